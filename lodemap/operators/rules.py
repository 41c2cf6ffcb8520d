"""Client modules: cleaners of rows and checks of rules, run where the rows lie.

A module has cleaners (row in, row out) and checks (row in, messages out).  Checks run
as a table function in a lateral join, so each message is a row beside its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

Cleaner = Callable[[dict], dict]
Check = Callable[[dict], Iterable[str]]


@dataclass(frozen=True)
class Module:
    name: str
    cleaners: tuple[Cleaner, ...] = ()
    checks: tuple[Check, ...] = ()


class Modules:
    """Modules by name, in the order in which they came."""

    def __init__(self) -> None:
        self.held: dict[str, Module] = {}

    def register(self, module: Module) -> None:
        name = module.name.strip()
        if not name:
            raise ValueError("a module needs a name")
        if name in self.held:
            raise ValueError(f"a module is called {name!r} already")
        self.held[name] = module

    def cleaned(self, df: DataFrame) -> DataFrame:
        """Rows after all cleaners, one after the other; columns keep their names and types."""
        cleaners = [c for m in self.held.values() for c in m.cleaners]
        if not cleaners:
            return df
        columns = df.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
                for clean in cleaners:
                    rows = [clean(dict(r)) for r in rows]
                yield pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns)

        return df.mapInPandas(run, df.schema)

    def checked(self, df: DataFrame) -> DataFrame:
        """``df``'s columns, ``module`` and ``message``: a row for each message. A row without a message gives none."""
        checks = [(name, c) for name, m in self.held.items() for c in m.checks]

        @F.udtf(returnType="module string, message string")
        class Messages:
            def eval(self, row: Row) -> Iterator[tuple[str, str]]:
                values = row.asDict(recursive=True)
                for name, check in checks:
                    for message in check(dict(values)):
                        yield name, str(message)

        if not checks:
            return df.select("*", F.lit("").alias("module"), F.lit("").alias("message")).where(F.lit(False))
        rows = df.select("*", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
        return rows.lateralJoin(Messages(F.col("_row").outer())).drop("_row")


def within(column: str, low: float, high: float) -> Check:
    """A number outside its bounds."""

    def check(row: dict) -> Iterator[str]:
        x = row.get(column)
        if x is not None and not low <= x <= high:
            yield f"{column} is outside {low:g} to {high:g}"

    return check


def needed(column: str) -> Check:
    def check(row: dict) -> Iterator[str]:
        if row.get(column) is None or row[column] == "":
            yield f"{column} is missing"

    return check


def in_order(first: str, second: str) -> Check:
    """Two values the wrong way round."""

    def check(row: dict) -> Iterator[str]:
        a, b = row.get(first), row.get(second)
        if a is not None and b is not None and a > b:
            yield f"{first} is after {second}"

    return check
