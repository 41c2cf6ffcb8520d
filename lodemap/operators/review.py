"""Approved schemas applied to raw tables, corrections of them, and previews."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import bare, cast_clean, clean_cell, dtype_of, scaled, votes

#: Corrections that change data, against those that only change names and notes.
STRUCTURAL = frozenset("set_dtype rename_column scale_column set_header_row add_column remove_column add_link edit_link remove_link".split())
MINOR = frozenset("set_friendly_name set_file_description set_column_description set_usage_note set_glossary_term set_starter_question".split())


def unique_names(names: list[str | None]) -> list[str]:
    """Header names: blank ones by position, repeated ones numbered from 2."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"column_{i + 1}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def header_names(raw: DataFrame, header_row: int) -> list[str]:
    """The names in a raw table's header row, which is one row."""
    cols = [c for c in raw.columns if c != "_row_id"]
    row = raw.where(F.col("_row_id") == header_row).select(*cols).first()
    return unique_names(list(row) if row else [None] * len(cols))


def apply_header(raw: DataFrame, header_row: int, columns: list[tuple[str, str, float | None]]) -> DataFrame:
    """Rows below the header, with (name, type, factor) for each column by position; rows without any cell go.

    ``_row_id`` stays, so order can be asked for later.  One aggregate votes on
    dates and decimal commas of all columns, then cells are cleaned, once, and cast.
    """
    cols = [c for c in raw.columns if c != "_row_id"]
    body = raw.where(F.col("_row_id") > header_row)
    asked = [c for c, (_, kind, _) in zip(cols, columns) if dtype_of(kind) in ("date", "datetime", "float", "int")]
    found = votes(body, asked) if asked else {}
    used = cols[: len(columns)]
    clean = body.select("_row_id", *[clean_cell(F.col(c)).alias(c) for c in used])
    clean = clean.select("*", *[bare(F.col(c)).alias(f"{c}|bare") for c, (_, kind, _) in zip(used, columns) if dtype_of(kind) in ("int", "float")])
    out, names = [], []
    for i, (name, kind, factor) in enumerate(columns):
        cell = F.col(cols[i]) if i < len(cols) else F.lit(None).cast("string")
        text = F.col(f"`{cols[i]}|bare`") if i < len(cols) and dtype_of(kind) in ("int", "float") else cell
        value = cast_clean(cell, text, kind, found.get(cols[i]) if i < len(cols) else None)
        if factor is not None:
            value = scaled(value if dtype_of(kind) in ("int", "float") else value.try_cast("double"), factor, dtype_of(kind) == "int")
        meta = {"category": True} if dtype_of(kind) == "category" else {}
        out.append(value.alias(f"v{i}"))
        names.append(F.col(f"v{i}").alias(name, metadata=meta))
    # a row of its own, so that the test of what it holds isn't moved before the casts, which would be done again for it
    kept = clean.select("_row_id", F.inline(F.array(F.struct(*out))))
    return kept.dropna("all", subset=[f"v{i}" for i in range(len(columns))]).select("_row_id", *names)


def preview(df: DataFrame, limit: int = 12) -> DataFrame:
    """The first rows in order; the order column itself isn't shown."""
    return df.orderBy("_row_id").limit(limit).drop("_row_id")


@dataclass(frozen=True)
class Spec:
    """An approved table: header row and (name, type, factor) of each column."""

    header_row: int
    columns: tuple[tuple[str, str, float | None], ...]
    links: tuple[dict, ...] = field(default=())


def is_structural(operation: dict) -> bool:
    """Known minor corrections are minor; all others need a confirmation."""
    return operation.get("op") not in MINOR


def corrected(spec: Spec, operation: dict) -> Spec:
    """A new spec with one structural correction; factors multiply, edited links replace the old ones."""
    op, name = operation["op"], operation.get("column")
    cols = list(spec.columns)
    at = next((i for i, c in enumerate(cols) if c[0] == name), None)
    if op in ("set_dtype", "rename_column", "scale_column", "remove_column") and at is None:
        raise KeyError(f"no column {name!r}")
    if op == "set_dtype":
        cols[at] = (cols[at][0], dtype_of(operation["dtype"]), cols[at][2])
    elif op == "rename_column":
        cols[at] = (operation["to"], *cols[at][1:])
    elif op == "scale_column":
        kind = cols[at][1] if dtype_of(cols[at][1]) in ("int", "float") else "float"
        cols[at] = (cols[at][0], kind, (cols[at][2] or 1.0) * operation["factor"])
    elif op == "remove_column":
        del cols[at]
    elif op == "add_column":
        cols.append((operation["column"], dtype_of(operation.get("dtype", "string")), None))
    elif op == "set_header_row":
        return replace(spec, header_row=operation["row"])
    elif op in ("add_link", "edit_link", "remove_link"):
        same = ("tab_a", "col_a", "tab_b", "col_b")
        old = operation.get("old", operation["link"])
        kept = [x for x in spec.links if any(x[k] != old[k] for k in same)]
        return replace(spec, links=tuple(kept if op == "remove_link" else [*kept, operation["link"]]))
    else:
        raise ValueError(f"unknown correction {op!r}")
    return replace(spec, columns=tuple(cols))
