"""What an analyst, or a program in their place, may ask of an approved workspace: tables, profiles, the guide, documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from . import profile, retrieve
from .fulltext import Index
from .retrieve import LEAST, MOST

#: Fixed value: hits of a search without a number.
HITS = 5


@dataclass
class Toolbox:
    """Answers as plain records. Profiles are made when they are first asked for, one Spark job a table, and kept."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    names: dict[str, str] = field(default_factory=dict)
    notes: dict | None = None
    index: Index | None = None
    within: Column | None = None
    _known: dict[str, dict] = field(default_factory=dict)

    def list_tables(self) -> dict:
        found = [{"name": n, "display_name": self.names.get(n, n), "row_count": self._facts(n)["row_count"], "columns": self.tables[n].columns} for n in sorted(self.tables)]
        return {"ok": bool(found), "table_count": len(found), "tables": found}

    def describe_table(self, table: str | None = None) -> dict:
        if table not in self.tables:
            error = "describe_table missing required field: table" if table is None else f"Unknown table: {table}"
            return {"ok": False, "error": error, "available_tables": sorted(self.tables)}
        facts = self._facts(table)
        return {"ok": True, "table": table, "display_name": self.names.get(table, table), "column_count": len(facts["columns"]), **facts}

    def read_guide(self) -> dict:
        """The notes on tables and columns, without questions to start with."""
        if self.notes is None:
            return {"ok": False, "guide": None, "available_tables": sorted(self.tables)}
        return {"ok": True, "guide": {k: v for k, v in self.notes.items() if k != "questions"}, "available_tables": sorted(self.tables)}

    def search_documents(self, question: str | None = None, top_n: object = None) -> dict:
        """The best chunks with citations; at least one and at most ten, five if the number is none."""
        if question is None:
            return {"ok": False, "error": "search_documents missing required field: question"}
        if not question.strip():
            return {"ok": False, "error": "question must not be empty"}
        if self.index is None:
            return {"ok": False, "error": "document search is not configured", "missing": ["index"]}
        hits = retrieve.hybrid(self.spark, self.index, question.strip(), number(top_n, HITS, LEAST, MOST), self.within).collect()
        found = [{k: v for k, v in r.asDict(recursive=True).items() if k != "n_terms"} for r in hits]
        return {"ok": True, "question": question.strip(), "result_count": len(found), "chunks": found, "has_low_confidence": any(r.get("low_confidence") for r in found)}

    def _facts(self, table: str) -> dict:
        if table not in self._known:
            rows = profile.profile({table: self.tables[table]}).collect()  # a row a column
            kinds = dict(self.tables[table].dtypes)
            columns = [{"name": r["col"], "dtype": kinds[r["col"]], **{k: v for k, v in r.asDict(recursive=True).items() if k not in ("tab", "col")}} for r in sorted(rows, key=lambda r: list(kinds).index(r["col"]))]
            self._known[table] = {"row_count": max((r["total"] for r in rows), default=0), "columns": columns}
        return self._known[table]


def number(given: object, default: int, least: int, most: int) -> int:
    """A whole number from an argument of any kind, brought between its bounds."""
    try:
        wanted = int(given) if not isinstance(given, bool) else default
    except (TypeError, ValueError):
        wanted = default
    return max(least, min(most, wanted))
