"""Progress of streams as a table of events: one row for a start, each batch and an end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, name string, kind string, batch long, rows long, millis long, at string, message string"


class ProgressLog(StreamingQueryListener):
    """Gathers what streams report and writes it in one file for each that ends; ``read`` gives the table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.held: dict[str, list[tuple]] = {}
        self.names: dict[str, str | None] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        self._add(str(event.id), "started", None, None, None, event.timestamp, None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(str(p.id), "batch", p.batchId, p.numInputRows, p.batchDuration, p.timestamp, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        query = str(event.id)
        self._add(query, "failed" if event.exception else "done", None, None, None, None, event.exception)
        self.spark.createDataFrame(self.held.pop(query), SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.ended.append(query)

    def _add(self, query: str, kind: str, batch, rows, millis, at, message) -> None:
        self.held.setdefault(query, []).append((query, self.names.get(query), kind, batch, rows, millis, at, message))

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)
