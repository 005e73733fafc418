"""Latency accounting of streaming queries: progress events become rows that the scoring operators take."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: As timings are elsewhere (event, seconds), with the query and batch that they come from.
ROWS = "query string, batch bigint, event string, seconds double, rows bigint"


def rows_of(progress: dict) -> list[tuple]:
    """One row for each phase that a progress event times; `triggerExecution` is the whole batch."""
    name = progress.get("name") or progress.get("id")
    return [(name, int(progress["batchId"]), phase, ms / 1000, int(progress.get("numInputRows", 0))) for phase, ms in sorted((progress.get("durationMs") or {}).items())]


class Latencies(StreamingQueryListener):
    """Writes each batch's phases as JSON lines into a folder of Spark's file systems, so that they outlive the query; add it with
    spark.streams.addListener()."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = rows_of(json.loads(event.progress.json))
        if found:
            self.spark.createDataFrame(found, ROWS).coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def latencies(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of all batches so far, for scoring.latency and scoring.penalty."""
    return spark.read.schema(ROWS).json(path)
