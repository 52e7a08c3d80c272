"""What runs do, as metrics: rows, nulls and seconds of a query's stages, kept in a table like scraped metrics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "metric string, labels map<string,string>, ts double, value double"


def watched(df: DataFrame, name: str, columns: list[str] | None = None) -> tuple[DataFrame, Observation]:
    """``df``, which counts its rows and the nulls of its columns as it runs: no pass of its own."""
    columns = df.columns if columns is None else columns
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls.{c}") for c in columns]), seen


def append(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """A few rows (metric, labels, ts, value) added to the table."""
    if rows:
        spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(path)


def record(df: DataFrame, name: str, write: Callable[[DataFrame], None], path: str) -> None:
    """Runs ``write`` on ``df`` and adds what was seen to the table at ``path``; a run that fails is recorded as such, and
    fails."""
    observed, seen = watched(df, name)
    began, failed = time.time(), 1.0
    try:
        write(observed)
        failed = 0.0
    finally:
        now, labels = time.time(), {"query": name}
        rows = [("run_seconds", labels, now, now - began), ("run_failed", labels, now, failed)]
        if not failed:
            got = seen.get
            rows += [("run_rows", labels, now, float(got["rows"]))]
            rows += [("run_nulls", labels | {"column": k.removeprefix("nulls.")}, now, float(v)) for k, v in got.items() if k.startswith("nulls.")]
        append(df.sparkSession, rows, path)


class StreamLog(StreamingQueryListener):
    """Adds a row for each measure of each batch of the session's streams to the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p, now = event.progress, time.time()
        labels = {"query": p.name or str(p.id), "batch": str(p.batchId)}
        rows = [("stream_input_rows", labels, now, float(p.numInputRows)), ("stream_batch_seconds", labels, now, p.batchDuration / 1000)]
        rows += [("stream_step_seconds", labels | {"step": k}, now, v / 1000) for k, v in p.durationMs.items()]
        rows += [("stream_state_rows", labels | {"operator": str(k)}, now, float(s.numRowsTotal)) for k, s in enumerate(p.stateOperators)]
        append(self.spark, rows, self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
