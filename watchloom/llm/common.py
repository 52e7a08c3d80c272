"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators see it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none (a local test session), a temporary folder is made once per
    application; on a cluster that is an error, since executors would not see it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="watchloom-")
    return _FALLBACK[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files when the query ends, rather than when the driver's JVM collects its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Has Spark filter scans of any size by the other side of a join.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t"}


#: Narrow rows that a file of a table is planned for, where a bound on the table's rows is known.
FILE_ROWS = 50_000


def materialize(df: DataFrame, label: str, settings: dict[str, str] | None = None, most_rows: int | None = None) -> DataFrame:
    """Write ``df``, under ``settings`` of the session, to the shared folder and read it back: lineage ends
    here, and an executor that is lost later takes nothing with it. The shuffle files of the write go when it
    ends. Of at most ``most_rows`` narrow rows, a file has ``FILE_ROWS`` on average, so that small tables aren't as
    many files as a shuffle has partitions."""
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
    path = shared_path(spark, label)
    settings = {CLEANUP: "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def internal(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in have:
        name += "_"
    return name
