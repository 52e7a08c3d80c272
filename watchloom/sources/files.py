"""File sources and sinks: JSON lines, result documents, clip catalogues, reports, audit trails."""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.functions.text import redact_fields

#: Files of a results folder that aren't a camera's document.
NOT_RESULTS = ("summary.json", "fused.json", "economy.json")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the checkpoint folder, which executors share. A local session without one uses its warehouse; on a
    cluster that is an error, since the warehouse may be on the driver's own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def json_lines(spark: SparkSession, path: str, schema, tolerant: bool = True, limit: int | None = None) -> DataFrame:
    """A JSON-lines file or folder; blank lines are skipped, malformed ones dropped or an error."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    return rows.limit(limit) if limit else rows


def result_documents(spark: SparkSession, folder: str, schema) -> DataFrame:
    """One row per readable document of a folder, with ``file``."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.withColumn("file", F.url_decode(name)).filter(~F.col("file").isin(*NOT_RESULTS))


#: A file of more bytes is digested as a stream of its lines.
WHOLE = 64 << 20
BOM = b"\xef\xbb\xbf"
SPLIT = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


class _Digest:
    """SHA-256 of a file from its lines, each with a line end. The last of those may not be in the file, and the reader leaves out
    a mark of UTF-8 at its start; its size tells."""

    def __init__(self):
        self.plain, self.marked, self.n, self.last = hashlib.sha256(), hashlib.sha256(BOM), 0, b""

    def add(self, data: memoryview) -> None:
        self.n += len(data)
        for h in (self.plain, self.marked):
            h.update(self.last)
            h.update(data[:-1])
        self.last = bytes(data[-1:])

    def of(self, path: str, size: int) -> str:
        missing = size - self.n
        if missing not in (0, -1, len(BOM), len(BOM) - 1):
            raise ValueError(f"{path} has {size} bytes, of which {self.n} were read")
        h = self.plain if missing <= 0 else self.marked
        if missing in (0, len(BOM)):
            h.update(self.last)
        return h.hexdigest()


def _digest_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, sha256) of lines (file, size, line), which come file by file and in order."""
    now, digest = None, None
    done = lambda: pa.RecordBatch.from_pydict({"file": [now[0]], "sha256": [digest.of(*now)]})
    for batch in batches:
        if not batch.num_rows:
            continue
        name, size, line = (batch.column(c) for c in ("file", "size", "line"))
        offsets = np.frombuffer(line.buffers()[1], np.int64 if pa.types.is_large_binary(line.type) else np.int32)[line.offset : line.offset + len(line) + 1]
        data = memoryview(line.buffers()[2])
        one = name[0].as_py() == name[len(name) - 1].as_py()
        starts = [0] if one else [0, *(np.flatnonzero(pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()]
        for low, high in itertools.pairwise([*starts, len(line)]):
            own = (name[low].as_py(), size[low].as_py())
            if own != now:
                if now:
                    yield done()
                now, digest = own, _Digest()
            digest.add(data[offsets[low] : offsets[high]])
    if now:
        yield done()


def manifest(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, size, sha256) of all files under a folder. A file of up to WHOLE bytes is one row while it is digested. A larger
    one, which no row may hold, is one task: its lines, as they are, are added to its digest one batch after the other."""
    under = lambda kind: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    found = under("binaryFile").load(folder)
    size = F.col("length").alias("size")
    small = found.filter(F.col("length") <= WHOLE).select("path", size, F.sha2("content", 256).alias("sha256"))
    large = found.filter(F.col("length") > WHOLE).select("path", size, F.col("_metadata.file_path").alias("_file"))
    most = large.agg(F.max("size")).first()[0]
    if most is None:
        return small
    text = under("text").option("lineSep", "\n").load(folder).filter(F.col("_metadata.file_size") > WHOLE)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.concat("value", F.lit("\n")).cast("binary").alias("line"))
    path, before = scratch(spark, "digests"), [spark.conf.get(k) for k in SPLIT]
    try:
        for k in SPLIT:  # a file isn't split, and not dealt with another
            spark.conf.set(k, f"{most + 1}b")
        lines.mapInArrow(_digest_lines, "file string, sha256 string").write.parquet(path)
    finally:
        for k, v in zip(SPLIT, before, strict=True):
            spark.conf.set(k, v)
    digests = spark.read.schema("file string, sha256 string").parquet(path)
    return small.unionByName(large.join(digests, F.col("_file") == F.col("file")).select("path", "size", "sha256"))


def clip_catalogue(spark: SparkSession, folder: str, glob: str, clip_sec: float) -> DataFrame:
    """(path, size, sha256, index, start_sec) of a folder's clips in the order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    n = F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1
    return rows.withColumn("index", n).withColumn("start_sec", n * F.lit(float(clip_sec))).drop("folder")


def append_lines(rows: DataFrame, path: str, topic: str | None = None) -> None:
    """Append as JSON lines, a folder per topic (dots in its name become underscores)."""
    if topic:
        rows = rows.withColumn(topic, F.replace(topic, F.lit("."), F.lit("_")))
    writer = rows.write.mode("append")
    (writer.partitionBy(topic) if topic else writer).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON, replaced whole."""
    rows.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows (ts, action, actor, target, fields), secrets masked; nothing is ever rewritten."""
    rows.withColumn("fields", redact_fields(F.col("fields"))).write.mode("append").parquet(path)


def partitioned_events(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Events by day, so that a range of time reads its days only."""
    rows.withColumn("event_date", F.to_date(ts)).write.mode("append").partitionBy("event_date").parquet(path)
