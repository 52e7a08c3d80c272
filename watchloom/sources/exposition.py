"""Scraped metrics: the text in which services tell their counters, gauges and histograms, as a long table.

A scrape is a file; a folder of them is read whole or as a stream, whose checkpoint keeps what has been read, so
that a restarted stream repeats nothing. Lines are taken apart by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sample's line: name, labels, value and, perhaps, milliseconds; and a label in it.
SAMPLE = r"^\s*([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(?:\{(.*)\})?\s+(\S+)(?:\s+(-?[0-9]+))?\s*$"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
COLUMNS = "metric string, labels map<string,string>, ts double, value double"


def number(text: Column) -> Column:
    """A value as written: a number, NaN or an infinity; null if it is none."""
    low = F.lower(text)
    infinite = F.when(low.isin("+inf", "inf", "+infinity", "infinity"), float("inf")).when(low.isin("-inf", "-infinity"), float("-inf"))
    return F.coalesce(infinite, F.when(low == "nan", float("nan")), F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), text.try_cast("double")))


def label_map(text: Column) -> Column:
    """The labels between the braces; of a name that comes twice, the last."""
    pattern = F.lit(LABEL)
    plain = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\\\", "\u0001"), r"\\n", "\n"), r'\\"', '"'), "\u0001", r"\\")
    names, values = F.regexp_extract_all(text, pattern, F.lit(1)), F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), plain)
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]))
    return F.map_from_entries(last)


def samples(lines: DataFrame, at: str = "scraped_at") -> DataFrame:
    """(metric, labels, ts, value) of lines (value, and the time of their scrape): comments, blank lines and lines that
    aren't samples are left out; a sample without a time of its own is of its scrape's."""
    part = lambda k: F.regexp_extract("value", SAMPLE, k)
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").rlike(SAMPLE))
    ts = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("double") / 1000, F.col(at))
    found = rows.select(part(1).alias("metric"), label_map(part(2)).alias("labels"), ts.alias("ts"), number(part(3)).alias("value"), part(3).alias("written"))
    return found.filter("value IS NOT NULL").drop("written")


def _scrapes(reader, folder: str) -> DataFrame:
    lines = reader.format("text").load(folder)
    return lines.select("value", (F.unix_micros(F.col("_metadata.file_modification_time")) / F.lit(1e6)).alias("scraped_at"))


def scrapes(spark: SparkSession, folder: str) -> DataFrame:
    return samples(_scrapes(spark.read, folder))


def scrape_stream(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    return samples(_scrapes(spark.readStream.option("maxFilesPerTrigger", per_batch), folder))
