"""Exact percentiles of groups of any size, by selection.

A group of up to ``SMALL`` values is left to Spark's own percentile. In a larger one each wanted order
statistic is narrowed down: a pass counts the values between its bounds in ``CELLS`` cells and takes, of the cell that
holds its rank, the least and the greatest value as the next bounds, until the two are equal. What is shuffled are
counts, which each task adds up first; no buffer holds a group's values, and a pass divides the range by the number
of cells or better. Few groups are larger than ``SMALL``: their bounds are a table of at most rows / SMALL rows a percentile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.sources.files import scratch

SMALL = 1_000_000
CELLS = 4096


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "bounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: list[str], b: list[str]):
    on = F.lit(True)
    for x, y in zip(a, b, strict=True):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def percentiles(values: DataFrame, by: list[str], value: str, wanted: dict[str, float], small: int = SMALL, cells: int = CELLS) -> DataFrame:
    """(by, and a column for each of ``wanted``: name to fraction) with linear interpolation between order
    statistics, the same as ``percentile``; nulls and NaN don't count, a group without values has no row."""
    v = F.col(value).cast("double")
    rows = values.select(*by, v.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    own = lambda df: df.groupBy(*by).agg(*[F.percentile("v", q).alias(name) for name, q in wanted.items()])
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).filter(F.col("n") > small)
    large = _written(large)
    if large.isEmpty():
        return own(rows)
    keys = [f"k_{c}" for c in by]
    named = lambda df: df.withColumnsRenamed(dict(zip(by, keys, strict=True)))
    rest = own(rows.join(named(large.select(*by)), _same(by, keys), "left_anti"))

    ranks = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("rank")) for name, q in wanted.items()])
    each = large.withColumn("r", F.explode(ranks)).withColumn("end", F.explode(F.array(F.lit(0), F.lit(1))))
    place = F.when(F.col("end") == 0, F.floor("r.rank")).otherwise(F.ceil("r.rank"))
    found, open_ = [], _written(each.select(*by, F.col("r.name").alias("name"), F.col("r.rank").alias("rank"), "end", place.alias("k"), "low", "high", F.lit(0).cast("long").alias("below")))
    while True:
        found.append(open_.filter("low = high"))
        now = named(open_.filter("low < high"))
        if now.isEmpty():
            break
        met = rows.join(now, _same(by, keys) & F.col("v").between(F.col("low"), F.col("high")))
        cell = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * cells), F.lit(cells - 1))
        state = [*keys, "name", "rank", "end", "k", "below"]
        counted = met.groupBy(*state, cell.alias("cell")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("m").over(Window.partitionBy(*keys, "name", "end").orderBy("cell"))
        hit = counted.withColumn("upto", upto).filter((F.col("below") + F.col("upto") > F.col("k")) & (F.col("below") + F.col("upto") - F.col("m") <= F.col("k")))
        narrowed = hit.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "name", "rank", "end", "k", "low", "high", (F.col("below") + F.col("upto") - F.col("m")).alias("below"))
        open_ = _written(narrowed)
    ends = found[0]
    for f in found[1:]:
        ends = ends.unionAll(f)
    low, high = (F.max(F.when(F.col("end") == e, F.col("low"))) for e in (0, 1))
    part = F.max("rank") - F.floor(F.max("rank"))
    each = ends.groupBy(*by, "name").agg((low + (high - low) * part).alias("x"))
    told = each.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in wanted])
    return rest.unionByName(told)
