"""Connected components by alternating large and small stars, on tables in the shared folder.

Each half step tells every node's neighbours the least node it knows; components shrink to stars
around their least node in a number of rounds that grows with the logarithm of their size. A round's tables are
deleted when the next one has read them. Joins meet written tables on both sides, so that a hub with many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import discard, materialize


def _least(pairs: DataFrame, rows: int) -> DataFrame:
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "w"), "stars-least", most_rows=rows)


def _large(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, 2 * rows)
    told = both.join(least, both["u"] == least["w"]).filter(F.col("v") > F.col("u"))
    out = materialize(told.select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct(), "stars", most_rows=rows)
    discard(least)
    return out


def _small(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, rows)
    told = down.join(least, down["u"] == least["w"])
    out = told.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.*")
    out = materialize(out.filter("u <> v").distinct(), "stars", most_rows=2 * rows)
    discard(least)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge up, or none and is a centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count_if(F.col("up") == 0).alias("down"))
    return per.filter("up > 1 OR (up > 0 AND down > 0)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (u, v); the component is its least node."""
    now = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    while True:
        rows = now.count()  # of the files' footers
        large = _large(now, rows)
        discard(now)
        now = _small(large, rows)
        discard(large)
        if _stars(now):
            break
    rows = 2 * now.count()
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = materialize(stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct()), "components", most_rows=rows)
    discard(now)
    return out
