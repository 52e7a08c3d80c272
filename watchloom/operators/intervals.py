"""Joins of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levelled(df: DataFrame, p: str, start: str, end: str, bucket: float) -> DataFrame:
    """``df`` with ``p`` before its columns' names, and the level at which each interval is at home."""
    df = df.select(*[F.col(c).alias(p + c) for c in df.columns]).filter(F.col(p + start).isNotNull() & F.col(p + end).isNotNull())
    long_ = F.greatest(F.col(p + end) - F.col(p + start), F.lit(0)) / bucket
    return df.withColumn(p + "home", F.when(long_ > 1, F.ceil(F.log2(long_))).otherwise(0).cast("int"))


def listed(df: DataFrame, p: str, start: str, end: str, bucket: float, top: int, home: bool, visits: bool) -> DataFrame:
    """A row for each level, at home and above it, and cell there that an interval touches."""
    levels = F.sequence(F.col(p + "home"), F.lit(top)) if home and visits else F.array(F.col(p + "home")) if home else F.when(F.col(p + "home") < top, F.sequence(F.col(p + "home") + 1, F.lit(top)))
    df = df.withColumn(p + "level", F.explode(levels))
    width = F.lit(float(bucket)) * F.pow(F.lit(2.0), F.col(p + "level"))
    first, last = F.floor(F.col(p + start) / width), F.floor(F.col(p + end) / width)
    return df.withColumn(p + "first", first).withColumn(p + "cell", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, bucket: float, closed: bool = False) -> DataFrame:
    """Pairs of intervals of equal ``keys`` that overlap, half-open unless ``closed``.

    Cells have the width ``bucket`` at level 0, and twice that of the level below at each other. An interval is at
    home at the level whose cells are as long as itself, where it touches two at most, and visits the longer cells
    that it lies in, up to the level of the longest interval. Two intervals meet at the home of the longer one, in an equi-join on
    keys, level and cell, and are kept in their first common cell only. So an interval is a few rows a level, however long it is;
    a hot key is spread over its cells; and visitors never meet each other. Columns come out prefixed ``l_``
    and ``r_``; an interval without a start or an end meets none.
    """

    a, b = levelled(left, "l_", start, end, bucket), levelled(right, "r_", start, end, bucket)
    top = max([0, *(df.agg(F.max(p + "home")).first()[0] or 0 for df, p in ((a, "l_"), (b, "r_")))])

    of = lambda df, p, home, visits: listed(df, p, start, end, bucket, top, home, visits)
    meet = (F.col("l_" + start) <= F.col("r_" + end)) & (F.col("r_" + start) <= F.col("l_" + end)) if closed else (F.col("l_" + start) < F.col("r_" + end)) & (F.col("r_" + start) < F.col("l_" + end))
    for c in [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys] + [F.col("l_level") == F.col("r_level"), F.col("l_cell") == F.col("r_cell")]:
        meet = meet & c
    meet = meet & (F.col("l_cell") == F.greatest("l_first", "r_first"))
    own = [f"l_{c}" for c in left.columns] + [f"r_{c}" for c in right.columns]
    pairs = of(a, "l_", True, False).join(of(b, "r_", True, True), meet).select(*own)
    if top == 0:
        return pairs
    return pairs.unionAll(of(a, "l_", False, True).join(of(b, "r_", True, False), meet).select(*own))


def event_in_window_join(points: DataFrame, spans: DataFrame, key: str, t: str, before: float, after: float) -> DataFrame:
    """Each span (key, at) with the number of points within [at - before, at + after], and what it says:
    match, ambiguous or no_match; unavailable where the key has no points at all."""
    s = spans.select("*", (F.col("at") - before).alias("_a"), (F.col("at") + after).alias("_z"))
    width = before + after
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_z") / width))))
    p = points.select(F.col(key).alias("_k"), F.col(t).alias("_t"), F.floor(F.col(t) / width).alias("_pb"))
    hits = s.join(p, (s[key] == p["_k"]) & (s["_b"] == p["_pb"]) & F.col("_t").between(F.col("_a"), F.col("_z")), "left")
    counted = hits.groupBy(*spans.columns).agg(F.count("_t").alias("n"))
    known = points.select(F.col(key).alias("_k")).distinct()
    said = F.when(F.col("_k").isNull(), "unavailable").when(F.col("n") == 0, "no_match").when(F.col("n") == 1, "match").otherwise("ambiguous")
    return counted.join(known, counted[key] == known["_k"], "left").withColumn("status", said).drop("_k")
