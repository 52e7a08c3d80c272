"""Clips, sliding windows, time buckets and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clips_of(t: Column, clip: float, stride: float) -> Column:
    """Numbers of the clips [k*stride, k*stride + clip) that hold second ``t``."""
    low = F.greatest(F.lit(0), F.floor((t - clip) / stride) + 1)
    high = F.floor(t / stride)
    return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>"))


def window_bounds(duration: Column, length: float, stride: float) -> Column:
    """Windows (start, end) of a segment: the first to reach the end is cut there and is the last;
    where strides leave a tail, a window over it closes the segment."""
    if length <= 0 or stride <= 0:
        raise ValueError("length and stride must be positive")
    count = F.greatest(F.ceil((duration - length) / stride), F.lit(0)) + 1  # up to the first that reaches the end
    starts = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)).cast("long") - 1), lambda k: k * F.lit(float(stride))), lambda s: s < duration)
    cut = F.transform(starts, lambda s: F.struct(F.round(s, 3).alias("start"), F.round(F.least(s + length, duration), 3).alias("end")))
    last = F.element_at(cut, -1)["end"]
    tail = F.array(F.struct(F.round(F.greatest(F.lit(0.0), duration - length), 3).alias("start"), F.round(duration, 3).alias("end")))
    none = F.filter(cut, lambda c: F.lit(False))
    return F.when(duration <= 0, none).when(last < F.round(duration, 3), F.concat(cut, tail)).otherwise(cut)


def new_windows(windows: Column, overlap: float, index: Column) -> Column:
    """Of a segment's windows, those that end after the overlap with the segment before."""
    skip = F.when(index > 0, F.lit(float(overlap))).otherwise(0.0)
    return F.filter(windows, lambda w: w["end"] > skip)


def sessions(df: DataFrame, key: str, t: str, gap: float, order: str) -> DataFrame:
    """``df`` with ``session``: the number of the run without a gap of more than ``gap`` seconds."""
    w = Window.partitionBy(key).orderBy(t, order)
    fresh = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def heatmap(points: DataFrame, by: str, width: Column, height: Column, cell: int = 40, least_cells: int = 8, least_points: int = 3) -> DataFrame:
    """(by, cx, cy, n): how many of each ``by``'s points (x, y) lie in each cell of its frame, whose size the aggregates
    ``width`` and ``height`` give. The frame has a cell for each ``cell`` of its size, ``least_cells`` at least; a point on
    its far edge is in the last. What has fewer than ``least_points`` is left out."""
    size = points.groupBy(F.col(by).alias("_by")).agg(width.cast("double").alias("w"), F.max(height).cast("double").alias("h"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_points).drop("n")
    p = points.join(size, F.col(by).eqNullSafe(F.col("_by")))
    place = lambda v, most: F.least(F.floor(F.col(v) / F.col(most) * _cells_of(most, cell, least_cells)), _cells_of(most, cell, least_cells) - 1)
    return p.groupBy(by, place("x", "w").alias("cx"), place("y", "h").alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def _cells_of(most: str, cell: int, least: int) -> Column:
    return F.greatest(F.lit(least).cast("long"), F.floor(F.floor(most) / cell))
