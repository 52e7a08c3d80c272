"""A store's cameras and zones as configured: what is wrong with them, what they cover, and where events are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.geometry import corner_centre


def event_point(x: Column, y: Column, norm_x: Column, norm_y: Column, bbox: Column) -> Column:
    """Where an event is: its own point, else its normalised one, else the middle of its box's corners; each only if it
    is whole."""
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")))
    middle = F.when(F.size(bbox) == 4, pair(*corner_centre(bbox)))
    return F.coalesce(pair(x, y), pair(norm_x, norm_y), middle)


def problems(zones: DataFrame, cameras: DataFrame) -> DataFrame:
    """(zone, problem) of zones (zone, camera, polygon) against the known ``cameras`` (camera): a camera that isn't
    known; too few corners; the first corner that isn't two numbers or lies outside the unit square."""
    known = cameras.select(F.col("camera").alias("known")).distinct()
    z = zones.join(known, F.col("camera") == F.col("known"), "left")
    malformed = lambda p: p.isNull() | (F.size(p) != 2) | F.exists(p, lambda v: v.isNull() | F.isnan(v))
    outside = lambda p: F.exists(p, lambda v: (v < 0) | (v > 1))
    bad = F.get(F.filter(F.col("polygon"), lambda p: malformed(p) | outside(p)), 0)
    some_bad = F.exists("polygon", lambda p: malformed(p) | outside(p))
    few = F.coalesce(F.size("polygon") < 3, F.lit(True)) | F.col("polygon").isNull()
    shape = F.when(few, "fewer than 3 corners").when(some_bad, F.when(malformed(bad), "malformed corner").otherwise("corner outside the frame"))
    camera = F.when(F.col("known").isNull(), "unknown camera")
    return z.select("zone", F.explode(F.array_compact(F.array(camera, shape))).alias("problem"))


def coverage(zones: DataFrame, cameras: DataFrame) -> DataFrame:
    """(what, name, n): how many cameras and zones there are, zones by type, and each camera without a zone."""
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("name"), "n")
    by_type = zones.groupBy(F.col("zone_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("what"), "name", "n")
    seen = zones.select(F.col("camera").alias("seen")).distinct()
    blind = cameras.join(seen, F.col("camera") == F.col("seen"), "left_anti").select(F.lit("blind").alias("what"), F.col("camera").cast("string").alias("name"), F.lit(1).cast("long").alias("n"))
    return count(cameras, "cameras").unionAll(count(zones, "zones")).unionAll(by_type).unionAll(blind)
