"""How well cameras see: light, sharpness, stillness and blackness of sampled frames as scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The luma under which a frame is black and up to which light counts, the sharpness that is
#: enough, the mean change under which a camera is frozen and up to which it counts.
BLACK, BRIGHT, SHARP, FROZEN, MOVING = 15.0, 40.0, 100.0, 0.5, 5.0


def health_scores(samples: DataFrame) -> DataFrame:
    """(camera, black_frame_score, blur_score, freeze_score, health_score) of sampled frames (camera, at,
    luma, sharpness). Motion is the mean change of luma from frame to frame; one frame alone tells nothing
    about it and counts half."""
    before = F.lag("luma").over(Window.partitionBy("camera").orderBy("at"))
    moved = samples.withColumn("moved", F.abs(F.col("luma") - before))
    return scores_of(moved, "camera")


def scores_of(measured: DataFrame, by: str) -> DataFrame:
    """The scores of measured frames (luma, sharpness, and moved since the one before)."""
    f = measured.groupBy(by).agg(
        F.avg("luma").alias("light"), F.avg((F.col("luma") < BLACK).cast("int")).alias("black"), (1 - F.least(F.lit(1.0), F.avg("sharpness") / SHARP)).alias("blur"),
        F.when(F.count(F.lit(1)) == 1, 0.5).when(F.avg("moved") < FROZEN, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.avg("moved") / MOVING)).alias("freeze"))
    health = F.least(F.lit(1.0), F.col("light") / BRIGHT) * (1 - F.col("blur")) * (1 - F.col("freeze")) * (1 - F.col("black"))
    scores = {"black_frame_score": F.col("black"), "blur_score": F.col("blur"), "freeze_score": F.col("freeze"), "health_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), health))}
    return f.select(by, *[F.round(c, 3).alias(n) for n, c in scores.items()])
