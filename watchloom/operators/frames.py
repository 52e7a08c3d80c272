"""Frames as pixels: sampling, the motion gate, and how well a camera sees.

A frame is a row (clip, frame, at, pixels, width, height) whose pixels are bytes, three a pixel from the top left. A clip's frames are
sorted within a partition by Spark and read in Arrow batches; between frames a task keeps one luma image of one clip, so a
clip of any length costs the memory of one frame.

Defined results: a frame without pixels, or with fewer bytes than its size asks for, can't be decoded: it is never looked at, has
no measures and isn't one of the samples that health is judged by; bytes beyond the size are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators.health import scores_of

#: The weights of red, green and blue; how much a pixel's grey must change, and the share of pixels
#: that must, for a frame to be looked at; samples a second.
LUMA = (0.299, 0.587, 0.114)
PIXEL_DELTA, LEAST_CHANGED, SAMPLE_FPS = 25, 0.15, 1.0


def luma(pixels: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    """The grey values of a frame, as (height, width)."""
    if pixels is None or not width or not height or width < 0 or height < 0 or len(pixels) < 3 * width * height:
        return None
    rgb = np.frombuffer(pixels, np.uint8, 3 * width * height).reshape(height, width, 3)
    return rgb.astype(np.float32) @ np.array(LUMA, np.float32)


def sharpness(grey: np.ndarray) -> float:
    """The variance of the differences of each inner pixel with its four neighbours; 0 without an inner one."""
    if min(grey.shape) < 3:
        return 0.0
    inner = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
    return float(inner.var())


def changed_fraction(a: np.ndarray, b: np.ndarray, delta: int = PIXEL_DELTA) -> float:
    """The share of pixels whose grey, in whole steps, differs by more than ``delta``; all of them between sizes."""
    if a.shape != b.shape:
        return 1.0
    return float((np.abs(a.astype(np.uint8).astype(np.int16) - b.astype(np.uint8).astype(np.int16)) > delta).mean())


def _in_order(frames: DataFrame, start: Callable, schema: str) -> DataFrame:
    """Frames of each clip in order of time, given to what ``start`` makes anew for each clip: a function of (at, grey)
    that gives a tuple of the columns of ``schema`` beyond clip, frame and at."""
    kinds = {f.name: f.dataType for f in frames.sparkSession.createDataFrame([], schema).schema.fields}
    arrow = {n: {"double": pa.float64(), "boolean": pa.bool_()}[k.simpleString()] for n, k in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, step = None, None
        for batch in batches:
            c = {n: batch.column(batch.schema.names.index(n)) for n in ("clip", "frame", "at", "pixels", "width", "height")}
            out = []
            for k in range(len(batch)):
                now = c["clip"][k].as_py()
                if step is None or now != clip:
                    clip, step = now, start()
                out.append(step(c["at"][k].as_py(), luma(c["pixels"][k].as_py(), c["width"][k].as_py(), c["height"][k].as_py())))
            made = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([c["clip"], c["frame"], c["at"], *[pa.array(m, t) for m, t in zip(made, arrow.values(), strict=True)]], ["clip", "frame", "at", *arrow])

    f = frames.select(F.col("clip").cast("string").alias("clip"), F.col("frame").cast("long").alias("frame"), F.col("at").cast("double").alias("at"), "pixels", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    return f.repartition("clip").sortWithinPartitions("clip", "at", "frame").mapInArrow(run, f"clip string, frame long, at double, {schema}")


def sampled(frames: DataFrame, fps: float = SAMPLE_FPS) -> DataFrame:
    """The first frame of each clip's ``1 / fps`` seconds: one aggregate without the pixels, and a join that fetches those."""
    firsts = frames.filter("at IS NOT NULL").groupBy("clip", F.floor(F.col("at") * fps).alias("slot")).agg(F.min(F.struct("at", "frame")).alias("first")).select(F.col("clip").alias("c"), F.col("first.frame").alias("f"))
    return frames.join(firsts, F.col("clip").eqNullSafe(F.col("c")) & (F.col("frame") == F.col("f")), "left_semi")


def gate(frames: DataFrame, least: float = LEAST_CHANGED, fps: float = SAMPLE_FPS, delta: int = PIXEL_DELTA) -> DataFrame:
    """(clip, frame, at, changed, detect) of the sampled frames: one is looked at if enough of it has changed since the last
    one that was, so that slow drift adds up; a clip's first always is."""

    def start() -> Callable:
        last: list[np.ndarray] = []

        def step(at: float, grey: np.ndarray | None) -> tuple:
            if grey is None:
                return None, False
            changed = changed_fraction(last[0], grey, delta) if last else None
            look = changed is None or changed >= least
            if look:
                last[:] = [grey]
            return changed, look

        return step

    return _in_order(sampled(frames, fps), start, "changed double, detect boolean")


def gate_counts(gated: DataFrame) -> DataFrame:
    """(clip, sampled, detected, skipped)."""
    looked = F.count_if("detect")
    return gated.groupBy("clip").agg(F.count(F.lit(1)).alias("sampled"), looked.alias("detected"), (F.count(F.lit(1)) - looked).alias("skipped"))


def measures(frames: DataFrame) -> DataFrame:
    """(clip, frame, at, luma, sharpness, moved): the mean grey, how sharp, and the mean change of grey since the
    clip's frame before."""

    def start() -> Callable:
        last: list[np.ndarray] = []

        def step(at: float, grey: np.ndarray | None) -> tuple:
            if grey is None:
                return None, None, None
            moved = float(np.abs(grey - last[0]).mean()) if last and last[0].shape == grey.shape else None
            last[:] = [grey]
            return float(grey.mean()), sharpness(grey), moved

        return step

    return _in_order(frames, start, "luma double, sharpness double, moved double")


def health(frames: DataFrame) -> DataFrame:
    """(clip, black_frame_score, blur_score, freeze_score, health_score) from the frames' pixels."""
    return scores_of(measures(frames).filter("luma IS NOT NULL"), "clip")
