"""The boundary to models: loaded once per task, run over batches, each with a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators.search import hash_vector


class Model:
    """What a model gives the engine. ``infer`` maps a batch of rows to a batch of rows."""

    schema: str = ""

    def load(self) -> None: ...

    def infer(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def unload(self) -> None: ...


def apply_model(rows: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """``rows`` through a model; filter and deduplicate before, since each row costs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        model.load()
        try:
            for b in batches:
                yield model.infer(b)
        finally:
            model.unload()

    return rows.mapInPandas(run, make().schema)


def stand_in_detections(windows: DataFrame) -> DataFrame:
    """A person and an item in each window (id, start), at fixed places and confidences."""
    found = F.array(
        F.struct(F.lit("person").alias("label"), F.lit(0.92).alias("confidence"), F.array(*map(F.lit, (0.4, 0.3, 0.2, 0.5))).alias("bbox")),
        F.struct(F.lit("item").alias("label"), F.lit(0.71).alias("confidence"), F.array(*map(F.lit, (0.5, 0.5, 0.1, 0.1))).alias("bbox")),
    )
    return windows.select("id", (F.col("start") + 0.5).alias("frame_time_sec"), F.inline(found))


def stand_in_verdicts(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.lit("unclear").alias("verdict"), F.lit(0.5).alias("confidence"))


def prompt(kind, camera, zones):
    """What a model is asked about an event."""
    return F.concat(F.lit("Event: "), kind, F.lit("\nCamera: "), camera, F.lit("\nZones: "), F.array_join(zones, ", "), F.lit("\nAnswer in JSON."))


class HashEmbedder(Model):
    """A text's vector from its digests, as a model: (id, vector) of rows (id, text)."""

    def __init__(self, dim: int):
        self.dim, self.schema, self.ready = dim, "id long, vector array<double>", False

    def load(self) -> None:
        self.ready = True

    def infer(self, rows: pd.DataFrame) -> pd.DataFrame:
        if not self.ready:
            raise RuntimeError("the model isn't loaded")
        return pd.DataFrame({"id": rows["id"], "vector": [hash_vector(x or "", self.dim) for x in rows["text"]]})

    def unload(self) -> None:
        self.ready = False
