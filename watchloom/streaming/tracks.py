"""Tracking over a stream: a camera's live tracks as keyed state, frames in order of event time.

A camera's detections wait in state until the watermark has passed their time, so that files may bring a frame in parts
and out of order. A camera has one timer, for the first frame that waits; it works off all frames that are complete by
then, in order and one at a time, with the live tracks read and written once. Tracks are one state entry each, and a timer
after the last of them could still be met removes those that are over: a silent camera keeps the number of tracks
that it has had, the time of its last frame and the number of parts that have waited, and nothing else.

The result equals :func:`watchloom.operators.tracking.track` over the same detections, whatever files they came
in, as long as none is later than ``late``; one whose frame has been worked off already is given no track or, if
Spark finds it to be late, doesn't come out.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchloom.operators.tracking import MAX_AGE, Live, Tracker, as_boxes

#: State that grows with its keys is kept on disk, and only its changes are written.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TRACKED = "camera long, id long, track string"


def _after(t: float) -> int:
    """The first millisecond after a time in seconds."""
    return int(t * 1000 // 1) + 1


#: So many detections are put aside, or given out, at once.
PART = 20_000


class CameraTracks(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t double, part long", "found string")
        self.tracks = handle.getMapState("tracks", "id long", "label string, box string, last double")
        self.past = handle.getValueState("past", "tracks long, t double")
        self.parts = handle.getValueState("parts", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None) -> None:
        """The camera's timer, in the place of the one that it has."""
        old = self.timer.get()
        if old and old[0] != at:
            self.handle.deleteTimer(old[0])
            self.timer.clear()
        if at is not None and not (old and old[0] == at):
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past, (part,) = self.past.get(), self.parts.get() or (0,)
        held, n, first = {}, 0, None

        def put_aside() -> None:
            nonlocal part, n, first
            for t, found in held.items():
                self.waiting.updateValue((t, part), (json.dumps(found),))
            first = min(held, default=None) if first is None else min(first, *held)
            part, n = part + 1, 0
            held.clear()

        for frame in rows:
            missed = []
            for t, i, label, box in zip(frame["t"], frame["id"], frame["label"], frame["box"], strict=True):
                if past and t <= past[1]:
                    missed.append(int(i))
                else:
                    held.setdefault(float(t), []).append((int(i), label, None if box is None else [None if x is None else float(x) for x in box]))
                    n += 1
            if n >= PART:
                put_aside()
            yield self._out(key, missed, [None] * len(missed))
        if n:
            put_aside()
        if first is not None:
            self.parts.update((part,))
            old = self.timer.get()
            # a timer may also be for tracks that end
            self._wake(_after(first) if old is None else min(old[0], _after(first)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        keys = sorted(tuple(k) for k in self.waiting.keys())
        due = [k for k in keys if _after(k[0]) <= now]
        n, last = self.past.get() or (0, 0.0)
        tracker, had = Tracker(), {}
        tracker.count = n
        of: dict[str, list] = {}
        for (i,), (label, box, at) in self.tracks.iterator():
            had[i] = at
            of.setdefault(label, []).append((i, json.loads(box), at))
        for label, known in of.items():
            ids, boxes, at = zip(*sorted(known, key=lambda x: x[0]), strict=True)
            live = tracker.live[label] = Live()
            live.begin(0.0, as_boxes(boxes), np.array(ids))
            live.last[:] = at
        ids, names = [], []
        for t, own in itertools.groupby(due, key=lambda k: k[0]):
            own = list(own)
            found = sorted((tuple(d) for k in own for d in json.loads(self.waiting.getValue(k)[0])), key=lambda d: d[0])
            names += [f"{key[0]}:{k}" for k in tracker.frame(t, [(label, box) for _, label, box in found])]
            ids += [i for i, _, _ in found]
            for k in own:
                self.waiting.removeKey(k)
            last = t
            if len(ids) >= PART:
                yield self._out(key, ids, names)
                ids, names = [], []
        # what could no longer be met by a detection that isn't late
        ends = []
        for label, live in tracker.live.items():
            live.only(np.array([_after(x + MAX_AGE) > now for x in live.last], bool))
            for i, box, at in zip(live.ids.tolist(), live.boxes.tolist(), live.last.tolist(), strict=True):
                if had.pop(i, None) != at:
                    self.tracks.updateValue((i,), (label, json.dumps(box), at))
                ends.append(at)
        for i in had:
            self.tracks.removeKey((i,))
        self.past.update((tracker.count, last))
        self.timer.clear()
        if len(due) < len(keys):
            self._wake(_after(keys[len(due)][0]))
        elif ends:
            self._wake(_after(max(ends) + MAX_AGE))
        yield self._out(key, ids, names)

    def _out(self, key: tuple, ids: list, names: list) -> pd.DataFrame:
        return pd.DataFrame({"camera": pd.Series([key[0]] * len(ids), dtype="int64"), "id": pd.Series(ids, dtype="int64"), "track": pd.Series(names, dtype="object")})

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(camera, id, track) of a stream of detections (camera, id, t, label, box); those without a camera or a time
    only move the watermark on. A frame comes out when a later time has been seen from any camera."""
    d = detections.select(F.col("camera").cast("long").alias("camera"), F.col("id").cast("long").alias("id"), F.col("t").cast("double").alias("t"), "label", "box")
    d = d.withColumn("at", F.timestamp_micros((F.col("t") * 1000000).try_cast("long"))).withWatermark("at", late)
    # one condition that depends on the watermark's column, so that it isn't pushed below the watermark
    rows = d.filter("CASE WHEN at IS NOT NULL THEN camera IS NOT NULL AND id IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) ELSE false END")
    return rows.groupBy("camera").transformWithStateInPandas(CameraTracks(), outputStructType=TRACKED, outputMode="append", timeMode="eventTime")


def drained(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Works off what is there and gives what the sink then holds. The provider of the state is that of the
    session while the query starts; other queries keep theirs."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(TRACKED).parquet(sink)
