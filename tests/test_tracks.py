import random
import time

import pytest
from pyspark.sql import functions as F

from watchloom.operators import tracking
from watchloom.streaming import tracks

SCHEMA = "camera long, id long, t double, label string, box array<double>"


def some(seed, n=300):
    r = random.Random(seed)
    out = []
    for k in range(n):
        t = 7 + k // 6 * 0.5 + (20 if k > n // 2 else 0)
        out.append((r.choice((1, 2)), k, t, r.choice(("person", "bag")), [0.1 * r.randint(0, 4) + 0.01 * r.random(), 0.2, 0.2, 0.3]))
    return out


def reader(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def batch(spark, rows):
    return sorted(tuple(x) for x in tracking.track(spark.createDataFrame(rows, SCHEMA)).collect())


def close_of(rows):
    return [(None, None, max(x[2] for x in rows) + 100.0, None, None)]


@pytest.mark.parametrize("cut", ("frames", "anywhere"))
def test_stream_equals_batch_over_files_and_a_restart(spark, tmp_path, cut):
    rows = some(1)
    step = 60 if cut == "frames" else 43  # frames have six detections
    parts = [rows[k : k + step] for k in range(0, len(rows), step)]
    source, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: tracks.drained(spark, tracks.track_stream(reader(spark, source), "1 second"), sink, cp)
    for p in parts[:3]:
        put(spark, source, p)
    first = run().count()
    assert 0 < first < sum(map(len, parts[:3]))  # the last frames wait
    for p in parts[3:]:
        put(spark, source, p)
    put(spark, source, close_of(rows))
    got = sorted(tuple(x) for x in run().collect())  # the same checkpoint: the tracks go on
    assert got == batch(spark, rows)


def test_late_and_empty_detections(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, [(1, 1, 10.0, "person", [0.1, 0.1, 0.2, 0.2]), (1, 2, 11.0, "person", [0.1, 0.1, 0.2, 0.2])])
    put(spark, source, [(1, 3, 30.0, "bag", [0.5, 0.5, 0.1, 0.1])])
    put(spark, source, [(1, 4, 10.5, "person", [0.1, 0.1, 0.2, 0.2]), (1, 5, None, "bag", None), (1, 6, float("nan"), "bag", None)])
    put(spark, source, [(None, None, 99.0, None, None)])
    got = {x.id: x.track for x in tracks.drained(spark, tracks.track_stream(reader(spark, source)), str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    assert got.pop(4, None) is None and got == {1: "1:0", 2: "1:0", 3: "1:1"}


def test_cameras_do_not_share_tracks_and_silence_ends_them(spark, tmp_path):
    box = [0.1, 0.1, 0.2, 0.2]
    rows = [(1, 1, 0.5, "person", box), (2, 2, 0.5, "person", box), (1, 3, 5.0, "person", box), (1, 4, 10.5, "person", box), (2, 5, 10.5, "bag", box)]
    source = str(tmp_path / "in")
    put(spark, source, rows)
    put(spark, source, close_of(rows))
    got = sorted(tuple(x) for x in tracks.drained(spark, tracks.track_stream(reader(spark, source)), str(tmp_path / "out"), str(tmp_path / "cp")).collect())
    assert got == batch(spark, rows) == [(1, 1, "1:0"), (1, 3, "1:0"), (1, 4, "1:1"), (2, 2, "2:0"), (2, 5, "2:1")]


class State(dict):
    """A map or value of a key's state, and how often it was asked."""

    def __init__(self):
        self.asked = 0

    def _count(self, x=None):
        self.asked += 1
        return x

    def get(self):
        return self._count(super().get("value"))

    def update(self, value):
        self["value"] = self._count(value)

    def clear(self):
        self._count(super().clear())

    def getValue(self, k):
        return self._count(self[k])

    def updateValue(self, k, v):
        self[k] = self._count(v)

    def containsKey(self, k):
        return self._count(k in self)

    def removeKey(self, k):
        del self[self._count(k)]

    def keys(self):
        return self._count(list(super().keys()))

    def iterator(self):
        return self._count(list(super().items()))


class Handle:
    def __init__(self):
        self.states, self.timers = [], set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getMapState(self, *_):
        self.states.append(State())
        return self.states[-1]

    getValueState = getMapState


def test_a_camera_has_one_timer_and_few_questions_a_frame():
    import pandas as pd

    box, frames = [0.1, 0.1, 0.2, 0.2], 400
    rows = pd.DataFrame([(k, k // 3 * 0.5, ("bag", "person", "cup")[k % 3], box) for k in range(3 * frames)], columns=["id", "t", "label", "box"])
    handle, p = Handle(), tracks.CameraTracks()
    p.init(handle)
    at = lambda ms: type("At", (), {"getCurrentWatermarkInMs": lambda _: ms, "getExpiryTimeInMs": lambda _: min(handle.timers)})()
    out = [x for part in (rows[:600], rows[600:]) for x in p.handleInputRows((1,), iter([part]), at(0))]
    assert sum(map(len, out)) == 0 and len(handle.timers) == 1
    got = []
    for ms in (100_000, 10**9):  # half of the frames, then all; then the tracks are over
        while handle.timers and min(handle.timers) <= ms:
            now = at(ms)
            due = min(handle.timers)
            got += [x for d in p.handleExpiredTimer((1,), now, now) for x in d.itertuples(index=False)]
            handle.timers.discard(due)
        assert len(handle.timers) == (ms == 100_000)
    assert {(x.id, x.track) for x in got} == {(k, f"1:{k % 3}") for k in range(3 * frames)} and len(got) == 3 * frames
    assert sum(s.asked for s in handle.states) < 4 * frames


def plain_assignment(found, live):
    pairs = sorted((-tracking.overlap(a, b), tracking.distance(a, b), i, j) for i, a in enumerate(found) for j, b in enumerate(live) if tracking.overlap(a, b) >= tracking.IOU or tracking.distance(a, b) <= tracking.DISTANCE)
    out, used = [-1] * len(found), set()
    for _, _, i, j in pairs:
        if out[i] < 0 and j not in used:
            used.add(j)
            out[i] = j
    return out


@pytest.mark.parametrize("few,block,at_once", ((0, 1 << 20, 1 << 19), (0, 64, 8), (10**9, 1, 1)))
def test_assignment_is_the_greedy_one_whatever_the_blocks(monkeypatch, few, block, at_once):
    for name, n in (("FEW", few), ("BLOCK", block), ("AT_ONCE", at_once)):
        monkeypatch.setattr(tracking, name, n)
    r = random.Random(7)
    makes = (
        lambda: [r.random() / 2, r.random() / 2, 0.3, 0.3], lambda: [r.randrange(4) / 8, r.randrange(4) / 8, 0.1 + r.randrange(3) / 8, 0.25],
        lambda: [r.randrange(3) / 10, r.randrange(3) / 10, 0.25, 0.25], lambda: [r.randrange(9) / 50, r.randrange(9) / 50, 0.001, 0.001])
    for k in range(60):
        found, live = ([makes[k % 4]() for _ in range(r.randint(1, 40))] for _ in range(2))
        assert tracking.assign(tracking.as_boxes(found), tracking.as_boxes(live)).tolist() == plain_assignment(found, live)
    odd = [[0.1, None, 0.2, 0.2], None, [0.1, 0.1, 0.2, float("nan")], [0.1, 0.1, 0.2, 0.2]]
    assert tracking.assign(tracking.as_boxes(odd), tracking.as_boxes(odd[::-1])).tolist() == [-1, -1, -1, 0]


def test_many_alike_in_a_frame(spark):
    n = 4000  # in pairs that were more than a minute's work
    rows = [(1, f * n + k, float(f), "bag", [0.1 * (k % 3) + 0.01 * f, 0.2, 0.2, 0.3]) for f in range(4) for k in range(n)] + [(1, -1, 1.0, "bag", [None, 0.2, 0.2, 0.3]), (1, None, 9.0, None, None)]
    began = time.perf_counter()
    d = spark.createDataFrame(rows, SCHEMA)
    got = {x.id: x.track for x in tracking.track(d).collect()}
    assert len(got) == 4 * n + 2 and len(set(got.values())) == n + 2
    for f in range(1, 4):
        assert all(got[f * n + k] == got[k] for k in range(0, n, 97))
    summed = sorted((x.hits, x.label, x.first_seen, x.last_seen) for x in tracking.track_summary(d).collect())
    assert summed == [(1, "bag", 1.0, 1.0)] + [(4, "bag", 0.0, 3.0)] * n  # what has no id isn't counted
    assert time.perf_counter() - began < 40
