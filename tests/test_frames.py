import random

import numpy as np
import pytest

import watchloom.plans.composed  # noqa: F401
from watchloom.operators import frames, quantiles

SCHEMA = "clip string, frame long, at double, pixels binary, width int, height int"


def grey(p, w, h):
    rgb = np.frombuffer(p[: 3 * w * h], np.uint8).reshape(h, w, 3).astype(np.float32)
    return rgb @ np.array([0.299, 0.587, 0.114], np.float32)


def some(seed, n=60):
    r = np.random.default_rng(seed)
    rows, image = [], r.integers(0, 256, 3 * 12 * 8)
    for k in range(n):
        image = image + r.integers(-9, 10, image.shape) if k % 5 else r.integers(0, 256, image.shape) if k % 2 else image * 0
        rows.append((f"c{k // 20}", k, round(k * 0.3, 3), bytes(np.clip(image, 0, 255).astype(np.uint8)), 12, 8))
    random.Random(1).shuffle(rows)
    return rows


def by_clip(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        out.setdefault(row[0], []).append(row)
    return out


def test_gate_against_plain(spark):
    rows = some(1)
    got = {(x.clip, x.frame): (x.changed, x.detect) for x in frames.gate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = {}
    for clip, own in by_clip(rows).items():
        slots, last = set(), None
        for _, frame, at, p, w, h in own:
            if int(at) in slots:
                continue
            slots.add(int(at))
            g = grey(p, w, h).astype(np.uint8).astype(int)
            changed = None if last is None else float((np.abs(g - last) > 25).mean())
            look = changed is None or changed >= 0.15
            last = g if look else last
            want[(clip, frame)] = (changed, look)
    assert got == want and {x[1] for x in want.values()} == {True, False}


def test_slow_drift_is_looked_at_in_the_end(spark):
    rows = [("c", k, float(k), bytes([min(255, 4 * k)] * 300), 10, 10) for k in range(30)]
    got = sorted((x.frame, x.detect) for x in frames.gate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [f for f, d in got if d] == [0, 7, 14, 21, 28]  # 28 steps of grey at a time; from frame to frame it is 4
    counts = frames.gate_counts(frames.gate(spark.createDataFrame(rows, SCHEMA))).first()
    assert (counts.sampled, counts.detected, counts.skipped) == (30, 5, 25)


def test_health_against_plain(spark):
    rows = some(2) + [("one", 0, 0.0, bytes([200] * 300), 10, 10), ("still", 0, 0.0, bytes([3] * 300), 10, 10), ("still", 1, 1.0, bytes([3] * 300), 10, 10)]
    got = {x.clip: x for x in frames.health(spark.createDataFrame(rows, SCHEMA)).collect()}
    for clip, own in by_clip(rows).items():
        images = [grey(p, w, h) for *_, p, w, h in own]
        lap = [(g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var() for g in images]
        black, blur = np.mean([g.mean() < 15 for g in images]), 1 - min(1.0, float(np.mean(lap)) / 100)
        moved = [np.abs(a - b).mean() for a, b in zip(images, images[1:], strict=False)]
        still = 0.5 if not moved else 1.0 if np.mean(moved) < 0.5 else max(0.0, 1 - np.mean(moved) / 5)
        health = max(0.0, min(1.0, min(1.0, np.mean([g.mean() for g in images]) / 40) * (1 - blur) * (1 - still) * (1 - black)))
        x = got[clip]
        assert (x.black_frame_score, x.blur_score, x.freeze_score, x.health_score) == pytest.approx((black, blur, still, health), abs=6e-4)
    assert got["still"].freeze_score == 1.0 and got["one"].freeze_score == 0.5


def test_odd_frames(spark):
    ok = bytes(range(27))
    rows = [("c", 0, 0.0, None, 3, 3), ("c", 1, 1.0, b"ab", 3, 3), ("c", 2, 2.0, ok + b"more", 3, 3), ("c", 3, 3.0, ok, 1, 1), ("c", 4, None, ok, 3, 3), ("c", 5, 5.0, ok, None, 3), ("c", 6, 6.0, ok, 0, 3), (None, 7, 0.0, ok, 3, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.frame: x.detect for x in frames.gate(df).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 5: False, 6: False, 7: True}
    m = {x.frame: (x.luma is None, x.moved is None) for x in frames.measures(df).collect()}
    assert m[0] == m[1] == m[5] == (True, True) and m[2] == (False, False) and m[3] == (False, True)
    assert frames.health(df.filter("frame < 2")).count() == 0 and frames.gate(df.filter("false")).count() == 0


@pytest.mark.parametrize("small, cells", ((0, 4), (0, 4096), (30, 7)))
def test_percentiles_by_selection(spark, small, cells):
    r = random.Random(cells)
    rows = [(g, v) for g, n in (("a", 200), ("b", 25), ("c", 1), (None, 60)) for v in (r.choice((r.gauss(0, 1), -0.0, 5.0, r.random() * 1e300, -1e-300 * r.random())) for _ in range(n))]
    rows += [("a", None), ("a", float("nan")), ("d", None)] + [("e", 2.5)] * 70
    got = {x.g: (x.p50, x.p95, x.all, x.none) for x in quantiles.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95, "all": 1.0, "none": 0.0}, small, cells).collect()}
    assert set(got) == {"a", "b", "c", "e", None}
    for g, x in got.items():
        own = np.array([v for k, v in rows if k == g and v is not None and v == v])
        assert x == pytest.approx([np.quantile(own, q) for q in (0.5, 0.95, 1.0, 0.0)], rel=1e-12)


def test_frames_of_documents_against_plain(spark):
    import pyarrow.parquet as pq

    from watchloom.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {(x.clip, x.frame): x.detect for x in QUERIES["frames_gate"](spark, folder).collect()}
    size, want = 3 * 16 * 9, {}
    for doc in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        data, last, slots = (doc["text"] or "").encode(), None, set()
        for frame in range(max(1, -(-len(data) // size))):
            if int(frame * 0.4) in slots:
                continue
            slots.add(int(frame * 0.4))
            part, look = data[frame * size : (frame + 1) * size], False
            if len(part) == size:
                g = grey(part, 16, 9).astype(np.uint8).astype(int)
                look = last is None or float((np.abs(g - last) > 25).mean()) >= 0.15
                last = g if look else last
            want[(str(doc["doc_id"]), frame)] = look
    assert got == want and len(want) > 300
    assert QUERIES["frames_health"](spark, folder).count() > 50
