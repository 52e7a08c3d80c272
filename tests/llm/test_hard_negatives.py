import math
import random

import pytest

from watchloom.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>"


def plain(rows, positives=5, negatives=3, low=50, high=95):
    """All pairs, in Python's whole numbers."""
    use = []
    for mark, (v, label, x) in enumerate(rows):
        if label is None or x is None or any(e is None or not math.isfinite(e) or abs(e * 256) >= 1e150 for e in x):
            continue
        use.append((mark, v, label, [math.floor(e * 256) for e in x]))
    score = lambda a, b: sum(p * q for p, q in zip(a[3], b[3], strict=False))
    order = lambda a: lambda b: (-score(a, b), b[1] is None, b[1] or 0, b[0])
    clip = lambda n: min(max(n, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a in use:
        if a[1] is None or a[1] % 50:
            continue
        for p in sorted((b for b in use if b[2] == a[2] and b is not a), key=order(a))[:positives]:
            s = score(a, p)
            hard = sorted((b for b in use if b[2] != a[2] and low * s <= 100 * score(a, b) <= high * s), key=order(a))[:negatives]
            out += [(a[1], p[1], k + 1, n[1], clip(s), clip(score(a, n))) for k, n in enumerate(hard)]
    return sorted(out, key=repr)


def mined(spark, rows, **sizes):
    # one partition, so that the order of the table is that of the list
    return sorted((tuple(r) for r in H.mine(spark.createDataFrame(rows, SCHEMA).coalesce(1), **sizes).collect()), key=repr)


@pytest.mark.parametrize("sizes", ({}, {"tree_rows": 40, "block": 3}))
def test_clustered_against_all_pairs(spark, sizes):
    r = random.Random(5)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(k, r.choice((0, 1, 1, 1, 2, -3)), [x + r.gauss(0, 0.3) for x in r.choice(middles)]) for k in range(700)]
    got = mined(spark, rows, **sizes)
    assert got == plain(rows) and len(got) > 20


def test_nodes_are_left_out_and_nothing_is_lost():
    import numpy as np

    r = np.random.default_rng(3)
    q = np.floor(np.repeat(r.normal(0, 400, (30, 8)), 100, 0) + r.normal(0, 4, (3000, 8)))
    label = np.repeat(np.arange(3), 1000)
    order = H.tree_order(q, label)
    tree = H.Tree(q[order], label[order])
    seen, real = [], tree.scores
    tree.scores = lambda a, x, y: (seen.append((len(a), y - x)), real(a, x, y))[1]
    anchors, own = q[::100], np.array([int(np.flatnonzero(order == k)[0]) for k in range(0, 3000, 100)])
    score, row = H.search(tree, np.arange(3000), anchors, label[::100], own, None, 5)
    full = anchors @ tree.q.T
    full[(label[::100][:, None] != tree.label[None]) | (np.arange(3000)[None] == own[:, None])] = -(10**9)
    assert (np.sort(full, 1)[:, ::-1][:, :5] == score[:, 0]).all()
    assert sum(a * b for a, b in seen) < 0.2 * full.size  # most leaves are never compared
    near = score[:, 0, :1]
    windows = np.stack((near // 2, near * 95 // 100), -1).astype(np.int64)
    seen.clear()
    hard, _ = H.search(tree, np.arange(3000), anchors, label[::100], own, windows, 3)
    full = (anchors @ tree.q.T).astype(np.int64)
    for i in range(len(anchors)):
        may = sorted(s for s, x in zip(full[i], tree.label, strict=True) if x != label[100 * i] and windows[i, 0, 0] <= s <= windows[i, 0, 1])[::-1][:3]
        assert [s for s in hard[i, 0] if s != H.LEAST] == may
    assert sum(a * b for a, b in seen) < 0.6 * full.size


def test_ties_and_repeated_rows(spark):
    same = [0.5, 0.5]
    rows = [(k, k % 3, same if k % 2 else [0.5, 0.25]) for k in range(120)] + [(50, 2, same), (50, 2, same), (0, 0, same), (7, 1, [0.5, 0.4])]
    for sizes in ({}, {"tree_rows": 16, "block": 2}):
        assert mined(spark, rows, **sizes) == plain(rows)


def test_odd_rows(spark):
    x = [0.1, -0.2, 0.3]
    rows = [(0, 1, x), (1, None, x), (2, 1, None), (3, 1, [0.1, None, 0.3]), (4, 1, [float("nan"), 0.0, 0.0]), (5, 1, [float("inf"), 0.0, 0.0]), (None, 1, x), (None, 2, [0.09, -0.2, 0.2]),
            (6, 1, x), (8, 2, [0.1, -0.2]), (9, 2, [0.05, -0.1, 0.3, 9.0]), (10, 2, []), (50, 2, []), (100, 5, x)]
    got = mined(spark, rows)
    assert got == plain(rows) and any(r[1] is None for r in got) and any(r[3] is None for r in got)
    assert mined(spark, []) == []
    wide = [(0, 1, [3e40, 1.0]), (1, 1, [3e40, 0.0]), (2, 1, [1e20, 1.0]), (3, 2, [2e40, 5.0]), (4, 2, [2e40, 4.0]), (5, 2, [1.9e40, 4.0]), (6, 2, [9e19, 4.0]), (7, 1, [1e200, 0.0]), (8, 1, [-3e40, 0.0])]
    got = mined(spark, wide)
    assert got == plain(wide) and any(r[4] == (1 << 63) - 1 for r in got)


def test_clashing_names(spark):
    df = spark.createDataFrame([(k, k % 2, [1.0, k / 100]) for k in range(60)], SCHEMA).selectExpr("*", "1 as mark", "2 as tree", "3 as q", "'a' as score")
    assert H.mine(df).count() == len(plain([(k, k % 2, [1.0, k / 100]) for k in range(60)]))
