import hashlib
import random
import re

import pytest

from watchloom.llm import mixing as M


def water(sizes, weights, share, repeats):
    """Targets by sharing again and again what the full ones leave."""
    target, budget = {}, share * sum(sizes.values())
    open_ = dict(weights)
    while open_:
        level = (budget - sum(target.values())) / sum(open_.values())
        full = [s for s in open_ if level * open_[s] >= repeats * sizes[s] - 1e-9]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = repeats * sizes[s]
            del open_[s]
    return target


def plain(rows):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0d]+", t or "")), hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()) for d, t, s in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for _, x, n, _ in sized if x == s) for s in sources}
    target = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}, 1.5, 2)
    queue = []
    for s in sources:
        at = 0
        for r in range(2):
            for d, _, n, h in sorted((x for x in sized if x[1] == s), key=lambda x: x[3]):
                at += n
                if n and target[s] > 0:
                    queue.append((at / target[s], sources.index(s), h, d, n))
    taken, used = {}, 0
    for _, _, _, d, n in sorted(queue, key=lambda q: q[:3]):
        if used + n > 1.5 * sum(sizes.values()):
            break
        used += n
        taken[d] = taken.get(d, 0) + n
    return {d: (n, sizes[s], target[s], taken.get(d, 0)) for d, s, n, _ in sized}


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_against_plain(spark, seed):
    r = random.Random(seed)
    rows = [(k, None if k % 17 == 0 else " ".join("w" * r.randint(1, 3) for _ in range(r.choice((0, 1, 5, 40, 200)))), r.choice(("a", "a", "a", "B", "ü", "", None))) for k in range(300)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for x in got:
        n, size, target, taken = want[x.doc_id]
        assert (x.size, x.source_size, x.taken) == (n, size, taken) and x.target == pytest.approx(target, rel=1e-12)


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    got = M.mix(spark.createDataFrame([(None, None, None), (None, None, None)], schema).selectExpr("*", "1 as mark", "2 as size")).collect()
    assert [(x.size, x.source_size, x.target, x.taken) for x in got] == [(0, 0, 0.0, 0)] * 2
    same = M.mix(spark.createDataFrame([(1, "a b", "s")] * 4, schema)).collect()
    assert sum(x.taken for x in same) == 12 and max(x.taken for x in same) <= 4


def test_mixture_repeats_rows_as_often_as_taken(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 3}", "extra") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mark string")
    taken = {x.doc_id: x.taken // x.size for x in M.mix(df).collect()}
    got = {}
    for x in M.mixture(df).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + 1
    assert got == {d: n for d, n in taken.items() if n}


def test_very_long_text(spark):
    rows = [(1, "w " * 400_000, "a"), (2, "w " * 10, "a"), (3, "w " * 50_000, "b"), (4, None, "b"), (5, "w " * 7, None)]
    got = {x.doc_id: (x.size, x.source_size, x.taken) for x in M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = plain([(d, t, s) for d, t, s in rows])
    assert got == {d: (n, size, taken) for d, (n, size, _, taken) in want.items()}


def test_mixture_takes_rows_of_one_id_in_the_order_they_were_written(spark):
    rows = [(1, f"t{k} x", "s") for k in range(40)] + [(2, "y " * 60, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    runs = [sorted(x.text for x in M.mixture(df).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
