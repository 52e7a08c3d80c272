import hashlib
import math
import random
import re
import zlib

import pytest

from watchloom.llm import resampling as R

SCHEMA = "doc_id long, text string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, runs):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return [" ".join(words[k : k + n]) for k in range(len(words)) for n in range(1, runs + 1) if k + n <= len(words)], len(words)


def plain(docs, target, runs=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(d, *features(t, runs)) for d, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, f, _ in each:
        for x in f:
            s[bucket(x)] += 1
    for _, text in target:
        for x in features(text, runs)[0]:
            t[bucket(x)] += 1
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, f, n in each:
        w = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = may[: len(may) * 10 // 100]
    rank = {}
    for k, x in enumerate(drawn):
        rank.setdefault(x[:4], []).append(k + 1)
    return sorted(((*x[:4], rank[x[:4]].pop() if rank.get(x[:4]) else None) for x in out), key=repr)


def drawn(spark, docs, target, **more):
    got = R.resample(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(target, SCHEMA), **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def some(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(("the", "The", "Öl", "öl", "a1", "x-y", "it's", "日本", "é", "zq")) + r.choice(("", "s", "k", "7"))
    return [(k, r.choice((" ", "\n", ", ")).join(word() for _ in range(r.choice((0, 1, 19, 20, 21, 60))))) for k in range(n)]


@pytest.mark.parametrize("runs, buckets", ((1, 10_000), (2, 10_000), (3, 97)))
def test_against_plain(spark, runs, buckets):
    docs, target = some(1, 400), some(2, 30)
    got = drawn(spark, docs, target, runs=runs, buckets=buckets)
    assert got == plain(docs, target, runs, buckets) and sum(r[4] is not None for r in got) > 10


def test_odd_rows(spark):
    long = "Wort " * 200_000
    docs = [(1, None), (2, ""), (3, "-- !!"), (None, "a " * 25), (None, None), (4, long), (5, "b " * 20), (5, "b " * 20), (5, "c d " * 20), (6, "ß" * 70_000)] + [(k, "w v u " * 7) for k in range(10, 60)]
    assert drawn(spark, docs, [(1, None), (2, "b c"), (None, "w")]) == plain(docs, [(1, None), (2, "b c"), (None, "w")])
    assert drawn(spark, docs, []) == plain(docs, [])
    assert drawn(spark, [], [(1, "a")]) == []
    assert all(r[4] is None for r in drawn(spark, [(1, "a b")], [(1, "a")]))


def test_repeated_rows_share_the_ranks(spark):
    docs = [(1, "a b " * 15)] * 300 + [(k, "c " * 30) for k in range(2, 40)]
    got = drawn(spark, docs, [(1, "a")])
    assert got == plain(docs, [(1, "a")])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, len(docs) * 10 // 100 + 1))


def test_only_totals_are_shuffled_and_scoring_has_no_explode(spark):
    docs = spark.createDataFrame(some(3, 50), SCHEMA).selectExpr("*", "1 as score", "2 as rank", "3 as mark", "4 as buckets")
    plan = R.scored(docs, [0] * R.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
    assert R.resample(docs, docs).count() == 50
