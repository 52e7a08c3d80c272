import random
import re

import pyarrow as pa
import pytest

from watchloom.llm import passages as P

SCHEMA = "doc_id long, text string"


def plain(rows, window=20):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone |= set(range(k, k + window))
            seen.add(w)
        out[i] = (rows[i][0], len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return sorted(out.values(), key=repr)


def cut(spark, rows, parts=1, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.coalesce(1) if parts == 1 else df.repartition(parts)
    return sorted((tuple(r) for r in P.without_repeated_passages(df, **sizes).collect()), key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé日") for _ in range(r.randint(1, 3)))
    passage = [[word() for _ in range(r.choice((19, 20, 21, 34, 80)))] for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [[word() for _ in range(r.choice((0, 1, 7, 40)))] if r.random() < 0.5 else list(r.choice(passage)) for _ in range(r.randint(0, 5))]
        words = [w for p in parts for w in p]
        if words and r.random() < 0.3:
            words[r.randrange(len(words))] = word()
        texts.append(r.choice((" ", "\n", " \t\r")).join(words) + r.choice(("", " ", "\n")))
    return texts


@pytest.mark.parametrize("sizes", ({}, {"common": 1, "group": 50}, {"common": 3, "group": 7}, {"window": 8, "run": 3, "group": 100}, {"window": 6, "run": 6}))
def test_against_windows_in_a_set(spark, sizes):
    rows = [(3 * k, t) for k, t in enumerate(corpus(len(repr(sizes))))]
    got = cut(spark, rows, parts=7, **sizes)
    assert got == plain(rows, sizes.get("window", 20)) and sum(r[2] for r in got) > 100


def test_loops_and_hot_passages(spark):
    passage = " ".join(f"w{k}" for k in range(45))
    rows = [(k, f"{k} {passage} {k}") for k in range(80)] + [(100, "la " * 500), (101, "la " * 30 + passage), (102, "a b c " * 200), (103, passage + " " + passage)] + [(k, passage) for k in range(200, 260)]
    for sizes in ({}, {"common": 5, "group": 40}):
        assert cut(spark, rows, parts=6, **sizes) == plain(rows)


def test_a_task_keeps_only_the_first_of_common_windows():
    passage = " ".join(f"w{k}" for k in range(30))
    texts = pa.array([passage] * 50)
    words, last = P.hashed(*next(P.pieces(texts))[1:])
    whose, place, _, most, least = P.anchors(words, last)
    told = pa.array([[{"place": int(p), "most": int(m), "least": int(n), "common": True} for w, p, m, n in zip(whose, place, most, least, strict=True) if w == k] for k in range(50)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), texts, told], ["row", "text", "suffixes"])
    out = pa.Table.from_batches(list(P._carry_words(3, 20, 6)(iter([batch] * 4)))).to_pylist()
    assert sum(len(x["row"]) // 8 for x in out if not x["gone"]) == 11  # the windows of the passage, once


def test_odd_rows(spark):
    long = " ".join(f"{k % 9973}x" for k in range(120_000))
    rows = [(None, None), (None, "b " * 25), (None, "b " * 25), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, long), (6, long[:5000]), (7, "y" * 300_000 + " z"), (7, "p q " * 12), (7, "p q " * 12), (8, "    " * 30)]
    assert cut(spark, rows) == plain(rows)
    assert cut(spark, []) == []


def test_hashing_in_parts(monkeypatch):
    texts = pa.array(["a bb  ccc", None, "", " dd\ta", "é" * 9000 + " bb"] * 3)
    whole = [P.hashed(d, e) for _, d, e in P.pieces(texts)]
    monkeypatch.setattr(P, "WORDS", 2)
    parts = [P.hashed(d, e) for _, d, e in P.pieces(texts)]
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole, parts, strict=True))
    words, ends = whole[0]
    assert list(ends[:5]) == [3, 3, 3, 5, 7] and words[1] == words[6] and words[0] == words[4] and len(set(words.tolist())) == 5
    small = [x for _, d, e in P.pieces(texts.slice(3, 7), 10) for x in P.hashed(d, e)[0]]
    assert small == words[3:14].tolist()


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a " * 30), (2, "a " * 30)], SCHEMA).selectExpr("*", "1 as row", "2 as place", "3 as gram", "4 as spans")
    assert sorted(tuple(r)[:3] for r in P.without_repeated_passages(df).collect()) == [(1, 30, 29), (2, 30, 30)]
