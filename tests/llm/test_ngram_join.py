import random
import re
from collections import defaultdict

import numpy as np
import pytest

from watchloom.llm import ngram_join as N

WORDS = [f"w{k}" for k in range(400)]


def brute(rows):
    """doc -> (class, links, kept) by comparing all pairs of n-gram sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = defaultdict(list)
    for i in range(n):
        groups[top(i)].append(i)
    out = []
    for g in groups.values():
        first = min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
        out += [(rows[i][0], rows[first][0], links[i]) for i in g]
    return sorted(out, key=repr), len(groups)


def corpus(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split(" ")
            for _ in range(r.choice((0, 0, 1, 1, 2, 4, 9))):
                if w:
                    w[r.randrange(len(w))] = r.choice(WORDS)
        else:
            w = r.choices(WORDS, k=r.choice((0, 1, 3, 4, 5, 60, 120, 300)))
        rows.append((i, " ".join(w)))
    return rows


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = N.near_duplicates(df).select("doc.doc_id", "class_id", "n_links", "kept").collect()
    want, classes = brute(rows)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=repr) == want
    assert sum(r.kept for r in out) == classes


def test_against_brute_force(spark):
    compare(spark, corpus(1))


def test_large_group_needs_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    compare(spark, corpus(5, 90))


def test_odd_rows(spark):
    text = " ".join(WORDS[:40])
    rows = [(1, None), (2, None), (3, ""), (4, "  \n"), (5, text), (5, text), (None, text), (None, text), (6, "a b"), (7, "a  b"), (8, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as row", "3 as component")
    out = N.near_duplicates(df)
    got = out.select("doc.*", "class_id", "n_links", "kept").collect()
    assert len(got) == len(rows)
    five = [r for r in got if r.text == text]
    assert {r.class_id for r in five} == {5} and [r.n_links for r in five] == [3] * 4 and sum(r.kept for r in five) == 1
    assert sorted(r.doc_id for r in got if r.kept and r.text != text) == [1, 2, 3, 4, 6, 8]


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("recall", (0.9, 0.99, 0.999))
def test_banding_meets_recall(recall):
    bands, rows = N.banding(0.8, recall)
    assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= N.MOST_HASHES


def test_long_text():
    text = " ".join(random.Random(3).choices(WORDS, k=60_000))
    assert len(N.ngrams(text)) > 59_000
    assert (np.diff(N.ngrams(text).astype(object)) > 0).all()


def test_very_long_texts_meet(spark):
    long = [f"{k % 7001}w{k % 13}" for k in range(60_000)]
    near = long[:30_000] + ["other"] + long[30_001:]
    compare(spark, [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:20_000])), (4, "z" * 500_000), (5, "short text of a few words")])
