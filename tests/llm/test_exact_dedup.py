import hashlib
import random
import re

from watchloom.llm import exact_dedup as E


def digest(text):
    return hashlib.sha256(text.encode()).digest()


def test_filter_keeps_all_and_deletes(monkeypatch):
    f = E.CuckooFilter(64)
    held = [d for k in range(230) if f.insert(d := digest(str(k)))]
    assert len(held) > 200 and all(f.contains(d) for d in held)
    for d in held[:100]:
        assert f.delete(d)
    assert all(f.contains(d) for d in held[100:])


def test_overflow_resizes_from_the_stored_keys():
    s = E.Shard(E.CuckooFilter(2))
    for k in range(500):
        s.add(digest(str(k % 250)), (False, k, k), 1)
    assert s.resizes >= 5 and s.keys == 250
    assert {e.size for _, e in s.entries()} == {2} and sorted(e.best[1] for _, e in s.entries()) == list(range(250))
    assert s.remove(digest("3")) and not s.remove(digest("3")) and s.keys == 249


def test_against_plain(spark):
    r = random.Random(1)
    rows = [(k, r.choice(("a b", "a  b", "a\tb\n", "a b ", "", None, "x", "ü x", "ü\x0bx", " "))) for k in range(200)]
    got = {x.doc_id: x for x in E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    groups = {}
    for k, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(k)
    for norm, ids in groups.items():
        for k in ids:
            assert (got[k].keep_id, got[k].group_size, got[k].kept) == (min(ids), len(ids), k == min(ids))
            assert got[k].text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (None, "b"), (1, "x" * 300_000)]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as row"))
    by = {}
    for r in got.collect():
        by.setdefault(r.text_sha256, []).append(r)
    assert sorted((len(v), sum(x.kept for x in v)) for v in by.values()) == [(1, 1), (2, 1), (3, 1)]
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_takes_insertions_and_deletions(spark):
    df = lambda a, z: E.digests(spark.createDataFrame([(k, f"t{k}") for k in range(a, z)], "doc_id long, text string"))
    index = E.build_index(df(0, 50), 8)
    index = E.update_index(index, E.insertions(df(40, 80), 8))
    index = E.update_index(index, E.deletions(df(0, 10), 8))
    live = {r.keep_id: r.group_size for r in E.live(index).collect()}
    assert sorted(live) == list(range(10, 80)) and all(live[k] == (2 if 40 <= k < 50 else 1) for k in live)
