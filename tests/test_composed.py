import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.operators import intervals, matching, requests, search
from watchloom.plans.registry import QUERIES

SPANS = "clip string, id long, start double, end double, zones array<string>"
FOLDER = "/root/testdata/sf0.001"


def best_total(value):
    """The most pairs and then the most overlap, by trying all."""
    n, m = value.shape
    best = (0, 0.0)
    for columns in itertools.permutations([*range(m), *[None] * n], n):
        pairs = [(r, c) for r, c in enumerate(columns) if c is not None and value[r, c] > 0]
        best = max(best, (len(pairs), sum(value[r, c] for r, c in pairs)))
    return best


def test_assignment_against_all_permutations():
    r = random.Random(2)
    for _ in range(150):
        n, m = r.randint(1, 4), r.randint(1, 4)
        value = np.array([[r.random() if r.random() < 0.5 else 0.0 for _ in range(m)] for _ in range(n)])
        pairs = matching.assignment(value)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        count, total = best_total(value)
        assert len(pairs) == count and sum(value[i, j] for i, j in pairs) == pytest.approx(total)


def overlap(a, b):
    """Of two spans that can match, else 0."""
    shared = min(a[3], b[3]) - max(a[2], b[2])
    if a[0] != b[0] or shared <= 0 or not (set(a[4] or ()) & set(b[4] or ()) or not a[4] and not b[4]):
        return 0.0
    return shared / (max(a[3], b[3]) - min(a[2], b[2]))


def test_matching_against_brute_force(spark):
    r = random.Random(8)

    def some(n, first):
        out = []
        for k in range(n):
            a = r.choice((0, 30, 60)) + r.randint(0, 8)
            out.append((r.choice("xyz"), first + k, float(a), float(a + r.randint(1, 7)), r.sample(["p", "q"], r.randint(0, 2))))
        return out

    expected, predicted = some(24, 0), some(24, 100)
    got = matching.match_spans(spark.createDataFrame(expected, SPANS), spark.createDataFrame(predicted, SPANS), ["clip"]).collect()
    by_id = {x[1]: x for x in expected + predicted}
    assert len({x.expected_id for x in got}) == len({x.predicted_id for x in got}) == len(got)
    assert all(x.overlap == pytest.approx(overlap(by_id[x.expected_id], by_id[x.predicted_id])) for x in got)
    most = 0.0
    for clip, base in itertools.product("xyz", (0, 30, 60)):  # no span reaches from one of these to another
        e = [x for x in expected if x[0] == clip and base <= x[2] < base + 20]
        p = [x for x in predicted if x[0] == clip and base <= x[2] < base + 20]
        value = np.array([[overlap(a, b) for b in p] for a in e]).reshape(len(e), len(p))
        if value.size:
            mine = [x for x in got if by_id[x.expected_id] in e]
            count, total = best_total(value if len(e) <= len(p) else value.T)
            assert len(mine) == count and sum(x.overlap for x in mine) == pytest.approx(total)
            most += count
    assert most > 10


def test_odd_spans_match_nothing(spark):
    e = spark.createDataFrame([("a", 1, 0.0, 5.0, None), ("a", 2, 5.0, 5.0, ["z"]), (None, 3, 0.0, 5.0, ["z"]), ("a", 4, None, 5.0, ["z"])], SPANS)
    p = spark.createDataFrame([("a", 11, 1.0, 5.0, []), (None, 12, 0.0, 5.0, ["z"]), ("a", 13, 5.0, 9.0, None)], SPANS)
    got = matching.match_spans(e, p, ["clip"])
    assert [(x.expected_id, x.predicted_id) for x in got.collect()] == [(1, 11)]
    said = {x.clip: x for x in matching.precision_recall(e, p, got, "clip").collect()}
    assert said["a"].precision == 0.5 and said["a"].recall == pytest.approx(1 / 3)
    none = e.filter("false")
    assert matching.match_spans(none, none, ["clip"]).count() == 0


@pytest.mark.parametrize("closed", (False, True))
def test_long_and_short_intervals(spark, closed):
    r = random.Random(3)
    rows = lambda n: [(r.choice("ab"), k, a, a + r.choice((0.0, 1.0, 9.0, 10.0, 500.0, 3.2e7))) for k, a in ((k, float(r.randint(-3000, 3000))) for k in range(n))]
    x, y = rows(90) + [("a", 900, None, 1.0), ("b", 901, 3.0, None)], rows(80)
    schema = "key string, id long, s double, e double"
    got = sorted((p.l_id, p.r_id) for p in intervals.overlap_join(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), ["key"], "s", "e", 10.0, closed).collect())
    meet = (lambda a, b: a[2] <= b[3] and b[2] <= a[3]) if closed else (lambda a, b: a[2] < b[3] and b[2] < a[3])
    assert got == sorted((a[1], b[1]) for a in x for b in y if a[0] == b[0] and None not in a and meet(a, b)) and len(got) > 500


def test_a_year_is_tens_of_rows(spark):
    a = spark.createDataFrame([("k", 1, 0.0, 3.2e7)], "key string, id long, s double, e double")
    b = spark.createDataFrame([("k", 2, 5.0, 6.0)], "key string, id long, s double, e double")
    assert intervals.overlap_join(a, b, ["key"], "s", "e", 10.0).count() == 1
    listed = intervals.listed(intervals.levelled(b, "", "s", "e", 10.0), "", "s", "e", 10.0, 22, True, True)
    assert listed.count() == 23 and intervals.listed(intervals.levelled(a, "", "s", "e", 10.0), "", "s", "e", 10.0, 22, True, True).count() <= 2
    short = intervals.overlap_join(b, b, ["key"], "s", "e", 10.0)
    assert "Union" not in short._jdf.queryExecution().analyzed().toString() and short.count() == 1


def test_search_for_many_equals_one_by_one(spark):
    r = random.Random(6)
    vec = lambda: [r.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(8)]
    kinds = ("camera_health_issue", "possible_loss", "suspicious_item_interaction", "other")
    events = [(k, r.choice(kinds), r.choice((None, 10.0, float(k)))) for k in range(300)]
    items = [(k, r.choice(("a bottle near the shelf", "camera black", None, "")), vec() if k % 11 else None) for k in range(200, 500)] + [(900, "x", [1.0]), (901, "x", [None] * 8), (902, "zero", [0.0] * 8)]
    asked = [(1, "camera black or blind", vec()), (2, "nothing of that kind", vec()), (3, "who left with the bottle and walked away", vec()), (4, None, None), (5, "who took a bottle", [0.0] * 8)]
    got = requests.search_many(
        spark.createDataFrame(asked, "request long, text string, vector array<double>"), spark.createDataFrame(events, "id long, kind string, at double"),
        spark.createDataFrame(items, "id long, text string, vector array<double>"), k=7, most_events=40)
    got = {(x.request, x.rank): x for x in got.collect()}
    parsed = {x.request: x for x in spark.createDataFrame(asked, "request long, text string, vector array<double>").select("request", search.request_columns(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    import re

    words = lambda s: set(re.findall("[a-z]{3,}", (s or "").lower()))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or np.inf)
    for q, text, vector in asked:
        want_kinds = parsed[q].p.kinds
        meta = sorted((e for e in events if not want_kinds or e[1] in want_kinds), key=lambda e: (e[2] is None, -(e[2] or 0), e[0]))[:40]
        near = []
        if vector:
            near = [(i, t, round(max(0.0, float(unit(vector) @ unit(v))), 9)) for i, t, v in items if v and len(v) == 8 and None not in v]
            near = sorted(near, key=lambda x: (-x[2], x[0]))[:50]
        c = {i: [0.0, k, at, ""] for i, k, at in meta}
        for i, t, s in near:
            old = c.get(i, [0.0, None, None, ""])
            c[i] = [max(s, old[0]), old[1], old[2], t or ""]
        times = [x[2] for x in c.values() if x[2] is not None]
        low, span = (min(times), max(times) - min(times) or 1.0) if times else (0, 1.0)
        out = []
        for i, (s, k, at, t) in c.items():
            hit, late, shared = k is not None and k in want_kinds, (at - low) / span if at is not None else 0.0, len(words(text) & words(t))
            out.append((-round(round(0.7 * s + 0.2 * hit + 0.1 * late, 6) + 0.05 * shared, 6), i, k, hit, shared))
        out.sort(key=lambda x: x[:2])
        for rank, (s, i, k, hit, shared) in enumerate(out[:7], 1):
            x = got.pop((q, rank))
            assert (x.id, x.kind) == (i, k) and x.score == pytest.approx(-s, abs=2e-6)
            assert ("∈query" in x.why) == hit and ("critic:+" in x.why) == bool(shared)
    assert not got


def test_blocks_and_tiles_do_not_matter(spark):
    r = random.Random(1)
    rows = [(k, [float(r.randint(-2, 2)) for _ in range(4)]) for k in range(120)]
    v, q = spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(rows[:30], "request long, vector array<double>")
    one = sorted(tuple(x) for x in requests.nearest_to_each(q, v, 5).collect())
    assert one == sorted(tuple(x) for x in requests.nearest_to_each(q, v, 5, tile=17, block=4).collect()) and len(one) == 150
    assert requests.nearest_to_each(q.filter("false"), v, 5).count() == 0


def test_stream_of_tracks_equals_the_batch(spark):
    got = sorted(tuple(x) for x in QUERIES["stream_tracks"](spark, FOLDER).select("camera", "id", "track").collect())
    assert got == sorted(tuple(x) for x in QUERIES["track_greedy"](spark, FOLDER).select("camera", "id", "track").collect())
