import random
import uuid

import pytest
from pyspark.sql import functions as F

import watchloom.plans.knowledge  # noqa: F401
from watchloom.functions import geometry
from watchloom.functions.scalar import uuid5
from watchloom.functions.text import redact, redact_fields, redact_value
from watchloom.functions.verdicts import balanced, read_answer
from watchloom.operators import economics, fusion, governance, intervals, rules, search, tables, tracking, windows
from watchloom.plans.registry import QUERIES

#: The six runtimes' availability, clips a minute, p95 ms, quality, cost per 1000 clips.
RUNTIMES = [
    ("tensorrt_llm", False, 63.324538258575195, 1170.25, 0.96, 0.6843055555555556, 1),
    ("nim", False, 57.295645530939645, 1296.68, 0.96, 0.7272222222222223, 1),
    ("vllm", False, 46.278441959120705, 1608.35, 0.96, 0.8643333333333334, 2),
    ("llama_cpp", True, 29.347028613352897, 2534.55, 0.93, 0.8234791666666668, 3),
    ("transformers", True, 23.139220979560353, 3216.7, 0.96, 1.4405555555555558, 3),
    ("ollama", True, 27.347310847766636, 2728.6, 0.93, 0.9141666666666668, 2),
]

SUBJECT = "track string, arrival long, event_id string, ts double, zone_types array<string>, objects array<string>, object_near_hand boolean, has_item boolean, camera_health_score double"


def fired(spark, events):
    df = spark.createDataFrame([(e.get("track", "t"), i, f"e{i}", e["ts"], e.get("zones", []), e.get("objects", ["person"]), e.get("near"), e.get("item"), e.get("score")) for i, e in enumerate(events)], SUBJECT)
    return sorted((r.track, r.rule_id, r.arrival) for r in rules.first_firings(df).collect())


def test_blocked_camera(spark):
    assert fired(spark, [{"track": "cam:1", "ts": 0.0, "score": 0.2, "objects": []}]) == [("cam:1", "camera_health_issue", 0)]


def test_ordinary_customer(spark):
    assert fired(spark, [{"ts": 0.0, "zones": ["shelf"]}, {"ts": 12.0, "zones": ["billing_counter"]}, {"ts": 20.0, "zones": ["exit"]}]) == []


def test_pick_and_leave(spark):
    got = fired(spark, [{"ts": 0.0, "zones": ["shelf"]}, {"ts": 4.0, "zones": ["shelf"], "near": True}, {"ts": 9.0, "zones": ["exit"], "item": True}])
    assert got == [("t", "possible_billing_bypass", 2), ("t", "suspicious_item_interaction", 1)]


def test_late_event_is_not_the_latest(spark):
    assert fired(spark, [{"ts": 9.0, "zones": ["shelf"], "item": True}, {"ts": 1.0, "zones": ["exit"]}]) == []


def test_parse_rules():
    r = rules.parse([{"id": "a", "conditions": [{"person_in_zone": "x"}], "action": {"create_incident": "loss", "severity": "high"}}])[0]
    assert (r.makes, r.incident, r.conditions) == ("loss", True, (("person_in_zone", "x"),))


def test_unknown_condition_never_holds(spark):
    df = spark.createDataFrame([("t", 0, "e", 0.0, [], [], None, None, None)], SUBJECT)
    assert rules.first_firings(df, (rules.Rule("r", "m", conditions=(("no_such", 1),)),)).count() == 0


@pytest.mark.parametrize(
    ("duration", "length", "stride", "want"),
    [(10.0, 5, 2, [(0, 5), (2, 7), (4, 9), (6, 10)]), (4.0, 5, 2, [(0, 4)]), (0.0, 5, 2, []), (10.0, 2, 5, [(0, 2), (5, 7), (8, 10)]), (30.0, 5, 2, None)],
)
def test_window_bounds(spark, duration, length, stride, want):
    got = spark.range(1).select(windows.window_bounds(F.lit(duration), length, stride).alias("w")).first().w
    if want is None:
        assert len(got) == 14 and len(spark.range(1).select(windows.new_windows(windows.window_bounds(F.lit(duration), length, stride), 5, F.lit(1)).alias("w")).first().w) == 13
    else:
        assert [(w.start, w.end) for w in got] == want


def test_window_bounds_want_positive():
    with pytest.raises(ValueError):
        windows.window_bounds(F.lit(1.0), 0, 1)


def test_overlap_join_against_brute_force(spark):
    r = random.Random(4)
    a = [(i, r.randrange(3), (s := r.uniform(0, 100)), s + r.choice((0.0, 1.0, 30.0))) for i in range(80)]
    df = spark.createDataFrame(a, "id int, k int, s double, e double")
    for closed in (False, True):
        got = sorted((x.l_id, x.r_id) for x in intervals.overlap_join(df, df, ["k"], "s", "e", 7.0, closed).collect())
        meet = (lambda x, y: x[2] <= y[3] and y[2] <= x[3]) if closed else (lambda x, y: x[2] < y[3] and y[2] < x[3])
        assert got == sorted((x[0], y[0]) for x in a for y in a if x[1] == y[1] and meet(x, y))


def test_uuid5(spark):
    got = spark.createDataFrame([("a|b|c",), ("ü",), ("",)], "s string").select("s", uuid5(F.col("s")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.s)) for r in got)


def ray(x, y, p):
    odd = False
    for i in range(len(p)):
        a, b = p[i], p[i - 1]
        if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / ((b[1] - a[1]) or 1e-12) + a[0]:
            odd = not odd
    return odd and len(p) >= 3


def test_point_in_polygon(spark):
    r = random.Random(2)
    rows = [(r.random(), r.random(), [[r.random(), r.random()] for _ in range(r.choice((0, 2, 3, 4, 7)))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, p array<array<double>>")
    assert [x.i for x in df.select(geometry.inside(F.col("x"), F.col("y"), F.col("p")).alias("i")).collect()] == [ray(*q) for q in rows]


def test_upsert_keeps_other_columns(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    n = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], "k int, v string, w string")
    assert sorted(map(tuple, tables.upsert(t, n, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")]


def test_insert_first_writer_wins(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    n = spark.createDataFrame([(1, "z"), (2, "d"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, tables.insert_new(t, n, ["k"], F.col("v")).collect())) == [(1, "a"), (2, "c")]


def test_activate_unknown(spark):
    with pytest.raises(KeyError):
        tables.activate(spark.createDataFrame([("a",)], "n string"), "n", "b")


def test_tracker():
    t, box = tracking.Tracker(), [0.1, 0.1, 0.2, 0.2]
    assert t.frame(0, [("person", box)]) == [0]
    assert t.frame(1, [("person", [0.12, 0.1, 0.2, 0.2]), ("person", [0.7, 0.7, 0.1, 0.1])]) == [0, 1]
    assert t.frame(2, [("bag", box)]) == [2]
    assert t.frame(100, [("person", box)]) == [3]


def test_motion_gate_compares_with_the_last_frame_looked_at(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.0, 0.1, 0.14, 0.16, 0.2))], "clip long, frame long, level double")
    assert [r.detect for r in tracking.motion_gate(df).orderBy("frame").collect()] == [True, False, False, True, False]


def test_merge_reports(spark):
    rows = [("g", 0, 0.0, 10.0, "person takes item"), ("g", 1, 1.0, 11.0, "person takes item from shelf"), ("g", 2, 50.0, 60.0, "person takes item"), ("g", 3, 0.0, 10.0, "dog"), ("g", 4, 0.0, 10.0, "")]
    got = fusion.merge_reports(spark.createDataFrame(rows, "grp string, pos long, start double, end double, description string"), "grp").orderBy("place").collect()
    assert [(r.description, r.merged) for r in got] == [("person takes item from shelf", 2), ("person takes item", 1), ("dog", 1), ("", 1)]


@pytest.mark.parametrize(
    ("text", "verdict", "ok"),
    [
        ('{"verdict": "suspicious", "confidence": 0.9}', "suspicious", True), ('```json\n{"verdict": "benign"}\n```', "benign", True), ('{"verdict": " Benign"} and so on', "benign", True),
        ('{"verdict": "suspicious", ("observed_actions": ["a", "b")}', "suspicious", True), ('{"verdict": "suspicious", "expl', "suspicious", True), ('{"verdict": "confirmed"}', "unclear", True), ("nothing", "unclear", False), (None, "unclear", False), ('{"verdict": "maybe"}', "unclear", True),
    ],
)
def test_read_answer(text, verdict, ok):
    got = read_answer(text)
    assert (got["verdict"], got["parse_success"]) == (verdict, ok)
    assert ok or (got["confidence"], got["missing_evidence"], got["recommended_next_step"], got["structured_event_type"]) == (0.0, ["model output was not valid JSON"], "manual_review", "parse_error")


def test_answer_fields():
    got = read_answer('{"verdict": "benign", "confidence": 85, "observed_actions": "look; take\\n", "missing_evidence": 3, "recommended_next_step": null}')
    assert (got["confidence"], got["observed_actions"], got["missing_evidence"], got["recommended_next_step"]) == (0.85, ["look", "take"], ["3"], "")


def test_redaction(spark):
    texts = {
        "rtsp://u:p@h/x": "rtsp://u:***REDACTED***@h/x",
        "Authorization: Bearer abc.def-1": "Authorization: Bearer ***REDACTED***",
        "use hf_abcdefghij1 now": "use ***REDACTED*** now",
        "sk-12345678_x and key-short": "***REDACTED*** and key-short",
        "db_password = 'a b' next": "db_password=***REDACTED*** next",
        'api-key: "x y", token=zzz': "api-key=***REDACTED***, token=***REDACTED***",
        "plain text: nothing here": "plain text: nothing here",
    }
    df = spark.createDataFrame(list(texts.items()), "t string, w string")
    assert [(r.t, r.g) for r in df.select("t", "w", redact(F.col("t")).alias("g")).filter("g <> w").collect()] == []


def test_redaction_reaches_nested_values(spark):
    df = spark.sql("SELECT named_struct('user', 'hf_abcdefghij1', 'auth', 'x', 'list', array(map('Token', 'y', 'note', 'pk-123456789')), 'n', 7, 'dsn', 5) AS v")
    got = df.select(redact_value(F.col("v"), df.schema["v"].dataType).alias("v")).first().v.asDict()
    assert got == {"user": "***REDACTED***", "auth": "***REDACTED***", "list": [{"Token": "***REDACTED***", "note": "***REDACTED***"}], "n": 7, "dsn": None}
    assert df.select(redact_fields(F.create_map(F.lit("secret"), F.lit("x"))).alias("m")).first().m == {"secret": "***REDACTED***"}


def test_roles(spark):
    df = spark.createDataFrame([("admin", "backup", True), ("viewer", "approve", False), ("reviewer", "reject", True), ("reviewer", "retention", False), ("ghost", "read", False), ("viewer", "read", True), ("admin", "no_such", False)], "r string, a string, w boolean")
    assert df.filter(governance.may(F.col("r"), F.col("a")) != F.col("w")).count() == 0


def test_repeated_keys_of_incoming_rows(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "y"), (2, "x"), (3, "q"), (3, "p")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "x"), (3, "p")]
    parents = spark.createDataFrame([("x",), ("p",), ("q",)], "id string")
    assert sorted(map(tuple, tables.insert_with_parent(old, new, "k", parents, "v", "id").collect())) == [(1, "a"), (2, "b"), (3, "p")]


@pytest.mark.parametrize(
    ("text", "kinds", "routes", "objects"),
    [
        ("show a person who picked an item and walked away", ["billing_bypass", "possible_billing_bypass", "possible_loss", "suspicious_item_interaction"], [], ["item"]),
        ("bottles left by the shelf", ["possible_billing_bypass", "possible_loss"], ["shelf"], ["bottle"]),
        ("camera covered at the exit", ["camera_health_issue"], ["exit"], []),
        ("anything", [], [], []),
    ],
)
def test_requests(spark, text, kinds, routes, objects):
    assert tuple(spark.createDataFrame([(text,)], "q string").select(search.request_columns(F.col("q")).alias("r")).first().r) == (kinds, routes, objects)


def test_vectors(spark):
    import hashlib

    import numpy as np

    v = search.hash_vector("abc")
    first = int.from_bytes(hashlib.sha256(b"text:abc|0").digest()[:2], "big") / 65535 * 2 - 1
    assert len(v) == 768 and abs(sum(x * x for x in v) - 1) < 1e-9 and v[0] * first > 0
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0])], "k long, e array<double>")
    got = {r.k: r.vector for r in search.project_vectors(df, "k", "e", 3, 2).collect()}
    m = np.random.default_rng(3 * 1_000_003 + 2).standard_normal((2, 3)) / np.sqrt(2)
    want = m @ np.array([1.0, 2.0, 3.0])
    assert np.allclose(got[1], want / np.linalg.norm(want)) and got[2] == [0.0, 0.0]


def test_retention_keeps_rows_without_a_time(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2024-01-01'), ('b', TIMESTAMP_NTZ'2024-01-20'), ('c', NULL) t(id, ts)")
    got = df.filter(governance.expired(F.col("ts"), F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"), 14)).collect()
    assert [r.id for r in got] == ["a"]


def test_published_scores(spark):
    from watchloom.plans.registry import QUERIES

    runs = spark.createDataFrame(RUNTIMES, "runtime string, available boolean, cpm double, p95 double, quality double, cost double, portable int").withColumn("task", F.lit("t"))
    ranks = economics.ranked(runs, ["task"])
    got = {r.runtime: r.score for r in ranks.collect()}
    assert tuple(economics.picked(ranks, ["task"]).first()) == ("t", "llama_cpp", "transformers")
    assert got == {"tensorrt_llm": 1.0, "nim": 0.9235, "vllm": 0.7623, "llama_cpp": 0.2598, "transformers": 0.25, "ollama": 0.2007}


@pytest.fixture(scope="module")
def late_events(spark, tmp_path_factory):
    """Events of high ids in a folder of tables: two busy days of few users, then a pause, then more."""
    r = random.Random(11)
    at, rows = 1_704_067_200, []
    for k in range(900):
        at += r.choice((20, 100, 400)) + (40_000 if k % 300 == 299 else 0)
        rows.append((2500 + 3 * k, at, r.randrange(40), r.choice(("view", "error", "purchase")), round(r.random() * 300, 2), '{"k": %d}' % r.randrange(100)))
    df = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double, props string")
    folder = str(tmp_path_factory.mktemp("tables"))
    df.selectExpr("event_id", "cast(timestamp_seconds(at) as timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    return folder, rows


def plain_tracks(rows):
    frames, out = {}, {}
    for i, at, user, _, value, props in rows:
        k = int(props[6:-1])
        frames.setdefault(user % 5, {}).setdefault(float(at // 600), []).append((i, "person" if k % 2 == 0 else "bag", [value / 1000, k / 200, 0.3, 0.3]))
    for camera, by in frames.items():
        tracker = tracking.Tracker()
        for t in sorted(by):
            found = sorted(by[t])
            out |= {i: (camera, f"{camera}:{n}", label, t) for (i, label, _), n in zip(found, tracker.frame(t, [x[1:] for x in found]), strict=True)}
    return out


def test_tracks_of_all_events(spark, late_events):
    folder, rows = late_events
    want = plain_tracks(rows)
    got = {r.id: (r.camera, r.track) for r in QUERIES["track_greedy"](spark, folder).collect()}
    assert got == {i: x[:2] for i, x in want.items()} and len(got) == 900
    tracks = {}
    for camera, n, label, t in want.values():
        tracks.setdefault((camera, n, label), []).append(t)
    summed = {(r.camera, r.track, r.label): (r.first_seen, r.last_seen, r.hits) for r in QUERIES["track_summary"](spark, folder).collect()}
    assert summed == {k: (min(v), max(v), len(v)) for k, v in tracks.items()} and max(x[2] for x in summed.values()) > 3


def test_tracks_go_from_batch_to_batch(spark, late_events):
    folder, rows = late_events
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: (r.camera, r.track) for r in QUERIES["track_greedy"](spark, folder).collect()}
        looks = {r.frame: r.detect for r in QUERIES["track_motion_gate"](spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {i: x[:2] for i, x in plain_tracks(rows).items()}
    last, want = {}, {}
    for i, _, user, _, value, _ in rows:
        want[i] = user % 20 not in last or abs(value / 500 - last[user % 20]) >= 0.15
        if want[i]:
            last[user % 20] = value / 500
    assert looks == want and len(looks) == 900


def test_reports_of_all_events_are_merged(spark, late_events):
    folder, rows = late_events
    kept = {}
    for i, _, user, kind, value, props in rows:
        text = f"a person {kind}" + (" again" if int(props[6:-1]) > 50 else "")
        words, mine = set(text.split()), kept.setdefault(user, [])
        for k in mine:
            inter, hull = min(value, k[1]) + 60 - max(value, k[1]), max(value, k[1]) + 60 - min(value, k[1])
            if len(words & set(k[2].split())) / max(len(words), len(k[2].split())) >= 0.5 and max(0, inter) / hull > 0.3:
                if len(text) > len(k[2]):
                    k[:3] = [i, value, text]
                k[3] += 1
                break
        else:
            mine.append([i, value, text, 1])
    got = {(r.grp, r.place): (r.pos, r.start, r.description, r.merged) for r in QUERIES["fusion_greedy_merge"](spark, folder).collect()}
    assert got == {(user, n): tuple(k) for user, mine in kept.items() for n, k in enumerate(mine)}
    assert sum(x[3] for x in got.values()) == 900 and max(x[3] for x in got.values()) > 3


def test_actions_without_a_firing_or_with_odd_events(spark):
    rows = [("t", 0, "e0", 0.0, ["shelf"], ["person"], None, None, None), ("t", 1, None, None, None, None, True, None, None), ("t", 2, "e2", 4.0, ["shelf", "exit"], ["person"], None, None, None), ("t", 3, "e3", 9.0, ["late"], [], None, None, None), ("u", 4, "e4", 1.0, [], [], None, None, None)]
    got = rules.actions(spark.createDataFrame(rows, SUBJECT)).collect()
    assert [(a.track, a.rule_id, a.arrival, a.zones, a.sources) for a in got] == [("t", "suspicious_item_interaction", 2, ["exit", "shelf"], ["e0", "e2"])]
    plan = rules.actions(spark.createDataFrame(rows, SUBJECT))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_whys_end_at_the_first_that_does_not_hold(spark):
    rows = [("t", 0, "e0", 0.0, ["shelf"], ["person"], None, None, 0.7), ("t", 1, "e1", 1.0, ["exit"], ["person"], True, None, None)]
    odd = rules.Rule("odd", "m", conditions=(("no_such", 1), ("person_in_zone", "shelf")))
    got = {x.arrival: [(w.rule_id, w.place, w.observed, w.amount, w.holds) for w in x.whys] for x in rules.explain(spark.createDataFrame(rows, SUBJECT), (*rules.RULES, odd)).collect()}
    health, none = ("camera_health_issue", 0, None, 0.7, False), ("odd", 0, None, None, False)
    bypass = ("possible_billing_bypass", 0, "false", None, False)
    assert got[0] == [("suspicious_item_interaction", 0, "true", None, True), ("suspicious_item_interaction", 1, "false", None, False), bypass, health, none]
    assert got[1] == [("suspicious_item_interaction", 0, "true", None, True), ("suspicious_item_interaction", 1, "true", None, True), ("suspicious_item_interaction", 2, None, 1.0, False), bypass, health, none]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('say {"a": [1, 2} and more', '{"a": [1, 2]'), ('{"a": (1}', '{"a": 1}'), ('{"a": "x}"} tail', '{"a": "x}"}'), ('{"a": "cut', '{"a": "cut"}'), ('{"a": "q\\"', '{"a": "q\\""}'),
        ('{"a": [1, ', '{"a": [1]}'), ('{"a": ', '{"a"}'), ("none", ""), ("{", "{}"), ('{"a": {"b": [', '{"a": {"b": []}}'), ('{"k": "\\\\"}', '{"k": "\\\\"}'),
    ],
)
def test_brackets_are_closed(text, want):
    if text.startswith("say"):
        assert balanced(text).startswith(want)  # the wrong closer is the list's; the object's follows
    else:
        assert balanced(text) == want


def test_an_answer_of_brackets_alone_is_unread():
    for text in ("[" * 200_000, '{"a": ' + "[" * 200_000, '{"a":' * 100_000, "{" + "(" * 1000):
        got = read_answer(text)
        assert got["verdict"] == "unclear"
    assert read_answer('```json\n{"verdict": "benign", "confidence": 80)\n```')["verdict"] == "benign"


def test_merging_against_one_pass_over_a_group(spark):
    r = random.Random(12)
    words = ("a person", "a person takes", "dog", "", "a person takes the item", "the item")
    rows = [(r.choice((None, "g", "h")), k, a, a + r.choice((1.0, 5.0, 20.0)), r.choice(words)) for k, a in ((k, float(r.randint(0, 120))) for k in range(200))]
    rows += [("g", 500, None, 3.0, "dog"), ("g", 501, 1.0, None, "dog"), ("g", 502, 1.0, 2.0, None)]
    got = fusion.merge_reports(spark.createDataFrame(rows, "grp string, pos long, start double, end double, description string").repartition(3), "grp")
    want = []
    for g in (None, "g", "h"):
        kept = []
        for _, pos, a, z, text in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            w, hit = set((text or "").split()), None
            for k in kept:
                v = set(k[3].split())
                if a is None or z is None or k[1] is None or k[2] is None or not w or not v or len(w & v) / max(len(w), len(v)) < 0.5:
                    continue
                if (min(z, k[2]) - max(a, k[1])) / (max(z, k[2]) - min(a, k[1])) > 0.3:
                    hit = k
                    break
            if hit is None:
                kept.append([pos, a, z, text or "", 1])
            else:
                hit[:4] = [pos, a, z, text] if len(text) > len(hit[3]) else hit[:4]
                hit[4] += 1
        want += [(g, i, *k) for i, k in enumerate(kept)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and max(k[6] for k in want) > 3
