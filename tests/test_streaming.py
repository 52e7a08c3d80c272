import os

import pytest
from pyspark.sql import functions as F

from watchloom.operators import rules
from watchloom.plans.analytics import subjects
from watchloom.plans.registry import Tables
from watchloom.streaming import streams

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


def fed(spark, tmp_path, parts=3):
    events = subjects(Tables(spark, FOLDER)).drop("all_objects")
    n = events.count()
    for k in range(parts):  # one file per batch, in order of arrival
        events.filter((F.col("arrival") >= k * n // parts) & (F.col("arrival") < (k + 1) * n // parts)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    return events


def test_stream_fires_as_batch_does(spark, tmp_path):
    events = fed(spark, tmp_path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    streams.drain(streams.firings(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.track, r.rule_id, r.arrival) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.track, r.rule_id, r.arrival) for r in rules.first_firings(events).collect())


def test_tumbling_counts(spark, tmp_path):
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    s = streams.topic(spark, str(tmp_path / "in"), e.schema)
    q = streams.tumbling_counts(s, "1 day").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window.start, r.event_type): r.n for r in spark.table("tumbling").collect()}
    assert got == {(r.window.start, r.event_type): r.n for r in e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_dead_letters(spark, tmp_path):
    df = spark.range(3)

    def fail(batch):
        raise ValueError("no")

    streams.with_dead_letters(fail, str(tmp_path / "ok"), str(tmp_path / "dead"))(df, 7)
    streams.with_dead_letters(lambda b: b, str(tmp_path / "ok"), str(tmp_path / "dead"))(df, 8)
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 3 and spark.read.parquet(str(tmp_path / "ok")).count() == 3


def test_an_item_flag_counts_as_in_batch(spark, tmp_path):
    schema = "track string, arrival long, event_id string, ts double, zone_types array<string>, objects array<string>, object_near_hand boolean, has_item boolean, camera_health_score double"
    rows = [("t", k, f"e{k}", float(k), z, ["person"], None, k == 1, None) for k, z in enumerate((["shelf"], ["shelf"], ["exit"]))]
    events = spark.createDataFrame(rows, schema)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    state = streams.History()
    for e in events.orderBy("arrival").collect():
        state.add(e)
    assert state.item and state.holds("person_has_item", True)
    assert [r.rule_id for r in rules.first_firings(events).collect() if r.rule_id == "possible_billing_bypass"] == ["possible_billing_bypass"]
    assert all(state.holds(k, v) for r in streams.RULES if r.id == "possible_billing_bypass" for k, v in r.conditions)


ODD = "track string, arrival long, event_id string, ts double, zone_types array<string>, objects array<string>, object_near_hand boolean, has_item boolean, camera_health_score double"


def test_nulls_and_late_events_fire_as_in_batch(spark, tmp_path):
    """Events without a time or lists, and a batch that brings earlier times than the one before."""
    nan = float("nan")
    rows = [
        ("a", 0, "e0", None, ["shelf"], None, None, None, None), ("a", 1, "e1", 2.0, None, None, True, None, nan), ("a", 2, "e2", 3.0, None, ["person"], None, None, None),
        ("b", 3, "e3", 9.0, ["shelf"], ["person", "bag"], None, None, None), ("b", 4, "e4", 1.0, ["exit"], None, None, None, None), ("b", 5, "e5", nan, ["exit"], [], None, None, 0.4),
        ("b", 6, "e6", 9.0, ["exit"], None, None, None, None), ("c", 7, "e7", None, ["exit"], ["box"], None, None, 0.5), ("d", 8, "e8", -5.0, ["exit"], [], False, True, None),
    ]
    want = sorted((r.track, r.rule_id, r.arrival, r.ts if r.ts == r.ts else None) for r in rules.first_firings(spark.createDataFrame(rows, ODD)).collect())
    assert len(want) > 5
    for per in (1, 4):
        for k in range(0, len(rows), per):
            spark.createDataFrame(rows[k : k + per], ODD).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{per}"))
        stream = spark.readStream.schema(ODD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{per}"))
        streams.drain(streams.firings(stream), str(tmp_path / f"out{per}"), str(tmp_path / f"cp{per}"))
        assert sorted((r.track, r.rule_id, r.arrival, r.ts) for r in spark.read.parquet(str(tmp_path / f"out{per}")).collect()) == want
