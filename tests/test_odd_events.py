"""Queries over events that the small tables don't have: ties, nulls, large values, many in a frame. The SQL is DuckDB's."""

import datetime
import random
import time

import duckdb
import pytest

from tests.test_queries import rows
from watchloom.plans.registry import QUERIES, SQL

START = datetime.datetime(2024, 1, 1)
COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def compared(spark, tmp_path):
    """Whether a query gives what its SQL gives over events, by the query's name."""

    def run(name, events):
        folder = str(tmp_path)
        spark.createDataFrame(events, COLUMNS).coalesce(1).write.parquet(f"{folder}/events.parquet")
        con = duckdb.connect()
        con.sql("SET threads = 1")
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        df, want = QUERIES[name](spark, folder), con.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        got = rows(df.collect(), df.columns)
        assert got == rows(want.fetchall(), want.columns)
        return got

    return run


def some_events(n, seed=3, users=40, every=60.0, value=lambda r: float(r.randrange(1, 300))):
    r = random.Random(seed)
    return [(i, START + datetime.timedelta(seconds=i * every), r.randrange(users), r.choice(("view", "error")), value(r), '{"k": %d}' % r.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("what", ("repeated", "nulls"))
def test_range_rate_of_ties_and_nulls(compared, what):
    events = some_events(1500)  # whole numbers, whose sums are exact
    if what == "repeated":
        events = events * 3
    else:
        r = random.Random(5)
        events = [(i, ts, u, e, None if r.random() < 0.3 or ts.hour < 2 else v, p) for i, ts, u, e, v, p in events] + [(9000, None, 1, "view", 1.0, "{}"), (9001, START, 1, None, 1.0, "{}")]
    assert len(compared("metric_range_rate", events)) > 20


def test_answers_above_one_and_without_a_value(compared):
    odd = [520.16, 0.0, 5e-324, 1e300, -7.5, None, 50_000.0, 501.0]
    events = [(i, START, i % 12, "view", odd[i // 12], "{}") for i in range(12 * len(odd))] + [(999, START, None, "view", 1.0, "{}")]
    assert len(compared("model_answers", events)) == 12 * len(odd)


def test_gated_pairs_of_ties_and_nulls(compared):
    events = some_events(900, users=10, every=20.0, value=lambda r: r.choice((None, 1.5, 1.5, 80.0, 400.25, float("nan"))))
    events += events[:200] + [(8000, None, 1, "view", 1.0, '{"k": 1}'), (8001, START, None, "view", 1.0, '{"k": 1}'), (8002, START, 1, None, 1.0, '{"k": 1}'), (8003, START, 1, "view", 1.0, "{}")]
    assert len(compared("geo_gated_pairs", events)) > 1000


def test_pairs_of_many_alike(spark, tmp_path):
    n = 3000
    frames = spark.range(2 * n).selectExpr("id AS event_id", f"timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 10 * int(id div {n})) AS ts", "5L AS user_id", "'view' AS event_type", "double(id % 2) * 900 AS value", """'{"k": 4}' AS props""")
    frames.write.parquet(f"{tmp_path}/events.parquet")
    began = time.perf_counter()
    got = QUERIES["geo_gated_pairs"](spark, str(tmp_path)).selectExpr("count(*)", "count(distinct a)", "count(distinct b)", "count_if(a >= 3000 or b < 3000 or (a - b) % 2 <> 0)").first()
    assert tuple(got) == (n * n // 2, n, n, 0)  # lists are of up to 1,024 events
    assert time.perf_counter() - began < 30


def test_hypotheses_of_events_without_a_value(compared):
    r = random.Random(8)
    events = [(i, ts, u, e, None if r.random() < 0.5 else v, p) for i, ts, u, e, v, p in some_events(800, users=12, every=30.0)]
    got = compared("track_hypotheses", events)
    assert len(got) > 20
