"""Every registered query of the engine with SQL, against DuckDB on the small tables."""

import decimal
import math
import os

import duckdb
import pytest

from watchloom.plans import analytics, boundaries, composed, estate, extras, knowledge, relational, series  # noqa: F401
from watchloom.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_packages_and_manifest_against_plain(spark):
    import hashlib
    import json

    import pyarrow.parquet as pq

    cases = {}
    for r in pq.read_table(f"{FOLDER}/conversations.parquet").to_pylist():
        cases.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {r.conv_id: r for r in QUERIES["evidence_package"](spark, FOLDER).collect()}
    assert set(got) == set(cases)
    for conv, parts in cases.items():
        body = json.loads(got[conv].package)
        want = sorted(parts, key=lambda p: tuple((x is not None, x) for x in p))
        assert body["conv_id"] == conv and [(p.get("turn"), p.get("role"), p.get("text")) for p in body["timeline"]] == want
        assert got[conv].n == len(parts) and got[conv].sha256 == hashlib.sha256(got[conv].package.encode()).hexdigest()
    blobs = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in QUERIES["manifest"](spark, FOLDER).collect()}
    for name in os.listdir(FOLDER):
        data = open(f"{FOLDER}/{name}", "rb").read()
        assert blobs[name] == (len(data), hashlib.sha256(data).hexdigest())


def test_track_summary_and_motion_gate_against_plain(spark):
    from watchloom.plans.knowledge import detections
    from watchloom.plans.registry import Tables

    tracks = {(r.camera, r.id): r.track for r in QUERIES["track_greedy"](spark, FOLDER).collect()}
    want = {}
    for d in detections(Tables(spark, FOLDER)).collect():
        k = (d.camera, tracks[(d.camera, d.id)])
        low, high, n, label = want.get(k, (d.t, d.t, 0, d.label))
        assert label == d.label  # a track is of one label
        want[k] = (min(low, d.t), max(high, d.t), n + 1, label)
    assert {(r.camera, r.track): (r.first_seen, r.last_seen, r.hits, r.label) for r in QUERIES["track_summary"](spark, FOLDER).collect()} == want
    last, looks = {}, {}
    for r in sorted(Tables(spark, FOLDER).events.select("user_id", "event_id", "value").collect(), key=lambda r: r.event_id):
        clip, level = r.user_id % 20, r.value / 500
        looks[(clip, r.event_id)] = clip not in last or abs(level - last[clip]) >= 0.15
        if looks[(clip, r.event_id)]:
            last[clip] = level
    assert {(r.clip, r.frame): r.detect for r in QUERIES["track_motion_gate"](spark, FOLDER).collect()} == looks


def test_projection_against_plain(spark):
    import numpy as np
    import pyarrow.parquet as pq

    table = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in table], float)
    m = np.random.default_rng(64 * 1_000_003 + 16).standard_normal((16, 64)) / 4
    y = x @ m.T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    got = {r.vec_id: r.vector for r in QUERIES["search_projection"](spark, FOLDER).collect()}
    assert len(got) == len(table) and all(np.allclose(got[r["vec_id"]], v) for r, v in zip(table, y, strict=True))
