import hashlib
import json

import pytest

from watchloom.schemas import ZONES
from watchloom.sources import dimensions, files


def test_result_documents(spark, tmp_path):
    for name, doc in {"cam 1.json": {"video": "a", "caption": "x"}, "cam2.json": {"video": "b", "caption": None}, "summary.json": {"video": "no"}, "fused.json": {"video": "no"}}.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    got = files.result_documents(spark, str(tmp_path), "video string, caption string").collect()
    assert sorted((r.file, r.video, r.caption) for r in got) == [("cam 1.json", "a", "x"), ("cam2.json", "b", None)]


def test_clip_catalogue(spark, tmp_path):
    for camera in ("left", "right"):
        (tmp_path / camera).mkdir()
        for k in range(3):
            (tmp_path / camera / f"clip_{k}.mp4").write_bytes(f"{camera}{k}".encode())
    (tmp_path / "left" / "notes.txt").write_text("no clip")
    got = files.clip_catalogue(spark, str(tmp_path), "*.mp4", 30).collect()
    assert len(got) == 6
    for r in got:
        camera, name = r.path.split("/")[-2:]
        k = int(name[5])
        assert (r["index"], r.start_sec, r.size, r.sha256) == (k, 30.0 * k, len(camera) + 1, hashlib.sha256(f"{camera}{k}".encode()).hexdigest())


def test_zone_file(spark, tmp_path):
    path = tmp_path / "zones.json"
    path.write_text(json.dumps([{"id": "z", "store_id": "s", "camera_id": "c", "name": "n", "zone_type": "shelf", "polygon": [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]}]))
    assert dimensions.zones(spark, str(path)).first().polygon == [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]
    assert dimensions.zones(spark, str(tmp_path / "none.json")).count() == 0 and len(ZONES.split(", ")) == 6


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \nnot json\n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path), "a long").filter("a IS NOT NULL").collect()) == [1, 2]
    assert files.json_lines(spark, str(tmp_path), "a long", limit=1).count() == 1


def test_exposition_lines(spark):
    from pyspark.sql import functions as F

    from watchloom.sources import exposition

    lines = [
        "# HELP up Whether it answers", "#no space", "", "   ", "up 1", 'http_total{code="200",path="/a\\"b\\\\n\\nc"} 1.5e3 1700000000123', 'x_bucket{le="+Inf",} +Inf', "neg -Inf -5", "nan NaN", 'twice{a="1",a="2"} 3',
        'brace{a="} 1"} 2', "bad", "1bad 2", "word abc", 'open{a="1" 2', ":colon:ok .5", 'unicode{ä="1",b="é"} 4',
    ]
    got = {r.metric: (r.labels, r.ts, r.value) for r in exposition.samples(spark.createDataFrame([(x, 9.0) for x in lines], "value string, scraped_at double")).collect()}
    nan = got.pop("nan")
    assert nan[:2] == ({}, 9.0) and nan[2] != nan[2]
    assert got == {
        "up": ({}, 9.0, 1.0), "http_total": ({"code": "200", "path": '/a"b\\n\nc'}, 1700000000.123, 1500.0), "x_bucket": ({"le": "+Inf"}, 9.0, float("inf")), "neg": ({}, -0.005, float("-inf")),
        "twice": ({"a": "2"}, 9.0, 3.0), "brace": ({"a": "} 1"}, 9.0, 2.0), ":colon:ok": ({}, 9.0, 0.5), "unicode": ({"b": "é"}, 9.0, 4.0),
    }
    assert exposition.samples(spark.createDataFrame([], "value string, scraped_at double").withColumn("other", F.lit(1))).count() == 0


def test_a_failing_run_is_recorded_and_fails(spark, tmp_path):
    from watchloom.operators import telemetry

    df, path = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a long, b string"), str(tmp_path / "metrics")
    telemetry.record(df, "good", lambda x: x.write.parquet(str(tmp_path / "out")), path)

    def fail(x):
        raise ValueError("no")

    with pytest.raises(ValueError):
        telemetry.record(df, "bad", fail, path)
    got = {(r.metric, r.labels["query"], r.labels.get("column")): r.value for r in spark.read.parquet(path).collect()}
    assert got[("run_rows", "good", None)] == 3 and got[("run_nulls", "good", "a")] == 1 and got[("run_nulls", "good", "b")] == 2
    assert got[("run_failed", "good", None)] == 0 and got[("run_failed", "bad", None)] == 1 and ("run_rows", "bad", None) not in got and got[("run_seconds", "good", None)] > 0


def test_batches_of_a_stream_are_recorded(spark, tmp_path):
    import time

    from watchloom.operators import telemetry
    from watchloom.streaming import streams

    for k in range(3):
        spark.range(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = telemetry.StreamLog(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(log)
    try:
        streams.drain(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        for _ in range(100):
            if (tmp_path / "metrics").exists() and spark.read.schema(telemetry.METRICS).parquet(str(tmp_path / "metrics")).filter("metric = 'stream_input_rows'").count() == 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = spark.read.schema(telemetry.METRICS).parquet(str(tmp_path / "metrics")).filter("metric = 'stream_input_rows'").collect()
    assert [r.value for r in rows] == [10.0] * 3 and sorted(r.labels["batch"] for r in rows) == ["0", "1", "2"]


def test_a_session_as_the_operators_want_it(spark):
    from watchloom.session import session

    assert session("again", spark__sql__shuffle__partitions="4").conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_scratch_is_shared_or_an_error(spark, monkeypatch):
    class Cluster:
        sparkContext = type("C", (), {"master": "spark://x:1", "getConf": lambda self: {}})()
        conf = {}

    with pytest.raises(ValueError):
        files.scratch(Cluster(), "x")
    assert "/x-" in files.scratch(spark, "x")


@pytest.mark.parametrize("per_batch", ("10000", "3"))
def test_manifest_of_files_beyond_a_row(spark, tmp_path, monkeypatch, per_batch):
    import random

    r, conf = random.Random(2), {k: spark.conf.get(k) for k in files.SPLIT}
    monkeypatch.setattr(files, "WHOLE", 50)
    contents = {
        "small": b"a", "marked": files.BOM + b"x" * 60 + b"\n", "marked 2": files.BOM + b"y\r\n" * 40 + b"z", "lines": b"\n" * 99, "open": b"line\nand " + b"a half" * 20,
        "noise": r.randbytes(200_000), "more noise": r.randbytes(70_000) + b"\n"}
    (tmp_path / "deep er").mkdir()
    for k, (name, data) in enumerate(contents.items()):
        (tmp_path / ("deep er" if k % 2 else ".") / f"{name}.parquet").write_bytes(data)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        got = files.manifest(spark, str(tmp_path), "*.parquet").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {x.path.rsplit("/", 1)[1][:-8]: (x.size, x.sha256) for x in got} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    assert len(got) == len(contents) and {k: spark.conf.get(k) for k in files.SPLIT} == conf


def test_a_file_that_isnt_read_as_it_is(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(files, "WHOLE", 10)
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"line\n" * 100))  # the reader unpacks it
    with pytest.raises(Exception, match="bytes, of which"):
        files.manifest(spark, str(tmp_path), "*.gz")
