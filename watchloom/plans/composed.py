"""Queries that compose several operators: searches for many requests, matched spans, tracks of a stream."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from watchloom.functions.scalar import seconds
from watchloom.operators import frames, matching, requests, search, telemetry
from watchloom.plans.analytics import subjects
from watchloom.plans.knowledge import REQUEST, detections, kinds_sql, request_text
from watchloom.plans.registry import Tables, query
from watchloom.sources import exposition, files
from watchloom.streaming import streams, tracks

#: What the events' types stand for.
KINDS = {"error": "camera_health_issue", "purchase": "possible_billing_bypass", "click": "suspicious_item_interaction", "view": "billing_bypass"}
DIM = 64


_KIND = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items()) + " ELSE event_type END"
_TERMS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z]{{3,}}'))"
_UNIT = "[x / sqrt(list_sum([y * y for y in v])) for x in v]"


@query("search_requests", f"""WITH q0 AS (SELECT item_id AS request, {REQUEST} AS text FROM benchmark),
q1 AS (SELECT request, text, list_aggregate([sha256('text:' || text || '|' || i) for i in range({DIM // 16})], 'string_agg', '') AS h FROM q0),
q2 AS (SELECT request, text, [('0x' || substr(h, 4 * j + 1, 4))::BIGINT / 65535 * 2 - 1 for j in range({DIM})] AS v FROM q1),
q AS (SELECT request, {_UNIT} AS v, {_TERMS.format("text")} AS wanted, {kinds_sql("lower(text)")} AS kinds FROM q2),
i AS (SELECT vec_id AS id, text, embedding::DOUBLE[] AS v FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
n AS (SELECT request, id, round(greatest(0, list_cosine_similarity(q.v, i.v)), 9) AS vector, text FROM q, i QUALIFY row_number() OVER (PARTITION BY request ORDER BY round(greatest(0, list_cosine_similarity(q.v, i.v)), 9) DESC, id) <= 50),
e AS (SELECT event_id AS id, {_KIND} AS kind, epoch_us(ts) / 1e6 AS tt FROM events),
s AS (SELECT DISTINCT kinds FROM q),
l AS (SELECT kinds, id, kind, tt FROM s, e WHERE len(kinds) = 0 OR list_contains(kinds, kind) QUALIFY row_number() OVER (PARTITION BY kinds ORDER BY tt DESC NULLS LAST, id) <= 200),
u AS (SELECT request, id, 0.0::DOUBLE AS vector, kind, tt, NULL AS text FROM q JOIN l USING (kinds) UNION ALL SELECT request, id, vector, NULL, NULL, text FROM n),
m AS (SELECT request, id, max(vector) AS vector, max(kind) AS kind, max(tt) AS tt, max(text) AS text FROM u GROUP BY 1, 2),
c AS (SELECT m.*, coalesce(list_contains(kinds, kind), false) AS hit, len(list_intersect({_TERMS.format("text")}, wanted)) AS shared,
  coalesce((tt - min(tt) OVER r) / CASE WHEN max(tt) OVER r = min(tt) OVER r THEN 1 ELSE max(tt) OVER r - min(tt) OVER r END, 0) AS recency FROM m JOIN q USING (request) WINDOW r AS (PARTITION BY request)),
f AS (SELECT *, round(round(0.7::DOUBLE * vector + 0.2::DOUBLE * hit::INT + 0.1::DOUBLE * recency, 6) + 0.05::DOUBLE * shared, 6) AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank FROM f)
SELECT request, CAST(rank AS INTEGER) AS rank, id, kind, tt AS at_s, score,
  format('vector={{:.3f}}*0.7 + meta={{}}*0.2{{}} + recency={{:.2f}}*0.1{{}}', vector, hit::INT, CASE WHEN hit THEN ' (' || kind || '∈query)' ELSE '' END, recency,
    CASE WHEN shared > 0 THEN format(' | critic:+{{:.2f}} (matched {{}} term(s))', 0.05 * shared, shared) ELSE ' | critic: no lexical overlap' END) AS why FROM k WHERE rank <= 10""")
def search_requests(t: Tables):
    """All requests at once, from their words to ranked and explained results."""
    texts = t.benchmark.select(F.col("item_id").alias("request"), request_text().alias("text"))
    asked = search.hash_vectors(texts, "request", "text", DIM).withColumnRenamed("request", "r").join(texts, F.col("r") == F.col("request")).select("request", "text", "vector")
    kind = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(k)) for e, k in KINDS.items()], F.col("event_type"))
    events = t.events.select(F.col("event_id").alias("id"), kind.alias("kind"), seconds("ts").alias("at"))
    items = t.embeddings.join(t.documents.select("doc_id", "text"), F.col("vec_id") == F.col("doc_id"), "left").select(F.col("vec_id").alias("id"), "text", F.col("embedding").cast("array<double>").alias("vector"))
    return requests.search_many(asked, events, items).withColumnRenamed("at", "at_s")


@query("match_golden")
def match_golden(t: Tables):
    """Precision and recall by kind of events that are expected (from odd users) against those said (from even ones), a clip
    being an hour of twenty users."""
    zones = F.when(F.col("value") < 150, F.array(F.lit("exit"))).when(F.col("value") < 350, F.array(F.lit("shelf"), F.lit("exit"))).otherwise(F.array(F.lit("shelf")))
    spans = t.events.select(F.concat_ws(":", F.floor(seconds("ts") / 3600).cast("string"), (F.col("user_id") % 20).cast("string")).alias("clip"), "event_type", F.col("event_id").alias("id"), seconds("ts").alias("start"), (seconds("ts") + 300 + F.col("value")).alias("end"), zones.alias("zones"))
    expected, predicted = spans.filter(F.col("id") % 2 == 1), spans.filter(F.col("id") % 2 == 0)
    matched = matching.match_spans(expected, predicted, ["clip", "event_type"])
    return matching.precision_recall(expected, predicted, matched, "event_type")


@query("stream_tracks")
def stream_tracks(t: Tables):
    """The tracks of detections that come as a stream of files, a stretch of time each, and a last file that only says that time has
    passed; the same as those of ``track_greedy``."""
    path = files.scratch(t.spark, "tracks")
    found = detections(t).filter("t IS NOT NULL")
    ends = [r[0] for r in found.select(F.explode(F.percentile("t", [0.0, 0.25, 0.5, 0.75, 1.0])).alias("t")).collect()]
    for low, high in itertools.pairwise(ends):
        found.filter(((F.col("t") > low) | (low == ends[0])) & (F.col("t") <= high)).write.mode("append").parquet(f"{path}/in")
    found.agg((F.max("t") * 2 + 3600).alias("t")).selectExpr("cast(null as bigint) AS camera", "cast(null as bigint) AS id", "t", "cast(null as string) AS label", "cast(null as array<double>) AS box").write.mode("append").parquet(f"{path}/in")
    stream = t.spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    # the files of a stretch may come in two batches, of which the first has files of the next stretch too
    late = max([b - a for a, b in zip(ends, ends[2:], strict=False)], default=0.0)
    return tracks.drained(t.spark, tracks.track_stream(stream, f"{int(late) + 1} seconds"), f"{path}/out", f"{path}/checkpoint")


WIDTH, HEIGHT = 16, 9


def frames_of(t: Tables):
    """The documents' bytes as frames of 16 x 9 pixels, five in two seconds, a document being a clip; a rest too short
    for a frame is one that can't be decoded."""
    size = 3 * WIDTH * HEIGHT
    data = t.documents.select(F.col("doc_id").cast("string").alias("clip"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    cut = data.withColumn("frame", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("data") / size) - 1, F.lit(0)))))
    return cut.select("clip", "frame", (F.col("frame") * 0.4).alias("at"), F.substring("data", (F.col("frame") * size + 1).cast("int"), F.lit(size)).alias("pixels"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


@query("frames_gate")
def frames_gate(t: Tables):
    """Which sampled frames are looked at, by how many pixels have changed since the last one that was."""
    return frames.gate(frames_of(t))


@query("frames_gate_counts")
def frames_gate_counts(t: Tables):
    return frames.gate_counts(frames.gate(frames_of(t)))


@query("frames_health")
def frames_health(t: Tables):
    """How well each clip can be seen, from its pixels."""
    return frames.health(frames_of(t))


@query("metric_scrape", "WITH c AS (SELECT event_type, user_id % 7 AS instance, epoch_us(date_trunc('day', ts)) / 1e6 AS s, count(*) AS n FROM events GROUP BY ALL) SELECT 'events_total' AS metric, event_type AS kind, 'host \"' || instance || '\"' AS instance, s AS ts, sum(n) OVER (PARTITION BY event_type, instance ORDER BY s)::DOUBLE AS value FROM c")
def metric_scrape(t: Tables):
    """Counters as services tell them, scraped by a stream into the table that metrics are asked of; a stream that is started
    again reads nothing twice."""
    day = F.floor(seconds("ts") / 86400) * 86400
    counted = t.events.groupBy("event_type", (F.col("user_id") % 7).alias("instance"), day.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("event_type", "instance").orderBy("s"))
    line = F.format_string('events_total{kind="%s", instance="host \\"%s\\""} %d %d', "event_type", F.col("instance").cast("string"), so_far, F.col("s") * 1000)
    path = files.scratch(t.spark, "scrapes")
    lines = counted.select(line.alias("value")).unionAll(t.region.selectExpr("'# HELP events_total ' || r_name AS value")).unionAll(t.region.selectExpr("'' AS value"))
    lines.write.text(f"{path}/in")
    for _ in range(2):
        streams.drain(exposition.scrape_stream(t.spark, f"{path}/in"), f"{path}/out", f"{path}/checkpoint")
    found = t.spark.read.schema(exposition.COLUMNS).parquet(f"{path}/out")
    return found.select("metric", F.col("labels")["kind"].alias("kind"), F.col("labels")["instance"].alias("instance"), "ts", "value")


@query("telemetry_run", "SELECT 'run_rows' AS metric, NULL AS column_, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'run_nulls', 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'run_nulls', 'source', count(*) FILTER (source IS NULL) FROM documents UNION ALL SELECT 'run_nulls', 'doc_id', count(*) FILTER (doc_id IS NULL) FROM documents UNION ALL SELECT 'run_failed', NULL, 0")
def telemetry_run(t: Tables):
    """What a run over the documents tells about itself, besides its seconds."""
    path = files.scratch(t.spark, "telemetry")
    telemetry.record(t.documents.select("doc_id", "lang", "source"), "documents", lambda df: df.write.parquet(f"{path}/out"), f"{path}/metrics")
    told = t.spark.read.schema(telemetry.METRICS).parquet(f"{path}/metrics").filter("metric <> 'run_seconds'")
    return told.select("metric", F.col("labels")["column"].alias("column_"), "value")


@query("stream_rule_versions", "WITH e AS (SELECT user_id AS track, min(event_id) FILTER (event_type = 'view' AND event_id % 2 = 0) AS old, min(event_id) FILTER (event_type = 'view') AS seen, max(event_id) FILTER (event_id % 2 = 1) AS late, min(event_id) FILTER (event_id % 2 = 1) AS next FROM events GROUP BY 1), f AS (SELECT track, min(event_id) AS first FROM events JOIN e ON user_id = track WHERE event_id % 2 = 1 AND (old IS NOT NULL OR event_id >= (SELECT min(event_id) FROM events v WHERE v.user_id = track AND v.event_type = 'view' AND v.event_id % 2 = 1)) GROUP BY 1) SELECT track, 'added' AS rule_id, first AS arrival FROM f")
def stream_rule_versions(t: Tables):
    """A rule that is added between two batches fires at its subjects' next events, though its condition held before."""
    path = files.scratch(t.spark, "versions")
    events = subjects(t).drop("all_objects")
    added = {"id": "added", "conditions": [{"person_in_zone": "shelf"}], "action": {"create_event": "added"}}
    for version, (rules, part) in enumerate((([], 0), ([added], 1))):
        streams.put_rules(t.spark, rules, version, f"{path}/rules")
        events.filter(F.col("arrival") % 2 == part).write.mode("append").parquet(f"{path}/in")
        fed = t.spark.readStream.schema(events.schema).parquet(f"{path}/in")
        streams.drain_each(fed, streams.versioned(f"{path}/rules", f"{path}/tagged"), f"{path}/tagging")
        tagged = t.spark.readStream.schema(events.withColumns({"rules_version": F.lit(0).cast("long"), "rules": F.lit("")}).schema).option("recursiveFileLookup", True).parquet(f"{path}/tagged")
        streams.drain(streams.firings(tagged), f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.schema(streams.FIRED.format("long")).parquet(f"{path}/out").select("track", "rule_id", "arrival")
