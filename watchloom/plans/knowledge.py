"""Queries: fusion, tracking, search, evidence, summaries, metrics, economics, governance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from watchloom.functions.scalar import as_list, confidence, seconds
from watchloom.functions.text import describe_event, describe_observation, redact, token_overlap
from watchloom.operators import economics, fusion, governance, metrics, search, summary, tables, tracking
from watchloom.plans.registry import Tables, query, uuid5_sql

K = "json_extract_string(props, '$.k')::INT"


def k_of():
    """The number in an event's document."""
    return F.get_json_object("props", "$.k").cast("int")


@query("fusion_best_span", f"WITH f AS (SELECT event_type AS query, user_id AS camera, value AS a, value + {K} AS z, {K} > 5 AS ok FROM events WHERE event_type <> 'signup') SELECT q.query, b.camera, b.a AS start, b.z AS \"end\" FROM (SELECT DISTINCT event_type AS query FROM events) q LEFT JOIN (SELECT * FROM f WHERE ok QUALIFY row_number() OVER (PARTITION BY query ORDER BY z - a DESC, camera, a) = 1) b USING (query)")
def fusion_best_span(t: Tables):
    f = t.events.filter("event_type <> 'signup'").select(F.col("event_type").alias("query"), F.col("user_id").alias("camera"), F.col("value").alias("start"), (F.col("value") + k_of()).alias("end"), (k_of() > 5).alias("format_ok"))
    sound = f.filter("format_ok").withColumn("length", F.col("end") - F.col("start"))
    best = tables.latest(sound, ["query"], F.desc("length"), F.col("camera"), F.col("start"))
    return t.events.select(F.col("event_type").alias("query")).distinct().join(best, "query", "left").select("query", "camera", "start", "end")


@query("fusion_candidate_pairs", "WITH d AS (SELECT item_id AS id, item_id % 10 * 1.0 AS a, item_id % 10 + 6.0 AS z, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark) SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.w, y.w)) / greatest(len(x.w), len(y.w)), 6) AS likeness, round(greatest(least(x.z, y.z) - greatest(x.a, y.a), 0) / (greatest(x.z, y.z) - least(x.a, y.a)), 6) AS overlap FROM d x JOIN d y ON x.id < y.id AND x.id % 4 = y.id % 4")
def fusion_candidate_pairs(t: Tables):
    """Likeness and overlap of the reports of a group, as pairs."""
    d = t.benchmark.select(F.col("item_id").alias("id"), (F.col("item_id") % 4).alias("g"), (F.col("item_id") % 10).cast("double").alias("s"), (F.col("item_id") % 10 + 6.0).alias("e"), "text")
    y = d.select(*[F.col(c).alias(f"y_{c}") for c in d.columns])
    p = d.join(y, (F.col("g") == F.col("y_g")) & (F.col("id") < F.col("y_id")))
    return p.select(F.col("id").alias("a"), F.col("y_id").alias("b"), F.round(token_overlap(F.col("text"), F.col("y_text")), 6).alias("likeness"), F.round(fusion.hull_iou(F.col("s"), F.col("e"), F.col("y_s"), F.col("y_e")), 6).alias("overlap"))


@query("fusion_greedy_merge")
def fusion_greedy_merge(t: Tables):
    """All events, merged within a user; an hour of a user is too little to merge (one event at sf0.1)."""
    r = t.events.select(F.col("user_id").alias("grp"), F.col("event_id").alias("pos"), F.col("value").alias("start"), (F.col("value") + 60).alias("end"), F.concat_ws(" ", F.lit("a person"), "event_type", F.when(k_of() > 50, "again")).alias("description"))
    return fusion.merge_reports(r, "grp")


@query("fusion_counters", "SELECT count(*) AS raw, count(DISTINCT user_id || event_type) AS uniq, count(*) / greatest(count(DISTINCT user_id || event_type), 1) AS ratio FROM events")
def fusion_counters(t: Tables):
    u = F.countDistinct(F.concat(F.col("user_id").cast("string"), "event_type"))
    return t.events.agg(F.count(F.lit(1)).alias("raw"), u.alias("uniq"), (F.count(F.lit(1)) / F.greatest(u, F.lit(1))).alias("ratio"))


def detections(t: Tables):
    box = F.array(F.col("value") / 1000, k_of() / 200, F.lit(0.3), F.lit(0.3))
    return t.events.select((F.col("user_id") % 5).alias("camera"), F.col("event_id").alias("id"), F.floor(seconds("ts") / 600).cast("double").alias("t"), F.when(k_of() % 2 == 0, "person").otherwise("bag").alias("label"), box.alias("box"))


@query("track_greedy")
def track_greedy(t: Tables):
    return tracking.track(detections(t))


@query("track_summary")
def track_summary(t: Tables):
    return tracking.track_summary(detections(t))


@query("track_motion_gate")
def track_motion_gate(t: Tables):
    return tracking.motion_gate(t.events.select((F.col("user_id") % 20).alias("clip"), F.col("event_id").alias("frame"), (F.col("value") / 500).alias("level")))


SHOWN = f"SELECT epoch_us(ts) // 3600000000 AS win, 'cam' || user_id % 3 AS camera, event_id AS id, CASE WHEN user_id % 7 > 0 THEN 't' || user_id END AS track, CASE WHEN {K} % 4 = 0 THEN 'bag' WHEN {K} % 4 = 1 THEN 'bottle' ELSE 'person' END AS label, value / 500 AS c, event_type <> 'view' AS shelf FROM events"


@query("track_hypotheses", f"""WITH d AS ({SHOWN}),
i AS (SELECT win, camera, max(c) FILTER (label <> 'person') AS item, list(DISTINCT label ORDER BY label) AS objects, coalesce(list(DISTINCT track ORDER BY track) FILTER (label <> 'person' AND track IS NOT NULL), []) AS ts FROM d GROUP BY ALL),
p AS (SELECT win, camera, coalesce(track, 'untracked') AS subject, any_value(track) AS track, arg_min(c, id) AS c FROM d WHERE label = 'person' AND shelf GROUP BY 1, 2, 3)
SELECT {uuid5_sql("win || '|' || camera || '|suspicious_item_interaction|' || subject")} AS event_id, win, camera, track, round(least(c, item), 4) AS confidence, objects, list_concat(CASE WHEN track IS NULL THEN [] ELSE [track] END, ts) AS track_ids FROM p JOIN i USING (win, camera) WHERE item IS NOT NULL""")
def track_hypotheses(t: Tables):
    label = F.when(k_of() % 4 == 0, "bag").when(k_of() % 4 == 1, "bottle").otherwise("person")
    zones = F.when(F.col("event_type") != "view", F.array(F.lit("shelf"), F.lit("exit"))).otherwise(F.array(F.lit("exit")))
    d = t.events.select(
        F.floor(seconds("ts") / 3600).alias("win"), F.concat(F.lit("cam"), (F.col("user_id") % 3).cast("string")).alias("camera"), F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("track"), label.alias("label"), (F.col("value") / 500).alias("confidence"), zones.alias("zone_types"))
    return tracking.hypotheses(d)


COS = "(SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]"


@query("search_knn", f"SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], {COS})), 6) AS score FROM embeddings ORDER BY greatest(0, list_cosine_similarity(embedding::DOUBLE[], {COS})) DESC, vec_id LIMIT 10")
def search_knn(t: Tables):
    """The ten nearest to one vector, exactly."""
    q = t.embeddings.filter("vec_id = 0").select("embedding").first()[0]
    return search.nearest(t.embeddings, q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("search_metadata_filter", "SELECT event_id, event_type, ts FROM events WHERE event_type IN ('error', 'purchase') AND user_id < 50 ORDER BY ts DESC, event_id LIMIT 200")
def search_metadata_filter(t: Tables):
    return t.events.filter(F.col("event_type").isin("error", "purchase") & (F.col("user_id") < 50)).orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "event_type", "ts")


@query("search_fused", f"""WITH v AS (SELECT vec_id AS id, greatest(0, list_cosine_similarity(embedding::DOUBLE[], {COS})) AS vector FROM embeddings),
c AS (SELECT id, vector, event_type, text, epoch_us(ts) / 1e6 AS tt FROM v JOIN events ON event_id = id JOIN documents ON doc_id = id),
s AS (SELECT *, (tt - min(tt) OVER ()) / nullif(max(tt) OVER () - min(tt) OVER (), 0) AS r FROM c),
f AS (SELECT id, round(0.7 * vector + 0.2 * (event_type = 'error')::INT + 0.1 * coalesce(r, 1), 6) AS score, text FROM s)
SELECT id, round(score + 0.05 * len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')), ['the', 'with', 'from', 'this', 'errors'])), 6) AS score FROM f ORDER BY score DESC, id LIMIT 20""")
def search_fused(t: Tables):
    """Vectors, kinds and recency fused, then ranked again by the request's words."""
    q = t.embeddings.filter("vec_id = 0").select("embedding").first()[0]
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.greatest(F.lit(0.0), search.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q]))).alias("vector"))
    e = t.events.select(F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("matches"), seconds("ts").alias("at"))
    c = v.join(e, "id").join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return search.rerank(search.fuse(c), ["the", "with", "from", "this", "errors"], 20, "id").select("id", "score")


#: Requests of several wordings; a text of the benchmark follows.
SAID = ("show a person who picked an item and walked away ", "camera black near the EXIT ", "who left without paying at the till ", "bags by the shelf, came in ", "")
REQUEST = "CASE item_id % 5 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SAID[:-1])) + " ELSE '' END || coalesce(text, '')"


def request_text():
    prefix = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("item_id") % len(SAID) + 1).cast("int"))
    return F.concat(prefix, F.coalesce("text", F.lit("")))


def _listed(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _when(q: str, pattern: str, then: str, otherwise: str = "[]") -> str:
    return f"CASE WHEN regexp_matches({q}, '{pattern}') THEN {then} ELSE {otherwise} END"


def objects_sql(q: str) -> str:
    return f"list_filter({_listed(search.OBJECTS)}, lambda w: regexp_matches({q}, '\\b' || w || 's?\\b'))"


def routes_sql(q: str) -> str:
    return "list_filter([" + ", ".join(_when(q, pattern, f"'{zone}'", "NULL") for pattern, zone in search.ROUTES) + "], lambda z: z IS NOT NULL)"


def kinds_sql(q: str) -> str:
    """The kinds of event that a request in lower case stands for, as SQL of the operator's own patterns."""
    parts = [_when(q, pattern, _listed(kinds)) for pattern, kinds in search.INTENTS]
    parts.append(f"CASE WHEN len({objects_sql(q)}) > 0 THEN {_when(q, search.LEAVING, _listed(search.LOSSES))} ELSE [] END")
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


@query("search_request_kinds", f"WITH r AS (SELECT item_id, lower({REQUEST}) AS q FROM benchmark) SELECT item_id, {kinds_sql('q')} AS kinds, {routes_sql('q')} AS routes, {objects_sql('q')} AS objects FROM r")
def search_request_kinds(t: Tables):
    """Requests of several wordings as kinds of event, zones and things."""
    return t.benchmark.select("item_id", search.request_columns(request_text()).alias("r")).select("item_id", "r.kinds", "r.routes", "r.objects")


@query("search_text_repr_events", "SELECT event_id, 'seen_' || event_type || ' at cam' || user_id || CASE WHEN event_type = 'view' THEN ' [shelf]' ELSE '' END || ' objects: person' || CASE WHEN value > 400 THEN ' severity=high' ELSE '' END AS text FROM events")
def search_text_repr_events(t: Tables):
    z = F.when(F.col("event_type") == "view", F.array(F.lit("shelf"))).otherwise(F.array().cast("array<string>"))
    return t.events.select("event_id", describe_event(F.concat(F.lit("seen_"), F.col("event_type")), F.concat(F.lit("cam"), F.col("user_id").cast("string")), z, F.array(F.lit("person")), F.when(F.col("value") > 400, "high").otherwise("info")).alias("text"))


@query("search_text_repr_observations", "SELECT conv_id, turn, 'verdict: ' || role || CASE WHEN turn % 2 = 0 THEN ' actions: look, take' ELSE '' END || CASE WHEN text <> '' THEN ' ' || left(text, 400) ELSE '' END AS text FROM conversations")
def search_text_repr_observations(t: Tables):
    acts = F.when(F.col("turn") % 2 == 0, F.array(F.lit("look"), F.lit("take"))).otherwise(F.array().cast("array<string>"))
    return t.conversations.select("conv_id", "turn", describe_observation(F.col("role"), F.lit(None).cast("string"), acts, F.col("text")).alias("text"))


@query("search_hash_vectors", """WITH h AS (SELECT item_id, list_aggregate([sha256('text:' || text || '|' || i) for i in range(48)], 'string_agg', '') AS h FROM benchmark),
v AS (SELECT item_id, [('0x' || substr(h, 4 * j + 1, 4))::BIGINT / 65535 * 2 - 1 for j in range(768)] AS v FROM h)
SELECT item_id, [round(x / sqrt(list_sum([y * y for y in v])), 9) for x in v] AS vector FROM v""")
def search_hash_vectors(t: Tables):
    return search.hash_vectors(t.benchmark, "item_id", "text").select("item_id", F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))


@query("search_projection")
def search_projection(t: Tables):
    return search.project_vectors(t.embeddings, "vec_id", "embedding", 64, 16)


@query("index_upsert", "SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 7 = 0")
def index_upsert(t: Tables):
    e = t.embeddings.select("vec_id", "label")
    return tables.replace_keys(e, e.filter("vec_id % 7 = 0").withColumn("label", F.col("label") + 100), ["vec_id"])


@query("infer_once_per_key", "SELECT event_id, event_type || '!' AS verdict FROM events")
def infer_once_per_key(t: Tables):
    """A costly function runs once per distinct input, and its results are joined back."""
    keys = t.events.select(F.col("event_type").alias("k")).distinct().withColumn("verdict", F.concat("k", F.lit("!")))
    return t.events.join(keys, F.col("event_type") == F.col("k")).select("event_id", "verdict")


@query("evidence_timeline", "SELECT 'turn' AS kind, conv_id AS id, NULL::TIMESTAMP AS at, turn AS sub FROM conversations UNION ALL SELECT 'event', event_id, ts, 0 FROM events")
def evidence_timeline(t: Tables):
    """Events and observations in one order, those without a time last."""
    a = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.lit(0).cast("long").alias("sub"))
    b = t.conversations.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("turn").cast("long").alias("sub"))
    return a.unionByName(b).orderBy(F.col("at").asc_nulls_last(), "kind", "id", "sub")


@query("evidence_window", "SELECT user_id, min(ts) - INTERVAL 20 SECOND AS a, min(ts) + INTERVAL 20 SECOND AS z FROM events WHERE event_type = 'error' GROUP BY 1")
def evidence_window(t: Tables):
    at = F.min("ts")
    return t.events.filter("event_type = 'error'").groupBy("user_id").agg((at - F.expr("INTERVAL 20 SECONDS")).alias("a"), (at + F.expr("INTERVAL 20 SECONDS")).alias("z"))


@query("evidence_headline", "SELECT conv_id, arg_max(text, turn) AS headline, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1")
def evidence_headline(t: Tables):
    return t.conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("headline"), F.count(F.lit(1)).alias("n"))


@query("evidence_package")
def evidence_package(t: Tables):
    """A case as one document: its parts in order, counts, custody digest."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    p = t.conversations.groupBy("conv_id").agg(parts.alias("timeline"))
    return p.select("conv_id", F.size("timeline").alias("n"), F.to_json(F.struct("conv_id", "timeline")).alias("package")).withColumn("sha256", F.sha2("package", 256))


@query("evidence_review", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'confirmed' WHEN '5-LOW' THEN 'dismissed' ELSE o_orderstatus END AS status FROM orders")
def evidence_review(t: Tables):
    decision = F.when(F.col("o_orderpriority") == "1-URGENT", "approve").when(F.col("o_orderpriority") == "5-LOW", "reject").otherwise("later")
    return t.orders.select("o_orderkey", governance.decide(F.col("o_orderstatus"), decision).alias("status"))


@query("evidence_audit_append", "SELECT conv_id, [role, 'approve'] AS log FROM conversations WHERE turn = 0")
def evidence_audit_append(t: Tables):
    return t.conversations.filter("turn = 0").select("conv_id", F.array_append(F.array("role"), F.lit("approve")).alias("log"))


LINES = f"SELECT epoch_us(ts) / 1e6 AS s, event_id AS o, 'cam' || user_id % 4 AS camera, strftime(ts, '%H:%M:%S') || ' cam' || user_id % 4 || ': ' || event_type || ' seen' || CASE WHEN {K} % 2 = 0 THEN ' near shelf, exit' ELSE '' END || ' (objects: person)' || CASE WHEN {K} % 3 = 0 THEN ' — VLM: took ' || {K} WHEN {K} % 3 = 1 THEN ' — VLM verdict: benign' ELSE '' END AS line FROM events WHERE event_type IN ('error', 'purchase')"
MODE = "loss_prevention"


def _fold_sql(level: str, lead: str, source: str, bucket: str, order: str, camera: str) -> str:
    rows = f"SELECT {bucket} AS bucket, list(line ORDER BY {order}) AS items, {camera} AS camera FROM {source} GROUP BY 1"
    if level == "clip":
        body, scope = "array_to_string(items[1:4], '; ') || CASE WHEN len(items) > 4 THEN '; (+' || len(items) - 4 || ' more)' ELSE '' END", f"' [camera=' || camera || ', mode={MODE}]'"
    else:
        body, scope = f"'{lead}: ' || len(items) || ' sub-summaries. ' || items[1] || CASE WHEN len(items) > 1 THEN ' Other notable: ' || items[2] ELSE '' END", f"' [mode={MODE}]'"
    return f"SELECT bucket, len(items)::INT AS n, {body} || {scope} || ' (sum:' || left(sha256(array_to_string(items, '|') || '#{level}'), 8) || ')' AS line FROM ({rows})"


FOLD = f"""WITH e AS ({LINES}),
c AS ({_fold_sql("clip", "", "e", "floor((s - (SELECT min(s) FROM e)) / 10)::BIGINT", "o", "arg_min(camera, o)")}),
f AS ({_fold_sql("5min", "5-minute window", "c", "bucket * 10 // 300", "bucket", "''")}),
h AS ({_fold_sql("hour", "1-hour window", "f", "bucket * 300 // 3600", "bucket", "''")}),
r AS ({_fold_sql("report", "incident-aware report", "h", "0", "bucket", "''")})"""


def _suspicious(t: Tables):
    """Events as a summary takes them."""
    k, none = k_of(), F.array().cast("array<string>")
    zones = F.when(k % 2 == 0, F.array(F.lit("shelf"), F.lit("exit"))).otherwise(none)
    said = F.when(k % 3 == 0, F.concat(F.lit("took "), k.cast("string")))
    e = t.events.filter(F.col("event_type").isin("error", "purchase"))
    return e.select(
        seconds("ts").alias("s"), "ts", F.col("event_id").alias("order"), F.concat(F.lit("cam"), (F.col("user_id") % 4).cast("string")).alias("camera"), F.concat("event_type", F.lit("_seen")).alias("kind"),
        zones.alias("zones"), F.when(k % 3 == 1, "benign").alias("verdict"), said.alias("explanation"), F.when(k % 5 == 0, F.array(F.lit("billing footage"))).alias("missing"))


def _staged(t: Tables):
    line = summary.caption(F.col("ts"), F.col("camera"), F.col("kind"), F.col("zones"), F.array(F.lit("person")), F.col("verdict"), F.col("explanation"))
    return summary.staged(_suspicious(t).withColumn("line", line), MODE)


@query("summary_clips", f"{FOLD} SELECT bucket, n, line FROM c")
def summary_clips(t: Tables):
    return _staged(t)["clip"]


@query("summary_five_minutes", f"{FOLD} SELECT bucket, n, line FROM f")
def summary_five_minutes(t: Tables):
    return _staged(t)["5min"]


@query("summary_hours", f"{FOLD} SELECT bucket, n, line FROM h")
def summary_hours(t: Tables):
    return _staged(t)["hour"]


@query("summary_report", f"{FOLD} SELECT n, line FROM r")
def summary_report(t: Tables):
    return _staged(t)["report"]


@query("summary_stats", f"{FOLD} SELECT (SELECT count(*) FROM c) AS clips, (SELECT count(*) FROM f) AS fives, (SELECT count(*) FROM h) AS hours")
def summary_stats(t: Tables):
    e = _suspicious(t)
    clip = F.floor((F.col("s") - e.agg(F.min("s")).scalar()) / 10)
    count = lambda span: F.countDistinct(F.floor(F.col("clip") * 10 / span))
    return e.select(clip.alias("clip")).agg(count(10).alias("clips"), count(300).alias("fives"), count(3600).alias("hours"))


@query("summary_timeline", f"SELECT strftime(ts, '%H:%M:%S') AS time, 'cam' || user_id % 4 AS camera, CASE WHEN {K} % 3 = 0 THEN 'took ' || {K} ELSE event_type || ' seen' || CASE WHEN {K} % 2 = 0 THEN ' near shelf, exit' ELSE '' END END AS event, event_id AS evidence_segment_id FROM events WHERE event_type IN ('error', 'purchase')")
def summary_timeline(t: Tables):
    """The suspicious moments of a report."""
    e = _suspicious(t)
    return e.select(F.date_format("ts", "HH:mm:ss").alias("time"), "camera", summary.moment(F.col("kind"), F.col("zones"), F.col("explanation")).alias("event"), F.col("order").alias("evidence_segment_id"))


@query("summary_open_questions", f"WITH e AS (SELECT event_id AS o, strftime(ts, '%H:%M') AS clock, 'cam' || user_id % 4 AS camera, {K} AS k FROM events WHERE event_type IN ('error', 'purchase')), c AS (SELECT list(DISTINCT camera ORDER BY camera) AS cs FROM e), q AS (SELECT o, 'Around ' || clock || ' on ' || camera || ': obtain billing footage.' AS question FROM e WHERE k % 5 = 0 UNION ALL SELECT o, 'Check ' || array_to_string(list_filter(cs, lambda x: x <> camera), ', ') || ' for the same person around ' || clock || ' (suspicious activity on ' || camera || ').' FROM e, c WHERE len(cs) > 1) SELECT question, min(o) AS first FROM q GROUP BY 1")
def summary_open_questions(t: Tables):
    return summary.open_questions(_suspicious(t))


@query("summary_review_items", "SELECT coalesce(CASE WHEN user_id % 2 = 0 THEN user_id END, event_id) AS item, min(event_id) AS first FROM events WHERE event_type = 'error' AND value > 300 GROUP BY 1")
def summary_review_items(t: Tables):
    item = F.coalesce(F.when(F.col("user_id") % 2 == 0, F.col("user_id")), F.col("event_id"))
    return t.events.filter("event_type = 'error' AND value > 300").groupBy(item.alias("item")).agg(F.min("event_id").alias("first"))


@query("summary_parity", "SELECT round(least(1, (SELECT count(*) FROM labels WHERE quality = 1) / 500.0), 3) AS quality, round(least(1, (SELECT count(*) FROM benchmark) / 20.0), 3) AS benchmark")
def summary_parity(t: Tables):
    q = t.labels.agg(summary.parity(F.count_if(F.col("quality") == 1), 500.0).alias("quality"))
    return q.withColumn("benchmark", t.benchmark.agg(summary.parity(F.count(F.lit(1)), 20.0)).scalar())


@query("metric_instant", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL")
def metric_instant(t: Tables):
    rows = t.events.filter(F.col("event_type").rlike("^(?:error|view)$")).withColumn("at", F.struct("ts", "event_id"))
    return metrics.instant(rows, ["user_id", "event_type"], "at", "value")


@query("metric_aggregate_by", "SELECT event_type, sum(v) AS total, avg(v) AS mean, max(v) AS high, count(*) AS series FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL) GROUP BY 1")
def metric_aggregate_by(t: Tables):
    last = metrics.instant(t.events.withColumn("at", F.struct("ts", "event_id")), ["user_id", "event_type"], "at", "value")
    return last.groupBy("event_type").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("high"), F.count(F.lit(1)).alias("series"))


@query("metric_rate", "WITH d AS (SELECT event_type, epoch_us(ts) / 1e6 AS s, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) SELECT event_type, floor(s / 3600)::BIGINT AS bucket, sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END) / 3600 AS rate FROM d GROUP BY ALL")
def metric_rate(t: Tables):
    return metrics.rate(t.events, ["event_type"], ["event_id"], "value", seconds("ts"), 3600.0)


BOUNDS = [5.0, 20.0, 50.0, 100.0, 200.0]


@query("metric_histogram", "SELECT event_type, le, n FROM (SELECT event_type, unnest([5, 20, 50, 100, 200, 'inf'::DOUBLE]) AS le, unnest([count(*) FILTER (value <= 5), count(*) FILTER (value <= 20), count(*) FILTER (value <= 50), count(*) FILTER (value <= 100), count(*) FILTER (value <= 200), count(*)]) AS n FROM events GROUP BY 1)")
def metric_histogram(t: Tables):
    return metrics.histogram(t.events, ["event_type"], "value", BOUNDS)


@query("metric_histogram_quantile", "WITH b AS (SELECT event_type, unnest([5, 20, 50, 100, 200]) AS le, unnest([0, 5, 20, 50, 100]) AS lo, unnest([count(*) FILTER (value <= 5), count(*) FILTER (value <= 20), count(*) FILTER (value <= 50), count(*) FILTER (value <= 100), count(*) FILTER (value <= 200)]) AS n, unnest([0, count(*) FILTER (value <= 5), count(*) FILTER (value <= 20), count(*) FILTER (value <= 50), count(*) FILTER (value <= 100)]) AS u, count(*) AS tot FROM events GROUP BY 1), h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS r FROM b WHERE n >= 0.9 * tot) SELECT t.event_type, coalesce((SELECT lo + (le - lo) * (0.9::DOUBLE * tot - u) / (n - u) FROM h WHERE h.event_type = t.event_type AND r = 1), 200)::DOUBLE AS quantile FROM (SELECT DISTINCT event_type FROM events) t")
def metric_histogram_quantile(t: Tables):
    return metrics.histogram_quantile(0.9, metrics.histogram(t.events, ["event_type"], "value", BOUNDS), ["event_type"])


@query("metric_compare_count", "SELECT count(*) AS n FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1) WHERE v > 50")
def metric_compare_count(t: Tables):
    return metrics.instant(t.events.withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at", "value").filter("value > 50").agg(F.count(F.lit(1)).alias("n"))


@query("metric_distinct_series", "SELECT count(DISTINCT source) AS sources FROM documents")
def metric_distinct_series(t: Tables):
    return t.documents.agg(F.countDistinct("source").alias("sources"))


@query("metric_scalar_arith", "SELECT event_type, greatest(60 * avg(value) / 1000, 1) AS per_minute FROM events GROUP BY 1")
def metric_scalar_arith(t: Tables):
    return t.events.groupBy("event_type").agg(F.greatest(60 * F.avg("value") / 1000, F.lit(1.0)).alias("per_minute"))


@query("metric_backlog", "SELECT epoch_us(ts) // 86400000000 AS day, sum(sum((event_type = 'view')::INT) - sum((event_type = 'click')::INT)) OVER (ORDER BY epoch_us(ts) // 86400000000)::BIGINT AS backlog FROM events GROUP BY 1")
def metric_backlog(t: Tables):
    """Created less processed, as it stands after each day."""
    d = t.events.groupBy(F.floor(seconds("ts") / 86400).alias("day")).agg((F.count_if(F.col("event_type") == "view") - F.count_if(F.col("event_type") == "click")).alias("d"))
    return d.select("day", F.sum("d").over(Window.orderBy("day")).alias("backlog"))


@query("metric_log_selector", f"SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND {K} >= 50 GROUP BY 1")
def metric_log_selector(t: Tables):
    """Log lines by label and by a field of their document."""
    return t.events.filter((F.col("event_type") == "error") & (F.from_json("props", "k int")["k"] >= 50)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("econ_benchmark", "WITH r AS (SELECT l_returnflag, l_extendedprice AS ms FROM lineitem) SELECT l_returnflag, count(*) AS n, round(count(*) / greatest(sum(ms) / 1000, 1e-9) * 60, 4) AS per_minute, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(avg(100 / (ms / 1000)), 4) AS tokens_per_sec, round(70 * greatest(sum(ms) / 1000, 1e-9) / 3600, 6) AS wh, round(70 * greatest(sum(ms) / 1000, 1e-9) / 3600 / 1000 * 10 / count(*) * 1000, 6) AS cost_per_1000 FROM r GROUP BY 1")
def econ_benchmark(t: Tables):
    r = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("latency_ms"), (100 / (F.col("l_extendedprice") / 1000)).alias("tokens_per_sec"))
    return economics.benchmark(r, ["l_returnflag"], 70.0)


@query("econ_economy", "SELECT round(avg(value), 2) AS avg_power_w, round(avg(value) * 556.5 / 3600, 4) AS energy_wh, round(avg(value) * 556.5 / 3600 / 1000 * 10, 6) AS cost, round(141 / greatest(avg(value) * 556.5 / 3600, 0.001), 2) AS events_per_wh, round(avg(value) * 556.5 / 3600 / 1000 * 10 / 141, 6) AS cost_per_event FROM events")
def econ_economy(t: Tables):
    return economics.economy(t.events, "value", 556.5, 141)


@query("econ_rollback", "SELECT user_id, nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def econ_rollback(t: Tables):
    """The profile before the current one, repeats aside."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    changes = t.events.withColumn("p", F.lag("event_type").over(w)).filter("p IS NULL OR p <> event_type")
    last = changes.groupBy("user_id").agg(F.max_by("p", "event_id").alias("previous"))
    return last.select("user_id", "previous")


@query("gov_retention_plan", "WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 100), e AS (SELECT *, ts <= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AS gone, user_id IN (SELECT user_id FROM l) AS held FROM events) SELECT event_type, count(*) AS total, count(*) FILTER (gone AND held) AS locked_skipped, count(*) FILTER (gone AND NOT held) AS would_delete FROM e GROUP BY 1")
def gov_retention_plan(t: Tables):
    gone = governance.expired(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 14)
    return governance.retention_plan(t.events, gone, t.events.filter("event_type = 'signup' AND value > 100").select("user_id"), "user_id", "event_type")


@query("gov_retention_apply", "SELECT event_id FROM events WHERE NOT (ts <= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100))")
def gov_retention_apply(t: Tables):
    gone = governance.expired(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 14)
    return tables.delete_where(t.events.select("event_id", "ts", "user_id"), gone, t.events.filter("event_type = 'signup' AND value > 100").select("user_id"), "user_id").select("event_id")


_MARKED = r"regexp_replace(regexp_replace({}, '(?i)([=:]\s*)(\S*\*\*\*REDACTED)', '\1' || chr(1) || '\2', 'g'), '(?i)([=:]\s*)(bearer)(\s|$)', '\1' || chr(1) || '\2\3', 'g')"
_VALUES = r"""(?i)\b([\w.-]*(?:password|passwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth)[\w.-]*)\s*[=:]\s*("[^"]*"|''[^'']*''|[^\s\x01]\S*)"""


# RE2 has no lookahead: values that stay as they are are marked before and unmarked after
@query("gov_redact", r"WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-zA-Z][\w+.-]*://)([^:/?#\s]+):([^@/?#\s]+)@', '\1\2:***REDACTED***@', 'g'), '(?i)\bbearer\s+[A-Za-z0-9._\-]+', 'Bearer ***REDACTED***', 'g'), '\bhf_[A-Za-z0-9]{10,}\b', '***REDACTED***', 'g'), '\b(sk|pk|key|tok)-[A-Za-z0-9_\-]{8,}\b', '***REDACTED***', 'g') AS x FROM documents) SELECT doc_id, replace(regexp_replace(" + _MARKED.format("x") + ", '" + _VALUES + r"', '\1=***REDACTED***', 'g'), chr(1), '') AS text FROM a")
def gov_redact(t: Tables):
    return t.documents.select("doc_id", redact(F.col("text")).alias("text"))


@query("gov_roles", "WITH r(k, role_rank) AS (VALUES (0, 0), (1, 1), (2, 2), (3, NULL)), a(j, least_rank) AS (VALUES (0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, NULL)) SELECT n_name, coalesce(role_rank >= least_rank, FALSE) AS may FROM nation JOIN r ON n_nationkey % 4 = k JOIN a ON n_nationkey % 7 = j")
def gov_roles(t: Tables):
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("n_nationkey") % len(names) + 1).cast("int"))
    role = pick(["viewer", "reviewer", "admin", "guest"])
    act = pick(["read", "approve", "reject", "activate-profile", "retention", "backup", "purge"])
    return t.nation.select("n_name", governance.may(role, act).alias("may"))


@query("text_coercions", "SELECT event_id, CASE WHEN value > 100 THEN 1.0 WHEN value > 1 THEN value / 100 ELSE value END AS confidence FROM events")
def text_coercions(t: Tables):
    return t.events.select("event_id", confidence(F.col("value").cast("string")).alias("confidence"))


@query("text_as_list", "SELECT item_id, ['a', 'b' || item_id] AS parts FROM benchmark")
def text_as_list(t: Tables):
    return t.benchmark.select("item_id", as_list(F.concat(F.lit("a; b"), F.col("item_id").cast("string"), F.lit(";\n"))).alias("parts"))
