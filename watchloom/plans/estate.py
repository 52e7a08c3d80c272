"""Queries over what a store has and costs: zones, runtimes, months, parity, retention, blobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom import schemas
from watchloom.functions.scalar import seconds
from watchloom.functions.text import describe_event
from watchloom.operators import economics, governance, inference, summary, tables, twin
from watchloom.operators.windows import heatmap
from watchloom.plans.registry import SQL, Tables, query
from watchloom.sources import files

#: Zones as suppliers have them: of the camera that is their nation, with corners that follow from their key.
_ZONES = """SELECT s_suppkey AS zone, s_nationkey + CASE WHEN s_suppkey % 11 = 0 THEN 100 ELSE 0 END AS camera, CASE s_suppkey % 3 WHEN 0 THEN 'shelf' WHEN 1 THEN 'exit' ELSE 'billing_counter' END AS zone_type,
  CASE WHEN s_suppkey % 5 = 0 THEN 2 WHEN s_suppkey % 17 = 0 THEN NULL ELSE 4 END AS corners, CASE WHEN s_suppkey % 7 = 0 THEN 2 WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS fault FROM supplier"""


def zones_of(t: Tables):
    """The same: every seventh zone has a corner outside the frame, every thirteenth one of a single number."""
    key = F.col("s_suppkey")
    unit = (key % 10) / 20
    last = F.when(key % 7 == 0, F.array(F.lit(0.2), F.lit(1.5))).when(key % 13 == 0, F.array(F.lit(0.3))).otherwise(F.array(unit, F.lit(0.9)))
    corners = F.array(F.array(unit, F.lit(0.1)), F.array(unit + 0.4, F.lit(0.1)), F.array(unit + 0.4, F.lit(0.9)), last)
    polygon = F.when(key % 5 == 0, F.slice(corners, 3, 2)).when(key % 17 != 0, corners)
    camera = F.col("s_nationkey") + F.when(key % 11 == 0, 100).otherwise(0)
    kind = F.when(key % 3 == 0, "shelf").when(key % 3 == 1, "exit").otherwise("billing_counter")
    return t.supplier.select(key.alias("zone"), camera.alias("camera"), kind.alias("zone_type"), polygon.alias("polygon"))


@query("geo_twin_validate", f"WITH z AS ({_ZONES}) SELECT zone, 'unknown camera' AS problem FROM z WHERE camera NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT zone, CASE WHEN corners IS NULL OR corners < 3 THEN 'fewer than 3 corners' WHEN fault = 1 THEN 'malformed corner' ELSE 'corner outside the frame' END FROM z WHERE coalesce(corners, 0) < 3 OR fault > 0")
def geo_twin_validate(t: Tables):
    """What is wrong with each configured zone."""
    return twin.problems(zones_of(t), t.nation.select(F.col("n_nationkey").alias("camera")))


@query("geo_twin_summary", f"WITH z AS ({_ZONES}) SELECT 'cameras' AS what, NULL AS name, count(*) AS n FROM nation UNION ALL SELECT 'zones', NULL, count(*) FROM z UNION ALL SELECT 'type', zone_type, count(*) FROM z GROUP BY zone_type UNION ALL SELECT 'blind', CAST(n_nationkey AS VARCHAR), 1 FROM nation WHERE n_nationkey NOT IN (SELECT camera FROM z)")
def geo_twin_summary(t: Tables):
    """Counts of cameras and zones, zones by type, and cameras that see none."""
    return twin.coverage(zones_of(t), t.nation.select(F.col("n_nationkey").alias("camera")))


@query("geo_event_point", "SELECT event_id, CASE WHEN user_id % 3 = 0 AND value > 100 THEN value / 500 WHEN user_id % 4 = 0 THEN value / 1000 WHEN user_id % 5 <> 0 THEN (value / 500 + 0.5) / 2 END AS x, CASE WHEN user_id % 3 = 0 AND value > 100 THEN 0.1 WHEN user_id % 4 = 0 THEN 0.2 WHEN user_id % 5 <> 0 THEN (0.3 + 0.5) / 2 END::DOUBLE AS y FROM events")
def geo_event_point(t: Tables):
    """Where events are, by the first of three ways of saying it that is whole."""
    v, u = F.col("value"), F.col("user_id")
    x, y = F.when(u % 3 == 0, v / 500), F.when(v > 100, F.lit(0.1))  # whole only where both are there
    box = F.when(u % 5 != 0, F.array(v / 500, F.lit(0.3), F.lit(0.5), F.lit(0.5))).otherwise(F.array(v, v))
    e = t.events.withColumn("p", twin.event_point(x, y, F.when(u % 4 == 0, v / 1000), F.lit(0.2), box))
    return e.select("event_id", "p.x", "p.y")


_RUNS = """WITH r AS (SELECT l_returnflag AS task, 'r' || l_suppkey % 6 AS runtime, count(*) / sum(l_extendedprice) AS cpm, quantile_cont(l_extendedprice, 0.95) AS p95, 1 - avg(l_discount) AS quality, avg(l_tax) AS cost FROM lineitem GROUP BY ALL),
k AS (SELECT *, runtime NOT IN ('r1', 'r4') AS available, CASE WHEN runtime IN ('r0', 'r3') THEN 3 WHEN runtime = 'r2' THEN 2 ELSE 1 END AS portable FROM r),
s AS (SELECT *, round(0.35::DOUBLE * coalesce((cpm - min(cpm) OVER w) / nullif(max(cpm) OVER w - min(cpm) OVER w, 0), 1) + 0.25::DOUBLE * coalesce((max(p95) OVER w - p95) / nullif(max(p95) OVER w - min(p95) OVER w, 0), 1)
  + 0.25::DOUBLE * coalesce((quality - min(quality) OVER w) / nullif(max(quality) OVER w - min(quality) OVER w, 0), 1) + 0.15::DOUBLE * coalesce((max(cost) OVER w - cost) / nullif(max(cost) OVER w - min(cost) OVER w, 0), 1), 4) AS score FROM k WINDOW w AS (PARTITION BY task))"""


def runs_of(t: Tables):
    """Suppliers in six groups as runtimes of the tasks that the return flags are."""
    li = t.lineitem.select(F.col("l_returnflag").alias("task"), F.concat(F.lit("r"), (F.col("l_suppkey") % 6).cast("string")).alias("runtime"), "l_extendedprice", "l_discount", "l_tax")
    by = ["task", "runtime"]
    means = li.groupBy(*by).agg((F.count(F.lit(1)) / F.sum("l_extendedprice")).alias("cpm"), (1 - F.avg("l_discount")).alias("quality"), F.avg("l_tax").alias("cost"))
    p95 = economics.percentiles(li, by, "l_extendedprice", {"p95": 0.95})
    r, name = means.join(p95, by), F.col("runtime")
    portable = F.when(name.isin("r0", "r3"), 3).when(name == "r2", 2).otherwise(1)
    return r.select(*by, "cpm", "p95", "quality", "cost", (~name.isin("r1", "r4")).alias("available"), portable.alias("portable"))


@query("econ_bakeoff", f"{_RUNS} SELECT task, runtime, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, runtime)::INT AS place FROM s")
def econ_bakeoff(t: Tables):
    """Runtimes of each task by a weighted score of measures scaled between the task's worst and best."""
    return economics.ranked(runs_of(t), ["task"]).select("task", "runtime", "score", "place")


@query("econ_bakeoff_pick", f"{_RUNS}, p AS (SELECT task, first(runtime ORDER BY available DESC, score DESC, runtime) AS production FROM s GROUP BY 1) SELECT p.task, production, coalesce(first(runtime ORDER BY available DESC, portable DESC, score DESC, runtime) FILTER (runtime <> production), production) AS fallback FROM p JOIN s ON s.task = p.task GROUP BY p.task, production")
def econ_bakeoff_pick(t: Tables):
    """What each task runs on: the best available runtime, and of the others the most robust one to fall back to."""
    return economics.picked(economics.ranked(runs_of(t), ["task"]), ["task"])


@query("econ_tco_bundle", "SELECT s_suppkey, round(w / 1000 * 10, 6) AS hour, CASE WHEN cpm > 0 THEN round(w * (1000 / (cpm / 60)) / 3600 / 1000 * 10, 6) ELSE 0 END AS per_1000, CASE WHEN cameras > 0 THEN round(w * 24 * 30 / 1000 * 10 / cameras, 6) ELSE 0 END AS camera_month, round(w * 24 * 30 / 1000 * 10, 6) AS store_month FROM (SELECT s_suppkey, abs(s_acctbal) / 100 AS w, s_suppkey % 9 AS cpm, s_nationkey AS cameras FROM supplier)")
def econ_tco_bundle(t: Tables):
    """What a box costs: an hour, a thousand clips, a camera's and a store's month of steady load."""
    watts, cpm, cameras = F.abs("s_acctbal") / 100, F.col("s_suppkey") % 9, F.col("s_nationkey")
    costs = {"hour": economics.per_hour(watts), "per_1000": economics.per_clips(watts, cpm), "camera_month": economics.camera_month(watts, cameras), "store_month": economics.store_month(watts)}
    return t.supplier.select("s_suppkey", *[F.round(c, 6).alias(n) for n, c in costs.items()])


@query("parity_report", """WITH d AS (SELECT 'rt_cv' AS capability, 'measured' AS status, count(*)::DOUBLE AS value, 50.0 AS enough FROM events WHERE event_type IS NOT NULL
UNION ALL SELECT 'rt_embedding', 'measured', count(*), 50 FROM embeddings UNION ALL SELECT 'search', CASE WHEN count(*) = 0 THEN 'pending' ELSE 'measured' END, count(*), 50 FROM embeddings
UNION ALL SELECT 'vios', 'measured', count(*), 20 FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'lvs', 'measured', (count(DISTINCT epoch_us(ts) // 60000000) > 0 AND count(DISTINCT epoch_us(ts) // 300000000) > 0 AND count(DISTINCT epoch_us(ts) // 3600000000) > 0)::INT, 1 FROM events
UNION ALL SELECT 'audio', 'pending', NULL, NULL)
SELECT capability, status, value, score, round(avg(score) OVER (), 3) AS overall, count(value) OVER () AS measurable FROM (SELECT *, CASE WHEN value IS NOT NULL THEN round(least(1, value / enough), 3) END AS score FROM d)""")
def parity_report(t: Tables):
    """How far each capability is there: a share of what is enough of its traces; one without a table is pending and doesn't
    count."""
    count = lambda df: df.agg(F.count(F.lit(1)).cast("double").alias("value"))
    s = seconds("ts")
    nests = t.events.agg((F.least(*[F.count_distinct(F.floor(s / w)) for w in (60, 300, 3600)]) > 0).cast("double").alias("value"))
    return summary.parity_report({
        "rt_cv": (count(t.events.filter("event_type IS NOT NULL")), 50.0), "rt_embedding": (count(t.embeddings), 50.0), "search": (count(t.embeddings), 50.0),
        "vios": (count(t.conversations.filter("role = 'assistant'")), 20.0), "lvs": (nests, 1.0), "audio": (None, None)}, empty_is_pending=("search",))


@query("gov_retention_audited", "WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 100), e AS (SELECT event_type, ts <= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AS gone, user_id IN (SELECT user_id FROM l) AS held FROM events) SELECT 'retention.apply' AS action, event_type AS target, CAST(count(*) FILTER (gone AND NOT held) AS VARCHAR) AS deleted, CAST(count(*) FILTER (gone AND held) AS VARCHAR) AS held, (SELECT count(*) FROM e WHERE NOT gone OR held) AS left_over FROM e GROUP BY 2")
def gov_retention_audited(t: Tables):
    """A retention run as it is carried out: the rows that stay are written, and what went is an audit row for each kind."""
    path = files.scratch(t.spark, "retention")
    e = t.events.select("event_id", "ts", "user_id", "event_type")
    gone = governance.expired(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 14)
    locked = t.events.filter("event_type = 'signup' AND value > 100").select("user_id")
    plan = governance.retention_plan(e, gone, locked, "user_id", "event_type")
    tables.delete_where(e, gone, locked, "user_id").write.parquet(f"{path}/kept")
    told = F.create_map(F.lit("deleted"), F.col("would_delete").cast("string"), F.lit("held"), F.col("locked_skipped").cast("string"))
    files.append_audit(plan.select(F.current_timestamp().alias("ts"), F.lit("retention.apply").alias("action"), F.lit("retention").alias("actor"), F.col("event_type").alias("target"), told.alias("fields")), f"{path}/audit")
    left = t.spark.read.schema(e.schema).parquet(f"{path}/kept").agg(F.count(F.lit(1)).alias("left_over"))
    audit = t.spark.read.schema("ts timestamp, action string, actor string, target string, fields map<string,string>").parquet(f"{path}/audit")
    return audit.select("action", "target", F.col("fields")["deleted"].alias("deleted"), F.col("fields")["held"].alias("held")).crossJoin(left)  # one row


@query("evidence_window_or_span", "WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS a, CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) / 1e6 + value END AS z, event_type FROM events), g AS (SELECT user_id, min(a) FILTER (event_type = 'error' AND user_id % 2 = 0) AS anchor, min(a) AS first, max(z) AS last FROM s GROUP BY 1) SELECT user_id, CASE WHEN anchor IS NOT NULL THEN anchor - 20 WHEN last IS NOT NULL THEN first END AS from_s, CASE WHEN anchor IS NOT NULL THEN anchor + 20 ELSE last END AS to_s FROM g")
def evidence_window_or_span(t: Tables):
    """Twenty seconds about a case's event or, of a case without one, all that its segments cover; null if they cover nothing."""
    s = seconds("ts")
    end = F.when(F.col("event_id") % 3 > 0, s + F.col("value"))
    g = t.events.groupBy("user_id").agg(F.min(F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), s)).alias("anchor"), F.min(s).alias("first"), F.max(end).alias("last"))
    known = F.col("anchor").isNotNull()
    return g.select("user_id", F.when(known, F.col("anchor") - 20).when(F.col("last").isNotNull(), F.col("first")).alias("from_s"), F.when(known, F.col("anchor") + 20).otherwise(F.col("last")).alias("to_s"))


@query("ingest_segments_once", "SELECT user_id AS camera, epoch_us(ts) // 3600000000 AS segment, min(event_id) AS event_id FROM events GROUP BY ALL")
def ingest_segments_once(t: Tables):
    """Of the arrivals of a camera's segment, the first; a segment that comes again in a run is not taken up again."""
    s = t.events.select(F.col("user_id").alias("camera"), F.floor(seconds("ts") / 3600).alias("segment"), "event_id")
    return tables.first_arrivals(s, ["camera", "segment"], "event_id")


@query("manifest")
def manifest(t: Tables):
    """(path, size, sha256) of the directory's files."""
    return files.manifest(t.spark, t.folder, "*.parquet")


_PARITY = SQL["parity_report"]


@query("parity_status", f"SELECT status, count(*) AS n, any_value(overall) AS overall FROM ({_PARITY}) GROUP BY 1")
def parity_status(t: Tables):
    """How many capabilities are measured and pending, and the mean of those measured."""
    return parity_report(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("overall").alias("overall"))


def _cells(most: str, least: int) -> str:
    return f"greatest({least}, CAST(floor({most}) AS BIGINT) // 40)"


@query("agg_heatmap", f"WITH p AS (SELECT user_id % 4 AS camera, value AS x, event_id % 540 AS y FROM events WHERE event_type <> 'signup'), s AS (SELECT camera, ceil(max(x)) AS w, 540 AS h, count(*) AS n FROM p GROUP BY 1), c AS (SELECT *, {_cells('w', 8)} AS nx, {_cells('h', 8)} AS ny FROM s WHERE n >= 3) SELECT p.camera, least(floor(x / w * nx), nx - 1)::BIGINT AS cx, least(floor(y / h * ny), ny - 1)::BIGINT AS cy, count(*) AS n FROM p JOIN c ON p.camera = c.camera GROUP BY ALL")
def agg_heatmap(t: Tables):
    """Where subjects were, a camera's frame in cells of 40 pixels, 8 by 8 at least; a camera with fewer than three is left out."""
    p = t.events.filter("event_type <> 'signup'").select((F.col("user_id") % 4).alias("camera"), F.col("value").alias("x"), (F.col("event_id") % 540).alias("y"))
    return heatmap(p, "camera", F.ceil(F.max("x")), F.lit(540))


@query("index_events", """WITH n AS (SELECT event_id, 'seen_' || event_type || ' at cam' || user_id || ' objects: person' || CASE WHEN value > 400 THEN ' severity=high' ELSE '' END AS text FROM events ORDER BY ts DESC, event_id LIMIT 1000),
h AS (SELECT event_id, text, sha256('text:' || text || '|0') AS h FROM n), v AS (SELECT event_id, text, [('0x' || substr(h, 4 * j + 1, 4))::BIGINT / 65535 * 2 - 1 for j in range(8)] AS v FROM h)
SELECT event_id AS id, text, [round(x / sqrt(list_sum([y * y for y in v])), 9) for x in v] AS vector FROM v UNION ALL SELECT vec_id, NULL, [round(x::DOUBLE, 9) for x in embedding[1:8]] FROM embeddings WHERE vec_id NOT IN (SELECT event_id FROM n)""")
def index_events(t: Tables):
    """The newest thousand events as texts and vectors, by a model that a task loads once, put into the index in the place of
    what it had of them."""
    newest = t.events.orderBy(F.desc("ts"), "event_id").limit(1000)
    none = F.array().cast("array<string>")
    text = describe_event(F.concat(F.lit("seen_"), F.col("event_type")), F.concat(F.lit("cam"), F.col("user_id").cast("string")), none, F.array(F.lit("person")), F.when(F.col("value") > 400, "high").otherwise("info"))
    rows = newest.select(F.col("event_id").alias("id"), text.alias("text"))
    vectors = inference.apply_model(rows, lambda: inference.HashEmbedder(8)).withColumnRenamed("id", "v_id")
    made = rows.join(vectors, F.col("id") == F.col("v_id")).select("id", "text", F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))
    index = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("text"), F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double"), 9)).alias("vector"))
    return tables.replace_keys(index, made, ["id"])


@query("sink_typed_detections", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS label, TRY_CAST(value AS DOUBLE) AS confidence, true AS no_window FROM events UNION ALL SELECT CAST(event_id AS VARCHAR), event_type, NULL, true FROM events")
def sink_typed_detections(t: Tables):
    """Rows of two makers as the table of detections takes them: cast, and null where a maker says nothing or nonsense."""
    path = files.scratch(t.spark, "detections")
    e = t.events
    tables.append_typed(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.col("value").cast("string").alias("confidence")), schemas.DETECTIONS, path)
    tables.append_typed(e.select(F.col("event_id").alias("id"), F.lit("high").alias("confidence"), F.col("event_type").alias("label")), schemas.DETECTIONS, path)
    return t.spark.read.schema(schemas.DETECTIONS).parquet(path).select("id", "label", "confidence", F.col("ai_window_id").isNull().alias("no_window"))
