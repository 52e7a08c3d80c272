"""Queries: aggregates, windows of time, rules, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import geometry
from watchloom.functions.scalar import micros, seconds, uuid5
from watchloom.operators import rules, windows
from watchloom.operators.health import health_scores
from watchloom.operators.quantiles import percentiles
from watchloom.plans.registry import Tables, query, uuid5_sql

K = "json_extract_string(props, '$.k')::INT"


def k_of():
    """The number in an event's document."""
    return F.get_json_object("props", "$.k").cast("int")


@query("agg_count_if", f"SELECT count(*) AS n, count(*) FILTER ({K} > 50) AS high, count(DISTINCT user_id) AS users FROM events")
def agg_count_if(t: Tables):
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.count_if(k_of() > 50).alias("high"), F.countDistinct("user_id").alias("users"))


@query("agg_group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_group_count(t: Tables):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_group_list", "SELECT user_id, list(event_type ORDER BY event_id) AS kinds FROM events GROUP BY 1")
def agg_group_list(t: Tables):
    return t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("kinds"))


@query("agg_span", "SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS dwell_us, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def agg_span(t: Tables):
    return t.events.groupBy("user_id").agg((F.max(micros("ts")) - F.min(micros("ts"))).alias("dwell_us"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("agg_bool", "SELECT user_id, bool_or(event_type = 'purchase') AS bought, bool_and(value < 480) AS small FROM events GROUP BY 1")
def agg_bool(t: Tables):
    return t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_and(F.col("value") < 480).alias("small"))


@query("agg_set_union", "SELECT user_id, list(DISTINCT w ORDER BY w) AS seen FROM (SELECT user_id, unnest([event_type, CASE WHEN value > 100 THEN 'large' ELSE 'small' END]) AS w FROM events) GROUP BY 1")
def agg_set_union(t: Tables):
    parts = F.array("event_type", F.when(F.col("value") > 100, "large").otherwise("small"))
    return t.events.groupBy("user_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(parts)))).alias("seen"))


@query("agg_stage_means", "SELECT stage, avg(v) AS mean FROM (SELECT unnest(['quantity', 'tax', 'discount']) AS stage, unnest([l_quantity, l_tax, l_discount]) AS v FROM lineitem) GROUP BY 1")
def agg_stage_means(t: Tables):
    stages = F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount"))
    return t.lineitem.select(F.explode(stages).alias("stage", "v")).groupBy("stage").agg(F.avg("v").alias("mean"))


@query("agg_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def agg_percentiles(t: Tables):
    """Exact percentiles with linear interpolation; kinds of event without a value have 0."""
    p = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = percentiles(t.events.select(F.col("event_type").alias("kind"), "value"), ["kind"], "value", p)
    kinds = t.events.select("event_type").distinct()
    return kinds.join(found, F.col("event_type").eqNullSafe(F.col("kind")), "left").select("event_type", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in p])


@query("agg_ratio_null", "SELECT source, avg(CASE WHEN lang IS NOT NULL THEN (lang = 'en')::INT END) AS share FROM documents GROUP BY 1")
def agg_ratio_null(t: Tables):
    return t.documents.groupBy("source").agg(F.avg((F.col("lang") == "en").cast("int")).alias("share"))


@query("agg_throughput", "SELECT l_returnflag, count(*) / greatest(sum(l_quantity) / 1000, 100, 1e-9) * 60 AS per_minute FROM lineitem GROUP BY 1")
def agg_throughput(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg((F.count(F.lit(1)) / F.greatest(F.sum("l_quantity") / 1000, F.lit(100.0), F.lit(1e-9)) * 60).alias("per_minute"))


@query("agg_dedup_ratio", "SELECT count(*) / greatest(count(DISTINCT event_type), 1) AS ratio FROM events")
def agg_dedup_ratio(t: Tables):
    return t.events.agg((F.count(F.lit(1)) / F.greatest(F.countDistinct("event_type"), F.lit(1))).alias("ratio"))


@query("agg_histogram_2d", f"SELECT (value / 50)::INT AS x, ({K} // 10)::INT AS y, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3".replace("(value / 50)::INT", "floor(value / 50)::INT"))
def agg_histogram_2d(t: Tables):
    return t.events.groupBy(F.floor(F.col("value") / 50).cast("int").alias("x"), F.floor(k_of() / 10).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("agg_hits", "SELECT role, count(*) FILTER (length(text) > 200) AS hits, count(*) AS n FROM conversations GROUP BY 1")
def agg_hits(t: Tables):
    return t.conversations.groupBy("role").agg(F.count_if(F.length("text") > 200).alias("hits"), F.count(F.lit(1)).alias("n"))


@query("agg_durations", "SELECT event_type, sum(greatest(0, value - 100)) AS seconds FROM events GROUP BY 1")
def agg_durations(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(F.greatest(F.lit(0.0), F.col("value") - 100)).alias("seconds"))


@query("agg_kpis", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM customer) AS customers")
def agg_kpis(t: Tables):
    o = t.orders.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))
    return o.withColumn("customers", t.customer.agg(F.count(F.lit(1))).scalar())


@query("agg_rollup_time", "SELECT epoch_us(ts) // 86400000000 AS day, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY ROLLUP (1, 2)")
def agg_rollup_time(t: Tables):
    s = t.events.select(F.floor(seconds("ts") / 86400).alias("day"), F.floor(seconds("ts") / 3600).alias("hour"))
    return s.rollup("day", "hour").agg(F.count(F.lit(1)).alias("n"))


@query("window_tumbling", "SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(t: Tables):
    return t.events.groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


@query("window_sliding_clips", "WITH e AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS s FROM events), k AS (SELECT unnest(generate_series(greatest(0, floor((s - 30) / 25) + 1)::BIGINT, floor(s / 25)::BIGINT)) AS clip FROM e) SELECT clip, count(*) AS n FROM k GROUP BY 1")
def window_sliding_clips(t: Tables):
    """Clips of 30 s every 25 s that hold each event."""
    start = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1e6
    return t.events.select(F.explode(windows.clips_of(start, 30, 25)).alias("clip")).groupBy("clip").agg(F.count(F.lit(1)).alias("n"))


@query("window_sliding_ai", "WITH s AS (SELECT o_orderkey AS id, round(o_totalprice / 10000, 3) AS d, o_orderkey % 2 AS i FROM orders), c AS (SELECT id, d, i, (unnest(generate_series(0, greatest(ceil((d - 5) / 2), 0)::BIGINT)) * 2)::DOUBLE AS a FROM s WHERE d > 0), w AS (SELECT id, i, a AS start, round(least(a + 5, d), 3) AS stop FROM c WHERE a < d) SELECT id, start, stop FROM w WHERE stop > CASE WHEN i > 0 THEN 5 ELSE 0 END")
def window_sliding_ai(t: Tables):
    """Windows of 5 s every 2 s of segments, less those that end within the overlap."""
    s = t.orders.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 10000, 3).alias("d"), (F.col("o_orderkey") % 2).alias("i"))
    return s.select("id", F.inline(windows.new_windows(windows.window_bounds(F.col("d"), 5, 2), 5, F.col("i"))).alias("start", "stop"))


@query("window_sessions", "WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s FROM events), g AS (SELECT *, (s - lag(s) OVER w > 1800)::INT AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), x AS (SELECT user_id, s, sum(coalesce(fresh, 0)) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, max(s) - min(s) AS length FROM x GROUP BY ALL")
def window_sessions(t: Tables):
    s = windows.sessions(t.events.select("user_id", "event_id", seconds("ts").alias("s")), "user_id", "s", 1800, "event_id")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("s") - F.min("s")).alias("length"))


@query("window_cumulative", "SELECT event_id, sum(value) OVER w AS total, count(*) OVER w AS n, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def window_cumulative(t: Tables):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.sum("value").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("n"), F.max("value").over(w).alias("high"))


def subjects(t: Tables) -> DataFrame:
    """The events as what subjects did: kinds of event are zones, a flag, an item and a camera's health."""
    zone = F.when(F.col("event_type") == "view", F.array(F.lit("shelf"))).when(F.col("event_type") == "purchase", F.array(F.lit("billing_counter"))).when(F.col("event_type") == "error", F.array(F.lit("exit"))).otherwise(F.array().cast("array<string>"))
    return t.events.select(
        F.col("user_id").alias("track"), F.col("event_id").alias("arrival"), "event_id", seconds("ts").alias("ts"), zone.alias("zone_types"), F.array(F.lit("person"), F.lit("bag")).alias("all_objects"),
        F.when(k_of() >= 90, F.array(F.lit("person"), F.lit("bag"))).otherwise(F.array(F.lit("person"))).alias("objects"), (F.col("event_type") == "click").alias("object_near_hand"),
        F.lit(None).cast("boolean").alias("has_item"), (F.col("value") / 500).alias("camera_health_score"))


HISTORY = f"""WITH e AS (SELECT user_id AS track, event_id AS arrival, epoch_us(ts) / 1e6 AS ts, event_type, {K} >= 90 AS item, value / 500 AS score FROM events),
h AS (SELECT track, arrival, ts,
  bool_or(event_type = 'view') OVER w AND bool_or(event_type = 'click') OVER w AND count(*) OVER w >= 2 AND max(ts) OVER w - min(ts) OVER w >= 3 AS r1,
  bool_or(item) OVER w AND NOT bool_or(event_type = 'purchase') OVER w AND arg_max(event_type, (ts, arrival)) OVER w = 'error' AS r2,
  min(score) OVER w <= 0.5 AS r3 FROM e WINDOW w AS (PARTITION BY track ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
f AS (SELECT track, 'suspicious_item_interaction' AS rule_id, min(arrival) AS arrival FROM h WHERE r1 GROUP BY 1
  UNION ALL SELECT track, 'possible_billing_bypass', min(arrival) FROM h WHERE r2 GROUP BY 1 UNION ALL SELECT track, 'camera_health_issue', min(arrival) FROM h WHERE r3 GROUP BY 1)"""


@query("rule_first_fire", f"{HISTORY} SELECT f.track, f.rule_id, f.arrival, h.ts FROM f JOIN h ON f.track = h.track AND f.arrival = h.arrival")
def rule_first_fire(t: Tables):
    """Where each rule first holds for each subject."""
    return rules.first_firings(subjects(t)).select("track", "rule_id", "arrival", "ts")


@query("rule_actions", f"""{HISTORY}, z AS (SELECT track, arrival, ts, CASE event_type WHEN 'view' THEN 'shelf' WHEN 'purchase' THEN 'billing_counter' WHEN 'error' THEN 'exit' END AS zone FROM e)
SELECT f.track, f.rule_id, count(*) AS n_sources, list(DISTINCT zone ORDER BY zone) FILTER (zone IS NOT NULL) AS zones, CASE f.rule_id WHEN 'possible_billing_bypass' THEN 'possible_loss' ELSE f.rule_id END AS makes, f.rule_id = 'possible_billing_bypass' AS incident
FROM f JOIN z ON f.track = z.track AND z.arrival <= f.arrival GROUP BY f.track, f.rule_id""")
def rule_actions(t: Tables):
    a = rules.actions(subjects(t))
    return a.select("track", "rule_id", F.size("sources").cast("long").alias("n_sources"), F.when(F.size("zones") > 0, F.col("zones")).alias("zones"), "makes", "incident")


_SHOWN = """WITH e AS (SELECT user_id AS track, event_id AS arrival, epoch_us(ts) / 1e6 AS ts, event_type, {k} >= 90 AS item, value / 500 AS score FROM events),
l AS (SELECT track, bool_or(event_type = 'view') AS shelf, bool_or(event_type = 'click') AS near, CASE WHEN count(*) >= 2 THEN max(ts) - min(ts) ELSE 0 END AS dwell, bool_or(item) AS item, bool_or(event_type = 'purchase') AS paid,
  coalesce(CASE arg_max(event_type, (ts, arrival)) WHEN 'view' THEN 'shelf' WHEN 'purchase' THEN 'billing_counter' WHEN 'error' THEN 'exit' END, '') AS last, min(score) AS worst FROM e GROUP BY 1),
w AS (SELECT track, 'suspicious_item_interaction' AS rule_id, 0 AS place, 'person_in_zone' AS condition, shelf::VARCHAR AS observed, NULL::DOUBLE AS amount, shelf AS holds, true AS looked FROM l
  UNION ALL SELECT track, 'suspicious_item_interaction', 1, 'object_near_person_hand', near::VARCHAR, NULL, near, shelf FROM l
  UNION ALL SELECT track, 'suspicious_item_interaction', 2, 'dwell_time_sec_gte', NULL, dwell, dwell >= 3, shelf AND near FROM l
  UNION ALL SELECT track, 'possible_billing_bypass', 0, 'person_has_item', item::VARCHAR, NULL, item, true FROM l
  UNION ALL SELECT track, 'possible_billing_bypass', 1, 'visited_billing_zone', paid::VARCHAR, NULL, NOT paid, item FROM l
  UNION ALL SELECT track, 'possible_billing_bypass', 2, 'moved_to_zone', last, NULL, last = 'exit', item AND NOT paid FROM l
  UNION ALL SELECT track, 'camera_health_issue', 0, 'camera_health_score_lte', NULL, worst, worst <= 0.5, true FROM l)
SELECT track, rule_id, place, condition, observed, amount, holds FROM w WHERE looked"""


@query("rule_whys", _SHOWN.format(k=K))
def rule_whys(t: Tables):
    """What each subject's whole history says of each rule: its conditions' evidence up to the first that doesn't hold."""
    last = Window.partitionBy("track").orderBy(F.desc("arrival"))
    told = rules.explain(subjects(t)).withColumn("n", F.row_number().over(last)).filter("n = 1")
    return told.select("track", F.inline("whys"))


@query("rule_action_ids", f"""{HISTORY} SELECT track, rule_id, {uuid5_sql("rule_id || '|' || track || '|' || CASE rule_id WHEN 'possible_billing_bypass' THEN 'possible_loss' ELSE rule_id END")} AS id FROM f""")
def rule_action_ids(t: Tables):
    """Name-based ids of the actions: the same whenever they are computed."""
    return rules.actions(subjects(t)).select("track", "rule_id", "id")


@query("rule_forward_once", "SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id")
def rule_forward_once(t: Tables):
    e = t.events.filter("event_type = 'error'").select(F.lit("cam").alias("camera_id"), F.col("user_id").alias("track"), F.lit("x").alias("makes"), F.lit("s").alias("segment_id"), F.col("event_id").alias("arrival"))
    return rules.forwards(e).select(F.col("track").alias("user_id"), F.col("arrival").alias("event_id"))


@query("rule_summary", f"{HISTORY} SELECT rule_id, count(*) AS n FROM f GROUP BY 1")
def rule_summary(t: Tables):
    return rules.first_firings(subjects(t)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("id_uuid5", f"SELECT n_nationkey, {uuid5_sql("n_name || '|x'")} AS id FROM nation")
def id_uuid5(t: Tables):
    return t.nation.select("n_nationkey", uuid5(F.concat_ws("|", "n_name", F.lit("x"))).alias("id"))


#: Zones of two cameras, as corners in the unit square.
ZONES = [(0, 0, "shelf", [[0.1, 0.1], [0.6, 0.1], [0.6, 0.7], [0.1, 0.7]]), (0, 1, "exit", [[0.5, 0.5], [0.9, 0.4], [0.7, 0.95]]), (1, 0, "billing_counter", [[0.2, 0.2], [0.8, 0.2], [0.5, 0.9]]), (1, 1, "line", [[0.0, 0.0], [1.0, 1.0]])]


def zones(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(ZONES, "camera long, ordinal int, zone_type string, polygon array<array<double>>")


def _edges(polygon: list, x: str, y: str) -> str:
    n = len(polygon)
    if n < 3:
        return "FALSE"
    parts = []
    for i in range(n):
        (ax, ay), (bx, by) = polygon[i], polygon[i - 1]
        slope = by - ay or 1e-12
        parts.append(f"((({ay} > {y}) <> ({by} > {y})) AND ({x} < ({bx} - {ax}) * ({y} - {ay}) / ({slope}) + {ax}))::INT")
    return f"(({' + '.join(parts)}) % 2 = 1)"


POINTS = f"SELECT event_id, user_id % 2 AS camera, value / 500 AS x, {K} / 100 AS y FROM events"


def points(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.col("user_id") % 2).alias("camera"), (F.col("value") / 500).alias("x"), (k_of() / 100).alias("y"))


@query("geo_zone_join", f"WITH p AS ({POINTS}) " + " UNION ALL ".join(f"SELECT event_id, '{z}' AS zone_type FROM p WHERE camera = {c} AND {_edges(poly, 'x', 'y')}" for c, _, z, poly in ZONES))
def geo_zone_join(t: Tables):
    """Points in the zones of their camera; the zones are configuration, a row per zone."""
    z = F.broadcast(zones(t).withColumnRenamed("camera", "c"))
    p = points(t)
    return p.join(z, (p["camera"] == z["c"]) & geometry.inside(F.col("x"), F.col("y"), F.col("polygon"))).select("event_id", "zone_type")


@query("geo_zone_attribution", f"WITH p AS ({POINTS}), h AS (" + " UNION ALL ".join(f"SELECT event_id, '{z}' AS zone_type, {o} AS o FROM p WHERE camera = {c} AND {_edges(poly, 'x', 'y')}" for c, o, z, poly in ZONES) + ") SELECT p.event_id, coalesce(list(zone_type ORDER BY o) FILTER (zone_type IS NOT NULL), []) AS zone_types FROM p LEFT JOIN h USING (event_id) GROUP BY 1")
def geo_zone_attribution(t: Tables):
    """Each point's zones in the zones' order, by one array of zones per camera: no join back."""
    by = zones(t).groupBy("camera").agg(F.array_sort(F.collect_list(F.struct("ordinal", "zone_type", "polygon"))).alias("zs")).withColumnRenamed("camera", "c")
    p = points(t)
    j = p.join(F.broadcast(by), p["camera"] == by["c"], "left")
    found = F.transform(F.filter("zs", lambda z: geometry.inside(F.col("x"), F.col("y"), z["polygon"])), lambda z: z["zone_type"])
    return j.select("event_id", F.coalesce(found, F.array().cast("array<string>")).alias("zone_types"))


@query("geo_box_overlap", f"WITH b AS (SELECT event_id, value / 500 AS x, {K} / 100 AS y FROM events), p AS (SELECT event_id, x, y, lead(x) OVER (ORDER BY event_id) AS x2, lead(y) OVER (ORDER BY event_id) AS y2 FROM b), o AS (SELECT event_id, greatest(least(x + 0.3, x2 + 0.3) - greatest(x, x2), 0) * greatest(least(y + 0.4, y2 + 0.4) - greatest(y, y2), 0) AS i, x, y, x2, y2 FROM p WHERE x2 IS NOT NULL) SELECT event_id, round(i / (0.24 - i), 9) AS iou, round(sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)), 9) AS distance FROM o")
def geo_box_overlap(t: Tables):
    b = t.events.select("event_id", F.array(F.col("value") / 500, k_of() / 100, F.lit(0.3), F.lit(0.4)).alias("a"))
    p = b.join(b.select((F.col("event_id") - 1).alias("n"), F.col("a").alias("b")), F.col("event_id") == F.col("n"))
    return p.select("event_id", F.round(geometry.iou(F.col("a"), F.col("b")), 9).alias("iou"), F.round(geometry.centroid_distance(F.col("a"), F.col("b")), 9).alias("distance"))


@query("geo_parse_boxes", "SELECT item_id, [[item_id / 1000, 0.1, round(0.5 - item_id / 1000, 9), 0.3]] AS boxes FROM benchmark")
def geo_parse_boxes(t: Tables):
    text = F.concat(F.lit("box <"), F.col("item_id"), F.lit("><100><500><400> bad <900><1><2><3>"))
    boxes = geometry.parsed_boxes(text)
    return t.benchmark.select("item_id", F.transform(boxes, lambda b: F.transform(b, lambda v: F.round(v, 9))).alias("boxes"))


@query("geo_camera_health", f"WITH s AS (SELECT user_id, event_id, least(value, 255) AS luma, {K} * 4 AS sharp FROM events), d AS (SELECT *, abs(luma - lag(luma) OVER (PARTITION BY user_id ORDER BY event_id)) AS moved FROM s), f AS (SELECT user_id, avg(luma) AS light, avg((luma < 15)::INT) AS black, 1 - least(1, avg(sharp) / 100) AS blur, CASE WHEN count(*) = 1 THEN 0.5 WHEN avg(moved) < 0.5 THEN 1 ELSE greatest(0, 1 - avg(moved) / 5) END AS still FROM d GROUP BY 1) SELECT user_id, round(black, 3) AS black_frame_score, round(blur, 3) AS blur_score, round(still, 3) AS freeze_score, round(greatest(0, least(1, least(1, light / 40) * (1 - blur) * (1 - still) * (1 - black))), 3) AS health_score FROM f")
def geo_camera_health(t: Tables):
    samples = t.events.select(F.col("user_id").alias("camera"), F.col("event_id").alias("at"), F.least("value", F.lit(255.0)).alias("luma"), (k_of() * 4).alias("sharpness"))
    return health_scores(samples).withColumnRenamed("camera", "user_id")


@query("geo_motion_fraction", "SELECT user_id, avg((abs(value - p) > 25)::INT) AS changed FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY 1")
def geo_motion_fraction(t: Tables):
    p = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.withColumn("p", p).filter("p IS NOT NULL").groupBy("user_id").agg(F.avg((F.abs(F.col("value") - F.col("p")) > 25).cast("int")).alias("changed"))
