"""Queries: scans, predicates, joins, table changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from watchloom.functions.scalar import first_present, seconds
from watchloom.functions.text import redact_fields
from watchloom.operators import tables
from watchloom.operators.intervals import event_in_window_join, overlap_join
from watchloom.plans.registry import Tables, query


@query("scan_project", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_project(t: Tables):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("scan_parameterized", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity < 5")
def scan_parameterized(t: Tables):
    return t.spark.sql("SELECT l_orderkey, l_linenumber, l_quantity FROM {lines} WHERE l_shipdate >= :a AND l_shipdate < :z AND l_quantity < :q", args={"a": "1995-01-01", "z": "1996-01-01", "q": 5}, lines=t.lineitem)


@query("filter_optional", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'error'")
def filter_optional(t: Tables, event_type: str | None = "error"):
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    return rows.filter(F.col("event_type") == event_type) if event_type else rows


@query("filter_dynamic_where", "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('purchase', 'signup') AND user_id < 40")
def filter_dynamic_where(t: Tables, kinds=("purchase", "signup"), below: int | None = 40):
    """A conjunction of the predicates given; of none, all rows."""
    rows = t.events.select("event_id", "event_type", "user_id")
    for p in ([F.col("event_type").isin(*kinds)] if kinds else []) + ([F.col("user_id") < below] if below is not None else []):
        rows = rows.filter(p)
    return rows


@query("filter_in_list", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_in_list(t: Tables):
    wanted = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return t.orders.select("o_orderkey", "o_custkey").join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("filter_time_range", "SELECT event_id, t FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS t FROM events) WHERE t IS NULL OR (t >= TIMESTAMP '2024-01-10' AND t <= TIMESTAMP '2024-01-12')")
def filter_time_range(t: Tables):
    """Inclusive at both ends; rows without a time stay."""
    rows = t.events.select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("t"))
    return rows.filter(F.col("t").isNull() | F.col("t").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")))


@query("filter_confidence_gate", "SELECT event_id, event_type, value / 500 AS confidence FROM events WHERE event_type IN ('error', 'purchase') OR json_extract_string(props, '$.k')::INT > 95 OR value / 500 >= 0.5")
def filter_confidence_gate(t: Tables):
    """Serious kinds and those marked for verification pass; of the others, confident ones."""
    rows = t.events.withColumn("confidence", F.col("value") / 500)
    serious = F.col("event_type").isin("error", "purchase") | (F.get_json_object("props", "$.k").cast("int") > 95)
    return rows.filter(serious | (F.col("confidence") >= 0.5)).select("event_id", "event_type", "confidence")


@query("filter_suspicious_flag", "SELECT event_id, event_type = 'error' OR json_extract_string(props, '$.k')::INT > 95 AS suspicious FROM events")
def filter_suspicious_flag(t: Tables):
    return t.events.select("event_id", ((F.col("event_type") == "error") | (F.get_json_object("props", "$.k").cast("int") > 95)).alias("suspicious"))


@query("filter_keyword_class", "SELECT item_id, regexp_matches(lower(text), 'the|with|from') AS flagged FROM benchmark")
def filter_keyword_class(t: Tables):
    return t.benchmark.select("item_id", F.lower("text").rlike("the|with|from").alias("flagged"))


@query("filter_exact_set", "SELECT doc_id, source IN ('src1', 'src2') AS listed FROM documents")
def filter_exact_set(t: Tables):
    return t.documents.select("doc_id", F.col("source").isin("src1", "src2").alias("listed"))


@query("filter_label_regex", "SELECT doc_id, source FROM documents WHERE regexp_full_match(source, 'src[1-3]') AND lang <> 'en'")
def filter_label_regex(t: Tables):
    return t.documents.filter(F.col("source").rlike("^(?:src[1-3])$") & (F.col("lang") != "en")).select("doc_id", "source")


@query("filter_not_null", "SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def filter_not_null(t: Tables):
    return t.documents.filter(F.col("lang").isNotNull() & F.col("source").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("project_first_present", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'none') AS label FROM documents")
def project_first_present(t: Tables):
    return t.documents.select("doc_id", F.coalesce(first_present(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), "source"), F.lit("none")).alias("label"))


@query("project_nested_getter", "SELECT event_id, coalesce(json_extract_string(props, '$.missing')::BIGINT, json_extract_string(props, '$.k')::BIGINT) AS k FROM events")
def project_nested_getter(t: Tables):
    """A field at the top level, else in the nested document."""
    p = F.try_parse_json("props")
    return t.events.select("event_id", F.coalesce(F.try_variant_get(p, "$.missing", "long"), F.try_variant_get(p, "$.k", "long")).alias("k"))


@query("join_locked", "SELECT DISTINCT o_custkey AS locked FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_acctbal < 0")
def join_locked(t: Tables):
    """What open cases hold on to: an inner join of three tables, distinct."""
    held = t.lineitem.select("l_orderkey").join(t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return held.join(t.customer.filter("c_acctbal < 0").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("locked")).distinct()


@query("join_latest_per_key", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def join_latest_per_key(t: Tables):
    last = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return t.customer.select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


SPANS = "SELECT event_id AS id, user_id, epoch_us(ts) / 1e6 - 900 AS a, epoch_us(ts) / 1e6 + 900 AS z, event_type FROM events"


@query("join_overlap", f"WITH s AS ({SPANS}) SELECT x.id AS l_id, y.id AS r_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.a < y.z AND y.a < x.z WHERE x.event_type = 'error' AND y.event_type = 'purchase'")
def join_overlap(t: Tables):
    """Errors and purchases of a user whose half-hours around them overlap."""
    s = t.events.select(F.col("event_id").alias("id"), "user_id", (seconds("ts") - 900).alias("a"), (seconds("ts") + 900).alias("z"), "event_type")
    return overlap_join(s.filter("event_type = 'error'"), s.filter("event_type = 'purchase'"), ["user_id"], "a", "z", 3600).select("l_id", "r_id")


@query("join_overlap_no_key", "WITH s AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) / 1e6 AS a, epoch_us(o_orderdate) / 1e6 + 7200 AS z FROM orders WHERE o_orderpriority = '1-URGENT') SELECT x.id AS l_id, y.id AS r_id FROM s x JOIN s y ON x.a <= y.z AND y.a <= x.z AND x.id < y.id")
def join_overlap_no_key(t: Tables):
    """Closed intervals without a key: buckets keep it from comparing all pairs."""
    s = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("a"), (seconds("o_orderdate") + 7200).alias("z"))
    return overlap_join(s, s, [], "a", "z", 86400, closed=True).filter("l_id < r_id").select("l_id", "r_id")


@query("join_parent_span", "SELECT l_orderkey, l_linenumber, o_orderdate + to_seconds(l_linenumber * 30) AS span_start, o_orderdate + to_seconds(l_linenumber * 30 + CAST(l_quantity AS BIGINT)) AS span_end FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_parent_span(t: Tables):
    """A child's absolute span from its parent's start."""
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = lambda s: F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s)
    return j.select("l_orderkey", "l_linenumber", at((F.col("l_linenumber") * 30).cast("decimal(18,6)")).alias("span_start"), at((F.col("l_linenumber") * 30 + F.col("l_quantity")).cast("decimal(18,6)")).alias("span_end"))


@query("join_semi_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_semi_exists(t: Tables):
    return t.orders.select("o_orderkey").join(t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("join_anti_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1995-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
def join_anti_delete(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return tables.delete_where(rows, F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("join_gather", "SELECT o_orderkey, c_name, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000 GROUP BY ALL")
def join_gather(t: Tables):
    """A case with its related rows as an ordered list."""
    j = t.orders.filter("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey", "c_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))


@query("join_full_outer_merge", "WITH a AS (SELECT vec_id AS id, label::DOUBLE / 10 AS score, '' AS txt FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS id, 0.5 AS score, 'v' || vec_id AS txt FROM embeddings WHERE vec_id % 3 = 0) SELECT coalesce(a.id, b.id) AS id, greatest(coalesce(a.score, 0), coalesce(b.score, 0))::DOUBLE AS score, coalesce(nullif(a.txt, ''), nullif(b.txt, '')) AS txt FROM a FULL OUTER JOIN b ON a.id = b.id")
def join_full_outer_merge(t: Tables):
    a = t.embeddings.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("sa"), F.lit("").alias("ta"))
    b = t.embeddings.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), F.lit(0.5).alias("sb"), F.concat(F.lit("v"), F.col("vec_id")).alias("tb"))
    return a.join(b, "id", "full_outer").select("id", F.greatest(F.coalesce("sa", F.lit(0.0)), F.coalesce("sb", F.lit(0.0))).alias("score"), first_present("ta", "tb").alias("txt"))


@query("join_bucket_containment", "WITH c AS (SELECT event_id, (epoch_us(ts) / 10000000)::BIGINT AS clip FROM (SELECT event_id, ts FROM events)), f AS (SELECT (clip * 10) // 300 AS five, count(*) AS n FROM c GROUP BY 1) SELECT c.event_id, f.n FROM c JOIN f ON (c.clip * 10) // 300 = f.five".replace("(epoch_us(ts) / 10000000)::BIGINT", "epoch_us(ts) // 10000000"))
def join_bucket_containment(t: Tables):
    """Clips with the size of the five minutes that hold them."""
    c = t.events.select("event_id", F.floor(F.floor(seconds("ts") / 10) * 10 / 300).alias("five"))
    return c.join(c.groupBy("five").agg(F.count(F.lit(1)).alias("n")), "five").select("event_id", "n")


@query("join_blind_spots", "SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def join_blind_spots(t: Tables):
    """Rows without any counterpart."""
    return t.nation.select("n_nationkey", "n_name").join(t.supplier.filter("s_acctbal > 9000").select("s_nationkey"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti")


@query("join_dangling_refs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)")
def join_dangling_refs(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 2).alias("r")).join(t.orders.select("o_orderkey"), F.col("r") == F.col("o_orderkey"), "left_anti").drop("r")


@query("join_provenance", "SELECT p_partkey, p_brand, s_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def join_provenance(t: Tables):
    return t.part.select("p_partkey", "p_brand").join(t.supplier.select("s_suppkey", "s_name"), F.col("p_partkey") == F.col("s_suppkey"), "left").drop("s_suppkey")


@query("join_vector_match", "WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, a.n - b.n AS diff, b.n / a.n AS ratio FROM a JOIN b USING (user_id)")
def join_vector_match(t: Tables):
    a = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    b = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "user_id").select("user_id", (F.col("n") - F.col("m")).alias("diff"), (F.col("m") / F.col("n")).alias("ratio"))


@query("join_transaction_window", "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events), b AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'), p AS (SELECT user_id, t FROM e WHERE event_type = 'purchase'), n AS (SELECT b.event_id, b.user_id, count(p.t) AS n FROM b LEFT JOIN p ON p.user_id = b.user_id AND p.t BETWEEN b.t - 18000 AND b.t + 24000 GROUP BY ALL) SELECT event_id, n, CASE WHEN user_id NOT IN (SELECT user_id FROM p) THEN 'unavailable' WHEN n = 0 THEN 'no_match' WHEN n = 1 THEN 'match' ELSE 'ambiguous' END AS status FROM n")
def join_transaction_window(t: Tables):
    """Clicks against purchases of the same user around them (an extension: transactions)."""
    e = t.events.select("event_id", "user_id", "event_type", seconds("ts").alias("at"))
    return event_in_window_join(e.filter("event_type = 'purchase'").select("user_id", "at"), e.filter("event_type = 'click'").select("event_id", "user_id", "at"), "user_id", "at", 18000, 24000).select("event_id", "n", "status")


@query("join_handoff", "WITH e AS (SELECT event_id, user_id % 10 AS zone, user_id, epoch_us(ts) / 1e6 AS t FROM events) SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM e a JOIN e b ON a.zone = b.zone AND a.user_id < b.user_id AND a.t - 60 < b.t + 60 AND b.t - 60 < a.t + 60")
def join_handoff(t: Tables):
    """Subjects of a zone within two minutes of each other (an extension: handoff)."""
    e = t.events.select("event_id", (F.col("user_id") % 10).alias("zone"), "user_id", (seconds("ts") - 60).alias("a"), (seconds("ts") + 60).alias("z"))
    return overlap_join(e, e, ["zone"], "a", "z", 600).filter("l_user_id < r_user_id").select("l_event_id", "r_event_id")


@query("join_same_bucket", "SELECT epoch_us(ts) // 3600000000 AS hour, list(DISTINCT event_type ORDER BY event_type) AS kinds, count(*) AS n FROM events GROUP BY 1")
def join_same_bucket(t: Tables):
    """What several sources saw in the same bucket of time, together."""
    return t.events.groupBy(F.floor(seconds("ts") / 3600).alias("hour")).agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.count(F.lit(1)).alias("n"))


@query("join_precision_recall", "WITH p AS (SELECT l.doc_id, quality = 1 AS truth, n_chars > 1500 AS said FROM labels l JOIN documents d USING (doc_id)) SELECT count(*) FILTER (truth AND said) / nullif(count(*) FILTER (said), 0) AS precision, count(*) FILTER (truth AND said) / nullif(count(*) FILTER (truth), 0) AS recall FROM p")
def join_precision_recall(t: Tables):
    p = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1500).alias("said"))
    both, said, truth = F.count_if(F.col("truth") & F.col("said")), F.count_if("said"), F.count_if("truth")
    return p.agg(F.try_divide(both, said).alias("precision"), F.try_divide(both, truth).alias("recall"))


CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM customer"


@query("sink_insert_new", f"WITH t AS ({CUSTOMERS} WHERE c_custkey % 2 = 0), r AS ({CUSTOMERS} WHERE c_custkey % 3 = 0) SELECT * FROM t UNION ALL SELECT * FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM t)")
def sink_insert_new(t: Tables):
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return tables.insert_new(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0"), ["c_custkey"], F.col("c_name"))


@query("sink_insert_with_parent", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 = 0 UNION ALL SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sink_insert_with_parent(t: Tables):
    rows = t.lineitem.filter("l_linenumber = 1").select("l_orderkey", "l_linenumber")
    return tables.insert_with_parent(rows.filter("l_orderkey % 4 = 0"), rows, "l_orderkey", t.orders.filter("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")


@query("sink_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 <> 0 THEN c_name ELSE 'new ' || c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def sink_upsert(t: Tables):
    """Rows that are there change their balance only; the others come in whole."""
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return tables.upsert(c.filter("c_custkey % 2 = 0"), new, ["c_custkey"], ["c_acctbal"])


@query("sink_replace_keys", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'again' FROM supplier WHERE s_suppkey % 5 = 0")
def sink_replace_keys(t: Tables):
    s = t.supplier.select("s_suppkey", "s_name")
    return tables.replace_keys(s, s.filter("s_suppkey % 5 = 0").withColumn("s_name", F.lit("again")), ["s_suppkey"])


@query("sink_point_update", "SELECT o_orderkey, coalesce((SELECT max(CASE WHEN l_returnflag = 'R' THEN 'X' END) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1), o_orderstatus) AS o_orderstatus FROM orders")
def sink_point_update(t: Tables):
    changes = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "X").alias("o_orderstatus"))
    return tables.update(t.orders.select("o_orderkey", "o_orderstatus"), changes, "o_orderkey", "o_orderstatus")


@query("sink_exclusive_flag", "SELECT n_name, n_name = 'FRANCE' AS active FROM nation WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = 'FRANCE') OR TRUE")
def sink_exclusive_flag(t: Tables):
    names = t.nation.select("n_name")
    wanted = "FRANCE"
    return tables.activate(names, "n_name", wanted) if names.filter(F.col("n_name") == wanted).limit(1).count() else names.withColumn("active", F.lit(False))


@query("sink_audit_redacted", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '***REDACTED***' ELSE role END AS val FROM conversations")
def sink_audit_redacted(t: Tables):
    """Audit fields with secret names masked before they are written."""
    name = F.when(F.col("turn") % 2 == 0, "api_token").otherwise("role")
    f = redact_fields(F.create_map(name, F.col("role")))
    return t.conversations.select("conv_id", "turn", F.element_at(F.map_values(f), 1).alias("val"))


@query("set_union_all", "SELECT conv_id AS id, 'turn' AS kind, text FROM conversations UNION ALL SELECT item_id, 'item', text FROM benchmark")
def set_union_all(t: Tables):
    return t.conversations.select(F.col("conv_id").alias("id"), F.lit("turn").alias("kind"), "text").unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit("item").alias("kind"), "text"))


@query("set_array_ops", "WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) SELECT item_id, len(list_intersect(w, ['the', 'and', 'for'])) AS shared, len(list_filter(w, lambda x: x NOT IN ('the', 'and', 'for'))) AS own FROM w")
def set_array_ops(t: Tables):
    from watchloom.functions.text import terms

    common = F.array(*[F.lit(x) for x in ("the", "and", "for")])
    w = t.benchmark.select("item_id", terms(F.col("text")).alias("w"))
    return w.select("item_id", F.size(F.array_intersect("w", common)).cast("long").alias("shared"), F.size(F.array_except("w", common)).cast("long").alias("own"))


@query("sort_recent_limit", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def sort_recent_limit(t: Tables):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("window_previous_state", "SELECT event_id, user_id, event_type, lag(event_type) OVER w AS previous, value - lag(value) OVER w AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def window_previous_state(t: Tables):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("previous"), (F.col("value") - F.lag("value").over(w)).alias("delta"))


@query("window_changes_only", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def window_changes_only(t: Tables):
    """A history without repeats of the current state."""
    p = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.withColumn("p", p).filter("p IS NULL OR p <> event_type").select("event_id", "user_id", "event_type")


@query("window_argmax", "SELECT s_nationkey, arg_max(s_name, (s_acctbal, s_suppkey)) AS best FROM supplier GROUP BY 1")
def window_argmax(t: Tables):
    return t.supplier.groupBy("s_nationkey").agg(F.max_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("best"))


@query("window_longest_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def window_longest_first(t: Tables):
    return tables.latest(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("dedup_first_seen", "SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1 ORDER BY 2")
def dedup_first_seen(t: Tables):
    return t.events.groupBy("event_type").agg(F.min("event_id").alias("first_id")).orderBy("first_id")
