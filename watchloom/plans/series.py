"""Queries over ranges of counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from watchloom.functions.scalar import seconds
from watchloom.operators import metrics
from watchloom.plans.registry import Tables, query

SPAN, STEP = 6 * 3600.0, 2 * 3600.0
BOUNDS = (50.0, 100.0, 200.0, 400.0)

#: The rate over ranges of a counter table c (series columns, s, v), as SQL.
_RATE = """p AS (SELECT {k}, s, v, lag(v) OVER (PARTITION BY {k} ORDER BY s, v) AS b FROM c),
g AS (SELECT {k}, s, v, CASE WHEN v < b THEN v ELSE v - b END AS grown FROM p),
l AS (SELECT {k}, s, v, grown, unnest(range(CAST(ceil(s / {step}) AS BIGINT), CAST(ceil((s + {span}) / {step}) AS BIGINT))) AS k FROM g),
a AS (SELECT {k}, k, count(*) AS n, min(s) AS t0, max(s) AS t1, arg_min(v, (s, v)) AS v0, coalesce(sum(grown), 0) - coalesce(arg_min_null(grown, (s, v)), 0) AS r FROM l GROUP BY ALL),
d AS (SELECT *, t1 - t0 AS len, (t1 - t0) / (n - 1) AS gap, t0 - (k * {step} - {span}) AS head, k * {step} - t1 AS tail FROM a WHERE n >= 2 AND t1 > t0),
x AS (SELECT *, CASE WHEN head < 1.1 * gap THEN head ELSE gap / 2 END AS h0, CASE WHEN tail < 1.1 * gap THEN tail ELSE gap / 2 END AS t2 FROM d),
rates AS (SELECT {k}, k * {step} AS step_at, r * ((len + least(h0, CASE WHEN r > 0 AND v0 >= 0 THEN len * v0 / r ELSE h0 END) + t2) / len) / {span} AS rate FROM x)"""


def _rate_sql(series: str) -> str:
    return _RATE.format(k=series, step=STEP, span=SPAN)


@query("metric_range_rate", "WITH c AS (SELECT event_type, user_id % 20 AS instance, epoch_us(ts) / 1e6 AS s, sum(value) OVER (PARTITION BY event_type, user_id % 20, ts::DATE ORDER BY ts, event_id) AS v FROM events), " + _rate_sql("event_type, instance") + " SELECT event_type, step_at, round(sum(rate), 9) AS rate FROM rates GROUP BY ALL")
def metric_range_rate(t: Tables):
    """Rates by kind of counters that start anew each day, over six hours, every two. Events of one time and id are read at
    once; before a day's first value its counter has none."""
    own = Window.partitionBy("event_type", F.col("user_id") % 20, F.to_date("ts")).orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    c = t.events.select("event_type", (F.col("user_id") % 20).alias("instance"), seconds("ts").alias("s"), F.sum("value").over(own).alias("v"))
    rates = metrics.range_rate(c, ["event_type", "instance"], "s", "v", SPAN, STEP, gaps=True)
    return rates.groupBy("event_type", "step_at").agg(F.round(F.sum("rate"), 9).alias("rate"))


_LE = ", ".join(f"({b})" for b in BOUNDS) + ", ('inf'::DOUBLE)"


@query("metric_range_quantile", f"""WITH e AS (SELECT event_type, le, epoch_us(date_trunc('hour', ts)) / 1e6 + 3600 AS s, ts::DATE AS day, count(*) FILTER (value <= le) AS n FROM events, (VALUES {_LE}) b(le) GROUP BY ALL),
c AS (SELECT event_type, le, s, CAST(sum(n) OVER (PARTITION BY event_type, le, day ORDER BY s) AS DOUBLE) AS v FROM e), {_rate_sql("event_type, le")},
o AS (SELECT *, max(rate) OVER w AS total, coalesce(lag(rate) OVER (w ORDER BY le), 0) AS under, coalesce(lag(le) OVER (w ORDER BY le), 0) AS low FROM rates WINDOW w AS (PARTITION BY event_type, step_at)),
h AS (SELECT * FROM o WHERE total > 0 AND rate >= 0.9 * total AND (under < 0.9 * total OR under = 0) QUALIFY row_number() OVER (PARTITION BY event_type, step_at ORDER BY le) = 1)
SELECT event_type, step_at, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (0.9 * total - under) / nullif(rate - under, 0) END, 6) AS quantile FROM h""")
def metric_range_quantile(t: Tables):
    """The 90th percentile by kind, from the rates of hourly read buckets that start anew each day."""
    hour = F.floor(seconds("ts") / 3600) * 3600.0 + 3600
    counted = t.events.select("event_type", "value", hour.alias("s"), F.to_date("ts").alias("day"))
    buckets = metrics.histogram(counted, ["event_type", "s", "day"], "value", list(BOUNDS))
    so_far = Window.partitionBy("event_type", "le", "day").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    c = buckets.select("event_type", "le", "s", F.sum("n").over(so_far).cast("double").alias("v"))
    out = metrics.range_quantile(0.9, c, ["event_type"], "le", "s", "v", SPAN, STEP)
    return out.select("event_type", "step_at", F.round("quantile", 6).alias("quantile"))
