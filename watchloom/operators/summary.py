"""Folding events into captions: clips, five minutes, hours, a report; and what the report asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The levels, their seconds, and how a summary of each begins.
LEVELS = (("clip", 10, ""), ("5min", 300, "5-minute window"), ("hour", 3600, "1-hour window"))
REPORT = "incident-aware report"
NOTHING = "No activity in the requested time range."


def caption(ts: Column, camera: Column, kind: Column, zones: Column | None = None, objects: Column | None = None, verdict: Column | None = None, explanation: Column | None = None) -> Column:
    """One event as a line: when, where, what, and what a model said of it."""
    listed = lambda before, items, after="": F.when(F.size(items) > 0, F.concat(F.lit(before), F.array_join(items, ", "), F.lit(after)))
    more = [] if zones is None else [listed(" near ", zones)]
    more += [] if objects is None else [listed(" (objects: ", objects, ")")]
    said = [F.when(c != "", F.concat(F.lit(f" — VLM{b}: "), c)) for b, c in (("", explanation), (" verdict", verdict)) if c is not None]
    more += [F.coalesce(*said)] if said else []
    when, where = F.coalesce(F.date_format(ts, "HH:mm:ss"), F.lit("?")), F.coalesce(camera, F.lit("?"))
    return F.concat(when, F.lit(" "), where, F.lit(": "), F.regexp_replace(F.coalesce(kind, F.lit("event")), "_", " "), *[F.coalesce(c, F.lit("")) for c in more])


def tag(items: Column, level: str) -> Column:
    """The first 8 hex digits of the digest of what a summary was made from."""
    return F.substring(F.sha2(F.concat(F.array_join(items, "|"), F.lit(f"#{level}")), 256), 1, 8)


def summarised(items: Column, level: str, lead: str, scope: Column | None = None) -> Column:
    """A level's summary of the lines or summaries below it."""
    n = F.size(items)
    if level == "clip":
        body = F.concat(F.array_join(F.slice(items, 1, 4), "; "), F.when(n > 4, F.concat(F.lit("; (+"), (n - 4).cast("string"), F.lit(" more)"))).otherwise(""))
    else:
        body = F.concat(F.lit(f"{lead}: "), n.cast("string"), F.lit(" sub-summaries. "), items[0], F.when(n > 1, F.concat(F.lit(" Other notable: "), items[1])).otherwise(""))
    inside = F.lit("") if scope is None else F.when(scope != "", F.concat(F.lit(" ["), scope, F.lit("]"))).otherwise("")
    return F.concat(F.when(n == 0, "No activity recorded in this interval.").otherwise(body), inside, F.lit(" (sum:"), tag(items, level), F.lit(")"))


def staged(events: DataFrame, mode: str = "", origin: float | None = None) -> dict[str, DataFrame]:
    """Summaries (bucket, n, line) by level of events (s, order, camera, line), each level from the one
    below. Buckets count from ``origin``, else from the earliest event; events without a time are in the
    first. The lines of a bucket are bounded by its length."""
    start = F.lit(origin) if origin is not None else events.agg(F.coalesce(F.min("s"), F.lit(0.0)).alias("start")).scalar()
    out, below, least = {}, events.select("order", "camera", "line", F.coalesce(F.floor((F.col("s") - start) / LEVELS[0][1]), F.lit(0)).alias("bucket")), LEVELS[0][1]
    for level, span, lead in LEVELS:
        if level != "clip":
            below = below.select(F.col("bucket").alias("order"), F.lit("").alias("camera"), "line", F.floor(F.col("bucket") * least / span).alias("bucket"))
        rows = below.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("order", "camera", "line"))).alias("rows"))
        said = ([F.concat(F.lit("camera="), F.col("rows")[0]["camera"])] if level == "clip" else []) + ([F.lit(f"mode={mode}")] if mode else [])
        scope = F.concat_ws(", ", *said) if said else None
        items = F.transform("rows", lambda r: r["line"])
        below, least = rows.select("bucket", F.size("rows").alias("n"), summarised(items, level, lead, scope).alias("line")), span
        out[level] = below
    hours = out["hour"].agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "line"))), lambda r: r["line"]).alias("items"))
    items = F.when(F.size("items") > 0, F.col("items")).otherwise(F.array(F.lit(NOTHING)))
    out["report"] = hours.select(F.size("items").alias("n"), summarised(items, "report", REPORT, F.lit(f"mode={mode}") if mode else None).alias("line"))
    return out


def moment(kind: Column, zones: Column, explanation: Column) -> Column:
    """What a suspicious event was, in a few words."""
    place = F.when(F.size(zones) > 0, F.concat(F.lit(" near "), F.array_join(zones, ", "))).otherwise("")
    return F.coalesce(F.nullif(explanation, F.lit("")), F.concat(F.regexp_replace(kind, "_", " "), place))


def open_questions(suspicious: DataFrame) -> DataFrame:
    """(question, first) of suspicious events (order, ts, camera, missing): what evidence is missing, and
    which other cameras to look at. Each question once, by where it is first asked. The cameras are a site's."""
    suspicious = suspicious.join(F.broadcast(suspicious.agg(F.array_sort(F.collect_set("camera")).alias("cameras"))), F.lit(True))  # one row
    clock = F.coalesce(F.date_format("ts", "HH:mm"), F.lit("?"))
    others = F.array_join(F.filter("cameras", lambda c: c != F.col("camera")), ", ")
    wanted = F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda m: F.concat(F.lit("Around "), clock, F.lit(" on "), F.coalesce("camera", F.lit("?")), F.lit(": obtain "), m, F.lit(".")))
    look = F.when(others != "", F.concat(F.lit("Check "), others, F.lit(" for the same person around "), clock, F.lit(" (suspicious activity on "), F.col("camera"), F.lit(").")))
    asked = suspicious.withColumn("qs", F.array_compact(F.concat(wanted, F.array(look)))).select("order", F.posexplode_outer("qs").alias("place", "question")).filter("question IS NOT NULL")
    return asked.groupBy("question").agg(F.min(F.struct("order", "place")).alias("at")).select("question", F.col("at.order").alias("first"))


def parity(n: Column, enough: float) -> Column:
    """How complete a capability is: its count over what is enough, 1 at most."""
    return F.round(F.least(F.lit(1.0), n / enough), 3)


def parity_report(found: dict[str, tuple[DataFrame | None, float | None]], empty_is_pending: tuple[str, ...] = ()) -> DataFrame:
    """(capability, status, value, score, overall, measurable): each capability's ``value`` (a one-row table, or none) as a
    share of what is enough, 1 at most; what can't be measured is pending and counts in no mean."""
    spark = next(df for df, _ in found.values() if df is not None).sparkSession
    rows = None
    for name, (df, enough) in found.items():
        if df is None:
            one = spark.range(1).select(F.lit(name).alias("capability"), F.lit("pending").alias("status"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("score"))
        else:
            v = F.col("value")
            status = F.when((v == 0) & F.lit(name in empty_is_pending), "pending").otherwise("measured")
            one = df.select(F.lit(name).alias("capability"), status.alias("status"), v.cast("double").alias("value"), parity(v, enough).alias("score"))
        rows = one if rows is None else rows.unionAll(one)
    mean = rows.agg(F.round(F.avg("score"), 3).alias("overall"), F.count("score").alias("measurable"))
    return rows.crossJoin(mean)  # one row
