"""Energy, cost and benchmark formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.operators.quantiles import percentiles
from watchloom.operators.search import normalised_score

RATE = 10.0


def watt_hours(watts: Column, seconds: Column) -> Column:
    return watts * seconds / 3600


def cost(wh: Column, rate: float = RATE) -> Column:
    return wh / 1000 * rate


def per_thousand(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n * 1000).otherwise(0.0)


#: Hours of a day and days of a month.
HOURS, DAYS = 24, 30


def per_hour(watts: Column, rate: float = RATE) -> Column:
    return cost(watt_hours(watts, F.lit(3600)), rate)


def per_clips(watts: Column, per_minute: Column, n: int = 1000, rate: float = RATE) -> Column:
    """The energy of ``n`` clips at a throughput; 0 without one."""
    return F.when(per_minute > 0, cost(watt_hours(watts, n / (per_minute / 60)), rate)).otherwise(0.0)


def store_month(watts: Column, rate: float = RATE) -> Column:
    """A month of one box at a steady load."""
    return cost(watt_hours(watts, F.lit(HOURS * DAYS * 3600)), rate)


def camera_month(watts: Column, cameras: Column, rate: float = RATE) -> Column:
    """A camera's share of it; 0 without cameras."""
    return F.when(cameras > 0, store_month(watts, rate) / cameras).otherwise(0.0)


#: What each measure weighs, and whether less of it is better.
SCORE = {"cpm": (0.35, False), "p95": (0.25, True), "quality": (0.25, False), "cost": (0.15, True)}


def ranked(runs: DataFrame, by: list[str]) -> DataFrame:
    """``runs`` (by, runtime, and the measures of ``SCORE``) with score and place, within each of ``by``."""
    s = normalised_score(runs, SCORE, by)
    return s.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "runtime")))


def picked(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by, production, fallback): the best available runtime, else the best; and of the others the one that is available,
    most portable and best, in this order; ties by name."""
    names = F.array_sort(F.collect_list(F.struct((~F.col("available")).alias("a"), (-F.col("portable")).alias("b"), (-F.col("score")).alias("c"), "runtime")))
    p = ranks.groupBy(*by).agg(F.min(F.struct((~F.col("available")).alias("a"), (-F.col("score")).alias("c"), "runtime"))["runtime"].alias("production"), names.alias("all"))
    rest = F.get(F.filter("all", lambda r: r["runtime"] != F.col("production")), 0)["runtime"]
    return p.select(*by, "production", F.coalesce(rest, F.col("production")).alias("fallback"))


def benchmark(runs: DataFrame, by: list[str], watts: float) -> DataFrame:
    """One row per group: throughput, latency percentiles, tokens, energy and cost."""
    seconds = F.greatest(F.sum("latency_ms") / 1000, F.lit(1e-9))
    wh = watt_hours(F.lit(watts), seconds)
    n = F.count(F.lit(1))
    sums = runs.groupBy(*by).agg(
        n.alias("n"), F.round(n / seconds * 60, 4).alias("per_minute"), F.round(F.avg("tokens_per_sec"), 4).alias("tokens_per_sec"),
        F.round(wh, 6).alias("wh"), F.round(per_thousand(cost(wh), n), 6).alias("cost_per_1000"))
    found = percentiles(runs, by, "latency_ms", {"p50": 0.5, "p95": 0.95}).withColumnsRenamed({c: f"p_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return sums.join(found, same, "left").select(*by, "n", "per_minute", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "tokens_per_sec", "wh", "cost_per_1000")


def economy(power: DataFrame, watts: str, seconds: float, events: int) -> DataFrame:
    """Average power, energy, cost, events per Wh and cost per event, with floors against division by 0."""
    avg = F.avg(watts)
    wh = avg * seconds / 3600
    return power.agg(
        F.round(avg, 2).alias("avg_power_w"), F.round(wh, 4).alias("energy_wh"), F.round(cost(wh), 6).alias("cost"),
        F.round(F.lit(float(events)) / F.greatest(wh, F.lit(0.001)), 2).alias("events_per_wh"), F.round(cost(wh) / max(events, 1), 6).alias("cost_per_event"))
