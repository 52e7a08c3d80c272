"""Retention, roles, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles by rank, and the least role of each action.
RANKS = {"viewer": 0, "reviewer": 1, "admin": 2}
ACTIONS = {"read": "viewer", "approve": "reviewer", "reject": "reviewer", "activate-profile": "admin", "retention": "admin", "backup": "admin"}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def may(role: Column, action: Column) -> Column:
    """Whether the role reaches the action's least role; what isn't known may not."""
    have, need = _lookup(RANKS, role), _lookup(RANKS, _lookup(ACTIONS, action))
    return F.coalesce(have >= need, F.lit(False))


def expired(ts: Column, now: Column, days: int) -> Column:
    """Rows of ``days`` or more; those without a time stay."""
    return F.coalesce(ts <= now - F.make_dt_interval(F.lit(days)), F.lit(False))


def retention_plan(rows: DataFrame, gone: Column, locked: DataFrame, key: str, by: str) -> DataFrame:
    """Per ``by``: rows, expired ones that a lock holds, and those to delete."""
    j = rows.withColumn("_gone", gone).join(locked.select(F.col(key).alias("_l")).distinct(), rows[key] == F.col("_l"), "left")
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_gone") & F.col("_l").isNotNull()).alias("locked_skipped"), F.count_if(F.col("_gone") & F.col("_l").isNull()).alias("would_delete"))


#: What a reviewer's decision makes of an incident.
DECISIONS = {"approve": "confirmed", "reject": "dismissed"}


def decide(status: Column, decision: Column) -> Column:
    """The status after a decision; one that isn't known leaves it."""
    return F.coalesce(_lookup(DECISIONS, decision), status)
