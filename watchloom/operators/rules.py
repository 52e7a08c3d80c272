"""Declarative rules over each subject's history, compiled to column expressions.

A rule is a conjunction of conditions on everything a subject has done so far. Each condition becomes a
running aggregate over the subject's arrivals, so a history is read once, in order, whatever the number
of rules; a rule fires at a subject's first arrival at which all its conditions hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.scalar import uuid5

SUBJECT, ARRIVAL = "track", "arrival"


@dataclass(frozen=True)
class Rule:
    """``makes`` is the type of the event or, if ``incident``, of the incident that the rule makes."""

    id: str
    makes: str
    severity: str = "info"
    verify: bool = False
    incident: bool = False
    conditions: tuple[tuple[str, object], ...] = field(default=())


#: The rules as configured.
RULES = (
    Rule("suspicious_item_interaction", "suspicious_item_interaction", "medium", True, False, (("person_in_zone", "shelf"), ("object_near_person_hand", True), ("dwell_time_sec_gte", 3))),
    Rule("possible_billing_bypass", "possible_loss", "high", True, True, (("person_has_item", True), ("visited_billing_zone", False), ("moved_to_zone", "exit"))),
    Rule("camera_health_issue", "camera_health_issue", "warning", False, False, (("camera_health_score_lte", 0.5),)),
)


def parse(text: list[dict]) -> tuple[Rule, ...]:
    """Rules from their configuration: conditions are lists of one-entry maps."""
    rules = []
    for r in text:
        act = r.get("action", {})
        made = act.get("create_incident") or act.get("create_event") or r["id"]
        conditions = tuple((k, v) for c in r.get("conditions", []) for k, v in c.items())
        rules.append(Rule(r["id"], made, act.get("severity", "info"), bool(act.get("needs_vlm_verification")), "create_incident" in act, conditions))
    return tuple(rules)


def history() -> Window:
    return Window.partitionBy(SUBJECT).orderBy(ARRIVAL).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clock() -> Column:
    """An event's time; one without a time is of time 0."""
    return F.coalesce(F.nanvl(F.col("ts").cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def observed(kind: str, value) -> tuple[Column, Column, Column]:
    """What the history shows of a condition: in words, as a number (either may be null), and whether the condition
    holds; one of a kind that isn't known never does. Null lists are empty."""
    w = history()
    ever = lambda c: F.coalesce(F.bool_or(c).over(w), F.lit(False))
    in_zone = lambda z: F.coalesce(F.array_contains("zone_types", z), F.lit(False))
    no_word, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    flag = lambda c: (c.cast("string"), no_number, c == F.lit(bool(value)))
    match kind:
        case "person_in_zone":
            seen = ever(in_zone(value))
            return seen.cast("string"), no_number, seen
        case "dwell_time_sec_gte":
            dwell = F.max(clock()).over(w) - F.min(clock()).over(w)
            return no_word, dwell, (F.count(F.lit(1)).over(w) >= 2) & (dwell >= value)
        case "object_near_person_hand":
            return flag(ever(F.col("object_near_hand")))
        case "person_has_item":
            return flag(ever(F.coalesce("has_item", F.lit(False)) | (F.size(F.array_except("objects", F.array(F.lit("person")))) > 0)))
        case "visited_billing_zone":
            return flag(ever(in_zone("billing_counter")))
        case "moved_to_zone":
            last = F.max_by(F.coalesce("zone_types", F.array().cast("array<string>")), F.struct(clock(), ARRIVAL)).over(w)
            return F.array_join(last, ","), no_number, F.coalesce(F.array_contains(last, value), F.lit(False))
        case "camera_health_score_lte":
            worst = F.min(F.nanvl(F.col("camera_health_score").cast("double"), F.lit(None).cast("double"))).over(w)
            return no_word, worst, F.coalesce(worst <= value, F.lit(False))
    return no_word, no_number, F.lit(False)


def condition(kind: str, value) -> Column:
    """One condition over the history."""
    return observed(kind, value)[2]


def evaluate(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``events`` (track, arrival, ts, zone_types, objects, ...) with ``holds``: rule ids that hold here."""
    checks = [F.when(reduce(lambda a, b: a & b, [condition(*c) for c in r.conditions], F.lit(True)), F.lit(r.id)) for r in rules]
    return events.withColumn("holds", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def explain(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``events`` with ``whys``: for each rule the evidence (rule_id, place, condition, observed, amount, holds) of its
    conditions in order, up to the first that doesn't hold; the others aren't looked at."""
    found = []
    for r in rules:
        so_far = F.lit(True)
        for place, (kind, value) in enumerate(r.conditions):
            word, number, holds = observed(kind, value)
            evidence = F.struct(F.lit(r.id).alias("rule_id"), F.lit(place).alias("place"), F.lit(kind).alias("condition"), word.alias("observed"), number.alias("amount"), holds.alias("holds"))
            found.append(F.when(so_far, evidence))
            so_far = so_far & holds
    return events.withColumn("whys", F.array_compact(F.array(*found)))


def first_firings(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(track, rule_id, arrival, ts): where each rule first holds for each subject."""
    held = evaluate(events, rules).select(SUBJECT, ARRIVAL, "ts", F.explode("holds").alias("rule_id"))
    return held.groupBy(SUBJECT, "rule_id").agg(F.min(ARRIVAL).alias(ARRIVAL), F.min_by("ts", ARRIVAL).alias("ts"))


def actions(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the firings make: (rule_id, track, arrival, zones, sources, makes, severity, needs_verification, incident,
    id): the subject's zones and source events so far.

    A history is shuffled once: running windows say where rules hold, a window over the whole history gives each
    rule's first such arrival, and one aggregate collects what came up to it.
    """
    own = evaluate(events, rules)
    whole = Window.partitionBy(SUBJECT)
    fired = {r.id: F.min(F.when(F.array_contains("holds", r.id), F.col(ARRIVAL))).over(whole) for r in rules}
    own = own.select(SUBJECT, ARRIVAL, "event_id", clock().alias("at"), F.coalesce("zone_types", F.array().cast("array<string>")).alias("zone_types"), *[c.alias(f"first{i}") for i, c in enumerate(fired.values())])
    made = []
    for i, r in enumerate(rules):
        first = F.col(f"first{i}")
        before = F.col(ARRIVAL) <= first
        made.append(F.struct(
            F.lit(r.id).alias("rule_id"), F.min(first).alias(ARRIVAL), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(before, F.col("zone_types")))))).alias("zones"),
            F.transform(F.array_sort(F.collect_list(F.when(before & F.col("event_id").isNotNull(), F.struct("at", ARRIVAL, "event_id")))), lambda x: x["event_id"]).alias("sources"),
            F.lit(r.makes).alias("makes"), F.lit(r.severity).alias("severity"), F.lit(r.verify).alias("needs_verification"), F.lit(r.incident).alias("incident")))
    if not made:
        return first_firings(events, rules)
    each = own.groupBy(SUBJECT).agg(F.array(*made).alias("made")).select(SUBJECT, F.inline("made")).filter(F.col(ARRIVAL).isNotNull())
    return each.withColumn("id", uuid5(F.concat_ws("|", "rule_id", F.col(SUBJECT).cast("string"), "makes")))


def forwards(fired: DataFrame) -> DataFrame:
    """One verification per camera, subject, type and segment: the first to arrive."""
    w = Window.partitionBy("camera_id", SUBJECT, "makes", "segment_id").orderBy(ARRIVAL)
    return fired.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
