"""Streams of events: rules with state per subject, windows, duplicates, dead letters.

A file source takes the place of the queue; offsets and state are in the checkpoint, so a restarted
query neither loses nor repeats an event. Watermarks and time-outs are additions, and are parameters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from watchloom.operators.rules import RULES, Rule, parse


def topic(spark: SparkSession, folder: str, schema, fmt: str = "parquet", per_batch: int = 8) -> DataFrame:
    """A folder as a topic: new files are new events, malformed JSON lines are dropped."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if fmt == "json":
        reader = reader.option("mode", "DROPMALFORMED")
    return reader.format(fmt).load(folder)


def timed(events: DataFrame, late: str) -> DataFrame:
    """With a watermark; times without a zone are the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, width: str = "30 seconds", slide: str = "25 seconds", late: str = "1 hour") -> DataFrame:
    return timed(events, late).groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, key: str, late: str | None = "1 hour") -> DataFrame:
    """Each key once within the watermark or, with ``late`` None, once for ever: the state then keeps every key."""
    return events.dropDuplicates([key]) if late is None else timed(events, late).dropDuplicatesWithinWatermark([key])


class History:
    """What the conditions need of a subject's past: a few numbers, whatever its length."""

    FIELDS = ("n", "low", "high", "near", "item", "zones", "latest_ts", "latest_zones", "health", "fired")

    def __init__(self, state: tuple | None = None):
        n, low, high, near, item, zones, lt, lz, health, fired = state or (0, 0.0, 0.0, False, False, [], float("-inf"), [], float("inf"), [])
        self.n, self.low, self.high, self.near, self.item = n, low, high, near, item
        self.zones, self.latest_ts, self.latest_zones, self.health, self.fired = set(zones), lt, list(lz), health, set(fired)

    def add(self, e) -> None:
        ts = 0.0 if e.ts is None or e.ts != e.ts else e.ts  # as in batch
        zones, objects = ([] if x is None else [y for y in x if y is not None] for x in (e.zone_types, e.objects))
        self.low, self.high = (min(self.low, ts), max(self.high, ts)) if self.n else (ts, ts)
        self.n += 1
        self.near |= bool(e.object_near_hand)
        self.item |= bool(e.has_item) or any(o != "person" for o in objects)
        self.zones |= set(zones)
        if ts >= self.latest_ts:
            self.latest_ts, self.latest_zones = ts, zones
        if e.camera_health_score is not None and e.camera_health_score == e.camera_health_score:
            self.health = min(self.health, e.camera_health_score)

    def holds(self, kind: str, value) -> bool:
        match kind:
            case "person_in_zone":
                return value in self.zones
            case "dwell_time_sec_gte":
                return self.n >= 2 and self.high - self.low >= value
            case "object_near_person_hand":
                return self.near == value
            case "person_has_item":
                return self.item == value
            case "visited_billing_zone":
                return ("billing_counter" in self.zones) == value
            case "moved_to_zone":
                return value in self.latest_zones
            case "camera_health_score_lte":
                return self.health <= value
        return False

    def state(self) -> tuple:
        return (self.n, self.low, self.high, self.near, self.item, sorted(self.zones), self.latest_ts, self.latest_zones, self.health, sorted(self.fired))


STATE = "n long, low double, high double, near boolean, item boolean, zones array<string>, latest_ts double, latest_zones array<string>, health double, fired array<string>"
FIRED = "track {}, rule_id string, arrival long, ts double"


@lru_cache(64)
def _told(text: str | None) -> tuple[Rule, ...]:
    return parse(json.loads(text)) if text else ()


def firings(events: DataFrame, rules: tuple[Rule, ...] = RULES, ttl_ms: int | None = None) -> DataFrame:
    """First firings (track, rule_id, arrival, ts) of a stream of subjects' events. Within a batch events are
    taken in order of arrival. With ``ttl_ms`` a subject that is silent so long is forgotten. Events with a column ``rules``
    bring the rules that hold for them (see ``versioned``), which then take the place of ``rules``."""
    own = "rules" in events.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        h, out = History(state.get if state.exists else None), []
        rows = pd.concat(list(frames)).sort_values("arrival")
        for e in rows.itertuples():
            h.add(e)
            for r in _told(e.rules) if own else rules:
                if r.id not in h.fired and all(h.holds(k, v) for k, v in r.conditions):
                    h.fired.add(r.id)
                    out.append((key[0], r.id, e.arrival, None if e.ts is None or e.ts != e.ts else e.ts))
        state.update(h.state())
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["track", "rule_id", "arrival", "ts"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("track").applyInPandasWithState(run, FIRED.format(events.schema["track"].dataType.simpleString()), STATE, "append", timeout)


def put_rules(spark: SparkSession, rules: list[dict], version: int, path: str) -> None:
    """A version of the configured rules, as a row (version, rules) added to a table; none is ever rewritten."""
    spark.createDataFrame([(version, json.dumps(rules))], "version long, rules string").coalesce(1).write.mode("append").parquet(path)


def versioned(config: str, sink: str) -> Callable[[DataFrame, int], None]:
    """A batch function that gives each event of a batch the newest version of the rules when the batch is worked off, and
    adds it to the topic ``sink``. A running stream so takes up a change with its next batch; a batch that is run again
    replaces what it wrote."""

    def run(batch: DataFrame, number: int) -> None:
        table = batch.sparkSession.read.schema("version long, rules string").parquet(config)
        newest = table.agg(F.max_by(F.struct("version", "rules"), "version").alias("v")).first()["v"]
        version, rules = (newest["version"], newest["rules"]) if newest else (None, None)
        tagged = batch.withColumns({"rules_version": F.lit(version).cast("long"), "rules": F.lit(rules).cast("string")})
        tagged.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return run


def drain_each(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off what is there, batch by batch, then stop."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Work off what is there, then stop."""
    stream.writeStream.format(fmt).outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_last(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Work off what is there; ``sink`` holds the whole result as of the last batch."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_dead_letters(work: Callable[[DataFrame], DataFrame], sink: str, dead: str) -> Callable[[DataFrame, int], None]:
    """A batch function: a batch that fails goes to ``dead`` whole, with its number and why; a batch that is run
    again replaces what it wrote."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        except Exception as e:  # noqa: BLE001  any failure of the work is what dead letters are for
            batch.withColumns({"why": F.lit(str(e)[:500])}).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return run
