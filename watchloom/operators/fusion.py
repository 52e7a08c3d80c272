"""Fusing reports of several viewpoints: best spans, and greedy merging of like descriptions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hull_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two spans over the span that holds both."""
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, inter / hull).otherwise(0.0)


def like(a: set, b: set) -> bool:
    return bool(a and b) and len(a & b) / max(len(a), len(b)) >= 0.5


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept reports of each island; rows come by group, island and place in the order of merging."""
    names, unit, kept, out = None, None, [], []

    def settled() -> list[tuple]:
        return [(k[6], k[7], k[0], k[1], k[2], k[3], k[5]) for k in kept]

    def record(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (names.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()), strict=True)], [names.field(0).name, "created", "pos", "start", "end", "description", "merged"])

    for batch in batches:
        names = batch.schema
        for group, island, pos, start, end, text in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if (group, island) != unit:
                out += settled()
                unit, kept = (group, island), []
            w, whole = set(text.lower().split()), start is not None and end is not None
            for k in kept:
                if not whole or k[1] is None or k[2] is None:
                    continue
                inter, hull = min(end, k[2]) - max(start, k[1]), max(end, k[2]) - min(start, k[1])
                if hull > 0 and inter / hull > 0.3 and like(w, k[4]):
                    if len(text) > len(k[3]):
                        k[:5] = [pos, start, end, text, w]
                    k[5] += 1
                    break
            else:
                kept.append([pos, start, end, text, w, 1, group, pos])
        if len(out) >= 10_000:
            yield record(out)
            out = []
    if names is not None:
        yield record(out + settled())


def merge_reports(reports: DataFrame, group: str) -> DataFrame:
    """Greedy merging in the order ``pos`` within each ``group``: a report joins the first kept one of like
    words and overlapping span (hull IoU above 0.3), and the longer description replaces the kept one in
    place. The order matters and likeness isn't transitive; but reports that merge overlap, so a group falls into
    islands of time without a common moment, each a unit of work of its own. ``place`` numbers a group's kept reports in
    the order in which they were first kept. A report without a start or an end merges with none; a null
    description has no words."""
    kind = reports.schema[group].dataType.simpleString()
    r = reports.select(group, F.col("pos").cast("long").alias("pos"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.coalesce("description", F.lit("")).alias("description"))
    order = Window.partitionBy(group).orderBy("start", "end", "pos")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("long")).withColumn("island", F.sum("new").over(order))
    rows = r.select(group, "island", "pos", "start", "end", "description").repartition(group, "island").sortWithinPartitions(group, "island", "pos", "start", "end", "description")
    kept = rows.mapInArrow(_merged, f"{group} {kind}, created long, pos long, start double, end double, description string, merged long")
    place = F.row_number().over(Window.partitionBy(group).orderBy("created")) - 1
    return kept.select(group, place.cast("long").alias("place"), "pos", "start", "end", "description", "merged")
