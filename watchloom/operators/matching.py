"""One-to-one matching of expected spans with predicted ones.

A predicted span can match an expected one of the same keys if they share a time and a zone (or neither
names one). Of all one-to-one matchings the one with the most pairs counts and, of those, that with the greatest
overlap in all. Spans of a key that hang together in time are an island, and no pair leaves one; a pair of spans that can
match nothing else is taken as it is, and only islands with a choice are solved, each as an assignment problem. An
island's choices are in one task: they are the spans of one key that overlap without a gap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assignment(overlap: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of (row, column) with positive overlap, of which there are as many as can be and then as much
    overlap as can be: rows are added one at a time along the shortest path of exchanges."""
    n, m = overlap.shape
    turned = n > m
    value = overlap.T if turned else overlap
    n, m = value.shape
    # a pair is worth more than all overlaps together; what can't match costs nothing and is left out after
    cost = np.where(value > 0, -(n + 1.0) - value, 0.0)
    row_price, column_price = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for new in range(n):
        distance, from_column, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, base = new, -1, 0.0
        while row >= 0:
            if column >= 0:
                done[column] = True
            through = base + cost[row] - row_price[row] - column_price
            better = ~done & (through < distance)
            distance[better], from_column[better] = through[better], column
            column = int(np.argmin(np.where(done, np.inf, distance)))
            base, row = distance[column], holder[column]
        # prices move by how much nearer than the end each column on the way was
        row_price[new] += base
        for c in np.flatnonzero(done):
            column_price[c] -= base - distance[c]
            row_price[holder[c]] += base - distance[c]
        while column >= 0:
            before = from_column[column]
            holder[column] = holder[before] if before >= 0 else new
            column = before
    pairs = [(int(r), c) for c, r in enumerate(holder) if r >= 0 and value[r, c] > 0]
    return sorted((c, r) if turned else (r, c) for r, c in pairs)


def match_spans(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(expected_id, predicted_id, overlap) of the matched spans (keys, id, start, end, zones). Spans without a key, a
    time or a length match nothing; ids are distinct on each side."""
    own = [*keys, "id", "start", "end", "zones"]
    sound = lambda df: df.select(*own).filter(" AND ".join(f"{k} IS NOT NULL" for k in (*keys, "id", "start", "end")) + " AND end > start")
    both = sound(expected).withColumn("side", F.lit("e")).unionByName(sound(predicted).withColumn("side", F.lit("p")))
    order = Window.partitionBy(*keys).orderBy("start", "end", "side", "id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = both.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("long")).withColumn("island", F.sum("new").over(order))
    unit = [*keys, "island"]
    e = placed.filter("side = 'e'").select(*unit, F.col("id").alias("expected_id"), F.col("start").alias("a"), F.col("end").alias("z"), F.col("zones").alias("ez"))
    p = placed.filter("side = 'p'").select(*[F.col(c).alias(f"p_{c}") for c in unit], F.col("id").alias("predicted_id"), F.col("start").alias("pa"), F.col("end").alias("pz"), F.col("zones").alias("pzones"))
    shared = F.least("z", "pz") - F.greatest("a", "pa")
    nowhere = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    zones = F.coalesce(F.arrays_overlap("ez", "pzones"), F.lit(False)) | (nowhere("ez") & nowhere("pzones"))
    on = (shared > 0) & zones
    for c in unit:
        on = on & (F.col(c) == F.col(f"p_{c}"))
    edges = e.join(p, on).select(*unit, "expected_id", "predicted_id", (shared / (F.greatest("z", "pz") - F.least("a", "pa"))).alias("overlap"))
    of = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*unit, c))
    edges = edges.withColumn("alone", (of("expected_id") == 1) & (of("predicted_id") == 1))

    def solve(island: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(island["expected_id"], return_inverse=True)
        columns, c = np.unique(island["predicted_id"], return_inverse=True)
        table = np.zeros((len(rows), len(columns)))
        table[r, c] = island["overlap"]
        pairs = assignment(table)
        return pd.DataFrame({"expected_id": [rows[i] for i, _ in pairs], "predicted_id": [columns[j] for _, j in pairs], "overlap": [table[i, j] for i, j in pairs]})

    out = ["expected_id", "predicted_id", "overlap"]
    chosen = edges.filter("NOT alone").groupBy(*unit).applyInPandas(solve, edges.select(*out).schema)
    return edges.filter("alone").select(*out).unionAll(chosen)


def precision_recall(expected: DataFrame, predicted: DataFrame, matched: DataFrame, by: str) -> DataFrame:
    """(by, expected, predicted, matched, precision, recall, f1); what has no denominator is null."""
    kind = expected.select(F.col("id").alias("e"), F.col(by).alias("kind"))
    count = lambda df, name, c=by: df.groupBy(F.col(c).alias(by)).agg(F.count(F.lit(1)).alias(name))
    hits = count(matched.join(kind, F.col("expected_id") == F.col("e")), "matched", "kind")
    joined = count(expected, "expected").join(count(predicted, "predicted"), by, "full").join(hits, by, "left").na.fill(0, ["expected", "predicted", "matched"])
    precision, recall = F.try_divide("matched", "predicted"), F.try_divide("matched", "expected")
    return joined.select(by, "expected", "predicted", "matched", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))
