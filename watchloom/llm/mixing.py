"""Mixing sources to target weights by weighted fair queueing.

Each document of a source, in a shuffled order, gets a virtual finish time: the source's cumulative
words up to its end, divided by the source's target. All documents (and, for sources whose target
exceeds their size, a second round of them) are range-sorted by that time and the sequence is cut
where the total budget is reached, which leaves each source within a document of its target.

Cumulative sums never gather a source in one task: rows are dealt to (source, slice of the shuffled
order) and slices get their offsets from a prefix sum over slice totals; the global order is cut in
the same way over equal ranges of virtual time.

Defined results: null text has size 0 and is taken 0 times; null source is a source of its own, the
last; an empty table gives an empty result; repeated rows are documents of their own; a very long text is one
document, taken whole or not; documents of equal place in the shuffled order come by id, size and, where rows
themselves are given back, by where they were written; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import WORD, internal, materialize, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
#: Rows that a slice of a source is planned for, and the most slices a source has.
SLICE_ROWS = 128
MAX_SLICES = 8192
#: Ranges of virtual time for each doubling of (1 + time).
RANGES = 4096


def word_count(text: Column) -> Column:
    """The number of maximal runs of characters other than white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, place, source_size, target) from (source, size) rows, one per source.

    The water level: sources are ordered by the level at which they are full (cap / weight); the
    level that spends the budget is that of the first prefix of full sources after which no other
    source is above its cap.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % n + 1).cast("int")).cast("long")
    by = by.withColumn("weight", weight).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "place")
    before, all_ = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    by = (
        by.withColumn("total", F.sum("source_size").over(all_))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("full"), F.col("level")))).over(all_)["level"])
    )
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")), F.col("cap").cast("double"))
    return by.select("source", "place", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs``' (doc_id) with size, source_size, target and taken, one row per document."""
    size = word_count(text_or_empty())
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = materialize(docs.select("doc_id", "source", size.alias("size"), shuffled.alias("h")), "mix")
    return placed(rows, weights, share, repeats).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    mark = internal(docs, "mark")
    table = materialize(docs.withColumn(mark, F.monotonically_increasing_id()), "mix-rows")
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = materialize(table.select("doc_id", "source", word_count(text_or_empty()).alias("size"), shuffled.alias("h"), F.col(mark).alias("mark")), "mix")
    taken = placed(rows, weights, share, repeats).filter("times > 0").select(F.col("mark").alias(mark + "t"), F.col("times").alias(mark + "n"))
    return table.join(taken, F.col(mark) == F.col(mark + "t")).select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(mark + "n").cast("int"))).alias(mark)).drop(mark)


def placed(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """``rows`` (doc_id, source, size, h and any others) with source_size, target, and times: how
    often the mix takes the row."""
    spark = rows.sparkSession
    n = rows.count()
    slices = min(MAX_SLICES, max(16, n // SLICE_ROWS))
    rows = rows.withColumn("slice", (F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * slices / (1 << 24)).cast("int"))
    totals = materialize(rows.groupBy("source", "slice").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-slices")
    targets = source_targets(totals, weights, share, repeats)
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "slice", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("offset"))
    plan = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    plan = materialize(plan, "mix-plan").withColumnsRenamed({"source": "p_source", "slice": "p_slice"})
    within = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size", *[c for c in rows.columns if c == "mark"]).rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.withColumn("run", F.sum("size").over(within)).withColumn("k", F.row_number().over(within))
    timed = timed.join(plan, timed["source"].eqNullSafe(plan["p_source"]) & (timed["slice"] == plan["p_slice"]), "left").drop("p_source", "p_slice")
    timed = materialize(timed.withColumn("cum", F.col("offset") + F.col("run")).drop("offset", "run"), "mix-timed")
    # each round of a source follows the one before it
    finish = lambda r: (F.col("cum") + r * F.col("source_size")) / F.col("target")
    each = timed.filter("size > 0 and target > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    each = each.select("place", "h", "k", "size", finish(F.col("round")).alias("finish"))
    each = each.withColumn("range", F.floor(F.log2(F.col("finish") + 1) * RANGES))
    budget = share * (totals.agg(F.sum("size")).first()[0] or 0)
    sums = each.groupBy("range").agg(F.sum("size").alias("size"))
    sums = sums.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    sorted_ = Window.partitionBy("range").orderBy("finish", "place", "h", "k").rowsBetween(Window.unboundedPreceding, 0)
    upto_here = each.withColumn("run", F.sum("size").over(sorted_)).join(sums, "range")
    last = upto_here.filter(F.col("before") + F.col("run") <= budget).agg(F.max(F.struct("finish", "place", "h", "k")).alias("cut")).first()["cut"]
    if last is None:
        return timed.withColumn("times", F.lit(0).cast("long"))
    cut = F.struct(*[F.lit(v).cast(t) for v, t in zip(last, ("double", "int", "string", "int"), strict=True)])
    taken = sum((F.struct(finish(F.lit(r)).alias("finish"), "place", "h", "k") <= cut).cast("long") for r in range(repeats))
    return timed.withColumn("times", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0).cast("long")))
