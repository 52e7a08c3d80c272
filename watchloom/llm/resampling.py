"""Importance resampling towards a target distribution, by counts of hashed word runs.

Each feature (a run of 1 to ``RUNS`` consecutive words) falls into one of ``BUCKETS`` buckets. The gain of a
bucket is the logarithm, in thousandths, of its smoothed share in the target texts over that in the documents.
A document's weight is the mean gain of its features; adding a Gumbel variate drawn from its id and taking the
highest scores draws documents without replacement with odds by weight.

Counts: a task adds up its own buckets, so that at most ``BUCKETS`` totals a task are shuffled, whatever the
texts. Scoring takes no shuffle and no explode: higher-order functions make each document's array of buckets, and
an aggregate looks each one up in the array of all gains, a constant of ``BUCKETS`` entries in the plan. Ranking
counts the documents under each score first (scores are whole numbers in a range that logarithms bound), which
tells the lowest score drawn; only documents from that score up are range-sorted, and a partition's rows are
numbered from the number of rows before it. So nothing is sorted that isn't drawn or tied with the last drawn.

Defined results: a null or empty text, or one without a word, has no features and weight 0; without target texts
or documents the smoothed shares still give gains; a text of any length is one row and counts whole; of equal
scores the smaller doc_id comes first, a null id (drawn as the text ``null``) last, of equal ids the one with fewer
features, and repeated rows in any order, since they are alike; an empty table gives an empty table; other columns
are ignored, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from watchloom.llm.common import discard, materialize, text_or_empty

RUNS = 1
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: What a word is made of: ASCII letters (lower-cased) and digits, and all characters beyond ASCII.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """The words of a text, A to Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), BREAK), "")


def bucket_list(words: Column, runs: int = RUNS, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to ``runs`` words; an array may be bound as ``words`` only once, so runs of
    all lengths come from one pass over the places."""
    bucket = lambda run: F.crc32(run.cast("binary")) % buckets
    if runs == 1:
        return F.transform(words, bucket)
    ends = lambda w, i: F.sequence(F.lit(1), F.least(F.lit(runs), F.size(w) - i))
    at = lambda w: F.transform(w, lambda _, i: F.transform(ends(w, i), lambda n: bucket(F.array_join(F.slice(w, i + 1, n), " "))))
    return F.flatten(F.flatten(F.transform(F.array(words), at)))


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the texts."""
    each = texts.select(F.explode(bucket_list(word_list(text_or_empty()), runs, buckets)).alias("bucket"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket in thousandths, rounded down."""
    spark = docs.sparkSession
    here, there = bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets)
    both = here.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(there.select("bucket", F.lit(0).cast("long"), F.col("n")))
    both = both.unionAll(spark.range(buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    rows = sorted((r.bucket, r.s, r.t) for r in counts.collect())  # as many as there are buckets
    all_s, all_t = sum(r[1] for r in rows), sum(r[2] for r in rows)
    told = spark.createDataFrame([(b, s, t) for b, s, t in rows], "bucket long, s long, t long").coalesce(1)
    d = lambda x: x.cast("double")
    ratio = (d(F.col("t")) + 1) * F.lit(float(all_s + buckets)) / ((d(F.col("s")) + 1) * F.lit(float(all_t + buckets)))
    return [r.gain for r in told.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def floor_div(a: Column, b: Column) -> Column:
    """Whole division of longs that goes down."""
    return F.call_function("div", a - F.pmod(a, b), b)


def scored(docs: DataFrame, gain: list[int], runs: int = RUNS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row per document and without a shuffle."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    words = word_list(text_or_empty())
    each = docs.select("doc_id", F.size(words).cast("long").alias("n_words"), bucket_list(words, runs, len(gain)).alias("buckets"))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, (b + 1).cast("int")))
    n = F.size("buckets").cast("long")
    mean = F.when(n > 0, floor_div(total, n)).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return each.select("doc_id", "n_words", n.alias("n_features"), mean.alias("weight"), (mean + gumbel).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, runs: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the rank of the documents drawn, null for the others."""
    columns = ["doc_id", "n_features", "weight", "score"]
    table = materialize(scored(docs, gains(docs, target, runs, buckets), runs, seed), "scores")
    may = F.col("n_words") >= least_words
    under = table.filter(may).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    under = sorted(((r.score, r.n) for r in under.collect()), reverse=True)  # scores are within bounds that logarithms set
    wanted, drawn, cut = sum(n for _, n in under) * percent // 100, 0, None
    for score, n in under:
        if drawn >= wanted:
            break
        drawn, cut = drawn + n, score
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return table.select(*columns, none)
    at_stake = may & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    # repeated rows differ by their mark, so that they too can lie in several ranges
    best = table.filter(at_stake).withColumn("mark", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("mark").asc()).sortWithinPartitions(*order, "mark")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    best = materialize(best.select(*columns, F.spark_partition_id().alias("part"), (place + 1).alias("place")), "drawn")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = best.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("place")
    ranked = best.join(starts, F.col("part") == F.col("p")).select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionAll(table.filter(~at_stake).select(*columns, none))
