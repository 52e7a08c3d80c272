"""Search for many requests at once: metadata and vectors, fused and ranked for each request.

The nearest vectors of all requests come from blocks of requests against tiles of vectors, each pair of them
once, in a task that holds one block and one tile; a tile gives at most k rows a request, and Spark limits those
before their shuffle. The newest events of a kind are found once a kind, not once a request.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.text import terms
from watchloom.operators.search import WEIGHTS, request_columns

TILE, BLOCK = 8192, 512
#: Digits of a cosine that count, so that equal vectors are equally near in whatever block they are.
DIGITS = 9


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in vectors])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, np.inf)


def _nearest_of_tile(k: int):
    def run(tile: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(tile) or not len(block):
            return pd.DataFrame({"request": [], "id": [], "score": []})
        tile = tile.sort_values("id", ignore_index=True)
        score = np.round(np.maximum(_units(block["vector"]) @ _units(tile["vector"]).T, 0), DIGITS)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # of equal scores the smaller id
        n = best.shape[1]
        return pd.DataFrame({"request": np.repeat(block["request"].to_numpy(), n), "id": tile["id"].to_numpy()[best.ravel()], "score": np.take_along_axis(score, best, 1).ravel()})

    return run


def nearest_to_each(requests: DataFrame, vectors: DataFrame, k: int, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(request, id, score): for each of ``requests`` (request, vector) the ``k`` of ``vectors`` (id, vector) with
    the greatest cosine (0 at least), ties by id. Rows with a null or another's length of vector have no part;
    ids and requests are longs."""
    asked, there = requests.filter("request IS NOT NULL AND vector IS NOT NULL"), vectors.filter("id IS NOT NULL AND vector IS NOT NULL")
    n, m, width = there.count(), asked.count(), asked.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return requests.sparkSession.createDataFrame([], "request long, id long, score double")
    sound = lambda df: df.filter((F.size("vector") == width) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    tiles, blocks = max(1, math.ceil(n / tile)), max(1, math.ceil(m / block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    left = sound(there).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), own("id", tiles).alias("tile"), every(blocks).alias("block"))
    right = sound(asked).select(F.col("request").cast("long").alias("request"), F.col("vector").cast("array<double>").alias("vector"), every(tiles).alias("tile"), own("request", blocks).alias("block"))
    found = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(_nearest_of_tile(k), "request long, id long, score double")
    order = Window.partitionBy("request").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def newest_of_kinds(asked: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """(kinds, id, kind, at): for each list of kinds in ``asked`` the newest events (id, kind, at) of those kinds, or of
    any kind where the list is empty. Lists are made of the kinds that patterns stand for, so there are few."""
    order = [F.col("at").desc_nulls_last(), F.col("id").asc()]
    of_kind = events.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("n") <= most).drop("n")
    lists = asked.select("kinds").distinct()
    told = lists.filter(F.size("kinds") > 0).select("kinds", F.explode("kinds").alias("wanted"))
    some = told.join(of_kind, F.col("wanted") == F.col("kind")).drop("wanted")
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("kinds").orderBy(*order))).filter(F.col("n") <= most).drop("n")
    any_ = lists.filter(F.size("kinds") == 0).crossJoin(events.orderBy(*order).limit(most))  # one list
    return some.select("kinds", "id", "kind", "at").unionAll(any_.select("kinds", "id", "kind", "at"))


def explained(c: DataFrame, weights: tuple[float, float, float]) -> Column:
    """How a score is put into words."""
    v, m, r = weights
    known = F.when(F.col("matches"), F.concat(F.lit(" ("), "kind", F.lit("∈query)"))).otherwise("")
    return F.concat(
        F.format_string(f"vector=%.3f*{v} + meta=%d*{m}", "vector", F.col("matches").cast("int")), known, F.format_string(f" + recency=%.2f*{r}", "recency"),
        F.when(F.col("shared") > 0, F.format_string(" | critic:+%.2f (matched %d term(s))", 0.05 * F.col("shared"), "shared")).otherwise(" | critic: no lexical overlap"))


def search_many(requests: DataFrame, events: DataFrame, items: DataFrame, k: int = 10, weights: tuple[float, float, float] = WEIGHTS, most_events: int = 200) -> DataFrame:
    """(request, rank, id, kind, at, score, why): the best ``k`` for each of ``requests`` (request, text, vector).

    Candidates are the newest ``most_events`` of ``events`` (id, kind, at) of the kinds that a request stands for, and
    the nearest of ``items`` (id, text, vector), five times ``k`` and 50 at least, merged by id. A score weighs the
    cosine, whether the kind is asked for, and how recent the event is among the request's candidates (0 without a time,
    or if all are of one time); each term of the request in an item's text adds 0.05. Ties go by id.
    """
    parsed = request_columns(F.coalesce("text", F.lit("")))
    asked = requests.select("request", "vector", parsed.alias("p"), terms(F.coalesce("text", F.lit(""))).alias("wanted")).select("request", "vector", "wanted", F.col("p.kinds").alias("kinds"))
    near = nearest_to_each(asked, items, max(5 * k, 50))
    near = near.join(items.select(F.col("id").alias("i"), "text"), F.col("id") == F.col("i")).select("request", "id", F.col("score").alias("vector"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("at"), "text")
    lists = newest_of_kinds(asked, events, most_events).withColumnRenamed("kinds", "of")
    meta = asked.select("request", "kinds").join(lists, F.col("kinds") == F.col("of")).select("request", "id", F.lit(0.0).alias("vector"), "kind", "at", F.lit(None).cast("string").alias("text"))
    merged = meta.unionAll(near).groupBy("request", "id").agg(F.max("vector").alias("vector"), F.max("kind").alias("kind"), F.max("at").alias("at"), F.max("text").alias("text"))
    own = asked.select(F.col("request").alias("r"), "kinds", "wanted")
    c = merged.join(own, F.col("request") == F.col("r")).drop("r")
    times = Window.partitionBy("request")  # at most k's and the events' candidates
    low, span = F.min("at").over(times), F.max("at").over(times) - F.min("at").over(times)
    c = c.withColumns({
        "matches": F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False)),
        "recency": F.coalesce((F.col("at") - low) / F.when(span == 0, 1.0).otherwise(span), F.lit(0.0)),
        "shared": F.size(F.array_intersect(terms(F.coalesce("text", F.lit(""))), "wanted"))})
    v, m, r = weights
    fused = F.round(v * F.col("vector") + m * F.col("matches").cast("int") + r * F.col("recency"), 6)
    c = c.select("request", "id", "kind", "at", F.round(fused + 0.05 * F.col("shared"), 6).alias("score"), explained(c, weights).alias("why"))
    order = Window.partitionBy("request").orderBy(F.desc("score"), "id")
    return c.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("request", "rank", "id", "kind", "at", "score", "why")
