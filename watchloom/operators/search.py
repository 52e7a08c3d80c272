"""Search: parsing of requests, vectors, merging, scoring and ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.text import terms
from watchloom.sources.files import scratch

#: Patterns of a request and the kinds of event that they stand for.
INTENTS = (
    (
        r"without (billing|paying|scan|checkout)|skip(ped)? (the )?(bill|counter)|not (pay|bill)|missing billing|bypass|walk(ed|s|ing)? away|left without",
        ("possible_billing_bypass", "possible_loss", "billing_bypass"),
    ),
    (
        r"pick(ed|s|ing)?( up)?|took|grab(bed|s|bing)?|interact|touch(ed|ing)?|remov(e|ed|ing)|put (it )?in (a )?(bag|pocket)",
        ("suspicious_item_interaction",),
    ),
    (r"camera (block|cover|down|black|frozen|tamper)|obscured|blind", ("camera_health_issue",)),
)
#: Patterns of a request and the zone that they hint at.
ROUTES = (
    (r"\bexit\b|left the store|out the door|walked out", "exit"),
    (r"\bentry\b|entered|came in", "entry"),
    (r"\bshelf|aisle|rack", "shelf"),
    (r"\bbilling|counter|checkout|cashier|till", "billing_counter"),
)
#: Things that a request may name, in this order.
OBJECTS = ("item", "product", "bottle", "box", "bag", "handbag", "backpack", "goods", "merchandise")
#: A thing and a leaving stand for a loss.
LEAVING = r"walk(ed|s|ing)? away|left|away"
LOSSES = ("possible_billing_bypass", "possible_loss")
WEIGHTS = (0.7, 0.2, 0.1)


def request_columns(text: Column) -> Column:
    """What requests stand for: a struct of kinds of event, routes (zones) and objects (things)."""
    low = F.lower(text)
    some = lambda found: F.flatten(F.array_compact(F.array(*found)))
    texts = lambda items: F.array(*[F.lit(x) for x in items])
    objects = some([F.when(low.rlike(rf"\b{w}s?\b"), texts([w])) for w in OBJECTS])
    kinds = [F.when(low.rlike(pattern), texts(ks)) for pattern, ks in INTENTS]
    kinds.append(F.when((F.size(objects) > 0) & low.rlike(LEAVING), texts(LOSSES)))
    routes = some([F.when(low.rlike(pattern), texts([zone])) for pattern, zone in ROUTES])
    return F.struct(F.array_sort(F.array_distinct(some(kinds))).alias("kinds"), routes.alias("routes"), objects.alias("objects"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of doubles; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, wanted: list[float], k: int, column: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The ``k`` rows nearest to one vector, with ``score`` = max(0, cosine); the vector is a constant."""
    q = F.array(*[F.lit(float(x)) for x in wanted])
    return vectors.withColumn("score", F.greatest(F.lit(0.0), cosine(F.col(column), q))).orderBy(F.desc("score"), tie).limit(k)


def fuse(candidates: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """``candidates`` (vector, matches, at) with the weighted score; recency is between the oldest and the
    newest of the candidates, 1 if all are of one time, 0 without a time."""
    path = scratch(candidates.sparkSession, "candidates")  # written, since they are read twice
    candidates.write.parquet(path)
    candidates = candidates.sparkSession.read.schema(candidates.schema).parquet(path)
    span = candidates.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    c = candidates.join(F.broadcast(span), F.lit(True))  # one row
    recency = F.when(F.col("at").isNull(), 0.0).when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    v, m, r = weights
    return c.withColumn("score", F.round(v * F.coalesce("vector", F.lit(0.0)) + m * F.col("matches").cast("int") + r * recency, 6)).drop("lo", "hi")


def rerank(scored: DataFrame, wanted: list[str], k: int | None, tie: str) -> DataFrame:
    """Scores raised by 0.05 for each term of the request in the text; the best ``k``."""
    hits = F.size(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(w) for w in wanted]).cast("array<string>")))
    out = scored.withColumn("score", F.round(F.col("score") + 0.05 * hits, 6)).orderBy(F.desc("score"), tie)
    return out.limit(k) if k else out


def hash_vector(text: str, dim: int = 768) -> list[float]:
    """A unit vector from a text's digests: pairs of bytes between -1 and 1."""
    raw = b"".join(hashlib.sha256(f"text:{text}|{n}".encode()).digest() for n in range(-(-dim // 16)))
    v = np.frombuffer(raw[: 2 * dim], ">u2").astype(float) / 65535 * 2 - 1
    return (v / (float(np.linalg.norm(v)) or 1.0)).tolist()


def hash_vectors(rows: DataFrame, key: str, text: str, dim: int = 768) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hash_vector(x or "", dim) for x in b.column(1).to_pylist()], pa.list_(pa.float64()))], [key, "vector"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")


def project_vectors(rows: DataFrame, key: str, column: str, source: int, target: int) -> DataFrame:
    """Gaussian random projection to ``target`` dimensions, unit length; the matrix follows from the shapes.
    Vectors that have ``target`` dimensions are only scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.random.default_rng(source * 1_000_003 + target).standard_normal((target, source)) / target**0.5
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, source)
            x = x if source == target else x @ m.T
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((x / np.where(norms > 0, norms, 1)).tolist(), pa.list_(pa.float64()))], [key, "vector"])

    return rows.select(key, column).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")


def normalised_score(rows: DataFrame, parts: dict[str, tuple[float, bool]], by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``score``: the weighted sum of columns scaled between their least and greatest, within each of
    ``by`` or overall; a flat column counts as 1; ``True`` means that less is better. The bounds are an aggregate of a row a group."""
    by = by or []
    ends = rows.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in parts for n, f in (("lo", F.min), ("hi", F.max))])
    names = [f"of_{c}" for c in by]
    ends = ends.withColumnsRenamed(dict(zip(by, names, strict=True)))
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    both = rows.join(ends, same) if by else rows.crossJoin(ends)  # one row
    total = F.lit(0.0)
    for c, (weight, less) in parts.items():
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        x = F.when(hi - lo < 1e-12, 1.0).otherwise(F.when(F.lit(less), hi - F.col(c)).otherwise(F.col(c) - lo) / (hi - lo))
        total = total + weight * x
    return both.select(*rows.columns, F.round(total, 4).alias("score"))
