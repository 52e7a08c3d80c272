"""Near-duplicate documents: a Jaccard join on sets of word n-grams by MinHash banding.

Band and row counts follow from the threshold and the wanted recall (:func:`banding`). Documents with
equal n-gram sets are one node. Nodes that share a band hash are candidates; band buckets are joined
to their least node rather than expanded into pairs, and candidate nodes of a connected piece are
verified in units of two blocks of at most about ``BLOCK`` nodes and ``GRAMS`` n-grams: a unit's task compares full n-gram
sets and gives, for each node, how many documents it links to and its piece's root, never the pairs. So
no bucket or piece meets in a task, no link between different texts within a piece is lost, and rows
grow with the documents, not the links.

Defined results: words are runs of characters other than white space; a text of fewer than ``WORDS``
words has one n-gram of all of them; null and empty texts have none and link to nothing; copies are
counted as links; very long texts count whole; equal ids are told apart by the order of the table as written; of a class, the row with the least id (of equal ids, the first row) stays; null ids
come last; extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import BLOOM, discard, materialize
from watchloom.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 192
SEED = 0x5EED
BLOCK = 64
#: N-grams of a block on average, so that a unit's memory has a bound in bytes too.
GRAMS = 1 << 20
COLUMNS = 8192
#: Rows that pass between Spark and Python at once, since texts and sets may be long.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold shares a band with
    probability ``recall``, within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes don't reach a recall of {recall} at {threshold}")
    return best


_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS), 4096), 0x9E3779B97F4A7C15, np.uint64))
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = _SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))), axis=0) if starts[0] == 0 else np.arange(len(b)) - np.concatenate((np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(b))))))
    values = _BYTES[b] * _powers(int(place.max()) + 1)[place]
    values[space] = 0
    return mix(np.add.reduceat(values, starts))


def ngrams(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of the text's n-gram hashes."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    grams, factor = np.full(len(w) - k + 1, k, np.uint64), _U(0xD6E8FEB86659FD93)
    for i in range(k):
        grams = mix(grams * factor + w[i : len(w) - k + 1 + i])
    return np.unique(grams)


class Sketch:
    """MinHash bands of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED + 1)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)[:, None] * _U(2) + _U(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 2048):
            least = np.minimum(least, (self.a * grams[None, at : at + 2048] + self.b).min(1))
        out = np.arange(self.bands, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            out = mix(out * _U(0x9E3779B97F4A7C15) + column)
        return out.view(np.int64)


def each(values: pa.Array, some: int = 128) -> Iterator:
    """The values as Python's, a few at a time in memory."""
    for at in range(0, len(values), some):
        yield from values.slice(at, some).to_pylist()


def sketch_column(text: Column, words: int, bands: int, rows: int) -> Column:
    """Struct of the n-gram set's digest, its size and its band keys; null without words."""

    def run(texts: pa.Array) -> pa.Array:
        sketch, digests, sizes, keys = Sketch(bands, rows), [], [], []
        for t in each(texts):
            g = ngrams(t, words)
            digests.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
            sizes.append(len(g))
            keys.append(sketch.keys(g) if len(g) else np.zeros(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["digest", "n", "bands"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<digest: binary, n: int, bands: array<bigint>>")(text)


def set_column(text: Column, words: int) -> Column:
    """The n-gram set as bytes."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([ngrams(t, words).tobytes() for t in each(texts)], pa.binary())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(text)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, a slice of n-grams at a time."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, gram, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[gram]
    who, gram = who[keep], number[gram[keep]]
    order = np.argsort(gram, kind="stable")
    who, gram = who[order], gram[order]
    out = np.zeros((n, n), np.float64)
    total = int(shared.sum())
    for at in range(0, total, COLUMNS):
        a, b = np.searchsorted(gram, (at, at + COLUMNS))
        m = np.zeros((n, min(COLUMNS, total - at)), np.float32)
        m[who[a:b], gram[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def roots(linked: np.ndarray) -> np.ndarray:
    """The first node of each node's piece."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(root)).min(1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(rows: list[tuple], same: bool, threshold: float) -> list[tuple[bytes, int, bytes]]:
    """(digest, documents linked, root's digest) of a unit's nodes (digest, block, size, set)."""
    rows = list({r[0]: r for r in rows}.values())
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    inter, sizes = overlaps(sets), np.array([len(s) for s in sets])
    union = sizes[:, None] + sizes[None] - inter
    linked = inter >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    if not same:
        block = np.array([r[1] for r in rows])
        linked &= block[:, None] != block[None]
    weight = np.array([r[2] for r in rows], np.int64)
    links, root = linked @ weight, roots(linked)
    return [(rows[k][0], int(links[k]), rows[root[k]][0]) for k in np.flatnonzero(links)]


def _units(threshold: float):
    """Units of a partition sorted by (component, i, j), a unit at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, out = None, []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["digest", "links", "root"])

        for batch in batches:
            for component, i, j, *row in zip(*(each(batch.column(c)) for c in ("component", "i", "j", "digest", "block", "size", "grams")), strict=True):
                if (component, i, j) != now:
                    if held:
                        out += _verify(held, now[1] == now[2], threshold)
                    now, held = (component, i, j), []
                    if len(out) >= 5000:
                        yield batch_of()
                        out = []
                held.append(tuple(row))
        if held:
            out += _verify(held, now[1] == now[2], threshold)
        yield batch_of()

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (doc, n_ngrams, class_id, n_links, kept): ``doc`` holds the row of ``docs``."""
    bands, rows = banding(threshold, recall)
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    found = own.withColumn("s", sketch_column(F.col("doc.text"), words, bands, rows)).select("doc", "row", "s.digest", "s.n", "s.bands")
    table = materialize(found, "ngrams", FEW)
    best = F.struct(F.col("doc.doc_id").isNull().alias("no"), F.col("doc.doc_id").alias("id"), "row")
    nodes = table.filter("n > 0").select("digest", best.alias("best"), "n", "bands").groupBy("digest").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    count = nodes.count()  # of the files' footers

    keyed = nodes.select("digest", F.explode("bands").alias("key"))
    hubs = materialize(keyed.groupBy("key").agg(F.min("digest").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("k"), "hub"), "hubs", most_rows=count)
    pieces = components(keyed.join(hubs, F.col("key") == F.col("k")).select(F.col("digest").alias("u"), F.col("hub").alias("v")))
    discard(hubs)

    found = pieces.join(nodes.select("digest", "size", "n", F.col("best.row").alias("best_row")), F.col("node") == F.col("digest")).drop("node")
    found = materialize(found, "candidates", most_rows=count)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / GRAMS)).cast("int")
    sizes = materialize(found.groupBy("component").agg(blocks.alias("blocks")).withColumnRenamed("component", "c"), "piece-sizes", most_rows=count)
    placed = materialize(found.join(sizes, F.col("component") == F.col("c")).drop("c", "n").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int")), "placed", most_rows=count)
    for spent in (pieces, found, sizes):
        discard(spent)
    # a sort-merge join at every size: the candidates grow with the documents, so no broadcast is planned for; Spark
    # may leave out other documents' texts by a Bloom filter of a bounded size, for which it wants a condition
    texts = table.select("row", F.col("doc.text").alias("text")).hint("merge").join(placed.filter("best_row >= 0"), F.col("row") == F.col("best_row"))
    full = materialize(texts.select("digest", "component", "blocks", "block", "size", set_column(F.col("text"), words).alias("grams")), "sets", BLOOM | FEW)
    discard(placed)
    paired = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "block", "size", "grams")
    unit = ["component", "i", "j"]
    links = materialize(paired.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_units(threshold), "digest binary, links long, root binary"), "links", FEW)
    discard(full)

    classes = components(links.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("digest").agg(F.sum("links").alias("links")).withColumnRenamed("digest", "d")
    members = materialize(classes.join(nodes.select("digest", "best"), F.col("node") == F.col("digest")).select("digest", "component", "best"), "members", most_rows=count)
    first = materialize(members.groupBy("component").agg(F.min("best").alias("first")).withColumnRenamed("component", "c"), "first", most_rows=count)
    firsts = members.join(first, F.col("component") == F.col("c")).select(F.col("digest").alias("m"), "first")
    result = nodes.select("digest", "best", "size").join(firsts, F.col("digest") == F.col("m"), "left").join(counts, F.col("digest") == F.col("d"), "left")
    result = materialize(result.select(F.col("digest").alias("r"), F.coalesce("first", "best").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "classes", most_rows=count)
    for spent in (nodes, links, classes, members, first):
        discard(spent)
    out = table.select("doc", "row", "digest", "n").join(result, F.col("digest") == F.col("r"), "left")
    alone = F.col("r").isNull()
    return out.select(
        "doc", F.col("n").alias("n_ngrams"), F.when(alone, F.col("doc.doc_id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("first.row") == F.col("row"))).alias("kept"))
