"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds the letters' vectors,
permuted by their place, by elementwise product; a text's vector bundles (adds) its trigrams'
vectors. A language's prototype bundles its documents. A text gets the language whose prototype has
the largest cosine with the text's vector.

Every letter of every script has a vector of its own, drawn from its code point by a seeded generator;
each run of anything else is one boundary symbol. Trigrams of ``a`` to ``z`` come from a table of
``PLAIN ** 3`` x ``DIMENSIONS`` bytes; others are bound when they are met, ``SOME`` at a time. Cost and memory
per task are those of a batch, the table and the counts of up to ``LOCAL_LANGUAGES`` languages; the driver
gets one vector for each language, of which there may be ``MOST_LANGUAGES``.

Defined results: null text, or a text without a letter, is ``und`` with score 0; without any labelled
row every text is ``und``; ties go to the first language by code point; null ids are never held out
and may teach; repeated rows count as often as they occur; very long texts count whole; extra columns are
ignored. The pipeline's stage
drops texts without a letter and texts that are long enough to judge and like no known language; without
any labelled row it keeps every text with a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import internal

DIMENSIONS = 1024
#: Symbols of the table: the boundary and the letters a to z. A letter beyond is its code point and these.
PLAIN = 27
SHIFT = 21
SEED = 20240607
#: Trigrams that are bound at once.
SOME = 2048
#: Languages, and different trigrams beyond the table's, whose counts a training task holds.
LOCAL_LANGUAGES = 64
LOCAL_TRIGRAMS = 1 << 18
MOST_LANGUAGES = 4096
UNKNOWN = "und"


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter."""
    table = np.zeros(0x110000, np.int64)
    for point in range(128, 0x110000):
        if chr(point).isalpha():
            table[point] = PLAIN + point
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    return table


def letter_vectors(symbols: np.ndarray) -> np.ndarray:
    """(letters, DIMENSIONS) of +1 and -1: the bits of a seeded counter generator at the symbol."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = symbols.astype(u)[:, None] * u(0x9E3779B97F4A7C15) + np.arange(1, DIMENSIONS // 64 + 1, dtype=u) * u(0xD1B54A32D192ED03) + u(SEED)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> u(shift))) * u(factor)
        x = x ^ (x >> u(31))
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def bound(symbols: np.ndarray) -> np.ndarray:
    """Vectors of trigrams (rows of three symbols): the first letter permuted twice, the second once."""
    own, at = np.unique(symbols, return_inverse=True)
    letters, at = letter_vectors(own), at.reshape(symbols.shape)
    return np.roll(letters, 2, axis=1)[at[:, 0]] * np.roll(letters, 1, axis=1)[at[:, 1]] * letters[at[:, 2]]


@lru_cache(1)
def plain_vectors() -> np.ndarray:
    """(PLAIN ** 3, DIMENSIONS): the vectors of the trigrams of boundary and a to z."""
    k = np.arange(PLAIN)
    return bound(np.stack(np.meshgrid(k, k, k, indexing="ij"), -1).reshape(-1, 3))


#: Trigrams of a text: (places in the table, counts), (codes of others, counts).
Trigrams = tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def trigram_counts(text: str | None) -> Trigrams | None:
    """The trigrams of a text; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = symbol_table()[points]
    if not symbols.any():
        return None
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0  # of a run of other characters, the first
    s = np.concatenate(([0], symbols[keep], [0]))
    far = s >= PLAIN
    odd = far[:-2] | far[1:-1] | far[2:]
    codes = (s[:-2] * PLAIN + s[1:-1]) * PLAIN + s[2:]
    counts = np.bincount(codes[~odd], minlength=1)
    found = np.flatnonzero(counts)
    others = ((s[:-2] << 2 * SHIFT) | (s[1:-1] << SHIFT) | s[2:])[odd]
    return (found, counts[found]), np.unique(others, return_counts=True)


def other_vectors(codes: np.ndarray) -> np.ndarray:
    low = (1 << SHIFT) - 1
    return bound(np.stack((codes >> 2 * SHIFT, codes >> SHIFT & low, codes & low), 1))


def bundle(got: Trigrams) -> np.ndarray:
    (found, counts), (codes, more) = got
    v = counts.astype(np.float32) @ plain_vectors()[found].astype(np.float32)
    for at in range(0, len(codes), SOME):
        v += more[at : at + SOME].astype(np.float32) @ other_vectors(codes[at : at + SOME]).astype(np.float32)
    return v


class Taught:
    """What a task has seen of a language: exact counts, and the bundle of those that were too many to hold."""

    def __init__(self):
        self.plain, self.codes, self.counts = np.zeros(PLAIN**3, np.int64), [], []
        self.held, self.vector = 0, np.zeros(DIMENSIONS, np.int64)

    def add(self, got: Trigrams) -> None:
        (found, counts), (codes, more) = got
        self.plain[found] += counts
        self.codes.append(codes)
        self.counts.append(more)
        self.held += len(codes)
        if self.held > LOCAL_TRIGRAMS:
            codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, at, np.concatenate(self.counts))
            if len(codes) > LOCAL_TRIGRAMS // 2:
                self.vector += _others(codes, sums)
                codes, sums = codes[:0], sums[:0]
            self.codes, self.counts, self.held = [codes], [sums], len(codes)

    def total(self) -> np.ndarray:
        codes = np.concatenate([*self.codes, np.zeros(0, np.int64)])
        return self.vector + _exact(self.plain) + _others(codes, np.concatenate([*self.counts, np.zeros(0, np.int64)]))


def _others(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    codes, at = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, at, counts)
    total = np.zeros(DIMENSIONS, np.int64)
    for k in range(0, len(codes), SOME):
        total += sums[k : k + SOME] @ other_vectors(codes[k : k + SOME]).astype(np.int64)
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Taught] = {}

    def out() -> pa.RecordBatch:
        vectors = [c.total().tolist() for c in held.values()]
        return pa.RecordBatch.from_pydict({"lang": pa.array(list(held), pa.string()), "v": pa.array(vectors, pa.list_(pa.int64()))})

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if got := trigram_counts(text):
                if lang not in held and len(held) >= LOCAL_LANGUAGES:
                    yield out()
                    held.clear()
                held.setdefault(lang, Taught()).add(got)
    yield out()


def _exact(counts: np.ndarray) -> np.ndarray:
    """The bundle as whole numbers, in pieces, so that sums don't depend on the order of tasks."""
    total = np.zeros(DIMENSIONS, np.int64)
    found = np.flatnonzero(counts)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        total += counts[part] @ plain_vectors()[part].astype(np.int64)
    return total


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text has remainder 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from (text, lang) rows."""
    sums = rows.filter("lang is not null").select("text", "lang").mapInArrow(_sums, "lang string, v array<long>")
    cells = sums.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    vectors = cells.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("v"))
    found = sorted(vectors.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs, protos = [r["lang"] for r in found], np.array([r["v"] for r in found], float).reshape(-1, DIMENSIONS)
    return langs, (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def classify(text: str | None, langs: list[str], protos: np.ndarray) -> tuple[str, float]:
    return _nearest(trigram_counts(text), langs, protos)


def _nearest(got: Trigrams | None, langs: list[str], protos: np.ndarray) -> tuple[str, float]:
    if got is None or not langs:
        return UNKNOWN, 0.0
    v = bundle(got)
    cosines = protos @ v / max(float(np.linalg.norm(v)), 1e-12)
    best = int(np.argmax(cosines))
    return langs[best], float(min(1.0, max(0.0, cosines[best])))


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score``; those that ``docs`` has already are replaced."""
    keep = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    schema = docs.select(*keep).schema.add(lang, "string").add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(t, langs, protos) for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, lang, score])

    return docs.select(*keep).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred and score, taught by the rows that aren't held out."""
    flagged = docs.withColumn("held_out", held_out(F.col("doc_id")))
    langs, protos = train(flagged.filter(~F.col("held_out")))
    return predict(flagged, langs, protos)


#: A text whose best cosine is lower is taken to be in no known language, if it is long enough to judge.
LEAST_SCORE = 0.1
#: Trigrams from which a text is long enough: a cosine grows with the root of their number, and with fewer
#: a clean text's may be below LEAST_SCORE (one of 42 trigrams was; from 100, the least at sf0.1 was 0.45).
JUDGED = 100


def weight(counts: np.ndarray) -> float:
    """Number of trigrams, repeated ones counting less: equal counts give the number of distinct ones."""
    c = counts.astype(np.float64)
    return float(c.sum() ** 2 / (c @ c))


def may_be_known(text: str | None, langs: list[str], protos: np.ndarray, least: float = LEAST_SCORE) -> bool:
    """False for texts without a letter and for those that are in no known language for certain."""
    got = trigram_counts(text)
    if got is None:
        return False
    return not langs or weight(np.concatenate((got[0][1], got[1][1]))) < JUDGED or _nearest(got, langs, protos)[1] >= least


def in_known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known, or that are too short to tell."""
    held = internal(docs, "held_out")
    flagged = docs.withColumn(held, held_out(F.col("doc_id")))
    langs, protos = train(flagged.filter(~F.col(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            yield batch.filter(pa.array([may_be_known(t, langs, protos, least) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
