"""Exact deduplication over a sharded cuckoo-filter index of live digests.

A document's digest is the SHA-256 of its text with each run of white space replaced by one space.
Digests are dealt to shards by their first bytes. A shard holds a cuckoo filter (two candidate
buckets of four 16-bit fingerprints), and the content bucketed by primary bucket: the full digest,
the row that stays and the group's size. A filter miss proves that a digest is new; a hit is
verified against the bucket's full digests, so false positives cost a lookup and never a document.
When an insertion finds no place, the filter is resized and refilled from the stored keys.

Defined results: null text counts as empty; empty texts are equal to one another; null ids lose to
any id; of repeated rows (same id, same text) exactly one is kept; a very long text is digested whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import SPACE, materialize, text_or_empty

SLOTS = 4
MAX_KICKS = 200
#: Rows that one map task gathers before it passes its partial groups on.
LOCAL_GROUPS = 200_000
#: Digests that a shard is planned for.
SHARD_KEYS = 100_000
MIN_SHARDS = 128


class CuckooFilter:
    """Fingerprints of 16 bits, four a bucket; ``insert`` returns False on overflow."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros(buckets * SLOTS, np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, keys: int) -> CuckooFilter:
        need = max(2, int(keys / (SLOTS * 0.85)) + 1)
        return cls(1 << (need - 1).bit_length())

    def places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[4:6], "little") or 1
        first = int.from_bytes(digest[8:16], "little") & (self.buckets - 1)
        return print_, first, self.other(first, print_)

    def other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & (self.buckets - 1)

    def contains(self, digest: bytes) -> bool:
        p, a, b = self.places(digest)
        t = self.table
        return p in t[a * SLOTS : a * SLOTS + SLOTS] or p in t[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, bucket: int, print_: int) -> bool:
        at = bucket * SLOTS
        for k in range(at, at + SLOTS):
            if not self.table[k]:
                self.table[k] = print_
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        p, a, b = self.places(digest)
        if self._put(a, p) or self._put(b, p):
            return True
        moves, bucket = [], a
        for kick in range(MAX_KICKS):
            k = bucket * SLOTS + (p + kick) % SLOTS
            moves.append((k, int(self.table[k])))
            p, self.table[k] = int(self.table[k]), p
            bucket = self.other(bucket, p)
            if self._put(bucket, p):
                return True
        for k, was in reversed(moves):  # undone, so that no live fingerprint is lost
            self.table[k] = was
        return False

    def delete(self, digest: bytes) -> bool:
        p, a, b = self.places(digest)
        for bucket in (a, b):
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[k] == p:
                    self.table[k] = 0
                    return True
        return False


@dataclass
class Entry:
    """What stays of a group: (id is null, id, row), and the group's size."""

    best: tuple
    size: int


@dataclass
class Shard:
    """One shard: the filter, and the content by primary bucket."""

    filter: CuckooFilter
    content: dict[int, dict[bytes, Entry]] = field(default_factory=dict)
    keys: int = 0
    resizes: int = 0

    def _find(self, digest: bytes) -> Entry | None:
        if not self.filter.contains(digest):
            return None
        return self.content.get(self.filter.places(digest)[1], {}).get(digest)

    def _store(self, digest: bytes, entry: Entry) -> None:
        self.content.setdefault(self.filter.places(digest)[1], {})[digest] = entry

    def entries(self) -> Iterator[tuple[bytes, Entry]]:
        for bucket in self.content.values():
            yield from bucket.items()

    def _grow(self) -> None:
        held, size = list(self.entries()), self.filter.buckets
        while True:
            size *= 2
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(d) for d, _ in held):
                break
        self.content = {}
        for d, e in held:
            self._store(d, e)

    def add(self, digest: bytes, best: tuple, size: int) -> None:
        if found := self._find(digest):
            found.best, found.size = min(found.best, best), found.size + size
            return
        while not self.filter.insert(digest):
            self._grow()
        self._store(digest, Entry(best, size))
        self.keys += 1

    def remove(self, digest: bytes) -> bool:
        if not self._find(digest):
            return False
        self.filter.delete(digest)
        del self.content[self.filter.places(digest)[1]][digest]
        self.keys -= 1
        return True


STATE = "shard int, buckets int, fingerprints binary, digest array<binary>, no_id array<boolean>, doc_id array<long>, row array<long>, size array<long>, resizes int"


def _state(shard: int, s: Shard) -> pd.DataFrame:
    held = list(s.entries())
    return pd.DataFrame({
        "shard": [shard], "buckets": [s.filter.buckets], "fingerprints": [s.filter.table.tobytes()], "digest": [[d for d, _ in held]],
        "no_id": [[e.best[0] for _, e in held]], "doc_id": [[e.best[1] for _, e in held]], "row": [[e.best[2] for _, e in held]],
        "size": [[e.size for _, e in held]], "resizes": [s.resizes],
    })


def _load(row) -> Shard:
    s = Shard(CuckooFilter(int(row.buckets), np.frombuffer(row.fingerprints, np.uint16).copy()), resizes=int(row.resizes))
    for d, no, i, r, n in zip(row.digest, row.no_id, row.doc_id, row.row, row.size, strict=True):
        s._store(bytes(d), Entry((bool(no), int(i), int(r)), int(n)))
        s.keys += 1
    return s


def _apply(s: Shard, ops: pd.DataFrame) -> Shard:
    for op, d, no, i, r, n in zip(ops["op"], ops["digest"], ops["no_id"], ops["doc_id"], ops["row"], ops["size"], strict=True):
        if op == "delete":
            s.remove(bytes(d))
        else:
            s.add(bytes(d), (bool(no), int(i), int(r)), int(n))
    return s


def _build(key: tuple, ops: pd.DataFrame) -> pd.DataFrame:
    return _state(int(key[0]), _apply(Shard(CuckooFilter.for_keys(len(ops))), ops))


def _change(key: tuple, state: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
    s = _load(next(state.itertuples())) if len(state) else Shard(CuckooFilter.for_keys(len(ops)))
    return _state(int(key[0]), _apply(s, ops))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest binary, row) of every row. ``row`` tells repeated rows apart; it's stable
    once the result is written."""
    norm = F.regexp_replace(text_or_empty(), SPACE, " ")
    return docs.select("doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def _partial(shards: int):
    """Groups within a map task, so that a digest sends a row a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([int.from_bytes(d[:4], "big") % shards for d, _ in rows], pa.int32()), "op": pa.array(["insert"] * len(rows), pa.string()),
                "digest": pa.array([d for d, _ in rows], pa.binary()), "no_id": pa.array([v[0][0] for _, v in rows], pa.bool_()),
                "doc_id": pa.array([v[0][1] for _, v in rows], pa.int64()), "row": pa.array([v[0][2] for _, v in rows], pa.int64()), "size": pa.array([v[1] for _, v in rows], pa.int64()),
            })

        for batch in batches:
            for i, d, r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "row")), strict=True):
                best = (i is None, 0 if i is None else i, r)
                if d in held:
                    held[d] = [min(held[d][0], best), held[d][1] + 1]
                else:
                    held[d] = [best, 1]
            if len(held) >= LOCAL_GROUPS:
                yield out()
                held.clear()
        yield out()

    return run


OPS = "shard int, op string, digest binary, no_id boolean, doc_id long, row long, size long"


def shard_count(rows: int) -> int:
    return max(MIN_SHARDS, -(-rows // SHARD_KEYS))


def insertions(found: DataFrame, shards: int) -> DataFrame:
    return found.select("doc_id", "digest", "row").mapInArrow(_partial(shards), OPS)


def deletions(gone: DataFrame, shards: int) -> DataFrame:
    """Operations that take the digests of ``gone`` (column digest) out of an index."""
    shard = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % shards
    return gone.select(shard.cast("int").alias("shard"), F.lit("delete").alias("op"), "digest", F.lit(False).alias("no_id"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("size")).distinct()


def build_index(found: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its filter and its live keys."""
    return insertions(found, shards).groupBy("shard").applyInPandas(_build, STATE)


def update_index(index: DataFrame, ops: DataFrame) -> DataFrame:
    """The index after ``ops`` (of :func:`insertions` or :func:`deletions`, same shard count)."""
    return index.groupBy("shard").cogroup(ops.groupBy("shard")).applyInPandas(_change, STATE)


def live(index: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of the index's live digests."""
    rows = index.select(F.explode(F.arrays_zip("digest", "no_id", "doc_id", "row", "size")).alias("e"))
    return rows.select("e.digest", F.when(~F.col("e.no_id"), F.col("e.doc_id")).alias("keep_id"), F.col("e.row").alias("keep_row"), F.col("e.size").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = materialize(digests(docs), "digests")
    held = materialize(live(build_index(found, shard_count(found.count()))), "cuckoo")
    return found.join(held, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
