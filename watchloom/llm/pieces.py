"""SentencePiece segmentation: the N best paths of the piece lattice, and decoding.

Positions of a unit of text are nodes, vocabulary pieces are edges with their scores. A forward
Viterbi pass gives each node the best score from the start; a backward A-star search from the end
uses those as its heuristic, which is exact, so paths leave its queue best first. A text is cut into
units between neighbouring characters that no piece joins; every path passes the cuts, so a text's
best path is that of its units, and its N best follow from the N - 1 units whose second path loses
least. The forward pass gives that loss, and the search runs for those units.

Characters that no piece holds become byte pieces at ``UNKNOWN_COST`` below the lowest score. The word
mark itself, where a text contains it, is spelt in bytes too, so decoding is an exact inverse.

Defined results: null text gives null columns; empty text gives no pieces, score 0; lone surrogates
are spelt by their three bytes; equal scores prefer the longer last piece; repeated rows repeat; a very long text is
segmented whole, unit by unit; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import operator
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
ESCAPED = "\udcff"  # stands for a word mark of the text itself while it is segmented; no UTF-8 text holds it
UNKNOWN_COST = 10.0
NBEST = 4
#: Units whose paths a worker keeps, and the longest of them, so that what it keeps is bounded in bytes too.
CACHE, CACHED_LENGTH = 500_000, 64
#: Code points whose pairs are looked up in a table.
TABLE = 1024


def default_model() -> str:
    """The public 32k model, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's vocabulary as a lattice."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_ = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.edges = {text[i]: (i, sp.get_score(i)) for i in normal}
        self.longest = max(map(len, self.edges))
        self.unknown = min((s for _, s in self.edges.values() if s > -1e8), default=0.0) - UNKNOWN_COST
        # what an id stands for by itself: bytes from 128 on do so only together
        self.alone: list[str | None] = [""] * n
        for i in normal:
            self.alone[i] = text[i].replace(MARK, " ")
        for b, i in self.bytes_.items():
            self.alone[i] = chr(b) if b < 128 else None
        # pairs of neighbours within a piece: no path has an edge across any other pair
        pairs = {(ord(a), ord(b)) for p in self.edges for a, b in itertools.pairwise(p)}
        self.low = np.zeros((TABLE, TABLE), bool)
        for a, b in pairs:
            a, b = (TABLE - 1 if ord(MARK) == x else x for x in (a, b))
            if a < TABLE and b < TABLE:
                self.low[a, b] = True
        self.high = np.array(sorted(a << 21 | b for a, b in pairs), np.int64)
        self.cache: dict[str, tuple[float, bytes, float]] = {}
        self.more: dict[tuple[str, int], tuple] = {}

    def spell(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes_[b] for b in (MARK if char == ESCAPED else char).encode("utf-8", "surrogatepass"))

    def units(self, text: str) -> list[str]:
        """The text with its word marks, cut between neighbours that no piece joins."""
        if not text:
            return []
        marked = MARK + text.replace(MARK, ESCAPED).replace(" ", MARK)
        points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.where(points == ord(MARK), TABLE - 1, points)
        left, right = low[:-1], low[1:]
        plain = (left < TABLE) & (right < TABLE)
        joined = self.low[np.where(plain, left, 0), np.where(plain, right, 0)]
        if not plain.all():
            k = np.flatnonzero(~plain)
            codes = points[k].astype(np.int64) << 21 | points[k + 1]
            at = np.minimum(np.searchsorted(self.high, codes), len(self.high) - 1)
            joined[k] = self.high[at] == codes
        cuts = (np.flatnonzero(~joined) + 1).tolist()
        return [marked[a:b] for a, b in zip([0, *cuts], [*cuts, len(marked)], strict=True)]

    def forward(self, unit: str) -> tuple[list[float], list[int], float]:
        """Viterbi: best score to each node, where its best edge starts, and the second score of the end."""
        edges, longest, n = self.edges, self.longest, len(unit)
        best, second, back = [0.0] * (n + 1), [-1e300] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            one = two = -1e300
            at = end - 1
            for start in range(end - longest if end > longest else 0, end):
                if e := edges.get(unit[start:end]):
                    v = best[start] + e[1]
                    if v > one:
                        two = max(one, second[start] + e[1])
                        one, at = v, start
                    elif v > two:
                        two = v
            if unit[end - 1] not in edges:
                v = best[end - 1] + self.unknown
                if v > one:
                    two = max(one, second[end - 1] + self.unknown)
                    one, at = v, end - 1
                elif v > two:
                    two = v
            best[end], second[end], back[end] = one, two, at
        return best, back, second[n]

    def best(self, unit: str) -> tuple[float, bytes, float]:
        """(score, ids as bytes, what the second path loses) of a unit; infinite where it has one path."""
        if got := self.cache.get(unit):
            return got
        best, back, second = self.forward(unit)
        ids, at = [], len(unit)
        while at:
            start = back[at]
            e = self.edges.get(unit[start:at])
            ids.append((e[0],) if e else self.spell(unit[start]))
            at = start
        if len(self.cache) >= CACHE:
            self.cache.clear()
        flat = np.array([i for own in reversed(ids) for i in own], np.int32)
        found = (best[-1], flat.tobytes(), best[-1] - second if second > -1e299 else float("inf"))
        if len(unit) <= CACHED_LENGTH:
            self.cache[unit] = found
        return found

    def best_paths(self, unit: str, n: int) -> tuple[tuple[float, tuple[int, ...]], ...]:
        """The ``n`` best (score, ids) of a unit by A-star from its end, best first."""
        if got := self.more.get((unit, n)):
            return got
        alpha, _, _ = self.forward(unit)
        edges, longest = self.edges, self.longest
        out, order = [], itertools.count()
        # (-(alpha + suffix), position, count, suffix score, (ids, rest)): of equals, the one nearest its end
        queue = [(-alpha[-1], len(unit), 0, 0.0, None)]
        while queue and len(out) < n:
            total, at, _, suffix, rest = heapq.heappop(queue)
            if not at:
                ids: list[int] = []
                while rest:
                    ids += rest[0]
                    rest = rest[1]
                out.append((-total, tuple(ids)))
                continue
            for start in range(max(0, at - longest), at):
                if e := edges.get(unit[start:at]):
                    s = suffix + e[1]
                    heapq.heappush(queue, (-(alpha[start] + s), start, next(order), s, ((e[0],), rest)))
            if unit[at - 1] not in edges:
                s = suffix + self.unknown
                heapq.heappush(queue, (-(alpha[at - 1] + s), at - 1, next(order), s, (self.spell(unit[at - 1]), rest)))
        score, raw, _ = self.best(unit)
        ids = tuple(np.frombuffer(raw, np.int32).tolist())  # of equal paths, the forward pass's own comes first
        found = ((score, ids), *[x for x in out if x[1] != ids][: n - 1])
        if len(self.more) >= CACHE // 4:
            self.more.clear()
        if len(unit) <= CACHED_LENGTH:
            self.more[unit, n] = found
        return found

    def combine(self, units: list[str], found: list[tuple], n: int) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        """The ``n`` best (score, changes) of a text from its units' best; changes are (unit, ids)."""
        best = sum(map(operator.itemgetter(0), found))
        ways: list[tuple[float, list]] = [(0.0, [])]
        if n > 1 and found:
            gaps = np.array([f[2] for f in found])
            least = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) < 64 else self._least(gaps, n - 1)
            for k in sorted(int(k) for k in least if gaps[k] != np.inf):
                paths = self.best_paths(units[k], n)
                ways = heapq.nsmallest(n, [(loss + paths[0][0] - s, [*changes, (k, ids)] if i else changes) for loss, changes in ways for i, (s, ids) in enumerate(paths)], key=lambda w: (w[0], len(w[1]), w[1]))
        return [(best - loss, changes) for loss, changes in ways[:n]]

    @staticmethod
    def _least(gaps: np.ndarray, n: int) -> np.ndarray:
        """Places of the ``n`` least gaps, of equals the first ones."""
        limit = np.partition(gaps, n - 1)[n - 1]
        below = np.flatnonzero(gaps < limit)
        return np.concatenate((below, np.flatnonzero(gaps == limit)[: n - len(below)]))

    def segmentations(self, text: str, n: int = NBEST) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids) of a text, written out."""
        units = self.units(text)
        found = self.best_of(units)
        out = []
        for score, changes in self.combine(units, found, n):
            own = dict(changes)
            out.append((score, [i for k, f in enumerate(found) for i in own.get(k, np.frombuffer(f[1], np.int32).tolist())]))
        return out

    def decode(self, ids) -> str:
        """The text of ``ids``."""
        parts = list(map(self.alone.__getitem__, ids))
        if None in parts:
            byte_of = self.byte_of
            runs = itertools.groupby(zip(parts, ids, strict=True), key=lambda x: x[0] is None)
            parts = [bytes(byte_of[i] for _, i in run).decode("utf-8", "surrogatepass") if spelt else "".join(p for p, _ in run) for spelt, run in runs]
        return "".join(parts).removeprefix(" ")

    def best_of(self, units: list[str]) -> list[tuple[float, bytes, float]]:
        """:meth:`best` of each unit."""
        get, best = self.cache.get, self.best
        return [get(u) or best(u) for u in units]


@lru_cache(4)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


SCHEMA = "doc_id long, n_pieces long, score double, ids array<int>, nbest_scores array<double>, nbest_changes array<string>, decoded boolean"


def _run(model_file: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield _encode_batch(pieces, batch.slice(at, 256), n)

    return run


def _encode_batch(pieces: Pieces, batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    offsets, flat, rows = [0], [], []
    size = 0
    for text in batch.column("text").to_pylist():
        if text is None:
            rows.append((None, None, None, None, None))
            offsets.append(size)
            continue
        units = pieces.units(text)
        best = pieces.best_of(units)
        found = pieces.combine(units, best, n)
        flat.append(raw := b"".join([f[1] for f in best]))
        ids = np.frombuffer(raw, np.int32).tolist()
        size += len(ids)
        offsets.append(size)
        changes = [" ".join(f"{k}:{'.'.join(map(str, own))}" for k, own in c) for _, c in found]
        rows.append((len(ids), found[0][0], [s for s, _ in found], changes, pieces.decode(ids) == text))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    nulls = np.array([r[0] is None for r in rows] + [False])
    lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32), pa.int32(), mask=nulls), pa.array(np.frombuffer(b"".join(flat), np.int32)))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), lists, pa.array(columns[2], pa.list_(pa.float64())), pa.array(columns[3], pa.list_(pa.string())), pa.array(columns[4], pa.bool_())],
        [x.split()[0] for x in SCHEMA.split(", ")])


def encode_documents(docs: DataFrame, model_file: str | None = None, n: int = NBEST) -> DataFrame:
    """One row per document: best ids and score, the N best scores and their changes (``unit:ids``
    against the best), and whether decoding the ids gives the text back."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_run(model_file or default_model(), n), SCHEMA)
