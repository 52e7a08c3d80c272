"""Removal of passages that repeat an earlier one, by suffix trees over groups of suffixes.

A word goes if it is covered by a window of ``WINDOW`` words whose sequence also starts earlier: in a document with a
smaller id, or further up in its own. Windows are judged on the input.

Which suffixes: the tree is a sparse one. Of each window, the place of the least hashed run of ``RUN`` words (the
first of equals) is its anchor, so equal windows have equal anchors at equal offsets, and a text has about one
anchor in eight words. Only suffixes from anchors are kept, with the words before them that their windows reach
back to; those whose first ``RUN`` words occur at no other anchor can't repeat and go before any word is shuffled.

Which groups: suffixes are dealt by a prefix, so that all that can share a node meet: by their first ``RUN`` words;
where more than ``COMMON`` suffixes share those, by a prefix as long as a whole window, each window then being a suffix
of its own. Of such long prefixes a task first builds the tree of what it has seen itself and passes on only the first of
each node's windows, so that a passage in a third of all documents comes to a group once a task. There are as many
groups as it takes for about ``GROUP`` suffixes in each.

Within a group: the suffixes in order, with the words that neighbours share, are the tree: a node of depth d is a run
of neighbours that share d words. The words before the anchors give a second tree, read backwards. A window that
begins o words before its anchor repeats if another suffix is under the same node of depth ``WINDOW`` - o of the one and
the same node of depth o of the other; all but the first of such a class are repeats. The deepest nodes of both sides
bound the maximal repeats, of which these windows are the covers.

Words are told apart by ``BYTES`` bytes of a 64-bit hash, the first ``RUN`` by all of it.

Defined results: a null or empty text has no words; one of fewer words than a window loses none; a very long text is cut
for hashing, never for comparing; ids that are null (last) or repeated are told apart by the order of the table as
written, so of repeated rows the first keeps its words; an empty table gives an empty table; other columns are
ignored, whatever they are named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import discard, materialize
from watchloom.llm.line_dedup import number_rows
from watchloom.llm.ngram_join import mix

WINDOW = 20
RUN = 6
#: Suffixes of a group, on average.
GROUP = 32768
#: Suffixes with the same first words from which on the prefix is a whole window.
COMMON = 8192
#: Windows of common prefixes that a task holds at once.
HELD = 65536
#: Bytes of a word's hash that suffixes carry.
BYTES = 5
#: Bytes of texts that are looked at together, and words that are hashed together.
PIECE, WORDS = 1 << 20, 1 << 16
#: Rows that pass between Spark and Python at once, since texts may be long.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
SEED = 0xA11CE

_U = np.uint64
_FACTOR = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64)
_NEAR = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_FAR = int(_NEAR[-1])


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, ends of the texts in them) of runs of texts of about ``size`` bytes."""
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at]
        at = to


def hashed(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the number of words up to the end of each text."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    begins = np.concatenate(([0], ends[:-1]))
    begins = begins[begins < len(data)]
    first[begins] = ~space[begins]
    starts = np.flatnonzero(first)
    out = np.empty(len(starts), np.uint64)
    stops = np.append(starts, len(data))
    for a in range(0, len(starts), WORDS):
        s = starts[a : a + WORDS]
        lo, hi = s[0], stops[min(a + WORDS, len(starts))]
        place = np.arange(hi - lo) - np.repeat(s - lo, np.diff(np.append(s, hi)))
        value = _BYTES[data[lo:hi]] * _NEAR[place & 4095]
        if (most := int(place.max()) >> 12) > 0:
            value *= np.cumprod(np.concatenate(([1], np.full(most, _FAR))).astype(np.uint64))[place >> 12]
        value[space[lo:hi]] = 0
        out[a : a + WORDS] = mix(np.add.reduceat(value, s - lo))
    return out, np.searchsorted(starts, ends, "left")


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on."""
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for i in range(n):
        out = mix(out * _FACTOR + words[i : len(words) - n + 1 + i])
    return out


def anchors(words: np.ndarray, ends: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """(text, place in the text, hash of the first words, most and least words that a window begins before it) of
    the anchors of texts that stand one after the other."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none, none
    text = np.repeat(np.arange(len(ends)), ends - starts)
    grams = runs(words, run)
    least, where = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - run + 1):
        other = grams[j : j + n]
        less = other < least
        least[less] = other[less]
        where[less] = j
    begin = np.flatnonzero(text[:n] == text[window - 1 :])  # the windows within one text
    at = begin + where[begin]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else none
    last = np.append(new[1:], len(at)) - 1
    at, whose = at[new], text[at[new]]
    return whose, at - starts[whose], grams[at], at - begin[new], at - begin[last]


def _shared(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their columns, and how many columns each shares with the one before it in that order."""
    if not rows.size:
        return np.arange(len(rows)), np.zeros(len(rows), np.int64)
    order = np.lexsort(rows.T[::-1])
    placed = rows[order]
    differ = placed[1:] != placed[:-1]
    same = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.concatenate(([-1], same))


def repeated(words: np.ndarray, row: np.ndarray, at: np.ndarray, most: np.ndarray, least: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes (row, place) with the words from ``most`` before them to ``window`` - ``least`` on, laid one after
    the other: an array (suffix, words before) of the windows that repeat an earlier one, and the order in
    which the suffixes have been put."""
    n, reach = len(row), window - run
    order = np.lexsort((at, row))
    length = most + window - least
    begin = (np.cumsum(length) - length)[order] + most[order]  # the suffix's own first word
    most, least = most[order], least[order]
    out = np.zeros((n, reach + 1), bool)
    if n < 2:
        return out, order
    right, left = np.arange(window), np.arange(1, reach + 1)
    there = right[None] < (window - least)[:, None]
    after = np.where(there, words[np.minimum(begin[:, None] + right, len(words) - 1)], _U(0))
    there = left[None] <= most[:, None]
    before = np.where(there, words[np.maximum(begin[:, None] - left, 0)], _U(0))
    (down, deep), (up, high) = _shared(after), _shared(before)
    for o in range(int(least.min()), int(most.max()) + 1):
        who = np.flatnonzero((least <= o) & (o <= most))
        if len(who) < 2:
            continue
        node, back = np.empty(n, np.int64), np.empty(n, np.int64)
        node[down] = np.cumsum(deep < window - o)
        back[up] = np.cumsum(high < o)
        _, first = np.unique(node[who] * (n + 1) + back[who], return_index=True)
        again = np.ones(len(who), bool)
        again[first] = False
        out[who[again], o] = True
    return out, order


def spans(again: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of window starts among ``again`` (suffix, words before)."""
    by_start = np.pad(again[:, ::-1].astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(by_start, axis=1)
    who, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    reach = again.shape[1] - 1
    return row[who], at[who] - (reach - a), at[who] - (reach - (b - 1))


_ANCHOR = "row long, place int, gram long, most int, least int"


def _find_anchors(window: int, run: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for at, data, ends in pieces(batch.column("text")):
                whose, place, gram, most, least = anchors(*hashed(data, ends), window, run)
                yield pa.RecordBatch.from_arrays([pa.array(rows[at + whose]), pa.array(place.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32))], ["row", "place", "gram", "most", "least"])

    return find


_SUFFIXES = "group int, gone boolean, row binary, place binary, most binary, least binary, words binary"


def _batch(group: int, gone: bool, *columns: np.ndarray) -> tuple:
    *numbers, words = columns
    return (group, gone, *[np.ascontiguousarray(c, t).tobytes() for c, t in zip(numbers, ("<i8", "<i4", "i1", "i1"), strict=True)], _narrow(words))


def _narrow(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def _wide(data: bytes) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    out = np.zeros((len(narrow), 8), np.uint8)
    out[:, :BYTES] = narrow
    return out.view("<u8").ravel()


def _gather(words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The words of the stretches laid one after the other."""
    ends = np.cumsum(length)
    return words[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - length), length)]


def _by_group(key: np.ndarray, groups: int, row: np.ndarray, place: np.ndarray, most: np.ndarray, least: np.ndarray, words: np.ndarray, window: int) -> list[tuple]:
    """Suffixes dealt by ``key``: one row a group."""
    group = (mix(key) % _U(groups)).astype(np.int64)
    length = most + window - least
    begin = np.cumsum(length) - length
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1)) if len(order) else []
    return [_batch(int(group[m[0]]), False, row[m], place[m], most[m], least[m], _gather(words, begin[m], length[m])) for m in np.split(order, cuts[1:]) if len(m)]


def _carry_words(groups: int, window: int, run: int):
    """Gives each text's suffixes their words, and deals them to groups."""

    def record(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), *[pa.binary()] * 5), strict=True)], ["group", "gone", "row", "place", "most", "least", "words"])

    def settle(held: list[tuple]) -> tuple[list[tuple], tuple]:
        """Rows of the repeats among the windows of common prefixes, and the others."""
        row, place, most, least, words = (np.concatenate(c) for c in zip(*held, strict=True))
        again, order = repeated(words, row, place, most, least, window, run)
        row, place, most, least, words = row[order], place[order], most[order], least[order], words.reshape(-1, window)[order]
        lost = again.any(1)
        gone = [_batch(-1, True, row[lost], place[lost], most[lost], least[lost], np.zeros(0))] if lost.any() else []
        return gone, (row[~lost], place[~lost], most[~lost], least[~lost], words[~lost].ravel())

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = batch.column("row").to_numpy()
            told = batch.column("suffixes")
            inner, counts = told.flatten(), np.diff(told.offsets.to_numpy())
            upto = np.concatenate(([0], np.cumsum(counts)))
            place_, most_, least_, common_ = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("place", "most", "least", "common"))
            for at, data, ends in pieces(batch.column("text")):
                words, last = hashed(data, ends)
                a, b = upto[at], upto[at + len(ends)]
                whose = np.repeat(np.arange(len(ends)), counts[at : at + len(ends)])
                place, most, least, common = place_[a:b].astype(np.int64), most_[a:b].astype(np.int64), least_[a:b].astype(np.int64), common_[a:b].astype(bool)
                begin = np.concatenate(([0], last[:-1]))[whose] + place
                row, out = rows[at + whose], []
                if (~common).any():
                    k = ~common
                    own, length = begin[k], (most + window - least)[k]
                    first = np.zeros(len(own), np.uint64)
                    for i in range(run):
                        first = mix(first * _FACTOR + words[own + i])
                    out += _by_group(first, groups, row[k], place[k], most[k], least[k], _gather(words, own - most[k], length), window)
                if common.any():
                    # a suffix for each of its windows
                    c = np.flatnonzero(common)
                    n = (most - least)[c] + 1
                    each = np.repeat(c, n)
                    o = least[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    held.append((row[each], place[each], o, o, _gather(words, begin[each] - o, np.full(len(each), window))))
                    if sum(len(h[0]) for h in held) >= HELD:
                        gone, left = settle(held)
                        out += gone
                        held = [left]
                        if len(left[0]) >= HELD // 2:
                            out += whole(left)
                            held = []
                if out:
                    yield record(out)
        if held:
            gone, left = settle(held)
            yield record(gone + whole(left))

    def whole(left: tuple) -> list[tuple]:
        """The windows of common prefixes, dealt by all their words."""
        row, place, most, least, words = left
        return _by_group(runs_of_rows(words.reshape(-1, window)), groups, row, place, most, least, words, window)

    return carry


def runs_of_rows(rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), rows.shape[1], np.uint64)
    for column in rows.T:
        out = mix(out * _FACTOR + column)
    return out


def _trees(window: int, run: int):
    def find(group: pa.Table) -> pa.Table:
        gone = group.column("gone").to_numpy().astype(bool)
        read = lambda name, kind, mine: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x, g in zip(group.column(name).to_pylist(), gone, strict=True) if g == mine]])
        row, place, most, least = (read(c, k, False) for c, k in (("row", "<i8"), ("place", "<i4"), ("most", "i1"), ("least", "i1")))
        words = np.concatenate([np.zeros(0, np.uint64), *[_wide(x) for x in group.column("words").to_pylist()]])
        again, order = repeated(words, row, place.astype(np.int64), most.astype(np.int64), least.astype(np.int64), window, run)
        found = spans(again, row[order], place[order].astype(np.int64))
        before = read("place", "<i4", True).astype(np.int64) - read("most", "i1", True)
        whose, first, last = (np.concatenate(c) for c in zip(found, (read("row", "<i8", True), before, before), strict=True))
        return pa.table({"row": whose, "first": first.astype(np.int32), "last": last.astype(np.int32)})

    return find


def repeats(docs: DataFrame, row: str, window: int = WINDOW, run: int = RUN, common: int = COMMON, group: int = GROUP) -> DataFrame:
    """(row, spans): the runs (first, last) of places where windows begin that repeat an earlier one, for the rows
    of ``docs`` that have any."""
    texts = docs.select(F.col(row).alias("row"), "text").filter(F.col("text").isNotNull())
    found = materialize(texts.mapInArrow(_find_anchors(window, run), _ANCHOR), "anchors", FEW)
    # written, so that both sides of the join are plain shuffles, of which Spark can split a frequent run of words
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("gram", "g")
    counts = materialize(counts, "repeated-runs")
    kept = found.join(counts, F.col("gram") == F.col("g"))
    kept = kept.groupBy("row").agg(F.collect_list(F.struct("place", "most", "least", (F.col("n") > common).alias("common"))).alias("suffixes"), F.count(F.lit(1)).alias("n"))
    kept = materialize(kept, "suffixes")
    discard(found)
    discard(counts)
    groups = max(1, math.ceil((kept.agg(F.sum("n")).first()[0] or 0) / group))
    with_words = texts.join(kept.select(F.col("row").alias("r"), "suffixes"), F.col("row") == F.col("r")).select("row", "text", "suffixes")
    dealt = with_words.mapInArrow(_carry_words(groups, window, run), _SUFFIXES)
    # rows of repeats that a task has found itself have no group; they go to any
    dealt = dealt.withColumn("group", F.when(F.col("gone"), F.pmod(F.hash("row"), F.lit(groups))).otherwise(F.col("group")))
    trees = materialize(dealt.groupBy("group").applyInArrow(_trees(window, run), "row long, first int, last int"), "repeats", FEW)
    discard(kept)
    return trees.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column("spans")
            inner, counts = told.flatten(), np.diff(told.offsets.to_numpy())
            upto = np.concatenate(([0], np.cumsum(counts)))
            first, last = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            n_words, n_removed, kept = [], [], []
            for k in range(len(batch)):
                words = (batch.column("text")[k].as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                a, b = upto[k], upto[k + 1]
                if b > a:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, first[a:b], 1)
                    np.add.at(step, np.minimum(last[a:b] + window, len(words)), -1)
                    stay = np.cumsum(step[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return cut


def without_repeated_passages(docs: DataFrame, window: int = WINDOW, run: int = RUN, common: int = COMMON, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): what is left of each text, its words joined by one space."""
    table, row = number_rows(docs.select("doc_id", "text"))
    gone = repeats(table, row, window, run, common, group).withColumnRenamed("row", "r")
    each = table.join(gone, F.col(row) == F.col("r"), "left")
    none = F.array().cast("array<struct<first: int, last: int>>")
    each = each.select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return each.mapInArrow(_cut(window), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept string")
