"""Hard-negative mining by ball trees: branch and bound on inner products, above and below.

Vectors are rounded down to whole multiples of 1 / ``SCALE``, so scores are whole numbers and ties are exact. The rows
are dealt to partitions of about ``TREE_ROWS``; each gets a tree whose upper levels part labels and whose lower levels
part the rows at the median of a direction. A node is a run of the tree's order, so the tree is stored as rows in
that order; a search finds middles and radii again by running sums. An inner product with any row of a ball is within
the anchor's length times the radius of that with its middle, which bounds it above and below.

Two searches, of blocks of ``BLOCK`` anchors in each tree: the first keeps an anchor's best ``POSITIVES`` rows of its
label and leaves out nodes of other labels and nodes strictly beneath the current kth score; the second keeps, for
each positive, the best ``NEGATIVES`` rows of other labels whose score lies in that positive's window, and leaves out
nodes wholly outside all of an anchor's windows or strictly beneath their kth. A block meets each tree once, in a task
that holds one tree and one block; the best of all trees are ranked by a window whose limit Spark applies before its
shuffle. The anchors are a stated set of queries against all rows: that work grows with anchors times rows, unless
the balls of clustered vectors are small enough to be left out.

Defined results: rows with a null label or vector, or with a component that is null, not finite, or beyond 1e150 once
multiplied (its products aren't finite), take no part; a row without a vec_id takes part but is no anchor, and comes last among ties; repeated
rows and ids are rows of their own (each an anchor, positive or negative; ties of equal ids by their order in the
table as written); a shorter vector counts as filled up with zeros, an empty one as all zeros; scores beyond 64 bits are found exactly and
returned as the nearest long; an anchor without a positive, and a positive without a negative, gives no row; an
empty table gives an empty result; other columns are ignored, whatever they are named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import discard, materialize

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
TREE_ROWS = 4096
BLOCK = 1024
LEAF = 128
#: Components from here on count as not finite: their products aren't finite as doubles.
WIDEST = 1e150
#: Rows that pass between Spark and Python at once: vectors may be long.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
#: A row in a tree's order that is worse than any.
NONE = -1


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, no_id, label, q) of the rows that take part; q holds whole numbers as doubles."""
    scaled = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    finite = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < WIDEST))
    id_ = F.col("vec_id").cast("long")
    own = rows.select(F.coalesce(id_, F.lit(0)).alias("vec_id"), id_.isNull().alias("no_id"), F.col("label").cast("long").alias("label"), scaled.alias("q"))
    return own.filter(F.col("label").isNotNull() & F.col("q").isNotNull()).filter(finite)


def _floor(x: Column) -> Column:
    """Rounded down, as a double: ``floor`` itself gives a long, which ends at 2^63; beyond 2^52 a double is whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def matrix(vectors: list, width: int | None = None) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    width = max((len(v) for v in vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def tree_order(q: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The rows in the order of a tree's leaves. A node of ``n`` rows has its first ``n // 2`` on the left: labels
    are parted first, then each node at the median of the direction from its middle to its farthest row."""
    order = np.argsort(label, kind="stable")
    open_ = [(0, len(order))]
    while open_:
        a, b = open_.pop()
        if b - a <= LEAF:
            continue
        rows, half = order[a:b], (b - a) // 2
        if label[rows[0]] == label[rows[-1]]:
            x = q[rows] - q[rows].mean(0)
            with np.errstate(over="ignore", invalid="ignore"):
                side = x @ x[np.argmax((x * x).sum(1))]
            order[a:b] = rows[np.argsort(np.nan_to_num(side), kind="stable")]
        open_ += [(a, a + half), (a + half, b)]
    return order


class Tree:
    """A tree over rows in its order."""

    def __init__(self, q: np.ndarray, label: np.ndarray):
        self.q, self.label = q, label
        # inner products of whole numbers are exact in doubles up to 2^53; beyond, Python's integers are used
        self.most = float(np.abs(q).max(initial=0.0))
        sums = np.vstack((np.zeros(q.shape[1]), np.cumsum(q, 0)))
        self.nodes: list[tuple] = []  # (first, last + 1, left, right, middle, radius); labels are those of the ends

        def make(a: int, b: int) -> int:
            here, at = len(self.nodes), a + (b - a) // 2
            self.nodes.append(())
            middle = (sums[b] - sums[a]) / max(1, b - a)
            reach = np.sqrt(((q[a:b] - middle) ** 2).sum(1).max(initial=0.0))
            kids = (make(a, at), make(at, b)) if b - a > LEAF else (None, None)
            labels = label[a:b]  # upper levels are sorted by label, lower ones have one
            self.nodes[here] = (a, b, *kids, middle, reach, labels.min(initial=1 << 62), labels.max(initial=-(1 << 62)))
            return here

        if len(q):
            make(0, len(q))

    def scores(self, anchors: np.ndarray, a: int, b: int) -> np.ndarray:
        rows = self.q[a:b]
        if self.most * float(np.abs(anchors).max(initial=0.0)) * max(1, rows.shape[1]) < 1 << 52:
            return (anchors @ rows.T).astype(np.int64)
        whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
        return whole(anchors) @ whole(rows).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by (score, then smaller id); ids of -1 are nobody."""
    if scores.shape[1] <= k:
        return scores, ids
    if scores.dtype != object:
        # those below the kth score go; of the others few remain, also where many tie
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above = scores >= kth
        most = int(above.sum(1).max(initial=0))
        if most < scores.shape[1]:
            keep = np.argsort(~above, axis=1, kind="stable")[:, :most]
            scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
            scores = np.where(scores >= kth, scores, LEAST)
    order = np.array([sorted(range(scores.shape[1]), key=lambda j: (-int(s[j]), i[j]))[:k] for s, i in zip(scores, ids, strict=True)]) if scores.dtype == object else np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


LEAST = -(1 << 62)


def search(tree: Tree, rank: np.ndarray, anchors: np.ndarray, label: np.ndarray, own: np.ndarray, windows: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and window (without windows: one, of any score), the scores and rows of the best ``k`` rows:
    of the same label, without windows, and otherwise of other labels. ``rank`` orders the tree's rows among ties,
    ``own`` is the anchor's own row in the tree or -1, ``windows`` has (lowest, highest) score."""
    n, w = len(anchors), 1 if windows is None else windows.shape[1]
    exact = object if tree.most * float(np.abs(anchors).max(initial=0.0)) * max(1, anchors.shape[1]) >= 1 << 52 or (windows is not None and windows.dtype == object) else np.int64
    least = -(10**305) if exact is object else LEAST
    score, row = np.full((n * w, k), least, exact), np.full((n * w, k), len(rank), np.int64)  # row: place among ties
    if not n or not tree.nodes:
        return score.reshape(n, w, k), np.full((n, w, k), NONE)
    length = np.sqrt((anchors * anchors).sum(1))
    back = np.argsort(rank)  # from place among ties to row
    low = high = None
    if windows is not None:
        low, high = windows[:, :, 0], windows[:, :, 1]
    open_ = [(0, np.arange(n))]
    while open_:
        at, who = open_.pop()
        a, b, left, right, middle, radius, first, last = tree.nodes[at]
        if windows is None:
            who = who[(label[who] >= first) & (label[who] <= last)]
        elif first == last:
            who = who[label[who] != first]
        if len(who):
            near, slack = anchors[who] @ middle, length[who] * radius
            err = 1e-9 * (np.abs(near) + slack) + 1e-6
            top, bottom = near + slack + err, near - slack - err
            kth = score.reshape(n, w, k)[who, :, k - 1].astype(float)
            may = top[:, None] >= kth
            if windows is not None:
                may &= (top[:, None] >= low[who].astype(float)) & (bottom[:, None] <= high[who].astype(float))
            who = who[may.any(1)]
        if not len(who):
            continue
        if left is not None:
            # the child with the higher bound first, so that the kth score is high before the other is looked at
            l, r = (float((anchors[who] @ tree.nodes[c][4]).mean()) for c in (left, right))
            open_ += [(left, who), (right, who)] if l <= r else [(right, who), (left, who)]
            continue
        s = tree.scores(anchors[who], a, b)
        same = label[who][:, None] == tree.label[None, a:b]
        allowed = same & (own[who][:, None] != np.arange(a, b)[None]) if windows is None else ~same
        places = np.broadcast_to(rank[None, a:b], s.shape)
        for j in range(w):
            inside = allowed if windows is None else allowed & (s >= low[who, j][:, None]) & (s <= high[who, j][:, None])
            slot = who * w + j
            inside = np.asarray(inside & (s >= score[slot, k - 1][:, None]), bool)
            some = inside.any(1)
            if not some.any():
                continue
            slot, inside = slot[some], inside[some]
            new = np.where(inside, s[some], least)
            new_ids = np.where(inside, places[some], len(rank))
            score[slot], row[slot] = best(np.hstack((score[slot], new)), np.hstack((row[slot], new_ids)), k)
    found = np.append(back, NONE)[row]
    return score.reshape(n, w, k), found.reshape(n, w, k)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("mark", ignore_index=True)  # the same tree in whatever order the rows come
    order = tree_order(matrix(list(rows["q"])), rows["label"].to_numpy(np.int64))
    rows = rows.iloc[order].reset_index(drop=True)
    return rows.assign(place=np.arange(len(rows)))


def _long(x) -> int:
    return min(max(int(x), -(1 << 63)), (1 << 63) - 1)


def _window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest score s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _searcher(k: int, low: int, high: int):
    """Searches one tree for one block of anchors: their positives, or, where they come with those, negatives."""

    def run(trees: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        columns = ["anchor", "slot", "score", "exact", "vec_id", "no_id", "mark"]
        if not len(trees) or not len(anchors):
            return pd.DataFrame({c: [] for c in columns})
        trees = trees.sort_values("place", ignore_index=True)
        width = max(max(map(len, trees["q"])), max(map(len, anchors["q"])))
        tree = Tree(matrix(list(trees["q"]), width), trees["label"].to_numpy(np.int64))
        mark = trees["mark"].to_numpy(np.int64)
        ids, no_id = trees["vec_id"].to_numpy(np.int64), trees["no_id"].to_numpy(bool)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((mark, ids, no_id))] = np.arange(len(ids))
        where = {m: i for i, m in enumerate(mark)}
        a_mark = anchors["mark"].to_numpy(np.int64)
        own = np.array([where.get(m, NONE) for m in a_mark])
        windows = None
        if "exacts" in anchors:
            each = [[_window(int(s), low, high) for s in e] for e in anchors["exacts"]]
            most = max(map(len, each))
            each = [e + [(1, 0)] * (most - len(e)) for e in each]  # an empty window
            big = max((abs(x) for e in each for y in e for x in y), default=0) >= 1 << 62
            windows = np.array(each, object if big else np.int64).reshape(len(each), most, 2)
        score, row = search(tree, rank, matrix(list(anchors["q"]), width), anchors["label"].to_numpy(np.int64), own, windows, k)
        n, slot, place = np.nonzero(row != NONE)
        hit = row[n, slot, place]
        found = [int(x) for x in score[n, slot, place]]
        return pd.DataFrame({
            "anchor": a_mark[n], "slot": slot.astype(np.int32), "score": np.array([_long(x) for x in found], np.int64), "exact": [str(x) for x in found],
            "vec_id": ids[hit], "no_id": no_id[hit], "mark": mark[hit]})

    return run


def _cells(rows: DataFrame, anchors: DataFrame, trees: int, blocks: int, k: int, low: int, high: int) -> DataFrame:
    """The searches of all trees for all blocks, each pair of them a group of its own."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", every(blocks)).groupBy("tree", "block")
    right = anchors.withColumn("block", F.pmod(F.hash(F.col("mark"), F.lit("block")), F.lit(blocks))).withColumn("tree", every(trees)).groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(_searcher(k, low, high), "anchor long, slot int, score long, exact string, vec_id long, no_id boolean, mark long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of an anchor's slot, numbered."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), *_beyond(), "no_id", "vec_id", "mark")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _beyond() -> list[Column]:
    """The order of scores that are at either end of a long: longer numbers are further from zero."""
    end = F.col("score").isin((1 << 63) - 1, -(1 << 63))
    away = F.when(end, F.struct(F.length("exact").alias("n"), F.col("exact").alias("s")))
    return [F.when(F.col("score") > 0, away).desc_nulls_last(), F.when(F.col("score") < 0, away).asc_nulls_last()]


def _asks(every: int) -> Column:
    return ~F.col("no_id") & (F.col("vec_id") % every == 0)


def _id() -> Column:
    return F.when(~F.col("no_id"), F.col("vec_id"))


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_every: int = ANCHOR_EVERY, tree_rows: int = TREE_ROWS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over (vec_id, label, embedding)."""
    marked = materialize(usable(rows).withColumn("mark", F.monotonically_increasing_id()), "vectors")
    n = marked.agg(F.count(F.lit(1)), F.count_if(_asks(anchor_every))).first()
    trees, blocks = max(1, math.ceil(n[0] / tree_rows)), max(1, math.ceil(n[1] / block))
    dealt = marked.withColumn("tree", F.pmod(F.hash("mark"), F.lit(trees)))
    stored = dealt.groupBy("tree").applyInPandas(_build, "vec_id long, no_id boolean, label long, q array<double>, mark long, tree int, place int")
    stored = materialize(stored, "ball-trees", FEW)
    # columns of its own, since the anchors meet the table they come from
    anchors = stored.filter(_asks(anchor_every)).select(*[F.col(c).alias(c) for c in ("vec_id", "label", "q", "mark")])
    first = materialize(_cells(stored, anchors, trees, blocks, positives, low, high), "near", FEW)
    best_ = materialize(_ranked(first, positives).select("anchor", "rank", "score", "exact", _id().alias("vec_id"), "mark"), "positives")
    discard(first)
    told = best_.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "exact"))).alias("e")).select("anchor", F.col("e.exact").alias("exacts"))
    asking = anchors.join(told, F.col("mark") == F.col("anchor")).drop("anchor")
    second = materialize(_cells(stored, asking, trees, blocks, negatives, low, high), "hard", FEW)
    hard = _ranked(second, negatives).select(F.col("anchor").alias("n_anchor"), (F.col("slot") + 1).alias("n_rank"), "rank", _id().alias("negative_id"), F.col("score").alias("negative_score"))
    kept = best_.select("anchor", F.col("rank").alias("p_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = kept.join(hard, (F.col("anchor") == F.col("n_anchor")) & (F.col("p_rank") == F.col("n_rank")))
    ids = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("mark").alias("a_mark"))
    out = both.join(ids, F.col("anchor") == F.col("a_mark"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
