"""Hard negatives of anchors: rows of another label whose score lies in a window under a positive's.

A score is the integer inner product of two whole-number vectors. Anchors lie
on spanning trees of short edges, a tree for each block of near anchors. The
scores of a tree's root are computed; from a parent to a child a candidate's
score moves by at most the edge's length times the candidate's norm, so the
parent's scores, or what is known of them, bound the child's. Only candidates
whose bounds reach the best positives, or overlap a window of negatives, are
scored again, exactly; what is scored has tight bounds for the child's own
children. Nothing is left out: bounds only save work, and where vectors have
no near anchors they save none.

Candidates and anchors meet block by block; trees are built once. First every
block gives an anchor's best positives and the best of all blocks are kept;
then every block gives the best negatives of each window, in the same way. A
task holds a block of candidates, a block of anchors, and bounds for the
anchors on the way down a tree.

Defined results: rows whose id, label or vector is null, whose vector is empty
or holds null or non-finite components, or whose norm is 2 ** 31 or more (its
scores could leave 64 bits) take no part; vectors of different lengths never
meet; repeated rows count once, rows that share an id alone are rows of their
own; ties go to the smaller id; anchors without positives and positives
without negatives have no rows; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelake.plans.rounds import written


@dataclass(frozen=True)
class MiningParameters:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # percent of a positive's score that a negative's reaches at least
    high: int = 95  # and at most
    block: int = 8192  # candidates in one task, about
    anchor_block: int = 512  # anchors in one task, about

    def window(self, score: int) -> tuple[int, int]:
        """Least and greatest score of a negative, both within."""
        return -(-self.low * score // 100), self.high * score // 100


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each row (the first row's is itself) and the distance to it, by Prim's algorithm."""
    n, v = len(vectors), vectors.astype(np.float64)
    parent, near, free = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.ones(n, dtype=bool)
    at, edge = 0, np.zeros(n)
    for _ in range(n - 1):
        free[at] = False
        d = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
        closer = free & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.argmin(np.where(free, near, np.inf)))
        edge[at] = near[at]
    return parent, edge


def walk(
    candidates: np.ndarray, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray,
    choose: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each anchor with the candidates to look at and their exact scores, parents before children.

    ``choose`` gets an anchor and the bounds of all candidates' scores, and
    tells which candidates matter; at the root everything is scored.
    """
    norms = np.sqrt((candidates.astype(np.float64) ** 2).sum(axis=1))
    lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    if len(candidates) and norms.max() * lengths.max() < 2.0**52:  # sums of products stay exact
        candidates, anchors = candidates.astype(np.float64), anchors.astype(np.float64)
    children: dict[int, list[int]] = {}
    for k, p in enumerate(parent):
        if k != p:
            children.setdefault(int(p), []).append(k)
    root = int(np.flatnonzero(parent == np.arange(len(parent)))[0])
    stack = [(root, None)]
    while stack:
        k, above = stack.pop()
        if above is None:
            low = high = (candidates @ anchors[k]).astype(np.float64)
            rows = choose(k, low, high)
            scores = (candidates[rows] @ anchors[k]).astype(np.int64)
        else:
            reach = norms * (edge[k] * (1 + 1e-9) + lengths[k] * 1e-12) + 1.0  # with room for rounding
            low, high = above[0] - reach, above[1] + reach
            rows = choose(k, low, high)
            # Copying most of the block's rows takes longer than scoring all.
            scores = candidates[rows] @ anchors[k] if len(rows) * 4 < len(low) else (candidates @ anchors[k])[rows]
            scores = scores.astype(np.int64)
            low[rows] = high[rows] = scores
        yield k, rows, scores
        stack += [(c, (low, high)) for c in children.get(k, [])]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id, in order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    v = table[column].combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _column(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy()


def _empty(fields: list[str]) -> pa.Table:
    return pa.table({f: pa.array([], pa.int64()) for f in fields})


POSITIVE = ["a", "a_id", "c", "c_id", "score"]
NEGATIVE = ["a", "n", "a_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def _positives(p: MiningParameters):
    def find(own: pa.Table, anchors: pa.Table) -> pa.Table:
        if not own.num_rows or not anchors.num_rows:
            return _empty(POSITIVE)
        anchors = anchors.sort_by("place")  # parents are places
        rows, ids, labels = (_column(own, c) for c in ("row", "vec_id", "label"))
        a_rows, a_ids, a_labels = (_column(anchors, c) for c in ("row", "vec_id", "label"))

        def choose(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            same = np.flatnonzero((labels == a_labels[k]) & (rows != a_rows[k]))
            if len(same) <= p.positives:
                return same
            least = np.partition(low[same], len(same) - p.positives)[len(same) - p.positives]
            return same[high[same] >= least]

        out = []
        for k, found, scores in walk(_matrix(own, "v"), _matrix(anchors, "v"), _column(anchors, "parent"), _column(anchors, "edge"), choose):
            at = best_of(scores, ids[found], p.positives)
            out += [(a_rows[k], a_ids[k], rows[found[i]], ids[found[i]], scores[i]) for i in at]
        columns = zip(*out, strict=True) if out else [[]] * len(POSITIVE)
        return pa.table({f: pa.array(np.array(c, dtype=np.int64)) for f, c in zip(POSITIVE, columns, strict=True)})

    return find


def _negatives(p: MiningParameters):
    def find(own: pa.Table, anchors: pa.Table) -> pa.Table:
        if not own.num_rows or not anchors.num_rows:
            return _empty(NEGATIVE)
        anchors = anchors.sort_by("place")
        ids, labels = _column(own, "vec_id"), _column(own, "label")
        a_rows, a_ids, a_labels = (_column(anchors, c) for c in ("row", "vec_id", "label"))
        windows = [[(x, p.window(x["score"])) for x in found or []] for found in anchors["positives"].to_pylist()]

        def choose(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            meets = np.zeros(len(low), dtype=bool)
            for least, most in {w for _, w in windows[k] if w[0] <= w[1]}:
                meets |= (high >= least) & (low <= most)
            return np.flatnonzero(meets & (labels != a_labels[k]))

        out = []
        for k, found, scores in walk(_matrix(own, "v"), _matrix(anchors, "v"), _column(anchors, "parent"), _column(anchors, "edge"), choose):
            for x, (least, most) in windows[k]:
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                at = inside[best_of(scores[inside], ids[found[inside]], p.negatives)]
                out += [(a_rows[k], x["n"], a_ids[k], x["c_id"], x["score"], ids[found[i]], scores[i]) for i in at]
        columns = zip(*out, strict=True) if out else [[]] * len(NEGATIVE)
        return pa.table({f: pa.array(np.array(c, dtype=np.int64)) for f, c in zip(NEGATIVE, columns, strict=True)})

    return find


def _tree(anchors: pa.Table) -> pa.Table:
    parent, edge = spanning_tree(_matrix(anchors, "v"))
    place = pa.array(np.arange(anchors.num_rows))
    return anchors.append_column("place", place).append_column("parent", pa.array(parent)).append_column("edge", pa.array(edge))


def usable(vector: Column, label: Column, vec_id: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec_id.isNotNull() & label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & finite


def mine(vectors: DataFrame, is_anchor: Column, p: MiningParameters = MiningParameters()) -> DataFrame:
    """Negatives of (vec_id, label, v array<long>) for the anchors among them.

    Returns anchor_id, positive_id, rank (from 1 among a positive's negatives),
    negative_id, positive_score, negative_score.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    base = vectors.select(long("vec_id"), long("label"), F.col("v").cast("array<long>").alias("v"), is_anchor.alias("asked"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    base = base.where(usable(F.col("v").cast("array<double>"), F.col("label"), F.col("vec_id"))).where(squares < 2.0**62)
    base = written(base.distinct().select("*", F.monotonically_increasing_id().alias("row"), F.size("v").alias("dim")))
    n, asked = base.agg(F.count("*"), F.coalesce(F.sum(F.col("asked").cast("int")), F.lit(0))).first()
    blocks, anchor_blocks = max(1, -(-n // p.block)), max(1, -(-asked // p.anchor_block))

    # Near anchors share a block: they are dealt by the signs of their leading components.
    signs = F.aggregate(F.slice("v", 1, 16), F.lit(0), lambda s, x: s * 2 + (x > 0).cast("int")).alias("signs")
    dealt = base.where("asked").select("*", signs).repartitionByRange(anchor_blocks, "dim", "signs", "row")
    dealt = written(dealt.select("dim", F.spark_partition_id().alias("ablock"), "row", "vec_id", "label", "v"))
    schema = "dim int, ablock int, row long, vec_id long, label long, v array<long>, place long, parent long, edge double"
    trees = written(dealt.groupBy("dim", "ablock").applyInArrow(_tree, schema))

    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = base.select("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), spread(anchor_blocks).alias("ablock"), "row", "vec_id", "label", "v")
    keys = ["dim", "block", "ablock"]

    def over_blocks(anchors: DataFrame, find, fields: list[str]) -> DataFrame:
        sent = anchors.select("dim", spread(blocks).alias("block"), *[c for c in anchors.columns if c != "dim"])
        return own.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(find, ", ".join(f"{f} long" for f in fields))

    first = Window.partitionBy("a").orderBy(F.desc("score"), "c_id", "c")
    best = over_blocks(trees, _positives(p), POSITIVE).withColumn("n", F.row_number().over(first)).where(F.col("n") <= p.positives)
    best = best.groupBy(F.col("a").alias("row")).agg(F.sort_array(F.collect_list(F.struct("n", "c_id", "score"))).alias("positives"))
    anchors = written(trees.join(best, "row", "left"))  # whole trees: who has no positives may have children
    first = Window.partitionBy("a", "n").orderBy(F.desc("negative_score"), "negative_id")
    out = over_blocks(anchors, _negatives(p), NEGATIVE).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= p.negatives)
    return out.select(F.col("a_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
