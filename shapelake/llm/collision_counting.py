"""Approximate nearest neighbours by collision counting on single projections.

Every block of vectors keeps one sorted array for each of many random
projections. Projections are the directions of random rotations: what they
measure of a difference adds up to its length, so that counts of vectors at one
distance vary by little more than half as much as under independent directions,
and few far ones reach the threshold. A query's window in each array is centred on its own projection;
virtual rehashing widens all windows together, and only what a widening adds
is counted. A vector that falls into enough windows is verified by its exact
cosine. Windows widen until the k-th best verified distance lies within the
radius they stand for.

Vectors are unit length for the index, so that distance follows cosine. Equal
vectors are one entry: of their ids only the smallest few can be among the
nearest, and only those are carried. Queries and vectors meet block by block:
blocks are as large as a task's memory takes, so that each vector is sent to
few query blocks and each sorted array serves tens of thousands of queries.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do null ids; vectors of different
lengths are never compared; repeated rows count once; ties go to the smaller
id; fewer than k candidates are all returned; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelake.plans.rounds import written


@dataclass(frozen=True)
class SearchParameters:
    projections: int = 64
    half_width: float = 1.3  # of a window, for radius 1
    deviations: float = 1.3  # by which the threshold lies below the mean count of a vector at the radius
    first_radius: float = 0.8
    ratio: float = 1.25
    block: int = 65_536  # vectors that are in one task at most
    tasks: int = 24  # smaller blocks, down to a tenth, where there would be fewer pairs of blocks
    query_block: int = 16_384
    seed: int = 5

    @property
    def threshold(self) -> float:
        p = math.erf(self.half_width / math.sqrt(2))
        # What the sum of squares explains of an indicator's variance is fixed under a rotation.
        slope = self.half_width * math.sqrt(2 / math.pi) * math.exp(-self.half_width**2 / 2)
        return self.projections * p - self.deviations * math.sqrt(self.projections * (p * (1 - p) - slope**2 / 2))

    def directions(self, dim: int) -> np.ndarray:
        """One column a projection: columns of random rotations, as many as are needed, scaled to the length of normal vectors."""
        rng, parts = np.random.default_rng(self.seed), []
        for _ in range(-(-self.projections // dim)):
            parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
        return np.concatenate(parts, axis=1)[:, : self.projections] * math.sqrt(dim)

    def block_counts(self, vectors: int, queries: int) -> tuple[int, int]:
        query_blocks = max(1, -(-queries // self.query_block))
        least = max(1, -(-vectors // self.block))
        return max(least, min(-(-self.tasks // query_blocks), max(1, vectors * 10 // self.block))), query_blocks


class Block:
    """Sorted projections of a block of unit vectors."""

    def __init__(self, unit: np.ndarray, p: SearchParameters):
        self.p, self.unit, self.verified = p, unit, 0
        self.lines = p.directions(unit.shape[1])
        values = (unit @ self.lines).T
        order = np.argsort(values, axis=1, kind="stable")
        self.order, self.values = order.astype(np.int32), np.take_along_axis(values, order, axis=1)

    def nearest(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows of at least k near vectors, or of all, for one unit query."""
        n, at = len(self.unit), query @ self.lines
        if n <= k:
            return np.arange(n)
        counts = np.zeros(n, dtype=np.int64)
        lo = hi = np.array([np.searchsorted(v, x) for v, x in zip(self.values, at, strict=True)])
        found, scores, radius = np.zeros(n, dtype=bool), np.full(n, -np.inf), self.p.first_radius
        while True:
            reach = radius * self.p.half_width
            new_lo = np.array([np.searchsorted(v, x - reach, "left") for v, x in zip(self.values, at, strict=True)])
            new_hi = np.array([np.searchsorted(v, x + reach, "right") for v, x in zip(self.values, at, strict=True)])
            parts = [o[a:b] for o, a, b in zip(self.order, new_lo, lo, strict=True)]
            parts += [o[a:b] for o, a, b in zip(self.order, hi, new_hi, strict=True)]
            counts += np.bincount(np.concatenate(parts), minlength=n)
            lo, hi = new_lo, new_hi
            fresh = np.flatnonzero((counts >= self.p.threshold) & ~found) if radius < 2 else np.flatnonzero(~found)
            found[fresh] = True
            scores[fresh] = self.unit[fresh] @ query
            have = int(found.sum())
            if have >= k:
                kth = math.sqrt(max(0.0, 2 - 2 * float(np.partition(scores, n - k)[n - k])))
                if kth <= radius or have == n:
                    break
                radius = min(kth, radius * self.p.ratio) if kth > radius else kth
            else:
                radius *= self.p.ratio
        self.verified += have
        best = np.partition(scores, n - k)[n - k]
        return np.flatnonzero(scores >= best - 1e-9)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 5, p: SearchParameters = SearchParameters(),
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query by cosine, itself left out."""
    v = F.col(vector_column).cast("array<double>")
    base = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("q"))
    base = base.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    base = base.withColumns({"c1": F.xxhash64("v"), "c2": F.xxhash64(F.lit(3), "v"), "dim": F.size("v")})
    same = ["c1", "c2", "dim"]
    ids = written(base.select("vec_id", "q", *same).distinct())
    order = Window.partitionBy(*same).orderBy("vec_id")
    # Of equal vectors, k + 1 ids are enough for any query; the limit is applied before the shuffle as well.
    first = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    classes = ids.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.max(F.col("q").cast("int")).alias("asked"))
    reps = base.select("vec_id", "v", *same).join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", *same])
    reps = written(reps.dropDuplicates(["vec_id", *same]).select("vec_id", "v", "dim", "asked"))
    n, asked = reps.agg(F.count("*"), F.coalesce(F.sum("asked"), F.lit(0))).first()
    blocks, query_blocks = p.block_counts(n, asked)
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    place = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    left = reps.select("dim", place(blocks, 0).alias("block"), spread(query_blocks).alias("qblock"), "vec_id", "v")
    right = reps.where("asked = 1").select("dim", spread(blocks).alias("block"), place(query_blocks, 1).alias("qblock"), "vec_id", "v")

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_rep": [], "rep": [], "score": []}).astype({"query_rep": "int64", "rep": "int64"})
        if not len(own) or not len(queries):
            return empty
        raw, asked = np.array(own["v"].tolist()), np.array(queries["v"].tolist())
        big = lambda m: m / np.abs(m).max(axis=1, keepdims=True)  # noqa: E731  squares neither overflow nor vanish
        unit = big(raw) / np.linalg.norm(big(raw), axis=1, keepdims=True)
        asked = big(asked) / np.linalg.norm(big(asked), axis=1, keepdims=True)
        ids, out, index = own["vec_id"].to_numpy(), [], Block(unit, p)
        for qid, q in zip(queries["vec_id"], asked, strict=True):
            near = index.nearest(q, k + 1)
            score = np.clip(unit[near] @ q, -1.0, 1.0)
            keep = np.lexsort((ids[near], -score))[: k + 1]
            out.append(pd.DataFrame({"query_rep": qid, "rep": ids[near][keep], "score": score[keep]}))
        return pd.concat(out) if out else empty

    keys = ["dim", "block", "qblock"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_rep long, rep long, score double")
    best = Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    first = first.join(classes.select(*same, "rep"), same).select("rep", "vec_id")
    found = written(found.join(first, "rep").select("query_rep", "vec_id", "score"))
    best = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    # All queries with equal vectors share what was found; each leaves itself out.
    lists = found.groupBy("query_rep").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("l"))
    queries = ids.where("q").join(classes.select(*same, F.col("rep").alias("query_rep")), same).select("vec_id", "query_rep")
    out = queries.join(lists, "query_rep").withColumnRenamed("vec_id", "query_id")
    others = F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
