"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. The driver sees
one row for each pattern, and no more, and routes word capacity from patterns
to source quotas, where the first use of a word is free and each repetition
costs more than the one before. Patterns that share no source, however far,
are routed apart, so that a corpus of many thousand sources without overlaps
costs no more than its sources. Each pattern's amount is then filled with whole
documents in the order of a seeded hash.

The order is cut by hash buckets, so that only one bucket of a pattern is ever
sorted: a source that holds a third of all rows is spread over all tasks.

Defined results: a null text has no words; null sources form a source of their
own, ordered last; documents of no words take part and are taken as nothing;
repeated rows are separate capacity; ids go through untouched, null ones
included; columns other than those asked for are left out, whatever their
names; an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shapelake.plans.rounds import written


@F.pandas_udf(LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """Number of words `[^\\x20\\x09-\\x0D]+`; bytes.split() parts at just these characters."""
    return pd.Series([0 if t is None else len(t.encode().split()) for t in texts], dtype="int64")


def capped_targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Shares ``share`` of all sizes by weight; none exceeds ``cap`` times its size, the excess is shared anew."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = cap * sizes[i]
            free.discard(i)
        left = share * sum(sizes) - sum(target[i] for i in range(len(sizes)) if i not in free)
    return target


def route(patterns: list[tuple[tuple, int]], quotas: dict, max_uses: int) -> list[int]:
    """Words to take from each pattern (its sources, its size), for each group of patterns that share sources apart."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for sources, _ in patterns:
        for s in sources[1:]:
            parent[root(s)] = root(sources[0])
    groups = defaultdict(list)
    for i, (sources, _) in enumerate(patterns):
        if sources:
            groups[root(sources[0])].append(i)
    taken = [0] * len(patterns)
    for own in groups.values():
        for i, n in zip(own, _flow([patterns[i] for i in own], quotas, max_uses), strict=True):
            taken[i] = n
    return taken


def _flow(patterns: list[tuple[tuple, int]], every_quota: dict, max_uses: int) -> list[int]:
    """A min-cost flow by shortest augmenting paths.

    Arcs: start to pattern once per use, with cost 0, 1, 4, 9, ...; pattern to
    each of its sources, free; source to end, up to its quota.
    """
    quotas = {s: every_quota[s] for sources, _ in patterns for s in sources}
    names = list(quotas)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, room, cost = [], [], []

    def arc(a, b, capacity, price):
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    uses = []
    for i, (sources, size) in enumerate(patterns):
        uses.append([len(to) + 2 * r for r in range(max_uses)])
        for r in range(max_uses):
            arc(0, 1 + i, size, r * r)
        for s in sources:
            arc(1 + i, node[s], size * max_uses, 0)
    for s in names:
        arc(node[s], end, quotas[s], 0)
    height = [0] * (end + 1)
    while True:
        best, via, heap = [float("inf")] * (end + 1), [-1] * (end + 1), [(0, 0)]
        best[0] = 0
        while heap:
            d, v = heapq.heappop(heap)
            if d > best[v]:
                continue
            for e in graph[v]:
                if room[e] > 0 and (n := d + cost[e] + height[v] - height[to[e]]) < best[to[e]]:
                    best[to[e]], via[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if via[end] < 0:
            break
        height = [h + (b if b < float("inf") else 0) for h, b in zip(height, best, strict=True)]
        path, v = [], end
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [sum(room[e ^ 1] for e in es) for es in uses]


def nearest_change(sizes: np.ndarray, taken: np.ndarray, left: int) -> tuple[int | None, int | None]:
    """(a document to leave out, one to take in), either may be None: what brings the sum nearest, where ``left`` is missing."""
    best, change = abs(left), (None, None)
    own, rest = np.flatnonzero(taken), np.flatnonzero(taken == 0)
    own = own[np.argsort(sizes[own], kind="stable")]
    held = np.concatenate([[0], sizes[own]])  # 0: nothing is left out
    for i in rest:
        at = np.searchsorted(held, sizes[i] - left)
        for j in (at - 1, at):
            if 0 <= j < len(held) and (gap := abs(int(left - sizes[i] + held[j]))) < best:
                best, change = gap, (int(own[j - 1]) if j else None, int(i))
    for j, i in enumerate(own):
        if abs(int(left + held[j + 1])) < best:
            best, change = abs(int(left + held[j + 1])), (int(i), None)
    return change


def mix(
    docs: DataFrame,
    quotas,
    memberships: Column,
    size: Column,
    max_uses: int = 2,
    seed: int = 17,
    bucket_rows: int = 2000,
    max_sent: int = 10_000,
    id_column: str = "doc_id",
    order: tuple[str, ...] = (),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Adds to each document (id, and what ``memberships`` and ``size`` need) its size and ``taken`` words.

    ``quotas`` maps the list of (sources of a pattern, size of the pattern) to
    {source: words}. ``taken`` is a multiple of the size, at most ``max_uses``
    times. A pattern's taken words differ from its flow by what no single exchange of
    two documents of its last bucket brings nearer. Documents are ordered by a hash of
    their ids, or of the columns ``order``; long columns ``carry`` go through.
    Up to ``max_sent`` patterns are sent to all tasks; more are joined by shuffle.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), memberships.alias("pattern"), size.alias("size"),
        F.xxhash64(F.lit(seed), *(order or (F.col(id_column).cast("long"),))).alias("u"), *carry,
    )
    base = written(base)
    total = base.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rows = total.collect()
    sent = F.broadcast if len(rows) <= max_sent else lambda df: df
    rows.sort(key=lambda r: [(x is None, x or "") for x in r.pattern])
    patterns = [(tuple(r.pattern), r.size) for r in rows]
    amounts = route(patterns, quotas(patterns), max_uses)
    # Amount = whole uses of all documents + a part of one more use.
    plan = []
    for r, amount in zip(rows, amounts, strict=True):
        uses = amount // r.size if r.size else 0
        plan.append((list(r.pattern), int(uses), int(amount - uses * r.size), max(1, -(-r.n // bucket_rows))))
    plan = spark.createDataFrame(plan, "pattern array<string>, uses long, part long, buckets long")
    # Null elements never equal: compare a key with nulls spelled out.
    key = lambda c: F.to_json(F.struct(F.col(c).alias("k")), {"ignoreNullFields": "false"})
    plan = plan.withColumn("key", key("pattern")).drop("pattern")
    placed = (
        base.withColumn("key", key("pattern"))
        .join(sent(plan), "key")
        .withColumn("bucket", F.expr("pmod(shiftrightunsigned(u, 8), buckets)"))
    )
    sums = placed.groupBy("key", "bucket").agg(F.sum("size").alias("sum"), F.first("part").alias("part"))
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sums.withColumn("before", F.coalesce(F.sum("sum").over(ahead), F.lit(0)))
    cut = cuts.where("before <= part and part < before + sum").groupBy("key").agg(
        F.min("bucket").alias("cut"), F.min_by(F.col("part") - F.col("before"), "bucket").alias("left")
    )
    placed = placed.join(sent(cut), "key", "left")
    whole = placed.where("cut is null or bucket != cut").withColumn("more", (F.col("bucket") < F.col("cut")).cast("long"))
    # The cut bucket, of about bucket_rows documents: each is taken, in hash order, if it fits in what is left.
    columns = ["doc_id", "pattern", "size", "uses", "more", *carry]

    def fill(bucket: pa.Table) -> pa.Table:
        keys = [(c, "ascending") for c in ("u", "doc_id", "size")]
        bucket = bucket.take(pc.sort_indices(bucket, sort_keys=keys, null_placement="at_end"))
        left, sizes = bucket["left"][0].as_py(), bucket["size"].to_numpy()
        more = np.zeros(len(sizes), dtype=np.int64)
        for i, n in enumerate(sizes):
            if n <= left:
                more[i], left = 1, left - n
        out, into = nearest_change(sizes, more, left)
        more[[i for i in (out, into) if i is not None]] ^= 1
        return bucket.append_column("more", pa.array(more)).select(columns)

    schema = "doc_id long, pattern array<string>, size long, uses long, more long" + "".join(f", {c} long" for c in carry)
    last = placed.where("bucket = cut").select("key", "doc_id", "pattern", "size", "uses", "u", "left", *carry)
    last = last.groupBy("key").applyInArrow(fill, schema)
    out = whole.select(*columns).unionByName(last)
    return out.select(
        "doc_id", "pattern", "size", ((F.col("uses") + F.coalesce("more", F.lit(0))) * F.col("size")).alias("taken"), *carry
    )


def weighted_quotas(share: float = 1.5, weights: tuple = (3, 1, 2), cap: float = 2.0):
    """Quotas for sources in code-point order, null last, with weights that repeat: returns a function for ``mix``."""

    def exact(patterns: list[tuple[tuple, int]]) -> dict:
        sizes: dict = {}
        for sources, n in patterns:
            for s in sources:
                sizes[s] = sizes.get(s, 0) + n
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        found = capped_targets([sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], share, cap)
        return dict(zip(names, found, strict=True))

    def quotas(patterns: list[tuple[tuple, int]]) -> dict:
        return {s: round(x) for s, x in exact(patterns).items()}

    quotas.exact = exact
    return quotas
