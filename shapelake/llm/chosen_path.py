"""Near-duplicate documents by a chosen-path set similarity join.

Each document's shingle set is embedded as minwise tokens. In every tree a
document descends from the root: at a node, one or two coordinates are drawn
from the node's own hash, and the document goes to the child named by its
token there. Two documents of similarity s share a child with probability s,
and the mean number of children is 1/threshold, so that similar documents meet
in a leaf of any depth with a chance that falls slowly, and others hardly
ever. The draw depends on the path alone, hence each document finds its leaves
by itself. Depth follows the number of documents, the number of trees follows
the depth and the target recall.

Leaves are compared exhaustively on 64-bit sketches. What is close there forms
candidate clusters, within which links are confirmed on full shingle sets.
Equal sets are one representative throughout: a group of copies costs one row.

A leaf of more than ``leaf_rows`` texts, as many variants of one text make, is
dealt into parts that are compared apart, then by a sample of all parts, which
joins what is common; what is then outside its largest component meets all of
its parts. No task holds more than two parts, and no close pair is left apart.

A cluster of more than ``block`` sets is compared in blocks, then through
delegates of the components found, and what is then outside a cluster's
largest component is compared with all of the cluster, so no link between
components is lost and no pair list is ever written.

Defined results: null or wordless texts have an empty set and no links; a row
with a null id stands alone, with a null component, and is kept; repeated rows
are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.llm.shingles import mixed, shingle_sets, shingles, text_slices, words
from shapelake.plans.rounds import connected_components, written


@dataclass(frozen=True)
class JoinParameters:
    shingle: int = 5
    threshold_percent: int = 80
    recall: float = 0.9995  # of a pair whose tokens agree a little less than the threshold
    slack: float = 0.05  # how much less
    tokens: int = 128
    background: float = 0.05  # similarity of unrelated documents
    leaf: int = 8  # unrelated documents that a leaf may hold on average
    sketch_distance: int = 17  # of 64 bits; at the threshold 6.4 differ on average, with a deviation of 2.4
    leaf_rows: int = 4096  # texts of a leaf that are compared in one piece
    block: int = 512
    delegates: int = 8
    seed: int = 7

    def depth(self, n: int) -> int:
        fewer = math.log(self.threshold_percent / 100 / self.background)
        return max(2, math.ceil(math.log(max(n, 1) / self.leaf) / fewer)) if n > self.leaf else 2

    def trees(self, depth: int) -> int:
        """By the branching process: two children with probability 1/threshold - 1, else one."""
        s, two = self.threshold_percent / 100 - self.slack, 100 / self.threshold_percent - 1
        meet = 1.0
        for _ in range(depth):
            miss = 1 - s * meet
            meet = 1 - ((1 - two) * miss + two * miss * miss)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - meet))


def _signatures(hashes: np.ndarray, begins: np.ndarray, p: JoinParameters) -> np.ndarray:
    """Minwise tokens of texts that have shingles: one row a text."""
    factors = np.random.default_rng(p.seed).integers(1, 2**63, p.tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(begins) - 1, p.tokens), dtype=np.uint64)
    for c in range(p.tokens):
        out[:, c] = np.minimum.reduceat(hashes * factors[c], begins[:-1])
    return mixed(out)


def _leaves(tokens: np.ndarray, depth: int, trees: int, p: JoinParameters) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all texts in all trees."""
    rows = np.repeat(np.arange(len(tokens)), trees)
    path = np.tile(mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), len(tokens))
    second = np.uint64(int((100 / p.threshold_percent - 1) * 2**32))
    for level in range(depth):
        draw = mixed(path + np.uint64(level + 1))
        one = (draw >> np.uint64(33)) % np.uint64(p.tokens)
        other = (one + np.uint64(1) + (mixed(draw) % np.uint64(p.tokens - 1))) % np.uint64(p.tokens)
        both = (mixed(draw ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) < second
        go = lambda r, w, c: mixed(w ^ mixed(tokens[r, c.astype(np.int64)] + c))
        rows, path = (
            np.concatenate([rows, rows[both]]),
            np.concatenate([go(rows, path, one), go(rows[both], path[both], other[both])]),
        )
    return rows, path


def document_leaves(docs: DataFrame, p: JoinParameters, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (digest of the set), sketch, leaves."""
    depth = p.depth(docs.count())
    trees = p.trees(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1)):
                hashes, begins = shingles(*words(data, offsets), p.shingle)
                rows = to - at
                n, d1, d2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                sketch, leaves = np.zeros(rows, np.uint64), [[]] * rows
                full = np.flatnonzero(np.diff(begins))
                if len(full):
                    for i in full:
                        own = np.unique(hashes[begins[i] : begins[i + 1]])
                        n[i], d1[i], d2[i] = len(own), own.sum(), mixed(own).sum()
                    tokens = _signatures(hashes, np.append(begins[full], begins[-1]), p)
                    bits = (tokens[:, :64] & np.uint64(1)) << np.arange(64, dtype=np.uint64)
                    sketch[full] = np.bitwise_or.reduce(bits, axis=1)
                    owner, leaf = _leaves(tokens, depth, trees, p)
                    order = np.argsort(owner, kind="stable")
                    parts = np.split(leaf[order].view(np.int64), np.flatnonzero(np.diff(owner[order])) + 1)
                    for i, x in zip(full, parts, strict=True):
                        leaves[i] = np.unique(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), pa.array(n), *(pa.array(x.view(np.int64)) for x in (d1, d2, sketch)), pa.array(leaves, type=pa.list_(pa.int64()))],
                    ["doc_id", "n", "d1", "d2", "sketch", "leaves"],
                )

    schema = "doc_id long, n long, d1 long, d2 long, sketch long, leaves array<long>"
    return docs.select(docs[id_column].cast("long"), docs[text_column]).mapInArrow(run, schema)


def _close(sketches: np.ndarray, ids: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a large leaf's closeness graph: each text meets only those not yet reached."""
    waiting = np.arange(len(ids))
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            near = np.bitwise_count(sketches[waiting] ^ sketches[i]) <= most
            for j in waiting[near]:
                yield ids[i], ids[j]
            queue.extend(waiting[near])
            waiting = waiting[~near]


def leaf_candidates(members: DataFrame, most: int, small: int = 32) -> DataFrame:
    """Candidate edges (a, b) from (leaf, id, sketch), for partitions that hold whole leaves in order."""

    def compare(leaf, ids, sketches):
        edges = np.flatnonzero(np.diff(leaf)) + 1
        starts = np.concatenate([[0], edges])
        sizes = np.diff(np.concatenate([starts, [len(leaf)]]))
        size_of = np.repeat(sizes, sizes)
        left, right = [], []
        for o in range(1, min(int(sizes.max()), small)):
            near = (leaf[:-o] == leaf[o:]) & (size_of[:-o] <= small) & (np.bitwise_count(sketches[:-o] ^ sketches[o:]) <= most)
            at = np.flatnonzero(near)
            left.append(ids[at])
            right.append(ids[at + o])
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            found = list(_close(sketches[s : s + n], ids[s : s + n], most))
            if found:
                a, b = np.array(found).T
                left.append(a)
                right.append(b)
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield compare(held[0][:cut], held[1][:cut], held[2][:cut].view(np.uint64))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield compare(held[0], held[1], held[2].view(np.uint64))

    return members.mapInArrow(run, "a long, b long")


def close_texts(members: DataFrame, p: JoinParameters) -> DataFrame:
    """Edges (a, b) that join all texts (leaf, id, sketch) of a leaf that are close, for leaves of any size."""

    def compared(rows: DataFrame) -> DataFrame:
        whole = rows.select("leaf", "id", "sketch").repartition("leaf").sortWithinPartitions("leaf")
        return leaf_candidates(whole, p.sketch_distance)

    sizes = written(members.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > p.leaf_rows))
    if not sizes.limit(1).count():
        return written(compared(members).distinct())
    parts = F.ceil(F.col("size") / p.leaf_rows).cast("int")
    large = members.join(sizes, "leaf").select("leaf", "id", "sketch", parts.alias("parts"))
    large = written(large.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    sample = large.where(F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")) == 0).withColumn("part", F.lit(-1))
    dealt = large.unionAll(sample).withColumn("leaf", F.xxhash64("leaf", "part"))
    small = members.join(sizes, "leaf", "left_anti").select("leaf", "id", "sketch")
    edges = written(compared(small.unionAll(dealt.select("leaf", "id", "sketch"))).distinct())
    # Components of all leaves so far: what another leaf has joined needs no comparison here.
    labels = connected_components(edges, "a", "b").withColumnRenamed("node", "id")
    now = written(large.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    counts = now.groupBy("leaf", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("leaf").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    outside = now.join(largest, "leaf").where("component != largest")
    chunks = outside.groupBy("leaf").agg(F.ceil(F.count("*") / p.leaf_rows).cast("int").alias("chunks"))
    outside = outside.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    outside = outside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    against = now.join(chunks, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meet = outside.select("leaf", "chunk", "part", "id", "sketch").unionAll(against.select("leaf", "chunk", "part", "id", "sketch"))
    meet = meet.distinct().withColumn("leaf", F.xxhash64("leaf", "chunk", "part"))
    return written(edges.unionAll(compared(meet)).distinct())


def exact_links(sets: list[np.ndarray], percent: int, columns: int = 8192) -> np.ndarray:
    """Matrix of booleans: 100 * intersection >= percent * union, on full sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        block = np.zeros((len(sets), columns), dtype=np.float32)
        block[row[a:b], column[a:b] - start] = 1
        common += block @ block.T
    inter = np.rint(common).astype(np.int64)
    return 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)


def group_links(texts: DataFrame, p: JoinParameters) -> DataFrame:
    """(a, b) with the smallest id a of each other id b's component, from (grp, id, text) in order of grp.

    Links are between members of a group only, and a group is small enough for
    one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(ids, sets):
            linked = exact_links(sets, p.threshold_percent) if len(set(ids)) > 1 else None
            waiting, a, b = np.arange(len(ids) if linked is not None else 0), [], []
            while len(waiting):
                queue, waiting, found = [waiting[0]], waiting[1:], [waiting[0]]
                while queue and len(waiting):
                    near = linked[queue.pop()][waiting]
                    found.extend(waiting[near])
                    queue.extend(waiting[near])
                    waiting = waiting[~near]
                names = {ids[i] for i in found}
                root = min(names)
                others = sorted(names - {root})
                a += [root] * len(others)
                b += others
            return a, b

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        group, ids, sets = None, [], []
        for batch in batches:
            a, b = [], []
            groups, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g, i, s in zip(groups, own, shingle_sets(batch.column(2), p.shingle), strict=True):
                if g != group:
                    x, y = stars(ids, sets)
                    a, b = a + x, b + y
                    group, ids, sets = g, [], []
                ids.append(i)
                sets.append(s)
            yield out(a, b)
        yield out(*stars(ids, sets))

    return texts.mapInArrow(run, "a long, b long")


def _confirmed(groups: DataFrame, texts: DataFrame, p: JoinParameters) -> DataFrame:
    """Links of all groups (grp, id), with the texts by id."""
    rows = groups.join(texts, "id").repartition("grp").sortWithinPartitions("grp").select("grp", "id", "text")
    return written(group_links(rows, p))


def near_duplicates(
    docs: DataFrame, p: JoinParameters = JoinParameters(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    table = written(document_leaves(docs, p, id_column, text_column))
    known = table.where("n > 0 and doc_id is not null")
    classes = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    reps = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    members = reps.select(F.explode("leaves").alias("leaf"), F.col("doc_id").alias("id"), "sketch")
    candidates = close_texts(members, p)
    clusters = written(connected_components(candidates, "a", "b").withColumnRenamed("component", "cluster"))
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    texts = texts.join(clusters.select(F.col("node").alias("id")), "id", "left_semi")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    placed = clusters.select(F.col("node").alias("id"), "cluster")
    if not sizes.where(f"size > {p.block}").limit(1).count():
        links = _confirmed(placed.select(F.col("cluster").alias("grp"), "id"), texts, p)
    else:
        links = _links_in_blocks(written(placed.join(sizes, "cluster")), written(texts), p)
    labels = links.select(F.col("b").alias("rep"), F.col("a").alias("component"))
    out = table.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    out = out.join(labels, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _links_in_blocks(placed: DataFrame, texts: DataFrame, p: JoinParameters) -> DataFrame:
    """What group_links returns, for clusters of any size, from (id, cluster, size)."""
    block = F.when(F.col("size") > p.block, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / p.block))).otherwise(0)
    placed = placed.withColumn("block", block)
    stars = _confirmed(placed.select(F.xxhash64("cluster", "block").alias("grp"), "id"), texts, p)
    large = written(placed.where(f"size > {p.block}"))

    def labelled(labels: DataFrame) -> DataFrame:
        return written(large.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))

    def joined(now: DataFrame, more: DataFrame) -> DataFrame:
        edges = now.select(F.col("component").alias("a"), F.col("id").alias("b")).unionAll(more)
        return labelled(connected_components(edges, "a", "b").withColumnRenamed("node", "id"))

    # Blocks hold each id once: their stars are components already. Delegates of each join most of a cluster.
    now = labelled(stars.select(F.col("b").alias("id"), F.col("a").alias("component")))
    parts = now.groupBy("cluster", "component").agg(F.count("*").alias("part"))
    chosen = now.join(parts, ["cluster", "component"])
    chosen = chosen.where(F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("part") / p.delegates)) == 0)
    spread = chosen.groupBy("cluster").agg(F.ceil(F.count("*") / p.block).alias("groups"))
    grp = F.xxhash64("cluster", F.pmod(F.xxhash64("component", F.lit(1)), F.col("groups")))
    now = joined(now, _confirmed(chosen.join(spread, "cluster").select(grp.alias("grp"), "id"), texts, p))
    # What is outside the largest component meets the whole cluster, a chunk at a time.
    parts = now.groupBy("cluster", "component").agg(F.count("*").alias("part"))
    largest = parts.groupBy("cluster").agg(F.max_by("component", F.struct("part", "component")).alias("largest"))
    outside = now.join(largest, "cluster").where("component != largest")
    chunks = outside.groupBy("cluster").agg(F.ceil(F.count("*") / p.block).cast("int").alias("chunks"))
    outside = outside.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    blocks = F.sequence(F.lit(0), (F.ceil(F.col("size") / p.block) - 1).cast("int"))
    probes = written(outside.select("cluster", "id", "chunk", F.explode(blocks).alias("block")))
    if probes.limit(1).count():
        against = now.join(chunks, "cluster").select(
            "cluster", "id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("block").cast("int")
        )
        pairs = probes.unionByName(against).select(F.xxhash64("cluster", "chunk", "block").alias("grp"), "id").distinct()
        now = joined(now, _confirmed(pairs, texts, p))
    small = stars.join(large.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")
    return written(small.unionAll(now.where("component != id").select(F.col("component").alias("a"), F.col("id").alias("b"))))
