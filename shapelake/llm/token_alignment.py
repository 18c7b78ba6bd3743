"""Alignment of two tokenizers' tokens by the bytes that they cover.

Both tokenizers cut the same bytes, a space and the text. The tokens of both
are intervals of byte offsets: sorted together by start, with the running
maximum of their ends, a group breaks where a start reaches that maximum. So a
group ends where tokens of both end. Within groups the overlaps of tokens are
expanded, and those that end together are links. How often each pair of ids is
linked is counted over all documents, and each document gets its links'
counts, and how many of them are the most frequent of their second id.

Texts are tokenised once, in Arrow batches, and written with each document's
distinct pairs. Pairs are counted with partial sums before the shuffle. Pairs
that hold a share of all links of at least ``1 / hot_pairs``, of which there
are at most ``hot_pairs``, are broadcast back; all others hold less each and
are joined, so that no frequent pair gathers in one task.

Defined results: null and empty texts, and texts whose bytes one of the
tokenizers does not keep, have no tokens and zeros; any id, null included, is
carried as it is; repeated rows count as often as they occur; ties for the
most frequent pair all count; other columns are ignored; an empty table gives
an empty result. A text is held whole in one task, with its tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.plans.rounds import written


@dataclass(frozen=True)
class ByteLevelRanks:
    """A byte-level BPE vocabulary as plain ranks; special tokens' strings are ordinary text."""

    path: str
    pattern: str

    def load(self):
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        parts = [b""] * (max(ranks.values()) + 1)
        for part, i in ranks.items():
            parts[i] = part
        return lambda text: encoding.encode_ordinary(" " + text), parts


@dataclass(frozen=True)
class PieceModel:
    """A sentencepiece model with byte fallback, which adds the space before a text itself."""

    path: str

    def load(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
        return model.encode, [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]


def groups_of(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray):
    """The group of each token of A and of B, and the overlapping pairs as places in A and in B.

    Both sides cover the same range without gaps.
    """
    side = np.repeat(np.array([0, 1], dtype=np.int8), [len(starts_a), len(starts_b)])
    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    order = np.lexsort((side, starts))
    side, starts, reach = side[order], starts[order], np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = starts[1:] >= reach[:-1]
    group = np.cumsum(breaks) - 1
    # Where a start is the last of equals, the latest token of either side overlaps the other.
    last = np.ones(len(order), dtype=bool)
    last[:-1] = starts[1:] != starts[:-1]
    is_b = side == 1
    seen_b = np.cumsum(is_b)
    seen_a = np.arange(1, len(order) + 1) - seen_b
    return group[~is_b], group[is_b], seen_a[last] - 1, seen_b[last] - 1


class Aligner:
    """Aligns texts in chunks; the tokens of a chunk lie end to end, so that a text's end is a group's end."""

    def __init__(self, a, b):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = a.load(), b.load()
        self.length_a, self.length_b = (np.array([len(x) for x in parts], dtype=np.int64) for parts in (self.bytes_a, self.bytes_b))
        named = lambda parts, end: np.array([f"{i}{end}" for i in range(len(parts))], dtype=object)
        self.name_a = np.concatenate([named(self.bytes_a, ","), named(self.bytes_a, "|")])
        self.name_b = np.concatenate([named(self.bytes_b, ","), named(self.bytes_b, ";")])

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        whole, a, b = b" " + text.encode(), self.encode_a(text), self.encode_b(text)
        same = all(b"".join(map(parts.__getitem__, ids)) == whole for parts, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if same else ([], [])

    def align(self, texts: list[str | None], digest: bool) -> pa.StructArray:
        """n_a, n_b, n_groups, n_overlaps, n_links, groups and links of each text."""
        found = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in found], dtype=np.int64) for k in (0, 1))
        a, b = (np.fromiter((i for x in found for i in x[k]), dtype=np.int64, count=int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        group_a, group_b, over_a, over_b = groups_of(ends_a - self.length_a[a], ends_a, ends_b - self.length_b[b], ends_b)
        of_a = np.repeat(np.arange(len(texts)), n_a)
        together = ends_a[over_a] == ends_b[over_b]
        link_a, link_b = over_a[together], over_b[together]
        count = lambda docs: np.bincount(docs, minlength=len(texts))
        n_groups = count(of_a[np.flatnonzero(np.diff(group_a, prepend=-1))])
        n_overlaps, n_links = count(of_a[over_a]), count(of_a[link_a])
        texts_out = self._render(a, b, group_a, group_b, n_a + n_b, digest)
        pairs, bounds = a[link_a] * len(self.bytes_b) + b[link_b], np.concatenate([[0], np.cumsum(n_links)])
        distinct = [np.unique(pairs[s:e], return_counts=True) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.concatenate([[0], np.cumsum([len(p) for p, _ in distinct])])
        flat = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([x[k] for x in distinct]).astype(np.int64), pa.int64()) for k in (0, 1)], ["pair", "n"]
        )
        columns = {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_overlaps": n_overlaps, "n_links": n_links,
            "groups": pa.array(texts_out, pa.string()), "links": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat),
        }
        return [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns.values()]

    def _render(self, a, b, group_a, group_b, n, digest: bool) -> list[str]:
        """Each text's groups as a1,a2|b1;a3|b2 or as the digest of that."""
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        before_b, through_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        ends = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, dtype=bool)
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + before_b[group_a]] = self.name_a[a + len(self.bytes_a) * ends(group_a)]
        out[np.arange(len(b)) + through_a[group_b]] = self.name_b[b + len(self.bytes_b) * ends(group_b)]
        names, bounds = out.tolist(), np.concatenate([[0], np.cumsum(n)]).tolist()
        whole = ["".join(names[s:e])[:-1] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        return [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in whole] if digest else whole


SCHEMA = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups string, "
    "links array<struct<pair:long,n:long>>"
)


def aligned(docs: DataFrame, a, b, digest: bool = False, chunk_bytes: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document, with its groups as text (or the digest of that) and its distinct links.

    A link's ``pair`` is the id of A times the size of B's vocabulary, plus the
    id of B, and ``n`` is how often the document holds it. ``row`` tells rows
    apart. About ``chunk_bytes`` of texts are aligned at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(a, b), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush(ids: list, texts: list) -> pa.RecordBatch:
            rows = pa.array(range(row, row + len(ids)), pa.int64())
            return pa.RecordBatch.from_arrays([rows, pa.array(ids, pa.int64()), *aligner.align(texts, digest)], names)

        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held >= chunk_bytes or len(ids) >= 4096:
                    yield flush(ids, texts)
                    row += len(ids)
                    ids, texts, held = [], [], 0
        if ids:
            yield flush(ids, texts)

    return docs.select(docs[id_column].cast("long"), docs[text_column].cast("string")).mapInArrow(run, SCHEMA)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """pair, total and best: how often each pair of ids is linked, and whether no pair of its id of B is linked more often."""
    counts = written(found.select(F.inline("links")).groupBy("pair").agg(F.sum("n").alias("total")))
    of_b = F.pmod("pair", F.lit(size_b)).alias("b")
    top = counts.groupBy(of_b).agg(F.max("total").alias("top"))  # a row for each id of B at most
    joined = counts.withColumn("b", of_b).join(F.broadcast(top), "b")
    return joined.select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, a, b, digest: bool = False, hot_pairs: int = 65_536) -> DataFrame:
    """``aligned`` without links, and n_best and count_sum of each document."""
    found = written(aligned(docs, a, b, digest))
    counts = written(pair_counts(found, len(b.load()[1])))
    every = counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    is_hot = F.col("total") * F.lit(hot_pairs) >= F.lit(every)
    hot, rest = F.broadcast(counts.where(is_hot)), counts.where(~is_hot)
    links = found.select("row", F.inline("links"))
    cold = links.join(hot.select("pair"), "pair", "left_anti").join(rest, "pair")
    sums = lambda df: df.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum")
    )
    columns = ["row", "n_best", "count_sum"]
    own = sums(links.join(hot, "pair")).select(*columns).unionAll(sums(cold).select(*columns))
    own = own.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("links").join(own, "row", "left")
    return out.drop("row").fillna(0, ["n_best", "count_sum"])
