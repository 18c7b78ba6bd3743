"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A chunk ends where the rolling hash of the last sixteen bytes has zeros in
given bits, so that after an insertion the cuts fall where they fell before.
From every cut, the shortest run of whole chunks that reaches ``least`` bytes
is hashed, and so is the shortest that reaches back so far from a text's end: no
chunk is too short to count, and a shared passage is covered from its first cut
to its last but the bytes of one run. A run found in more than one document is
repeated; repeated runs that overlap, adjoin or leave only a gap of less than
``least`` characters form a span, and spans of some length are reported. Of each
run the document with the smallest id keeps its copy.

Digests are aggregated before they are shuffled, and only runs whose digest
occurs in several documents meet their digest again; a passage that a third of
all documents hold is a few rows of that join's small side. A digest has 64 bits,
mixed from two hashes: of 3 billion different runs a quarter of a pair agrees.

Defined results: null and empty texts have no chunks; rows with a null id take
no part; rows that share an id count as one document; a text of any length is
chunked whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelake.llm.shingles import mixed, text_slices

_RANDOM = np.random.default_rng(97)
_GEAR = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64)
_GEAR[0] = 0
_VALUE = _RANDOM.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PAD = 16
SPAN_BITS = 20  # more than the length of a run takes


@dataclass(frozen=True)
class ChunkParameters:
    cut_bits: int = 4  # a chunk has 2 to this power bytes on average
    least: int = 16  # bytes that a run of chunks reaches
    most: int = 4096  # bytes
    least_span: int = 80  # characters


def chunks(data: np.ndarray, offsets: np.ndarray, p: ChunkParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end) of all chunks of texts laid end to end."""
    n, texts = len(data), len(offsets) - 1
    # Between texts stand bytes that add nothing, so that a text's cuts depend on it alone.
    place = np.arange(n) + _PAD * np.repeat(np.arange(1, texts + 1), np.diff(offsets))
    gear = np.zeros(n + _PAD * (texts + 1), dtype=np.uint64)
    gear[place] = _GEAR[data]
    for width in (1, 2, 4, 8):
        later = gear[:-width] << np.uint64(width)
        gear[width:] += later
    mask = np.uint64(((1 << p.cut_bits) - 1) << 11)
    cut = (gear[place] & mask) == 0
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = (data & 0xC0) == 0x80  # a cut never parts a character
    at = np.flatnonzero(cut & ~inside[1:]) + 1
    edges = np.unique(np.concatenate([at, offsets]))
    wide = np.flatnonzero(np.diff(edges) > p.most)
    if len(wide):
        more = [np.arange(edges[i] + p.most, edges[i + 1], p.most) for i in wide]
        more = np.concatenate(more)
        for _ in range(3):
            more = np.where(inside[more], more - 1, more)
        edges = np.unique(np.concatenate([edges, more]))
    return np.searchsorted(offsets, edges[:-1], side="right") - 1, edges[:-1], edges[1:]


def runs(text: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end) of the shortest runs of chunks of ``least`` bytes, from each cut and back from each text's end."""
    n = len(text)
    if not n:
        return text, start, end
    last = np.searchsorted(end, start + least)
    ahead = np.flatnonzero(last < n)
    ahead = ahead[text[last[ahead]] == text[ahead]]
    final = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    first = np.searchsorted(start, end[final] - least, side="right") - 1
    own = (first >= 0) & (text[first] == text[final])
    first, final = first[own], final[own]
    more = last[first] != final
    a, b = np.concatenate([ahead, first[more]]), np.concatenate([last[ahead], final[more]])
    return text[a], start[a], end[b]


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each run."""
    out, n = [], len(data)
    for values, odd in zip(_VALUE, _ODD, strict=True):
        powers, back = np.full(n, odd, dtype=np.uint64), np.full(n, pow(odd, -1, 1 << 64), dtype=np.uint64)
        powers[:1] = back[:1] = 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data] * np.cumprod(powers), out=sums[1:])
        out.append(mixed((sums[ends] - sums[starts]) * np.cumprod(back)[starts] + (ends - starts).astype(np.uint64)))
    return out


def document_chunks(docs: DataFrame, p: ChunkParameters, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest and at (first character, then length in SPAN_BITS bits) of the runs of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, data, offsets in text_slices(batch.column(1)):
                text, start, end = runs(*chunks(data, offsets, p), p.least)
                d1, d2 = digests(data, start, end)
                digest = mixed(d1 + d2 * np.uint64(_ODD[0]))
                chars = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                base = chars[offsets[text]]
                first, size = chars[start] - base, chars[end] - chars[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at + text]), pa.array(digest.view(np.int64)), pa.array((first << SPAN_BITS) + size)],
                    ["doc_id", "digest", "at"],
                )

    docs = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), text_column)
    return docs.mapInArrow(run, "doc_id long, digest long, at long")


def repeated_spans(docs: DataFrame, p: ChunkParameters = ChunkParameters(), **columns: str) -> DataFrame:
    """doc_id, start, end, n_chunks and removable (characters that a document with a smaller id holds as well)."""
    every = document_chunks(docs, p, **columns)
    known = every.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
    known = known.where("keeper < last").drop("last")
    again = every.join(known, "digest").select("doc_id", "at", "keeper").repartition("doc_id").distinct()
    start = F.shiftright("at", SPAN_BITS).cast("int")
    size = F.col("at").bitwiseAND(F.lit((1 << SPAN_BITS) - 1)).cast("int")
    again = again.select("doc_id", start.alias("start"), (start + size).alias("end"), "keeper")
    # Runs that begin later do not end earlier.
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(order)
    again = again.withColumn("new", F.when(gap < p.least, 0).otherwise(1))
    again = again.withColumn("span", F.sum("new").over(order))
    # Runs overlap: each adds what those before it have not covered.
    lost_end = F.when(F.col("keeper") < F.col("doc_id"), F.col("end"))
    covered = F.max(lost_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = again.withColumn("lost", F.coalesce(lost_end - F.greatest("start", covered), F.lit(0)))
    spans = again.groupBy("doc_id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.sum("lost").alias("removable")
    )
    return spans.where(F.col("end") - F.col("start") >= p.least_span).drop("span")
