"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays
within a piece). Documents are tokenised and packed in the task that reads
them, in groups of bounded size, so nothing is shuffled and a group's memory
is fixed by a parameter. Within a group, pieces go in descending order to the
lowest-cost sequence that can hold them; a piece that no sequence can hold is
cut at the lowest-cost sequence with room.

A group's sequences have exactly its tokens as capacity: full ones, then one
for each binary digit of what is left, since a sequence at a power of two
needs no padding.

Defined results: a null text counts as empty and still has its end token; any
id, null included, is carried as it is; repeated rows are packed one by one;
other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, cost double"
)


class TokenCounter:
    """Ids of a byte-level BPE vocabulary file, with an end token after each text.

    ``ranks`` names the same vocabulary as plain ranks; where it is given, the
    ids come from there, several times faster. Texts that hold a special
    token's string always take the vocabulary file's own way.
    """

    def __init__(self, vocabulary: str, ranks: str | None, end_id: int):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.end_id, self.fast = end_id, None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast is None or any(s in text for s in self.special):
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        out = np.empty(len(found) + 1, dtype="<u4")
        out[:-1] = found
        out[-1] = self.end_id
        return out


def capacities(tokens: int, capacity: int) -> list[int]:
    """Full sequences, then powers of two, that together hold exactly so many tokens."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: np.ndarray, room: np.ndarray, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Places documents of these lengths into sequences with this room: (document, start, length, sequence)."""
    room, cost = room.astype(np.int64).copy(), np.zeros(len(room))
    placed = []
    for doc in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[doc])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            k = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(room[k]))
            placed.append((int(doc), start, n, k))
            room[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return placed


def _pack_group(group: list[tuple[object, np.ndarray]], first_id: int, capacity: int, linear: float, quadratic: float):
    """Rows of a group's pieces, and how many sequences it takes."""
    rows, used = [], 0

    def row(doc, ids, start, n, sequence, offset, size, cost):
        crc = zlib.crc32(ids[start : start + n].tobytes())
        rows.append((doc, start, n, crc, len(ids), first_id + sequence, offset, size, cost))

    cost_of = lambda n: linear * n + quadratic * n * n
    for doc, ids in group:  # whole sequences of a long document stand alone
        for start in range(0, len(ids) - capacity + 1, capacity):
            row(doc, ids, start, capacity, used, 0, capacity, cost_of(capacity))
            used += 1
    rest = np.array([len(ids) % capacity for _, ids in group], dtype=np.int64)
    sizes = capacities(int(rest.sum()), capacity)
    fill, total, pieces = [0] * len(sizes), [0.0] * len(sizes), assign(rest, np.array(sizes), linear, quadratic)
    for _, _, n, k in pieces:
        total[k] += cost_of(n)
    for i, start, n, k in pieces:
        doc, ids = group[i]
        row(doc, ids, len(ids) - int(rest[i]) + start, n, used + k, fill[k], sizes[k], total[k])
        fill[k] += n
    return rows, used + len(sizes)


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    group_sequences: int = 1024,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, cost.

    ``group_sequences`` bounds a group's memory: a task holds about so many
    sequences of tokens, and one document. ``cost`` is the whole sequence's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary, ranks, end_id)
        base = TaskContext.get().partitionId() << 40
        group, held, used = [], 0, 0

        def flush():
            nonlocal group, held, used
            rows, n = _pack_group(group, base + used, capacity, linear, quadratic)
            group, held, used = [], 0, used + n
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.float64() if "double" in x else pa.int64() for x in SCHEMA.split(", ")]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = counter.ids(text.as_py())
                group.append((doc, ids))
                held += len(ids)
                if held >= group_sequences * capacity:
                    yield flush()
        if group:
            yield flush()

    return docs.select(docs[id_column].cast("long"), docs[text_column]).mapInArrow(run, SCHEMA)
