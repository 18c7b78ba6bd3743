"""Histories of a session: what a log of commits, undos and redos leaves, found in chunks of bounded size.

A history is a list of entries and a cursor. A commit writes an entry at the
cursor, cuts off what lies behind it and moves on; an undo moves the cursor
back, a redo forth, within the list. What is left is, for each place under the
last cursor, the last commit that wrote there.

Logs are dealt by ranges of (session, event), so that a session of any length
spreads over tasks, and cut into chunks. Most chunks follow from the session's
start in the same task. A task's first session may have begun before it: its
chunks are summed up instead, each as a function of the cursor and length that
it starts from. Up to its first commit a chunk is a walk between 0 and the
length: it moves the cursor by a fixed shift, cut to a lowest and a highest
place, which depend on the length alone. After the commit the cursor is the
length, and all that matters is whether undos reach the bottom. These
functions are tables as long as the walk is deep, and straight lines beyond.
Evaluated one after the other, one row a chunk, they give every chunk's start;
then all chunks are replayed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelake.functions import geometry as g
from shapelake.plans.rounds import written

LOG = ["event_seq", "action", "kind", "measure"]
CODES = {"commit": 1, "undo": 2, "redo": 3}
EVENTS = "event_seq array<long>, action array<string>, kind array<string>, measure array<double>"
STATES = "cursor long, length long, end_cursor long, end_length long"
#: Events that a Python worker holds at once as objects, besides the chunk it is at and the batch it was sent.
AT_ONCE = 1 << 14
SUMMARY = "shift long, low array<long>, high array<long>, cursors array<long>, lengths array<long>, commits boolean"


def _runs(actions: list[str]) -> list[tuple[int, int]]:
    """(code, count) of equal neighbouring actions; unknown ones are left out."""
    codes = np.array([CODES.get(a, 0) for a in actions])
    codes = codes[codes > 0]
    cuts = np.flatnonzero(np.diff(codes, prepend=-1))
    return list(zip(codes[cuts].tolist(), np.diff(cuts, append=len(codes)).tolist(), strict=True))


def advance(runs: list[tuple[int, int]], cursor, length):
    """Cursor and length after the runs, of one history or of arrays of them."""
    for code, n in runs:
        if code == 1:
            cursor = cursor + n
            length = cursor
        elif code == 2:
            cursor = np.maximum(cursor - n, 0)
        else:
            cursor = np.minimum(cursor + n, length)
    return cursor, length


def summarise(actions: list[str]) -> tuple:
    """What a chunk does to any cursor and length: the columns of SUMMARY."""
    runs = _runs(actions)
    first = next((k for k, r in enumerate(runs) if r[0] == 1), len(runs))
    walk, rest = runs[:first], runs[first:]
    # How far the walk gets from the bottom, or from the top, when the other end is out of reach.
    up = down = most = 0
    for code, n in walk:
        up, down = (max(up - n, 0), down + n) if code == 2 else (up + n, max(down - n, 0))
        most = max(most, up, down)
    shift = sum(n if code == 3 else -n for code, n in walk)
    lengths = np.arange(most + 1)
    low, high = advance(walk, np.zeros(most + 1, dtype=np.int64), lengths)[0], advance(walk, lengths, lengths)[0]
    at = length = deepest = 0
    for code, n in rest:
        at = at + n if code == 1 else at - n if code == 2 else min(at + n, length)
        length = at if code == 1 else length
        deepest = max(deepest, -at)
    starts = np.arange(deepest + 1)
    cursors, ends = advance(rest, starts, starts)
    return shift, low.tolist(), high.tolist(), cursors.tolist(), ends.tolist(), bool(rest)


def evaluate(summary: tuple, cursor: int, length: int) -> tuple[int, int]:
    """Cursor and length after a chunk that starts from these."""
    shift, low, high, cursors, lengths, commits = summary
    k = min(length, len(low) - 1)
    cursor = min(max(cursor + shift, low[k]), high[k] + length - k)
    if not commits:
        return cursor, length
    k = min(cursor, len(cursors) - 1)
    return cursors[k] + cursor - k, lengths[k] + cursor - k


def _chunks(size: int):
    """Rows of a log in order to chunks, each with its start or its summary."""
    names = ["session_id", "part", "k", *LOG, *[x.split()[0] for x in f"{STATES}, {SUMMARY}".split(", ")]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema(list(zip(names, [
            pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()),
            *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 4, pa.bool_(),
        ], strict=True)))
        rows, waiting, held, first, current, k, state = [], 0, [], True, object(), 0, (0, 0)

        def close():
            nonlocal waiting, held, k, state
            if held:
                waiting += len(held)
                events = [list(c) for c in zip(*held, strict=True)]
                if state is None:
                    rows.append((current, part, k, *events, None, None, None, None, *summarise(events[1])))
                else:
                    start, state = state, tuple(int(x) for x in advance(_runs(events[1]), *state))
                    rows.append((current, part, k, *events, *start, *state, None, None, None, None, None, None))
                held, k = [], k + 1

        def flush() -> pa.RecordBatch:
            nonlocal rows, waiting
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            rows, waiting = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for session, *event in zip(*batch.to_pydict().values(), strict=True):
                if session != current or len(held) == size:
                    close()
                if session != current:
                    # Of its first session alone a task can't know whether it began elsewhere.
                    state = None if first and part else (0, 0)
                    first, current, k = False, session, 0
                held.append(event)
                if waiting >= AT_ONCE:
                    yield flush()
        close()
        yield flush()

    return cut


def _resolve(chunks: pd.DataFrame) -> pd.DataFrame:
    """Starts of one session's chunks, of which the first one's is known: a row a chunk, without its events."""
    chunks, out, state = chunks.sort_values(["part", "k"]), [], (0, 0)
    for row in chunks.itertuples():
        if pd.isna(row.cursor):
            out.append(state)
            found = evaluate((int(row.shift), row.low, row.high, row.cursors, row.lengths, row.commits), *state)
            state = tuple(int(x) for x in found)
        else:
            out.append((int(row.cursor), int(row.length)))
            state = int(row.end_cursor), int(row.end_length)
    cursors, lengths = zip(*out, strict=True)
    return chunks[["session_id", "part", "k"]].assign(cursor=cursors, length=lengths)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the last commit of every place, and a row without a place for the cursor after it."""
    names = ["session_id", "part", "k", "place", *LOG[:1], *LOG[2:], "cursor"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names)

    rows = []
    for batch in batches:
        for n in range(batch.num_rows):  # a batch holds up to 10,000 chunks: one at a time becomes objects
            row = batch.slice(n, 1).to_pylist()[0]
            cursor, length, last = row["cursor"], row["length"], {}
            for i, action in enumerate(row["action"]):
                if action == "commit":
                    last[cursor] = i
                    cursor = length = cursor + 1
                elif action == "undo":
                    cursor = max(cursor - 1, 0)
                elif action == "redo":
                    cursor = min(cursor + 1, length)
            at = (row["session_id"], row["part"], row["k"])
            rows += [(*at, place, row["event_seq"][i], row["kind"][i], row["measure"][i], None) for place, i in last.items()]
            rows.append((*at, None, None, None, None, cursor))
            if len(rows) >= AT_ONCE:
                yield flush(rows)
                rows = []
    yield flush(rows)


def _same(a: str, b: str, *columns: str):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def surviving(op_log: DataFrame, chunk: int = 4096) -> DataFrame:
    """session_id, place (from 0), op_seq, kind, measure of what the log leaves."""
    order = ["session_id", *LOG]
    log = op_log.select(F.col("session_id").cast("long").alias("session_id"), F.col("event_seq").cast("long").alias("event_seq"), "action", "kind", F.col("measure").cast("double").alias("measure"))
    log = log.repartitionByRange(*order).sortWithinPartitions(*order)
    keys = "session_id long, part int, k long"
    chunks = written(log.mapInArrow(_chunks(chunk), f"{keys}, {EVENTS}, {STATES}, {SUMMARY}"))
    # At most one session of each task is open.
    opened = F.broadcast(chunks.where("cursor is null").select("session_id").distinct())
    of_open = chunks.alias("c").join(opened.alias("o"), _same("c", "o", "session_id"), "left_semi")
    starts = of_open.drop(*LOG).groupBy("session_id").applyInPandas(_resolve, f"{keys}, cursor long, length long")
    starts = written(starts)
    found = chunks.alias("c").join(starts.alias("s"), _same("c", "s", "session_id", "part", "k"), "left")
    start = lambda c: F.coalesce(f"s.{c}", f"c.{c}").alias(c)
    found = found.select("c.session_id", "c.part", "c.k", *[f"c.{c}" for c in LOG], start("cursor"), start("length"))
    replayed = written(found.mapInArrow(_replay, f"{keys}, place long, event_seq long, kind string, measure double, cursor long"))
    at = F.struct("part", "k")
    top = replayed.where("place is null").groupBy("session_id").agg(F.max_by("cursor", at).alias("top"))
    entry = F.max_by(F.struct(F.col("event_seq").alias("op_seq"), "kind", "measure"), at).alias("e")
    entries = replayed.where("place is not null").groupBy("session_id", "place").agg(entry)
    left = entries.alias("e_").join(top.alias("t"), _same("e_", "t", "session_id")).where(F.col("place") < F.col("top"))
    return left.select("e_.session_id", "place", "e.op_seq", "e.kind", "e.measure")


def with_previous(left: DataFrame, bucket: int = 4096) -> DataFrame:
    """Adds previous: the measure of the entry of the same kind that lies next below.

    Neighbours are looked up within buckets of places; the first of a kind in
    its bucket takes the last one of the bucket before that has any.
    """
    df = left.withColumn("bucket", F.floor(F.col("place") / bucket))
    inside = Window.partitionBy("session_id", "kind", "bucket").orderBy("place")
    df = df.withColumns({"first": F.row_number().over(inside) == 1, "near": F.lag("measure").over(inside)})
    ends = left.groupBy("session_id", "kind", F.floor(F.col("place") / bucket).alias("bucket")).agg(F.max_by("measure", "place").alias("last"))
    carry = ends.withColumn("carry", F.lag("last").over(Window.partitionBy("session_id", "kind").orderBy("bucket"))).where("bucket > 0")
    joined = df.alias("d").join(carry.alias("c"), _same("d", "c", "session_id", "kind", "bucket"), "left")
    previous = F.when(F.col("d.first"), F.col("c.carry")).otherwise(F.col("d.near"))
    return joined.select("d.session_id", "d.op_seq", "d.kind", "d.measure", previous.alias("previous"), "d.place")


def replay_history(op_log: DataFrame, chunk: int = 4096) -> DataFrame:
    """session_id, op_seq, kind, measure, previous: what each session's history holds, with the entry of its kind below.

    Rows without a session are one session; events of one number go by their
    action, kind and measure; unknown actions do nothing; an empty log gives an
    empty result. What lies below an entry that is left is what lay there when
    it was committed, so that the previous one is the one left below it.
    """
    return with_previous(written(surviving(op_log, chunk)), chunk).drop("place")


def latest_result(op_log: DataFrame, chunk: int = 4096) -> DataFrame:
    """The top operation of each session, with zero and null where its history is empty."""
    top = with_previous(written(surviving(op_log, chunk)), chunk).groupBy("session_id").agg(F.max_by(F.struct("kind", "measure", "previous"), "place").alias("t"))
    every = op_log.select(F.col("session_id").cast("long").alias("session_id")).distinct().alias("e")
    found = every.join(top.alias("t_"), _same("e", "t_", "session_id"), "left")
    return found.select(
        "e.session_id", F.col("t.kind").alias("kind"), F.coalesce("t.measure", F.lit(0.0)).alias("measure"),
        g.relative("t.measure", "t.previous").alias("relative"),
    )
