"""Histories in chunks of any size against a replay with two stacks."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapelake.operators import histories as h

SCHEMA = "session_id long, event_seq long, action string, kind string, measure double"


def stacks(actions, done=(), undone=()):
    done, undone = list(done), list(undone)
    for i, a in enumerate(actions):
        if a == "commit":
            done.append(i)
            undone.clear()
        elif a == "undo" and done:
            undone.append(done.pop())
        elif a == "redo" and undone:
            done.append(undone.pop())
    return len(done), len(done) + len(undone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["commit", "undo", "undo", "redo", "other"]), max_size=60), st.integers(0, 40), st.integers(0, 40))
def test_summary_of_a_chunk_holds_for_any_start(actions, cursor, behind):
    start = (cursor, cursor + behind)
    assert h.evaluate(h.summarise(actions), *start) == stacks(actions, range(cursor), range(behind))
    assert tuple(map(int, h.advance(h._runs(actions), *start))) == stacks(actions, range(cursor), range(behind))


def by_hand(rows):
    """Rows of ``replay_history`` from (session, seq, action, kind, measure)."""
    logs, out = defaultdict(list), []
    for r in rows:
        logs[r[0]].append(r[1:])
    for s, log in logs.items():
        done, undone = [], []
        for seq, action, kind, measure in sorted(log, key=lambda x: x[0]):
            if action == "commit":
                before = next((d[3] for d in reversed(done) if d[2] == kind), None)
                done.append((s, seq, kind, measure, before))
                undone.clear()
            elif action == "undo" and done:
                undone.append(done.pop())
            elif action == "redo" and undone:
                done.append(undone.pop())
        out += done
    return sorted(out, key=str)


def log_of(sizes, seed, weights):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for i in range(n):
            rows.append((s, i, rng.choices(["commit", "undo", "redo", "none"], weights)[0], rng.choice(["line", "shape", None]), float(rng.randrange(99))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk,weights", [(7, (5, 4, 3, 1)), (16, (2, 5, 4, 0)), (4096, (6, 3, 2, 1))])
def test_one_session_holds_most_events(spark, chunk, weights):
    rows = log_of({1: 3000, 2: 40, 3: 1, None: 200, 9: 60}, chunk, weights)
    # As many ranges as there are partitions: the long session spreads over several of them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = h.replay_history(spark.createDataFrame(rows, SCHEMA), chunk)
        assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_starts_come_from_summaries(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(h, "written", lambda df, w=h.written: seen.append(w(df)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = log_of({1: 900}, 3, (3, 5, 4, 1))
        got = h.replay_history(spark.createDataFrame(rows, SCHEMA), 50)
        assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)
        assert seen[0].where("cursor is null").count() > 5 and seen[1].count() >= seen[0].where("cursor is null").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_latest_and_empty(spark):
    rows = [(1, 1, "commit", "line", 4.0), (1, 2, "commit", "line", 6.0), (2, 1, "commit", "line", 1.0), (2, 2, "undo", None, None), (None, 1, "commit", "shape", 2.0)]
    log = spark.createDataFrame(rows, SCHEMA)
    got = {r.session_id: (r.kind, r.measure, r.relative) for r in h.latest_result(log, 2).collect()}
    assert got == {1: ("line", 6.0, 1.5), 2: (None, 0.0, None), None: ("shape", 2.0, None)}
    assert h.replay_history(log.limit(0)).count() == 0 and h.latest_result(log.limit(0)).count() == 0


def test_a_batch_of_many_chunks_is_replayed_piece_by_piece():
    import pyarrow as pa

    chunks, events = 3000, 20
    held = {"session_id": range(chunks), "part": [0] * chunks, "k": [0] * chunks, "cursor": [0] * chunks, "length": [0] * chunks}
    each = {"event_seq": list(range(events)), "action": ["commit"] * events, "kind": ["a"] * events, "measure": [0.5] * events}
    batch = pa.RecordBatch.from_pydict({**{c: list(v) for c, v in held.items()}, **{c: [v] * chunks for c, v in each.items()}})
    sizes = [b.num_rows for b in h._replay(iter([batch]))]
    assert sum(sizes) == chunks * (events + 1) and max(sizes) <= h.AT_ONCE + events + 1
