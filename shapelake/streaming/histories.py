"""Operation logs and clicks as streams, with state kept for each session."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REPLAY = "session_id long, op_seq long, kind string, measure double, previous double"
CHANGES = "session_id long, event_seq long, change string, place long, op_seq long, kind string, measure double, previous double"


class History(StatefulProcessor):
    """A session's list of entries, its cursor, and of each kind the topmost entry under the cursor.

    An entry knows its place and that of the entry of its kind below, so that
    every event reads and writes a few values, whatever the history's length.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "cursor long, length long")
        self.entries = handle.getMapState("entries", "place long", "op_seq long, kind string, measure double, below long")
        self.tops = handle.getMapState("tops", "kind string", "place long")

    @staticmethod
    def _key(kind: str | None) -> tuple[str]:
        return ("" if kind is None else f"={kind}",)

    def _put_top(self, kind: str | None, place: int | None) -> None:
        if place is None:
            self.tops.removeKey(self._key(kind))
        else:
            self.tops.updateValue(self._key(kind), (place,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cursor, length = self.at.get() if self.at.exists() else (0, 0)
        for event in sorted(rows, key=lambda r: r.event_seq):
            if event.action == "commit":
                below = self.tops.getValue(self._key(event.kind)) if self.tops.containsKey(self._key(event.kind)) else None
                place, entry = cursor, (event.event_seq, event.kind, event.measure, below[0] if below else None)
                self.entries.updateValue((place,), entry)
                self._put_top(event.kind, place)
                cursor = length = cursor + 1
            elif event.action == "undo" and cursor:
                cursor = place = cursor - 1
                entry = self.entries.getValue((place,))
                self._put_top(entry[1], entry[3])
            elif event.action == "redo" and cursor < length:
                place, cursor = cursor, cursor + 1
                entry = self.entries.getValue((place,))
                self._put_top(entry[1], place)
            else:
                continue
            previous = None if entry[3] is None else self.entries.getValue((entry[3],))[2]
            yield Row(session_id=key[0], event_seq=event.event_seq, change=event.action, place=place, op_seq=entry[0], kind=entry[1], measure=entry[2], previous=previous)
        self.at.update((cursor, length))

    def close(self) -> None:
        pass


def stream_changes(op_log: DataFrame) -> DataFrame:
    """One row for each event that changes a history: which entry it puts at which place (commit, redo) or takes away (undo).

    Events of a session are taken in the order of event_seq within a batch; a
    later batch holds later events. Kept up to date by place, with what lies at
    or above a commit's place cut off and an undo's place taken away, the rows
    are what ``replay_history`` gives. Needs the RocksDB state store.
    """
    log = op_log.select("session_id", "event_seq", "action", "kind", "measure")
    return log.groupBy("session_id").transformWithState(History(), CHANGES, "Append", "None")


def stream_histories(op_log: DataFrame) -> DataFrame:
    """For each session and batch, the whole history after it, as ``replay_history`` gives it, with the batch's last event.

    For short histories, as each batch reads and emits all of it; see ``stream_changes`` for long ones.

    Events of a session are taken in the order of event_seq within a batch; a
    later batch holds later events.
    """

    def replay(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, undone = state.get if state.exists else ("[]", "[]")
        done, undone = json.loads(done), json.loads(undone)
        log = pd.concat(list(batches)).sort_values("event_seq")
        for seq, action, kind, measure in log[["event_seq", "action", "kind", "measure"]].itertuples(index=False, name=None):
            if action == "commit":
                before = next((m for _, k, m, _ in reversed(done) if k == kind), None)
                done.append([int(seq), kind, float(measure), before])
                undone = []
            elif action == "undo" and done:
                undone.append(done.pop())
            elif action == "redo" and undone:
                done.append(undone.pop())
        state.update((json.dumps(done), json.dumps(undone)))
        out = pd.DataFrame(done, columns=["op_seq", "kind", "measure", "previous"])
        out.insert(0, "session_id", int(key[0]))
        yield out.assign(last_event=int(log["event_seq"].max()))

    return op_log.groupBy("session_id").applyInPandasWithState(
        replay, f"{REPLAY}, last_event long", "done string, undone string", "append", "NoTimeout"
    )


def stream_triples(clicks: DataFrame) -> DataFrame:
    """``assemble_arcs`` as a stream: a third click that makes a flat arc is ignored and retried."""

    def flat(ax, ay, bx, by, x, y) -> bool:
        chord = math.hypot(bx - ax, by - ay)
        height = abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / chord if chord else 0.0
        return chord > 0 and chord * height / (chord * chord / 4 + height * height) <= 1e-5

    def gather(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        op, *held = state.get if state.exists else (0, "[]")
        held, out = json.loads(held[0]), []
        log = pd.concat(list(batches)).sort_values("click_seq")
        for x, y in log[["x", "y"]].itertuples(index=False, name=None):
            if len(held) == 2:
                (ax, ay), (bx, by) = held
                if flat(ax, ay, bx, by, x, y):
                    continue
                out.append((int(key[0]), op, ax, ay, bx, by, float(x), float(y)))
                op, held = op + 1, []
            else:
                held.append([float(x), float(y)])
        state.update((op, json.dumps(held)))
        yield pd.DataFrame(out, columns=["session_id", "op_seq", "x1", "y1", "x2", "y2", "x3", "y3"])

    schema = "session_id long, op_seq long, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"
    return clicks.groupBy("session_id").applyInPandasWithState(gather, schema, "op long, held string", "append", "NoTimeout")
