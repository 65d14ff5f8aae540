"""Stateful processors: running count, hold and replay, lifecycle.

Each gets its rows in order, as an iterator; what it keeps between rows lives in the state store.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyferry.functions.states import (
    ABORT, BARRIER_ALIGNED, FINAL_DELTA_COMPLETE, PREPARE_SOURCE, PREPARE_TARGET, ROUND_COMPLETE,
    TERMINAL,
)
from keyferry.params import MAX_NON_DECREASING, MAX_ROUNDS, TIMEOUTS_S

CHUNK = 10_000

# Python workers get these classes themselves instead of importing this package, which they need
# not have. So code in here refers to values of other modules, not to the modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def in_order(df: DataFrame, by: list[str], order: list[str]) -> GroupedData:
    """Group a stream so that each group's rows come in order within a micro-batch.

    The sort is Spark's, per partition and spilling, on the partitioning the stateful operator asks
    for anyway; so there is one shuffle, and no group has to fit in a Python worker.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *by).sortWithinPartitions(*by, *order).groupBy(*by)


class RunningCount(StatefulProcessor):
    """Emit every record with its key's count so far. Can start from a moved state.

    One read and one write of the state per key and micro-batch. A record that is not after the key's
    last one fails the query: counts would be wrong otherwise.
    """

    OUTPUT = "seq long, key string, n long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long, last long")
        self.row = Row("seq", "key", "n")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, last = self.count.get() or (0, None)
        for r in rows:
            if last is not None and r.seq <= last:
                raise ValueError(f"record {r.seq} of key {key[0]} came after record {last}")
            n, last = n + 1, r.seq
            yield self.row(r.seq, r.key, n)
        self.count.update((n, last))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.count.update((initialState.n, None))

    def close(self) -> None:
        pass


class RunningFold(StatefulProcessor):
    """Emit every record with its key's value so far under a given fold.

    ``fold(state, record)`` gets the key's state as a tuple (``start`` at first) and the whole record, and
    returns the next state; ``state`` names its columns. The output is ``seq, key`` and the state. A moved
    state has ``key`` and the state's columns.
    """

    def __init__(self, fold: Callable[[tuple, Row], tuple], state: str, start: tuple) -> None:
        self.fold, self.state, self.start = fold, state, start

    @property
    def output(self) -> str:
        return f"seq long, key string, {self.state}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", f"last long, {self.state}")
        self.names = [part.split()[0] for part in self.state.split(",")]
        self.row = Row("seq", "key", *self.names)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.value.update((None, *(initialState[name] for name in self.names)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, *value = self.value.get() or (None, *self.start)
        value = tuple(value)
        for r in rows:
            if last is not None and r.seq <= last:
                raise ValueError(f"record {r.seq} of key {key[0]} came after record {last}")
            value, last = tuple(self.fold(value, r)), r.seq
            yield self.row(r.seq, r.key, *value)
        self.value.update((last, *value))

    def close(self) -> None:
        pass


# What is known of a move; unknown parts are null.
MOVE = ("source", "target", "flip_seq", "release_seq", "cancel_seq")


class HoldReplay(StatefulProcessor):
    """Fold records per key; hold those of a moving group after the flip while its end is unknown.

    Grouped by (key_group, lane): a lane holds part of the group's keys. Every row carries what is known
    of the group's move (``MOVE``) and the group's default ``owner``; rows with ``control`` are no records
    but bring news of a move to each lane. Whether a record is before or after a flip, a release or a
    cancellation is told by its ``seq`` alone, never by when either came. ``fold`` turns a key's state (a
    tuple, ``start`` at first) and the whole record into the next state, for each record in order; ``state``
    names the state's columns, ``payload`` those of the record that are held with it.
    Values and held rows go to the state store in batches of at most ``CHUNK``.

    Rows of a moved state have a ``kind``: ``state`` with ``key`` and ``state``, ``held`` with a record, or ``move``.
    """

    OUTPUT = "seq long, key string, key_group int, phase string, owner int, effective_seq long"

    def __init__(
        self,
        fold: Callable[[tuple, Row], tuple] = lambda state, record: (state[0] + 1,),
        state: str = "n long",
        start: tuple = (0,),
        payload: str = "",
    ) -> None:
        self.fold, self.state, self.start, self.payload = fold, state, start, payload

    @property
    def output(self) -> str:
        return f"{self.OUTPUT}, {self.state}"

    @property
    def held_record(self) -> str:
        return "seq long, key string, owner int" + (f", {self.payload}" if self.payload else "")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "key string", self.state)
        self.held = handle.getListState("held", self.held_record)
        self.move = handle.getValueState(
            "move",
            "source int, target int, flip_seq long, release_seq long, cancel_seq long, last long",
        )
        names = lambda ddl: [part.split()[0] for part in ddl.split(", ") if part]
        self.row = Row(*names(self.output))
        self.columns = names(self.held_record)
        self.record = Row(*self.columns)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        # Structs inside of rows of a moved state come as dictionaries.
        if initialState.kind == "state":
            self.counts.updateValue((initialState.key,), tuple(initialState.state.values()))
        elif initialState.kind == "held":
            self.held.appendValue(tuple(initialState.held.values()))
        else:
            self.move.update(tuple(initialState.move.values()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        group = key[0]
        before = tuple(self.move.get() or (None,) * 6)
        move, last = before[:5], before[5]
        # A lane without values needs not ask for that of each key.
        self.fresh = not self.counts.exists()
        values: dict[str, tuple] = {}
        waiting: list[Row] = []
        seen, plan, pick = None, self._plan(move), None
        for r in rows:
            if pick is None:
                # Rows give their columns by place: looking up each by name takes most of a record's time.
                place = r.__fields__.index
                pick = itemgetter(*map(place, MOVE)), itemgetter(*map(place, self.columns)), place("control"), place("seq")
            r = tuple(r)
            if (news := pick[0](r)) != seen:
                seen = news
                known = tuple(old if new is None else new for new, old in zip(news, move))
                if known != move:
                    ended = self._end(move) is None and self._end(known) is not None
                    move, plan = known, self._plan(known)
                    if ended:
                        self._hold(waiting)
                        yield from self._drain(group, plan, values)
            if r[pick[2]]:
                continue
            seq = r[pick[3]]
            if last is not None and seq <= last:
                raise ValueError(f"record {seq} of group {group} came after record {last}")
            last = seq
            record = self.record(*pick[1](r))
            flip, end = plan[:2]
            if end is None and flip is not None and seq > flip:
                waiting.append(record)
                if len(waiting) == CHUNK:
                    self._hold(waiting)
            else:
                yield self._emit(group, plan, record, values)
        self._hold(waiting)
        self._store(values)
        if (*move, last) != before:
            self.move.update((*move, last))

    @staticmethod
    def _end(move: tuple) -> int | None:
        """Where holding ends: at the release, or at a cancellation before it."""
        _, _, _, release, cancel = move
        return release if cancel is None or (release is not None and release <= cancel) else cancel

    def _plan(self, move: tuple) -> tuple:
        """Flip, end, whether that is a cancellation, source and target of a move."""
        source, target, flip, release, cancel = move
        end = self._end(move)
        return flip, end, end is not None and end == cancel and end != release, source, target

    def _emit(self, group: int, plan: tuple, r: Row, values: dict[str, tuple]) -> Row:
        flip, end, back, source, target = plan
        seq, key, owner = r[:3]
        effective = seq
        if flip is None or (back and seq > end):
            phase = "other"
        elif seq <= flip:
            phase, owner = "pre", source
        elif end is None or seq <= end:
            phase, owner, effective = "held", source if back else target, end
        else:
            phase, owner = "live", target
        return self.row(seq, key, group, phase, owner, effective, *self._next(key, r, values))

    def _drain(self, group: int, plan: tuple, values: dict[str, tuple]) -> Iterator[Row]:
        for held in self.held.get():
            yield self._emit(group, plan, self.record(*held), values)
        self.held.clear()

    def _hold(self, waiting: list[Row]) -> None:
        if waiting:
            self.held.appendList([tuple(r) for r in waiting])
            waiting.clear()

    def _next(self, key: str, record: Row, values: dict[str, tuple]) -> tuple:
        value = values.get(key)
        if value is None:
            if len(values) >= CHUNK:
                self._store(values)
                self.fresh = False
            value = None if self.fresh else self.counts.getValue((key,))
            value = self.start if value is None else tuple(value)
        values[key] = value = tuple(self.fold(value, record))
        return value

    def _store(self, values: dict[str, tuple]) -> None:
        for key, value in values.items():
            self.counts.updateValue((key,), value)
        values.clear()

    def close(self) -> None:
        pass


class Lifecycle(StatefulProcessor):
    """Follow one migration through its states, with a timer for the state it is in.

    Emits a row for every change of state; the last ``step`` of a migration is where it stands.
    """

    OUTPUT = "migration_id long, step int, state string, reason string, at_ts timestamp"
    STATE = (
        "state string, entered_ms long, source_ok boolean, target_ok boolean, rounds int, "
        "previous long, streak int, step int"
    )

    def __init__(
        self,
        timeouts: dict[str, int] | None = None,
        max_rounds: int = MAX_ROUNDS,
        max_non_decreasing: int = MAX_NON_DECREASING,
    ) -> None:
        self.limits_ms = {
            k: v * 1000 for k, v in {**TIMEOUTS_S, **(timeouts or {})}.items()
        }
        self.max_rounds = max_rounds
        self.max_non_decreasing = max_non_decreasing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", self.STATE)

    def _load(self) -> dict:
        names = [part.split()[0] for part in self.STATE.split(", ")]
        if self.at.exists():
            return dict(zip(names, self.at.get()))
        return dict(zip(names, ("IDLE", 0, False, False, 0, None, 0, 0)))

    def _deadline(self, s: dict) -> int | None:
        limit = self.limits_ms.get(s["state"])
        return None if limit is None else s["entered_ms"] + limit

    def _enter(self, s: dict, state: str, at_ms: int, reason: str | None, out: list) -> None:
        s.update(state=state, entered_ms=at_ms, step=s["step"] + 1)
        out.append((s["step"], state, reason, at_ms))

    def _expire(self, s: dict, now_ms: int, out: list) -> None:
        deadline = self._deadline(s)
        if deadline is not None and now_ms > deadline:
            self._enter(s, "ABORTED", deadline, f"timeout {s['state']}", out)

    def _event(self, s: dict, e, at_ms: int, out: list) -> None:
        kind, ok = e.kind, not (e.ok is False or e.ok == False)  # noqa: E712
        if s["state"] == "IDLE":
            if kind not in (PREPARE_SOURCE, PREPARE_TARGET):
                return
            self._enter(s, "INIT", at_ms, None, out)
        if s["state"] in TERMINAL:
            return
        if kind == ABORT:
            self._enter(s, "ABORTED", at_ms, e.reason or "abort", out)
        elif kind in (PREPARE_SOURCE, PREPARE_TARGET) and s["state"] == "INIT":
            if not ok:
                self._enter(s, "ABORTED", at_ms, "prepare failed", out)
                return
            s["source_ok" if kind == PREPARE_SOURCE else "target_ok"] = True
            if s["source_ok"] and s["target_ok"]:
                self._enter(s, "PRE_COPY", at_ms, None, out)
        elif kind == ROUND_COMPLETE:
            s["rounds"] += 1
            if s["state"] == "PRE_COPY":
                self._round(s, e, at_ms, out)
        elif kind == BARRIER_ALIGNED and s["state"] == "AWAIT_BARRIER":
            self._enter(s, "FINALIZING", at_ms, None, out)
        elif kind == FINAL_DELTA_COMPLETE and s["state"] == "FINALIZING":
            if ok:
                self._enter(s, "COMMITTED", at_ms, None, out)
            else:
                self._enter(s, "ABORTED", at_ms, "final delta failed", out)

    def _round(self, s: dict, e, at_ms: int, out: list) -> None:
        if e.converged:
            self._enter(s, "AWAIT_BARRIER", at_ms, None, out)
            return
        delta, previous = int(e.delta_size), s["previous"]
        s["streak"] = s["streak"] + 1 if previous is not None and delta >= previous else 0
        s["previous"] = delta
        if s["streak"] >= self.max_non_decreasing:
            self._enter(s, "ABORTED", at_ms, "divergence", out)
        elif s["rounds"] >= self.max_rounds:
            self._enter(s, "ABORTED", at_ms, "maximum rounds", out)

    def _rows(self, migration_id: int, out: list) -> pd.DataFrame:
        return pd.DataFrame({
            "migration_id": [migration_id] * len(out),
            "step": [o[0] for o in out],
            "state": [o[1] for o in out],
            "reason": [o[2] for o in out],
            "at_ts": pd.to_datetime([o[3] for o in out], unit="ms"),
        })

    def _save(self, s: dict, timer: int | None) -> None:
        deadline = self._deadline(s)
        if timer != deadline:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if deadline is not None:
                self.handle.registerTimer(deadline)
        self.at.update(tuple(s.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        s = self._load()
        timer = self._deadline(s)
        for pdf in rows:
            out: list = []
            for e in pdf.itertuples(index=False):
                at_ms = int(e.at_ts.value // 1_000_000)
                self._expire(s, at_ms, out)
                self._event(s, e, at_ms, out)
            if out:
                yield self._rows(key[0], out)
        self._save(s, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = self._load()
        out: list = []
        self._expire(s, timerValues.getCurrentWatermarkInMs(), out)
        self.at.update(tuple(s.values()))
        if out:
            yield self._rows(key[0], out)

    def close(self) -> None:
        pass
