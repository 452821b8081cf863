"""Streams whose rows take effect in order of event time, whatever order they arrive in.

Rows of a key wait in its state until the watermark has passed them; then no earlier
one can come any more, and they are folded in order of time. So the result is that of
the batch, however rows were dealt over micro-batches, but for rows that come later
than ``late``, which Spark drops. What a key holds are the rows of that span
and the state of its fold, which goes when the fold says that it is of no more use.

The session needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` as ``STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.rate_limit import Limiter

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(Protocol):
    """What is done with the rows of a key, one after the other. Rows are (at_us, id, more...)."""

    row: str  # the columns of a row
    state: str  # those of the state
    result: list[str]  # those of what comes out, after the key

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        """The state after a row, and what comes out."""

    def until(self, state: tuple) -> int:
        """The microsecond of event time from which the state is of no more use."""


class Calls:
    """Calls of a key, as the batch limiter judges them."""

    row, state, result = "at_us long, id long", "count long, ends long", ["id", "at_us", "allowed", "retry_after_s"]

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us

    def step(self, state, row):
        own = Limiter(*state) if state else Limiter()
        at, i = row
        ok = own.call(at, self.limit, self.window)
        return (own.count, own.ends), (i, at, ok, None if ok else -((at - own.ends) // 1_000_000))

    def until(self, state):
        return state[1]


class Stages:
    """Changes of a lead's stage. A lead that is idle for longer than ``idle_us`` begins anew."""

    row, state, result = "at_us long, id long, stage string", "stage string, at_us long", ["id", "at_us", "from_stage", "to_stage"]

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def step(self, state, row):
        at, i, stage = row
        before = state[0] if state else None
        return (stage, at), (i, at, before, stage) if before is not None and stage is not None and before != stage else None

    def until(self, state):
        return state[1] + self.idle


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them."""

    def __init__(self, fold: Fold, key: str):
        self.fold, self.key = fold, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fold.row)
        self.now = handle.getValueState("now", self.fold.state)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.fold.row.split(", ")]
        least = None
        for batch in rows:
            own = [tuple(None if pd.isna(x) else x for x in r) for r in batch[names].astype(object).itertuples(index=False, name=None)]
            if own:
                self.waiting.appendList(own)
                first = min(r[0] for r in own)
                least = first if least is None else min(least, first)
        if least is not None:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due = [r for r in waiting if r[0] <= passed]
        rest = waiting[len(due) :]
        state, out = (tuple(self.now.get()) if self.now.exists() else None), []
        for row in due:
            if state is not None and self.fold.until(state) <= row[0]:
                state = None
            state, said = self.fold.step(state, row)
            if said is not None:
                out.append((key[0], *said))
        if due:
            self.now.update(state)
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self._wake(rest[0][0])
        elif state is not None:
            if self.fold.until(state) <= passed:
                self.now.clear()
            else:
                self._wake(self.fold.until(state))
        if out:
            columns = [pd.Series(list(c), dtype=object) for c in zip(*out, strict=True)]
            yield pd.DataFrame(dict(zip([self.key, *self.fold.result], columns, strict=True)))

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, fold: Fold, key: str, result: str, late: str) -> DataFrame:
    if rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    timed = rows.where("at_us is not null").withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return timed.groupBy(key).transformWithStateInPandas(InOrder(fold, key), result, "Append", "EventTime")


def limited(calls: DataFrame, limit: int, window_us: int, late: str = "10 minutes") -> DataFrame:
    """(key string, id long, at_us long) -> the same with ``allowed`` and ``retry_after_s``, as by the batch limiter. A call without time is dropped."""
    return _folded(calls, Calls(limit, window_us), "key", "key string, id long, at_us long, allowed boolean, retry_after_s long", late)


def stage_changes(history: DataFrame, late: str = "10 minutes", idle_us: int = 365 * 86_400_000_000) -> DataFrame:
    """(lead_id long, id long, at_us long, stage string) -> (lead_id, id, at_us, from_stage, to_stage) wherever a lead's stage differs from the one before in time."""
    return _folded(history, Stages(idle_us), "lead_id", "lead_id long, id long, at_us long, from_stage string, to_stage string", late)
