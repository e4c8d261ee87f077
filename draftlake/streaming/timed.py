"""Streams whose state follows event time: rows in order, timers without messages, results that expire.

They need the session's state store to be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from draftlake.operators.admission import admit
from draftlake.streaming.streams import timed

#: Milliseconds after which a flow's level rises.
# Levels of flows that take long.
LEVELS = ((30_000, "WATCH"), (60_000, "WARNING"), (120_000, "URGENT"), (300_000, "OVERDUE"))
STEPS = 7


class InOrder(StatefulProcessor):
    """Rows (id, micros, ...) of a key go through ``step`` in the order of time and id, whichever
    batch they come in: they wait in the state until the watermark has passed them."""

    def __init__(self, waiting: str):
        self.schema = waiting
        self.names = [x.split()[0] for x in waiting.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def step(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def _call(self, rows: list[tuple]) -> None:
        """A timer for the earliest of the rows that wait."""
        self.waiting.put(rows) if rows else self.waiting.clear()
        if rows:
            self.handle.registerTimer(min(r[1] for r in rows) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        for batch in rows:
            held += [tuple(r) for r in batch[self.names].itertuples(index=False, name=None)]
        held = [tuple(None if x is pd.NaT or x != x else getattr(x, "item", lambda x=x: x)() for x in r) for r in held]
        self._call(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        ready = [r for r in held if r[1] < mark]
        self._call(held[len(ready) :])
        out = self.step(key, ready) if ready else []
        if out:
            yield pd.DataFrame(out, columns=self.output)

    def close(self) -> None:
        pass


class Limiter(InOrder):
    """Requests admitted by a sliding window; the state is the admitted times still inside it."""

    output = ["id", "tenant_id", "admitted"]

    def __init__(self, limit: int, seconds: int):
        super().__init__("id bigint, micros bigint")
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.inside = handle.getValueState("inside", "times array<bigint>")

    def step(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        known = list(self.inside.get()[0]) if self.inside.exists() else []
        times = known + [r[1] for r in rows]
        ok = admit(times, [True] * len(known) + [False] * len(rows), self.limit, self.span)
        last = times[-1]
        self.inside.update(([t for t, a in zip(times, ok, strict=True) if a and t > last - self.span],))
        return [(r[0], key[0], a) for r, a in zip(rows, ok[len(known) :], strict=True)]


class Results(InOrder):
    """Results that are kept for their lifetime and reused by later asks for the same thing.

    A row with a result stores it, a row without one asks; state goes when the result has expired
    and nothing waits.
    """

    output = ["id", "tenant_id", "fingerprint", "kind", "result", "reused"]

    def __init__(self, lifetime_ms: int):
        super().__init__("id bigint, micros bigint, result double")
        self.lifetime = lifetime_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stored = handle.getValueState("stored", "micros bigint, result double")

    def step(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        made = tuple(self.stored.get()) if self.stored.exists() else None
        out = []
        for number, micros, result in rows:
            if result is not None:
                made = (micros, result)
                continue
            fresh = made is not None and micros - made[0] <= self.lifetime
            out.append((number, *key, made[1] if fresh else None, fresh))
        if made is not None:
            self.stored.update(made)
            self.handle.registerTimer((made[0] + self.lifetime) // 1000 + 1)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.stored.exists() and self.stored.get()[0] + self.lifetime < timerValues.getCurrentWatermarkInMs() * 1000:
            self.stored.clear()


class Overdue(StatefulProcessor):
    """Levels of flows that take long, told when the watermark reaches them, message or not.

    A flow begins at its first message and ends at its last step or first anomaly; then its state
    and timers go.
    """

    output = ["flow_task_id", "level", "at_ms"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "began bigint, told int, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        began, told, over = tuple(self.flow.get()) if self.flow.exists() else (None, 0, False)
        over = bool(over or ((batch["step_index"] >= STEPS) | batch["is_anomaly"].astype(bool)).any())
        first = int(batch["ms"].min()) if began is None else min(began, int(batch["ms"].min()))
        if over:
            for x in list(self.handle.listTimers()):
                self.handle.deleteTimer(x)
            self.flow.clear()
        else:
            if began != first:
                for x in list(self.handle.listTimers()):
                    self.handle.deleteTimer(x)
                for after, _ in LEVELS[told:]:
                    self.handle.registerTimer(first + after)
            self.flow.update((first, told, over))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.flow.exists():
            return
        began, told, over = self.flow.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        for i, (after, level) in enumerate(LEVELS):
            if i >= told and began + after <= at:
                told = i + 1
                yield pd.DataFrame([(key[0], level, began + after)], columns=self.output)
        self.flow.update((began, told, over))

    def close(self) -> None:
        pass


def _micros(df: DataFrame, column: str) -> DataFrame:
    return timed(df, column).withColumn("micros", F.unix_micros(F.col(column)))


def admitted(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(id, tenant_id, admitted) of a stream of requests (id, tenant_id, created_at) in event time."""
    r = _micros(requests, "created_at").select("id", "tenant_id", "micros", "created_at")
    return r.groupBy("tenant_id").transformWithStateInPandas(Limiter(limit, seconds), "id bigint, tenant_id bigint, admitted boolean", "Append", "EventTime")


def reused(messages: DataFrame, lifetime_ms: int) -> DataFrame:
    """Asks of a stream (id, tenant_id, fingerprint, kind, at, result; null asks) and what they reuse."""
    m = _micros(messages, "at").select("id", "tenant_id", "fingerprint", "kind", "result", "micros", "at")
    schema = "id bigint, tenant_id bigint, fingerprint bigint, kind string, result double, reused boolean"
    return m.groupBy("tenant_id", "fingerprint", "kind").transformWithStateInPandas(Results(lifetime_ms), schema, "Append", "EventTime")


def overdue(messages: DataFrame) -> DataFrame:
    """(flow_task_id, level, at_ms) as flows of a stream (flow_task_id, step_index, is_anomaly,
    created_at) reach the levels."""
    m = _micros(messages, "created_at").select("flow_task_id", "step_index", "is_anomaly", F.expr("micros div 1000").alias("ms"), "created_at")
    return m.groupBy("flow_task_id").transformWithStateInPandas(Overdue(), "flow_task_id bigint, level string, at_ms bigint", "Append", "EventTime")
