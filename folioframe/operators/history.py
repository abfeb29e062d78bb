"""Edit histories: bursts of typing, undo and redo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BURST_MS, LIMIT = 1000, 100


def bursts(events: DataFrame, by: str, ts: str, kind: str, limit_ms: int = BURST_MS, tie: str | None = None) -> DataFrame:
    """events with ``burst`` (from 0): an event joins the one before it when of the same kind and at most limit_ms later."""
    w = Window.partitionBy(by).orderBy(ts, *([tie] if tie else []))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    joins = (gap <= limit_ms * 1000) & F.col(kind).eqNullSafe(F.lag(kind).over(w))
    return events.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("burst", F.sum("__new").over(w) - 1).drop("__new")


class History:
    """Depths of the undo and redo stacks under commit, undo, redo, reset."""

    def __init__(self, past: int = 0, future: int = 0, limit: int = LIMIT):
        self.past, self.future, self.limit = past, future, limit

    def apply(self, action: str) -> None:
        if action == "commit":
            self.past, self.future = min(self.past + 1, self.limit), 0
        elif action == "undo" and self.past:
            self.past, self.future = self.past - 1, self.future + 1
        elif action == "redo" and self.future:
            self.past, self.future = min(self.past + 1, self.limit), self.future - 1
        elif action == "reset":
            self.past = self.future = 0


def depths(actions: DataFrame, by: str, order: str, action: str, limit: int = LIMIT) -> DataFrame:
    """Undo and redo depth after each action. Rows go through one Python pass a partition, sorted by session and order, so a
    session of any length needs no memory but its two counters."""
    kind = actions.schema[by].dataType.simpleString()
    order_kind = actions.schema[order].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, History(limit=limit)
        for frame in frames:
            past, future = [], []
            for s, a in zip(frame[by], frame[action], strict=True):
                if s != session:
                    session, state = s, History(limit=limit)
                state.apply(a)
                past.append(state.past)
                future.append(state.future)
            yield pd.DataFrame({by: frame[by], order: frame[order], action: frame[action], "undo_depth": past, "redo_depth": future})

    ordered = actions.select(by, order, action).repartition(by).sortWithinPartitions(by, order)
    return ordered.mapInPandas(fold, f"`{by}` {kind}, `{order}` {order_kind}, `{action}` string, undo_depth long, redo_depth long")


class Transactions:
    """Editor states under transactions: a commit that changes the value clears redo and, if it pushes, keeps the value before;
    one that doesn't change it only moves the caret. version counts changes of the value."""

    def __init__(self, value, limit: int = LIMIT):
        self.value, self.caret, self.version, self.limit = value, None, 0, limit
        self.past: list = []
        self.future: list = []

    def commit(self, value, caret=None, push: bool = True) -> None:
        if value != self.value:
            if push:
                self.past = [*self.past, (self.value, self.caret)][-self.limit :]
            self.future, self.value, self.version = [], value, self.version + 1
        self.caret = caret

    def _step(self, source: list, target: list, first: bool) -> None:
        if not source:
            return
        value, caret = source.pop(0 if first else -1)
        target.insert(0, (self.value, self.caret)) if not first else target.append((self.value, self.caret))
        self.value, self.caret, self.version = value, caret, self.version + 1

    def undo(self) -> None:
        self._step(self.past, self.future, False)

    def redo(self) -> None:
        self._step(self.future, self.past, True)
        self.past = self.past[-self.limit :]

    def replace(self, value) -> None:
        """A new value without a history."""
        self.value, self.caret, self.past, self.future, self.version = value, None, [], [], self.version + 1


def replay(actions: DataFrame, by: str = "session_id", order: str = "seq", limit: int = LIMIT) -> DataFrame:
    """actions: session, order, type (commit, undo, redo, replace), text, push. The last state of each session: value, version,
    undo_depth, redo_depth. One Python pass a partition, sorted; a session holds its last ``limit`` values."""
    kind = actions.schema[by].dataType.simpleString()
    columns = [by, "value", "version", "undo_depth", "redo_depth"]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, t, out = None, None, []
        for frame in frames:
            for s, a, text, push in zip(frame[by], frame["type"], frame["text"], frame["push"], strict=True):
                if t is None or s != session:
                    if t is not None:
                        out.append((session, t.value, t.version, len(t.past), len(t.future)))
                    session, t = s, Transactions("", limit)
                if a == "commit":
                    t.commit(text, push=push is None or bool(push))
                elif a == "replace":
                    t.replace(text)
                elif a in ("undo", "redo"):
                    getattr(t, a)()
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if t is not None:
            yield pd.DataFrame([(session, t.value, t.version, len(t.past), len(t.future))], columns=columns)

    rows = actions.select(by, order, "type", "text", "push").repartition(by).sortWithinPartitions(by, order)
    return rows.mapInPandas(fold, f"`{by}` {kind}, value string, version long, undo_depth long, redo_depth long")
