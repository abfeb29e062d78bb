"""Live edit streams: undo and redo depths as keyed state, bursts as session windows, change counts in windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import LIMIT, History

OUTPUT, STATE = "session_id string, seq long, action string, undo_depth long, redo_depth long", "past long, future long"


def history_stream(actions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """actions: session_id, seq, action (commit, undo, redo, reset). Depths after each action; the state of a session is two
    numbers, whatever the length of its stream. Within a micro-batch actions are taken in the order of seq, so a session's
    part of one micro-batch is held and sorted at once: bound it by the source's limit for a trigger."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, future = state.get if state.exists else (0, 0)
        h = History(int(past), int(future), limit)
        rows = pd.concat(list(frames)).sort_values("seq")
        undo, redo = [], []
        for a in rows["action"]:
            h.apply(a)
            undo.append(h.past)
            redo.append(h.future)
        state.update((h.past, h.future))
        yield pd.DataFrame({"session_id": key[0], "seq": rows["seq"], "action": rows["action"], "undo_depth": undo, "redo_depth": redo})

    chosen = actions.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), "action")
    return chosen.groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def burst_stream(events: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """events: session_id, kind, ts. One row for each burst of one kind, closed by a gap: session_id, kind, start, end, n."""
    windows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id", "kind").agg(F.count("*").alias("n"))
    return windows.select("session_id", "kind", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def change_rates(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Edits in sliding windows by kind: start, end, kind, n, sessions (approximately)."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "kind").agg(F.count("*").alias("n"), F.approx_count_distinct("session_id").alias("sessions"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "sessions")


def newest_requests(requests: DataFrame) -> DataFrame:
    """requests: key, priority, seq. The queue's order: the newest request of a key with the least priority any of its requests
    had, first by priority, then by the first request's seq."""
    merged = requests.groupBy("key").agg(F.max("seq").alias("newest"), F.min("priority").alias("priority"), F.min("seq").alias("first"))
    return merged.orderBy("priority", "first").select("key", "newest", "priority")
