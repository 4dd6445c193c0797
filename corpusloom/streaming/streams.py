"""Streaming twins: windows over arriving turns, repeats within a time, events by the hour, incremental sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.sessions import MAX_CHARS, MAX_TURNS, counted


def window_stream(turns: DataFrame, max_turns: int = MAX_TURNS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(session_id, window, last_turn, turns, chars): a row as soon as a window of a session is full.

    The state of a session is four numbers. Turns count in the order of their numbers within a micro batch.
    """
    c = counted(F.col("role"))
    light = turns.where("session_id is not null").select("session_id", "turn", F.coalesce(c.cast("long"), F.lit(0)).alias("k"), F.coalesce(F.when(c, F.length("text")), F.lit(0)).cast("long").alias("c"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, n, size = state.get if state.exists else (0, 0, 0)
        out = []
        for turn, k, chars in sorted(zip(*(sum((b[x].tolist() for b in parts), []) for x in ("turn", "k", "c")), strict=True)) if (parts := list(batches)) else []:
            n, size = n + k, size + chars
            if n >= max_turns or size >= max_chars:
                out.append((key[0], index, turn, n, size))
                index, n, size = index + 1, 0, 0
        state.update((index, n, size))
        yield pd.DataFrame(out, columns=["session_id", "window", "last_turn", "turns", "chars"])

    return light.groupBy("session_id").applyInPandasWithState(fold, "session_id string, window long, last_turn long, turns long, chars long", "window long, turns long, chars long", "append", GroupStateTimeout.NoTimeout)


def repeats_dropped(events: DataFrame, key: list[str], at: str = "ts", within: str = "120 seconds") -> DataFrame:
    """Events whose key did not come within the watermark's span before; state older than that is forgotten."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def hourly(events: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(hour, event_type, n, value) of events by the hour; events up to ``late`` behind still count."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def sync_stream(pages: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that hands every micro batch of changed pages to ``apply``, the latest version of a path once."""

    def each(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("path").agg(F.max(F.struct("updated_at", *[c for c in batch.columns if c not in ("path", "updated_at")])).alias("r"))
        apply(latest.select("path", "r.*"))

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
