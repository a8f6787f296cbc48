"""File events: of a burst on one path only the last event counts.

A burst ends when its path is quiet for the gap. ``debounced`` goes by the events' own time, with a watermark: what comes
later than ``late`` is dropped, and a burst is handed on once the watermark has passed its end. ``settled`` goes by the time at
which events come in: each restarts its path's timer, however old it is, and what the timer finds is handed on, so the last
burst needs no later event and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP = "500 milliseconds"
LATE = "10 seconds"


def debounced(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(path, event, ts, events) of ``events`` (path, event, ts), streaming or batch. Of equal times the larger event name is last."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), "path").agg(
        F.max(F.struct("ts", "event")).alias("last"), F.count(F.lit(1)).alias("events")
    )
    return out.select("path", F.col("last.event").alias("event"), F.col("last.ts").alias("ts"), "events")


def settled(events: DataFrame, gap_ms: int = 500) -> DataFrame:
    """(path, event, ts, events) of the streaming ``events`` (path, event, ts): of each burst the event with the latest time, of equal times the larger name.

    State is one row a path with an open burst, and goes when its timer fires.
    """

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ts, event, count = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "event": [event], "ts": [ts], "events": [count]})
            return
        last, count = (state.get[:2], state.get[2]) if state.exists else (None, 0)
        for b in batches:
            for ts, event in zip(b["ts"], b["event"], strict=True):
                last = (ts, event) if last is None else max(last, (ts, event))
                count += 1
        state.update((last[0], last[1], count))
        state.setTimeoutDuration(gap_ms)

    rows = events.where("path IS NOT NULL AND ts IS NOT NULL AND event IS NOT NULL").select("path", "event", "ts").groupBy("path")
    return rows.applyInPandasWithState(run, "path string, event string, ts timestamp, events bigint", "ts timestamp, event string, events bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watched(events: DataFrame, extensions: tuple[str, ...], ignored: str | None = None) -> DataFrame:
    """Events of files that are indexed at all. ``ignored``: a pattern of paths, matched anywhere."""
    rows = events.where(F.concat(F.lit("."), F.substring_index("path", ".", -1)).isin(*extensions))
    return rows.where(~F.col("path").rlike(ignored)) if ignored else rows


def run(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = GAP, late: str = LATE, available_now: bool = False, timer_ms: int | None = None) -> StreamingQuery:
    """Hand each micro-batch of debounced events to ``apply`` (changes, batch id), which reindexes or deletes; with ``timer_ms`` those of settled()."""
    rows = debounced(events, gap, late) if timer_ms is None else settled(events, timer_ms)
    writer = rows.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
