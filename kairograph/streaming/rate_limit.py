"""Sliding-window rate limiter as a stateful stream (an extension: the batch form is a window query)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limiter import fold


def limit_requests(requests: DataFrame, most: int, window_s: int = 60, late: str = "10 minutes") -> DataFrame:
    """(key, ts, allowed) for a stream of (key, ts): at most ``most`` allowed requests in any ``window_s`` seconds.

    A stamp at or before now minus the window no longer counts; denied requests leave no trace. The state of a key is
    at most ``most`` stamps, and goes when the watermark has passed them all.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("ts")  # a key's requests of one trigger can come in several chunks
        stamps = (pdf["ts"].astype("datetime64[us]").astype("int64")).tolist()
        allowed, kept = fold(stamps, list(state.get[0]) if state.exists else [], most, window_s * 1_000_000)
        yield pd.DataFrame({"key": key[0], "ts": pdf["ts"], "allowed": allowed})
        state.update((kept,))
        if kept:
            state.setTimeoutTimestamp(max(kept[-1] // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))

    return requests.withWatermark("ts", late).groupBy("key").applyInPandasWithState(
        run, "key long, ts timestamp, allowed boolean", "stamps array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per hour and type of a stream of (ts, event_type), closed by the watermark."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
