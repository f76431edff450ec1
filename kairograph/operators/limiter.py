"""The sliding-window limiter over a table of requests: an ordered fold of each key, in parts that run side by side."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import settled


def fold(stamps: list[int], kept: list[int], most: int, window: int) -> tuple[list[bool], list[int]]:
    """Whether each of the rising ``stamps`` is allowed, and the allowed ones that can still count behind the last."""
    held, allowed = deque(kept), []
    for now in stamps:
        while held and held[0] <= now - window:
            held.popleft()
        allowed.append(len(held) < most)
        if allowed[-1]:
            held.append(now)
    return allowed, list(held)


def limit_table(requests: DataFrame, most: int, window_us: int = 60_000_000) -> DataFrame:
    """``requests`` (key, id, at in microseconds) with ``allowed``: at most ``most`` allowed ones of a key in any window.

    A stamp at or before now minus the window no longer counts; denied requests leave no trace, so what a request meets
    depends on all before it. Requests are dealt by ranges of key and time, so a hot key spans parts. Every part is
    folded at once, from an empty state; then a part is folded again while the state that it began with is not the one
    that the part before it now ends with, until all fit. Parts forget how they began as soon as their key pauses or
    fills up alike, so few are folded more than twice, and a state is at most ``most`` stamps. Requests of one time go by id.
    Null keys are a key of their own; null times are not in the result.
    """
    kind = requests.schema["key"].dataType.simpleString()
    dealt = requests.where("at IS NOT NULL").select("key", "id", F.col("at").cast("long").alias("at")).repartitionByRange("key", "at", "id").withColumn("part", F.spark_partition_id())
    dealt = settled(dealt)

    def run(own: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(begun):
            return pd.DataFrame({c: [] for c in ("key", "part", "first", "given", "left")}, dtype=object)  # Arrow makes no lists of empty columns of floats
        given = list(begun["given"].iloc[0])
        stamps = sorted(own["at"].tolist())
        return pd.DataFrame({"key": own["key"].iloc[:1], "part": own["part"].iloc[:1], "first": stamps[0], "given": [given], "left": [fold(stamps, given, most, window_us)[1]]})

    def folded(begun: DataFrame) -> DataFrame:
        return dealt.groupBy("key", "part").cogroup(begun.groupBy("key", "part")).applyInPandas(run, f"key {kind}, part int, first long, given array<long>, left array<long>")

    states = settled(folded(dealt.select("key", "part").distinct().withColumn("given", F.array().cast("array<long>"))))
    while True:
        before = F.lag("left").over(W.partitionBy("key").orderBy("part"))
        wanted = F.coalesce(F.filter(before, lambda s: s > F.col("first") - window_us), F.array().cast("array<long>"))
        stale = settled(states.withColumn("want", wanted).where("want <> given").select("key", "part", F.col("want").alias("given")))
        if stale.isEmpty():
            break
        kept = states.join(stale.select(F.col("key").alias("k"), F.col("part").alias("p")), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")), "left_anti")
        states = settled(kept.union(folded(stale)))

    def flag(own: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["at", "id"])
        return own[["key", "id", "at"]].assign(allowed=fold(own["at"].tolist(), list(begun["given"].iloc[0]) if len(begun) else [], most, window_us)[0])

    ids = requests.schema["id"].dataType.simpleString()
    return dealt.groupBy("key", "part").cogroup(states.groupBy("key", "part")).applyInPandas(flag, f"key {kind}, id {ids}, at long, allowed boolean")
