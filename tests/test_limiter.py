"""The limiter over tables against one sequential run."""

import random

import pytest

from kairograph.operators import limiter


def sequential(rows, most, window):
    kept, out = {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        own = kept[key] = [s for s in kept.get(key, []) if s > at - window]
        out[key, i] = len(own) < most
        if out[key, i]:
            own.append(at)
    return out


@pytest.mark.parametrize(("most", "window"), [(1, 50), (3, 100), (7, 1000)])
def test_equals_one_run(spark, most, window):
    """One key has two thirds of the requests, without a pause, and spans all parts."""
    draw = random.Random(most)
    rows = [(1, i, draw.randint(0, 20_000)) for i in range(2000)] + [(2, i, draw.randint(0, 10**6)) for i in range(900)] + [(None, i, 5 * (i // 3)) for i in range(100)]
    requests = spark.createDataFrame(rows, "key long, id long, at long").repartition(5)
    got = {(r["key"], r["id"]): r["allowed"] for r in limiter.limit_table(requests, most, window).collect()}
    assert got == sequential(rows, most, window)


def test_parts_that_are_not_folded_again(spark):
    """Far more parts than keys: most fit at once, so that a later fold finds groups without a new state, alone in their task too."""
    rows = [(k, i, 10 * i + k) for k in range(5) for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 61)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r["key"], r["id"]): r["allowed"] for r in limiter.limit_table(spark.createDataFrame(rows, "key long, id long, at long"), 1, 95).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got == sequential(rows, 1, 95)


def test_empty_and_null_times(spark):
    schema = "key string, id long, at long"
    assert limiter.limit_table(spark.createDataFrame([], schema), 2).count() == 0
    assert [tuple(r) for r in limiter.limit_table(spark.createDataFrame([("a", 1, None), ("a", 2, 7)], schema), 2).collect()] == [("a", 2, 7, True)]


def test_last_address(spark):
    from pyspark.sql import functions as F

    from kairograph.plans.validation import last_address

    chains = {
        "1.2.3.4": "1.2.3.4", "1.2.3.4, 999.1.1.1": "1.2.3.4", "unknown": None, "": None, "2001:db8::1,x": "2001:db8::1", "::": "::", "::1": "::1", "1::": "1::", "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8",
        "1:2:3:4:5:6:7": None, "1::2::3": None, ":::1": None, "::ffff:10.0.0.1": "::ffff:10.0.0.1", "1:2:3:4:5:6:1.2.3.4": "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::": "1:2:3:4:5:6:7::", "1:2:3:4::5:6:7:8": None,
        "01.2.3.4": None, "1.2.3": None, "12345::": None, "fe80::1%eth0": None, " 8.8.8.8 ": "8.8.8.8"}
    rows = spark.createDataFrame([(c,) for c in chains], "c string").select("c", last_address(F.col("c")).alias("a")).collect()
    assert {r["c"]: r["a"] for r in rows} == chains
