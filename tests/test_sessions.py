"""Graph sessions: written-out actions, and the stream against the replay of the table."""

import datetime

import pytest
from pyspark.sql import functions as F

from kairograph.operators.session import ACTIONS, Canvas, replay
from kairograph.plans.client import session_actions
from kairograph.sources.adapter import Tables
from kairograph.streaming.sessions import session_canvases


def canvas(*steps):
    c = Canvas()
    for action, node, *more in steps:
        c.act(action, node, *(more + [[], None, None][len(more):]))
    return c


def test_collapse_keeps_what_other_anchors_reach():
    c = canvas(("expand", 1, [2, 3]), ("expand", 3, [4, 5]), ("merge", 5, [6]), ("collapse", 3))
    assert sorted(c.nodes) == [1, 2, 3, 5, 6] and c.nodes[3] == [1, False] and c.trail == [1, 3]
    assert c.links == {(1, 2), (1, 3), (3, 5), (5, 6)} and c.focus == 3 and c.step == 2
    assert canvas(("expand", 1, [2]), ("collapse", 9)).nodes == {1: [1, True], 2: [1, False]}


def test_prune_goes_back_along_the_trail():
    c = canvas(("expand", 1, [2]), ("expand", 2, [3]), ("prune", 2))
    assert sorted(c.nodes) == [1, 3] and c.links == set() and c.trail == [1] and c.focus == 1
    assert canvas(("expand", 1, [2]), ("prune", 1)).focus == 1


def test_select_cuts_the_trail_and_what_hangs_on_it():
    c = canvas(("expand", 1, [2]), ("expand", 7, [8]), ("page", 7, [20, 21], "x"), ("open", 7, [], "x"), ("select", 1, [], None, 0))
    assert sorted(c.nodes) == [1, 2] and c.trail == [1] and c.focus == 1 and c.pages == {} and c.opened == {1: None}


def test_pages_and_cohorts():
    c = canvas(("page", 1, [5, 6], "x"), ("page", 1, [6, 7, 7], "x"), ("open", 1, [], "x"))
    assert c.pages == {(1, "x"): [5, 6, 7]} and c.opened == {}
    assert canvas(("expand", 1, []), ("open", 1, [], "x"), ("open", 1, [], None)).opened == {1: None}
    assert canvas(("expand", 1, [2]), ("reset", 4)).row(0) == (0, -1, 4, 0, [], [], [], 0, 0, 0)
    assert canvas(("focus", 3), ("focus", 4), ("focus", 3)).trail == [3, 4]


def test_a_pause_begins_anew_and_odd_rows_do_nothing(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, 0, at(0), "expand", 1, [2], None, None), (1, 1, at(100), "expand", 5, None, None, None), (2, 0, at(0), "fly", 1, [], None, None),
            (2, 1, at(1), None, None, None, None, None), (None, 0, at(0), "expand", 1, [], None, None), (3, 0, None, "expand", 1, [], None, None)]
    actions = spark.createDataFrame(rows, ACTIONS)
    got = {r["session"]: r for r in replay(actions, idle_s=60).collect()}
    assert set(got) == {1, 2} and got[1]["nodes"] == [5] and got[1]["trail"] == [5] and got[2]["nodes"] == [] and got[2]["seq"] == 1
    assert replay(actions.limit(0)).count() == 0


@pytest.mark.parametrize("idle_s", [40_000, 10**9])
def test_the_stream_equals_the_replay(spark, sf_dir, tmp_path, idle_s):
    actions = session_actions(Tables(spark, sf_dir))
    bounds = actions.approxQuantile("seq", [0.3, 0.7], 0.0)
    for k, (a, b) in enumerate(zip([-1, *bounds], [*bounds, 1e18], strict=True)):
        actions.where((F.col("seq") > a) & (F.col("seq") <= b)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        name = f"canvases_{idle_s}"
        run = session_canvases(stream, idle_s).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        run.awaitTermination()
        last = spark.table(name).groupBy("session").agg(F.max_by(F.struct(*spark.table(name).columns), "seq").alias("c")).select("c.*")
        assert sorted(last.collect(), key=lambda r: r["session"]) == sorted(replay(actions, idle_s).collect(), key=lambda r: r["session"])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)
