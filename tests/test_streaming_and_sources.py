import datetime

from pyspark.sql import functions as F

from kairograph.sources import runs
from kairograph.streaming import rate_limit


def test_rate_limit_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    stamps = [(1, s) for s in (0, 1, 2, 3, 59, 60, 61)] + [(2, 5)]
    rows = [(k, start + datetime.timedelta(seconds=s)) for k, s in stamps]
    spark.createDataFrame(rows, "key long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts timestamp").parquet(str(tmp_path / "in"))
    query = rate_limit.limit_requests(stream, 3).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["key"], (r["ts"] - start).seconds): r["allowed"] for r in spark.table("limited").collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): True, (1, 3): False, (1, 59): False, (1, 60): True, (1, 61): True, (2, 5): True}


def test_hourly_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    want = {(r[0], r[1]): r[2] for r in rate_limit.hourly_counts(events).collect()}
    events.write.parquet(str(tmp_path / "in"))
    query = rate_limit.hourly_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r[0], r[1]): r[2] for r in spark.table("hourly").collect()} == want


def test_runs(spark, tmp_path):
    root = str(tmp_path)
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, float("nan"), 0.0), (3, 1e9, 0.0)], "person_id long, x double, y double")
    runs.write_run(points, root, 1, "topic")
    runs.activate_run(spark, root, 1)
    runs.write_run(points.where("person_id > 5"), root, 2, "topic")
    assert runs.active_run(spark, root, "nonsense").count() == 1
    runs.activate_run(spark, root, 2)
    assert runs.active_run(spark, root).count() == 0


def test_snapshots_and_views(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html", F.lit("2024-01-01").cast("date").alias("fetched_at"))
    path = str(tmp_path / "snapshots")
    first = runs.append_snapshots(pages, path)
    assert first == pages.dropDuplicates(["url", "html"]).count() and runs.append_snapshots(pages, path) == 0
    view = runs.refresh_view(spark.read.parquet(path).select("url", "hash"), str(tmp_path / "view"), ["url"])
    assert view.count() == first
