"""Sinks and sources of derived tables: map runs with a pointer to the active one, views rebuilt in place, snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "run_id long, active boolean, at timestamp"


def write_run(points: DataFrame, root: str, run_id: int, view: str) -> None:
    """Finite points of one run and view as a partition of their own; a run that was cut off is simply written again."""
    finite = points.where(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") <= 1e6) & (F.abs("y") <= 1e6))
    finite.write.mode("overwrite").parquet(f"{root}/points/run_id={run_id}/view={view}")


def activate_run(spark: SparkSession, root: str, run_id: int) -> None:
    """Make a run the active one: a pointer row is appended, so readers see the old or the new run, never none."""
    row = spark.createDataFrame([(run_id, True)], "run_id long, active boolean").withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(f"{root}/pointer")


def active_run(spark: SparkSession, root: str, view: str | None = None) -> DataFrame:
    """The points of the run that was activated last, none before the first one; an unknown view means "topic"."""
    last = spark.read.schema(POINTERS).parquet(f"{root}/pointer").where("active").orderBy(F.desc("at"), F.desc("run_id")).limit(1).first()
    view = view if view in ("topic", "network") else "topic"
    return spark.read.parquet(f"{root}/points").where((F.col("run_id") == (last["run_id"] if last else None)) & (F.col("view") == view))


def refresh_view(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A derived table rebuilt in full, dealt by its lookup keys so that later reads prune by statistics."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_snapshots(pages: DataFrame, path: str, ttl_days: int = 365) -> int:
    """Append the pages (url, html, fetched_at) that are new by address and digest; returns how many."""
    spark = pages.sparkSession
    rows = pages.select("url", F.sha2("html", 256).alias("hash"), "html", "fetched_at", F.date_add("fetched_at", ttl_days).alias("expires_at")).dropDuplicates(["url", "hash"])
    try:
        known = spark.read.parquet(path).select("url", "hash")
        rows = rows.join(known, ["url", "hash"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    before = rows.count()
    rows.write.mode("append").parquet(path)
    return before
