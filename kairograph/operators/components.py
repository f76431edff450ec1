"""Iterated joins over links: components and distances."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one serves on a local master alone."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


#: Whether Spark removes the shuffle files of a query when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, which cuts its lineage; its shuffle files go at once."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) with the smallest node reachable over (src, dst); labels spread and jump until they rest."""
    both = settled(links.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct())
    labels = settled(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        spread = both.join(labels.toDF("dst", "m"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("m").alias("m"))
        new = labels.join(spread, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jumped = new.join(labels.toDF("component", "next"), "component", "left").select("node", F.least("component", "next").alias("component"), "old")
        jumped = settled(jumped)
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels
    raise RuntimeError("components not settled")


def reachable(start: DataFrame, links: DataFrame) -> DataFrame:
    """(id, distance) of all that ``start`` (id) reaches over directed (a, b), frontier by frontier until nothing is new."""
    seen = settled(start.select("id", F.lit(0).cast("long").alias("distance")).distinct())
    d = 0
    while True:
        d += 1
        new = seen.where(F.col("distance") == d - 1).join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        new = settled(new.withColumn("distance", F.lit(d).cast("long")))
        if new.isEmpty():
            return seen
        seen = settled(seen.union(new)) if d % 16 == 0 else seen.union(new)


def chains(links: DataFrame) -> DataFrame:
    """(id, steps, top): the longest way up from each ``a`` of ``links`` (a, b) and where it ends, the smallest of several.

    Ways are followed until none goes on; a way stops before it would come back to where it was.
    """
    links = settled(links.select("a", "b").distinct())
    ends = links.select(F.col("a").alias("id")).distinct().select("id", F.lit(0).cast("long").alias("steps"), F.col("id").alias("top"), F.array("id").alias("way"))
    found, walk = [], settled(ends)
    while not walk.isEmpty():
        found.append(walk.select("id", "steps", "top"))
        on = walk.join(links, F.col("top") == F.col("a")).where(~F.array_contains("way", F.col("b")))
        walk = settled(on.select("id", (F.col("steps") + 1).alias("steps"), F.col("b").alias("top"), F.array_append("way", F.col("b")).alias("way")))
    rows = reduce(DataFrame.union, found) if found else walk.select("id", "steps", "top")
    return rows.groupBy("id").agg(F.max("steps").alias("steps"), F.max_by("top", F.struct("steps", -F.col("top"))).alias("top"))


def ranked(df: DataFrame, order: list) -> DataFrame:
    """``df`` with place, the number of each row in ``order``, without a task that sees all rows.

    Rows are dealt by ranges of the order and written once with their part, so every reader sees the same parts; the
    places inside a part are then shifted by the sizes of the parts before it, of which there are as many as tasks.
    """
    parts = settled(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return local.join(before, "part").withColumn("place", (F.col("place") + F.col("before")).cast("long")).drop("part", "before")
