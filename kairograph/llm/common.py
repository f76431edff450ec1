"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Folders that stand in for a shared one on local masters, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else the checkpoint folder of the context.

    Where neither is set, a temporary folder serves on a local master, which has one disk; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(context.applicationId, "")
        if not found:
            found = _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kairograph/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def places(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (place in its tree, from 0, by ``order``) and ``n`` (rows of the tree).

    Rows are dealt by ranges of tree and order, so a tree of any size spreads over tasks, and written once with their
    number in the range; a range then only needs the counts of the ranges before it, one number for each tree in it.
    """
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("number", F.monotonically_increasing_id())
    dealt = materialize(dealt, "places")
    part = F.shiftright("number", 33).alias("part")
    runs = dealt.groupBy(tree, part).agg(F.min("number").alias("first"), F.count("*").alias("own"))
    earlier = W.partitionBy(tree).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(tree, "part", (F.coalesce(F.sum("own").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("own").over(W.partitionBy(tree)).alias("n"))
    return dealt.withColumn("part", part).join(runs, [tree, "part"]).withColumn("pos", F.col("number") + F.col("shift")).drop("part", "number", "shift")


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``; Spark bounds a batch by rows and by bytes, ``texts`` cuts it further."""
    return df.mapInArrow(run, schema)


def texts(batches: Iterator, column: str = "text", most: int = 4 << 20) -> Iterator[tuple]:
    """Arrow batches as (batch, list of str) pairs cut so that a piece holds about ``most`` bytes of text.

    Null texts become the empty string.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * most / max(1, batch.nbytes))))
        for at in range(0, n, step):
            piece = batch.slice(at, step)
            yield piece, [t or "" for t in piece.column(column).to_pylist()]


def local_forest(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a run of rows replaced by links of each node to the smallest one it reaches in the run."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst: long); component is the smallest node reachable.

    Links are first thinned to forests inside each task, then alternating large-star and small-star rounds run as
    joins and minimum aggregates. Each round is written to the shared folder, so lineage stays short and nothing
    passes through the driver but two numbers a round. Null ends and self-links are ignored. Hub nodes only meet
    partial minima and joins that Spark can split.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    edges = materialize(edges.mapInArrow(local_forest, "u long, v long").distinct(), name)
    before = state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(
            F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, name)
        if (now := state(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"{name}: components not settled after {most_rounds} rounds")
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), "v"))).alias("e")).groupBy("e.node").agg(F.min("e.v").alias("component"))


def state(edges: DataFrame) -> tuple:
    """What tells one set of links from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
