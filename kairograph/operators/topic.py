"""Splitting groups by Ward's rule and placing them by their profiles, with bounded memory for groups of any size.

A group of more than ``MICRO`` members is first summed into that many micro-clusters around members drawn by hash; Ward's
rule then runs on sizes and means alone. Distances are looked up along chains of nearest neighbours, never kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import settled

#: Members of a group that one task works on; more are summed into so many micro-clusters.
MICRO = 2000
#: Members of a group that a layout measures distances to.
LANDMARKS = 128


def dense(profiles: pd.Series, size: int | None = None) -> np.ndarray:
    """Profiles, lists of (topic, x) by rising topic, as rows of a matrix."""
    size = size or 1 + max((p[-1]["topic"] for p in profiles if len(p)), default=0)
    out = np.zeros((len(profiles), size))
    for k, p in enumerate(profiles):
        for c in p:
            out[k, c["topic"]] = c["x"]
    return out


def ward_chain(means: np.ndarray, sizes: np.ndarray, parts: int) -> np.ndarray:
    """``parts`` clusters of weighted points by the least rise of the squares, numbered by their first point.

    Each step follows the chain of nearest neighbours to two clusters that are each other's nearest and joins them; the
    joins of the least rise, n - parts of them, make the clusters. Memory is linear: only one row of distances at a time.
    """
    n = len(means)
    means, sizes, alive = means.astype(float).copy(), sizes.astype(float).copy(), np.ones(n, bool)
    joins, chain = [], []
    while len(joins) < n - 1:
        if not chain:
            chain = [int(alive.argmax())]
        i = chain[-1]
        cost = sizes * sizes[i] / (sizes + sizes[i]) * ((means - means[i]) ** 2).sum(1)
        cost[~alive] = np.inf
        cost[i] = np.inf
        j = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
            j = chain[-2]
            chain = chain[:-2]
            low, high = min(i, j), max(i, j)
            joins.append((cost[j], len(joins), low, high))
            means[low] = (means[low] * sizes[low] + means[high] * sizes[high]) / (sizes[low] + sizes[high])
            sizes[low] += sizes[high]
            alive[high] = False
        else:
            chain.append(j)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for _, _, i, j in sorted(joins)[: max(0, n - parts)]:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return np.unique([find(x) for x in range(n)], return_inverse=True)[1]


def count_topics(members: DataFrame) -> int:
    return 1 + (members.select(F.max(F.try_element_at("profile", F.lit(-1))["topic"])).first()[0] or 0)


def in_chunks(members: DataFrame, marks: DataFrame, work, schema: str, size: int = 4096) -> DataFrame:
    """``work``(members, marks) on chunks of about ``size`` members of each group, each with all marks of the group."""
    chunks = members.groupBy("grp").agg(F.ceil(F.count("*") / size).alias("chunks"))
    left = members.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).drop("chunks")
    right = marks.join(chunks, "grp").select("grp", "mark", "profile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = right.select(*[F.col(c).alias(c) for c in ("grp", "mark", "profile")], F.col("chunk").cast("long").alias("chunk"))
    return left.groupBy("grp", "chunk").cogroup(right.groupBy("grp", "chunk")).applyInPandas(lambda own, m: work(own, m) if len(own) else own_empty(schema), schema)


def own_empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame({part.split()[0]: [] for part in schema.split(", ")})


def split_groups(members: DataFrame, least: int = 60, per_part: int = 40, micro: int | None = None) -> DataFrame:
    """(id, grp, part) of ``members`` (id, grp, profile): groups of over ``least`` members in parts of about ``per_part``.

    Parts are numbered by their smallest member, or micro-cluster seed, from 0; smaller groups are part 0.
    """
    micro = micro or MICRO
    sizes = members.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > least)
    large = settled(members.join(sizes, "grp"))
    drawn = large.withColumn("at", F.row_number().over(W.partitionBy("grp").orderBy(F.xxhash64("id"), "id"))).where(F.col("at") <= micro)
    seeds = settled(drawn.select("grp", F.col("id").alias("seed"), "profile"))
    topics = count_topics(members)

    def nearest(own: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        marks = marks.sort_values("mark")
        ids, table = marks["mark"].to_numpy(), dense(marks["profile"], topics)
        near = ((table**2).sum(1)[None] - 2 * dense(own["profile"], topics) @ table.T).argmin(1)
        return pd.DataFrame({"id": own["id"], "grp": own["grp"], "seed": np.where(np.isin(own["id"], ids), own["id"], ids[near])})

    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    placed = settled(in_chunks(large.select("id", "grp", "profile"), seeds.withColumnRenamed("seed", "mark"), nearest, f"id {kinds['id']}, grp {kinds['grp']}, seed {kinds['id']}"))
    cells = placed.join(large.select("id", "profile"), "id").select("grp", "seed", F.explode("profile").alias("c")).groupBy("grp", "seed", "c.topic").agg(F.sum("c.x").alias("x"))
    counts = placed.groupBy("grp", "seed").agg(F.count("*").alias("m"))
    sums = cells.groupBy("grp", "seed").agg(F.array_sort(F.collect_list(F.struct("topic", "x"))).alias("profile"))
    micros = counts.join(sums, ["grp", "seed"]).join(sizes, "grp")

    def ward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seed")
        m = pdf["m"].to_numpy(float)
        labels = ward_chain(dense(pdf["profile"], topics) / m[:, None], m, max(2, -(-int(pdf["n"].iloc[0]) // per_part)))
        return pd.DataFrame({"grp": pdf["grp"], "seed": pdf["seed"], "part": labels})

    parts = micros.groupBy("grp").applyInPandas(ward, f"grp {kinds['grp']}, seed {kinds['id']}, part long")
    split = placed.join(parts, ["grp", "seed"]).select("id", "grp", "part")
    whole = members.join(sizes, "grp", "left_anti").select("id", "grp", F.lit(0).cast("long").alias("part"))
    return settled(split.union(whole))


def landmark_mds(members: DataFrame, landmarks: int | None = None) -> DataFrame:
    """(grp, id, x, y): classical scaling of each group by the distances 1 - cosine of the profiles of ``members`` (grp, id, profile).

    Up to ``landmarks`` members of a group, drawn by hash, are scaled exactly; the others are placed by their distances
    to these, which for a landmark gives its own place. So a group of up to that many members is scaled exactly, and no
    group is gathered. Each axis points to the landmark that is farthest out on it; a single member stands at the origin.
    """
    landmarks = landmarks or LANDMARKS
    drawn = members.withColumn("at", F.row_number().over(W.partitionBy("grp").orderBy(F.xxhash64("id"), "id"))).where(F.col("at") <= landmarks)
    marks = settled(drawn.select("grp", F.col("id").alias("mark"), "profile"))
    topics = count_topics(members)
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)

    def place(own: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        table = unit(dense(marks.sort_values("mark")["profile"], topics))
        square = (1 - table @ table.T) ** 2
        mean = square.mean(0)
        values, vectors = np.linalg.eigh(-0.5 * (square - mean[None] - mean[:, None] + mean.mean()))
        values, vectors = np.maximum(values[::-1][:2], 0), vectors[:, ::-1][:, :2]
        vectors = vectors * np.where(vectors[np.abs(vectors).round(9).argmax(0), range(vectors.shape[1])] < 0, -1, 1)
        axes = vectors / np.sqrt(np.where(values > 1e-12, values, np.inf))
        xy = -0.5 * ((1 - unit(dense(own["profile"], topics)) @ table.T) ** 2 - mean[None]) @ axes
        xy = np.pad(xy, ((0, 0), (0, 2 - xy.shape[1])))
        return pd.DataFrame({"grp": own["grp"], "id": own["id"], "x": xy[:, 0], "y": xy[:, 1]})

    return settled(in_chunks(members.select("id", "grp", "profile"), marks, place, f"grp {kinds['grp']}, id {kinds['id']}, x double, y double"))
