"""Embedding near-duplicates by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: Bytes of a block of vectors (one row of the block table) in double precision, about, and vectors of a tile.
BLOCK_BYTES, TILE = 16 << 20, 1024
#: Slack for rounding in the double-precision norms and products.
SLACK = 1e-9


def unit_rows(vectors: list, size: int | None = None) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantised:
    """Unit rows with their int8 codes, scales and exact lengths of the quantisation errors."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - codes * self.scale[:, None]) ** 2).sum(axis=1))
        self.codes = codes

    def tile(self, rows: slice) -> np.ndarray:
        """Codes of some rows, ready for a product: float32 holds sums of int8 products exactly up to 1000 dimensions."""
        return self.codes[rows].astype(np.float32 if self.codes.shape[1] <= 1000 else np.float64)


def links_of(a: Quantised, b: Quantised, rows: slice, cols: slice, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile with cosine >= ``least``: int8 product first, full precision where its bound allows a link."""
    near = (a.tile(rows) @ b.tile(cols).T) * (a.scale[rows, None] * b.scale[None, cols])
    bound = a.error[rows, None] * (1 + b.error[None, cols]) + b.error[None, cols] + SLACK
    i, j = np.nonzero(near + bound >= least)
    i, j = i + rows.start, j + cols.start
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    hit = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 18):
        own = slice(at, at + (1 << 18))
        hit[own] = (a.unit[i[own]] * b.unit[j[own]]).sum(axis=1) >= least
    return i[hit], j[hit]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links (i, j)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def block_pairs(left: Quantised, right: Quantised, same: bool, least: float):
    """(links per vector, (node, root) links that span each component) of a pair of blocks, tile by tile."""
    n, m = len(left.unit), len(right.unit)
    count, low = np.zeros(n + m, np.int64), np.arange(n + m)
    shift = 0 if same else n
    for r in range(0, n, TILE):
        for c in range(r if same else 0, m, TILE):
            i, j = links_of(left, right, slice(r, min(r + TILE, n)), slice(c, min(c + TILE, m)), least, same and r == c)
            if len(i):
                count += np.bincount(i, minlength=n + m) + np.bincount(j + shift, minlength=n + m)
                low = forest(n + m, np.concatenate([i, np.arange(n + m)]), np.concatenate([j + shift, low]))
    return count, low


def near_vectors(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows with equal, non-null labels link when their cosine in double precision is ``least`` or more; every pair of
    a label is decided by an int8 product with an error bound for each vector, and by a full product where the bound
    leaves it open. component_id is the smallest vec_id reachable by links, itself included.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label, link with nothing, and neither do vectors of different lengths; repeated rows link with each other and
    come out each; a null vec_id keeps its row and is named by the smallest known id of its component; other columns
    are ignored; an empty table gives an empty result.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.7e308)) & F.exists(e, lambda x: x != 0)
    rows = rows.select("vec_id", "label", F.when(whole & F.col("label").isNotNull(), e).alias("embedding")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "vectors")
    valid = rows.where("embedding IS NOT NULL").withColumn("size", F.size("embedding"))
    room = F.greatest(F.lit(TILE), F.floor(BLOCK_BYTES / (8 * F.col("size"))))
    counts = valid.groupBy("label", "size").agg(F.ceil(F.count("*") / room).alias("blocks"))
    dealt = valid.join(counts, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    packed = dealt.groupBy("label", "size", "blocks", "block").agg(F.collect_list(F.struct("row", "embedding")).alias("rows"))
    blocks = materialize(packed.mapInArrow(pack, "label string, size int, blocks long, block long, ids binary, data binary"), "vector-blocks")
    #: each block goes once to each of its pairs; the two sides of a pair stand next to each other in their task
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = blocks.select("*", F.explode(others).alias("other")).select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "label", "size", "block", "ids", "data")
    pair = ["label", "size", "low", "high"]

    def run(batches):
        first = None
        for batch in batches:
            for k in range(batch.num_rows):
                p = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                own = Quantised(unit_rows(np.frombuffer(p["data"]).reshape(-1, p["size"]))), np.frombuffer(p["ids"], np.int64)
                same = p["low"] == p["high"]
                if not same and p["block"] == p["low"]:
                    first = [p[c] for c in pair], own
                    continue
                if not same and (first is None or first[0] != [p[c] for c in pair]):
                    continue  # the hash dealt nothing to the other block
                (left, ids), (right, more) = own if same else first[1], own
                count, low = block_pairs(left, right, same, least)
                ids = np.concatenate([ids, more])
                hit = np.flatnonzero(count)
                yield pa.RecordBatch.from_pydict({"row": ids[hit], "root": ids[low[hit]], "n": count[hit]})

    found = materialize(pairs.repartition(*pair).sortWithinPartitions(*pair, "block").mapInArrow(run, "row long, root long, n long"), "vector-links")
    links = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    comps = connected_components(found.select(F.col("row").alias("src"), F.col("root").alias("dst")), "vector-cc").select(F.col("node").alias("row"), "component")
    named = rows.select("row", "vec_id").join(links, "row", "left").join(comps, "row", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "row").alias("c"))
    lows = named.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    return named.join(lows, "c").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def pack(batches):
    """Blocks of vectors as two byte strings: row numbers and doubles."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows = batch.column("rows")[k].as_py()
            yield pa.RecordBatch.from_pydict({
                "label": [str(batch.column("label")[k].as_py())], "size": pa.array([batch.column("size")[k].as_py()], pa.int32()), "blocks": [batch.column("blocks")[k].as_py()], "block": [batch.column("block")[k].as_py()],
                "ids": [np.array([r["row"] for r in rows], np.int64).tobytes()], "data": [np.array([r["embedding"] for r in rows], np.float64).tobytes()]})
