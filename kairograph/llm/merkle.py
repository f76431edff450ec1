"""A Merkle manifest of a table: one tree for each group of rows, one tree over their roots, and a proof for every row.

A leaf is the SHA-256 of a row. Inside a tree, runs of ``FANOUT`` neighbouring nodes become the SHA-256 of their joined
hexadecimal digests, level by level, until one node is left. Trees are cut into aligned blocks of ``FANOUT ** DEPTH``
leaves, each a contiguous matrix of digests that one task hashes level by level; what remains of the blocks is cut into
blocks again. A proof is read off the matrices by index arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, places

FANOUT = 16
#: Levels of a block: blocks of 4,096 leaves are 256 kB of digests.
DEPTH = 3
_HEX = 64
_PATH = "array<struct<at:int,siblings:binary>>"


def row_digest(columns: list[Column]) -> Column:
    """Hexadecimal SHA-256 of the values: null as ``-``, else the count of UTF-8 bytes, a colon and the value."""
    def part(c):
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)), 256)


def levels_above(n: int) -> int:
    """Levels between ``n`` nodes and the one that remains of them."""
    found = 0
    while n > 1:
        n, found = -(-n // FANOUT), found + 1
    return found


def hash_rows(matrix: np.ndarray) -> np.ndarray:
    """The level above a (nodes, 64) matrix of hexadecimal digests; the last run may be short."""
    full = len(matrix) // FANOUT
    rows = [hashlib.sha256(row).hexdigest() for row in matrix[: full * FANOUT].reshape(full, FANOUT * _HEX)]
    if len(matrix) > full * FANOUT:
        rows.append(hashlib.sha256(matrix[full * FANOUT :].tobytes()).hexdigest())
    return np.frombuffer("".join(rows).encode(), np.uint8).reshape(-1, _HEX)


def matrices(digests: bytes, n: int) -> list[np.ndarray]:
    """The levels of a block of a tree with ``n`` nodes, from the given one up to the single node that stands for it."""
    found = [np.frombuffer(digests, np.uint8).reshape(-1, _HEX)]
    for _ in range(min(DEPTH, levels_above(n))):
        found.append(hash_rows(found[-1]))
    return found


def path_in(levels: list[np.ndarray], at: int) -> list[dict]:
    """For the node ``at`` of the lowest level: its place in its run and the run's other digests, on each level."""
    found = []
    for level in levels[:-1]:
        start = at - at % FANOUT
        run = level[start : start + FANOUT]
        found.append({"at": at - start, "siblings": run[: at - start].tobytes() + run[at - start + 1 :].tobytes()})
        at //= FANOUT
    return found


def fold(digest: bytes, path: list[dict]) -> str:
    """The root that ``digest`` gives with the siblings of ``path``."""
    for step in path:
        cut = step["at"] * _HEX
        digest = hashlib.sha256(step["siblings"][:cut] + digest + step["siblings"][cut:]).hexdigest().encode()
    return digest.decode()


def proof_digest(path: list[dict]) -> str:
    found = hashlib.sha256()
    for step in path:
        found.update(step["siblings"])
    return found.hexdigest()


def blocks_of(nodes: DataFrame, carried: list[str], name: str) -> DataFrame:
    """One row for each aligned block of ``nodes`` (tree, pos, n, digest, carried columns).

    Gives tree, pos (the block's number), n (blocks of the tree), below (nodes of the tree), digest (what remains of the
    block), digests (its nodes' digests in one piece) and an array of each carried column. A block is bounded by design.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    size = FANOUT**DEPTH
    schema = "tree string, pos long, n long, below long, digest string, digests binary" + "".join(f", `{c}` array<{kinds[c]}>" for c in carried)

    def lift(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        below = block.column("n")[0].as_py()
        digests = "".join(block.column("digest").to_pylist()).encode()
        top = matrices(digests, below)[-1]
        out = {"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-below // size)], "below": [below], "digest": [top.tobytes().decode()], "digests": [digests]}
        for c in carried:
            column = block.column(c).combine_chunks()
            out[c] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        return pa.table(out)

    rows = nodes.select("tree", "pos", "n", "digest", *carried).groupBy("tree", F.floor(F.col("pos") / size).alias("block"))
    return materialize(rows.applyInArrow(lift, schema), name)


def ascend(nodes: DataFrame, name: str) -> DataFrame:
    """(tree, pos, path, top) for ``nodes`` (tree, pos, n, digest): siblings up to the tree's last node, and that node."""
    most = nodes.agg(F.max("n")).first()[0]
    if most is None or most <= 1:
        return nodes.select("tree", "pos", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
    blocks = blocks_of(nodes, [], name)
    above = ascend(blocks, name).withColumnsRenamed({"path": "above"})

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                levels = matrices(block["digests"], block["below"])
                own = range(len(levels[0]))
                yield pa.RecordBatch.from_pydict({
                    "tree": [block["tree"]] * len(own), "pos": [block["pos"] * FANOUT**DEPTH + k for k in own],
                    "path": [path_in(levels, k) + block["above"] for k in own], "top": [block["top"]] * len(own)}, kind)

    kind = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.binary())]))), ("top", pa.string())])
    return materialize(blocks.select("tree", "pos", "below", "digests").join(above, ["tree", "pos"]).mapInArrow(descend, f"tree string, pos long, path {_PATH}, top string"), name)


def merkle_manifest(docs: DataFrame, columns: tuple = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", key: str = "doc_id", received: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    One tree for each value of ``group``, leaves by ascending ``key``; the trees' roots, by group, make the root.
    ``received`` replaces columns by what came in from elsewhere: the leaf of the received row is folded with the
    original siblings, and ``verified`` tells whether that gives the root. Without it all rows are verified.

    Nulls in any column are hashed as such; a null group is a tree of its own before the others, a null key comes
    first in its tree, rows of one key are ordered by their leaf, and repeated rows are leaves of their own. A tree of
    one row is that leaf, a table of one tree is its subroot. An empty table gives no rows. Columns not named are
    left out, so their names cannot clash.
    """
    changed = {c: F.col(c) for c in columns} | (received or {})
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), row_digest([F.col(c) for c in columns]).alias("digest"), row_digest([changed[c] for c in columns]).alias("now"))
    blocks = blocks_of(places(rows, "tree", ["key", "digest"]), ["key", "now"], "merkle-blocks")
    above = ascend(blocks, "merkle-levels")
    tops = above.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    tops = materialize(places(tops, "tree", ["name"]), "merkle-tops")
    roots = tops.select("name", "pos").join(ascend(tops, "merkle-root"), "pos").select(F.col("name").alias("tree"), F.col("path").alias("last"), F.col("top").alias("root"))
    kind = docs.schema[key].dataType.simpleString()

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in enumerate(batch.select(["below", "digests", "path", "top", "last", "root", "now"]).to_pylist()):
                levels = matrices(block["digests"], block["below"])
                above = block["path"] + block["last"]
                found = {"key": batch.column("key")[at].values, "leaf": [], "proof_sha256": [], "folded_root": []}
                for k, now in enumerate(block["now"]):
                    path = path_in(levels, k) + above
                    found["leaf"].append(levels[0][k].tobytes().decode())
                    found["proof_sha256"].append(proof_digest(path))
                    found["folded_root"].append(fold(now.encode(), path))
                n = len(found["leaf"])
                yield pa.RecordBatch.from_pydict(found | {"subroot": [block["top"]] * n, "root": [block["root"]] * n, "verified": [x == block["root"] for x in found["folded_root"]]})

    schema = f"key {kind}, leaf string, proof_sha256 string, folded_root string, subroot string, root string, verified boolean"
    rows = blocks.select("tree", "pos", "below", "digests", "key", "now").join(above, ["tree", "pos"]).join(roots, "tree").mapInArrow(prove, schema)
    return rows.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
