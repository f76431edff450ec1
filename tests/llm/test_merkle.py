import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from kairograph.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, for each node its siblings as lists of (before, after) by level)."""
    level, paths, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        for k, p in enumerate(at):
            start = p - p % 16
            paths[k].append((level[start:p], level[p + 1 : start + 16]))
            at[k] = p // 16
        level = [digest(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def brute(rows, change):
    rows = sorted(rows, key=lambda r: (r.source is not None, (r.source or "").encode(), r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    trees = [(own := list(g), *tree([leaf_of(r, r.text) for r in own])) for _, g in groupby(rows, key=lambda r: r.source)]
    root, tops = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            now = leaf_of(r, change(r))
            for before, after in path + top:
                now = digest(*before, now, *after)
            proof = digest(*(d for before, after in path + top for d in before + after))
            out.append((r.doc_id, leaf_of(r, r.text), subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


def lowered(r):
    if r.text is None or r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5:
        return r.text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)


def test_query_equals_plain_hashing(spark, sf_dir):
    got = queries.QUERIES["op11_merkle_manifest"](spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), lowered)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [4096], [4097, 3], [70_000, 16, 1, 257]])
def test_trees_of_all_sizes(spark, sizes):
    rows = [(k, f"Text {k}", "en", f"s{s}", k) for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    hit = F.col("doc_id") % 3 == 0
    got = merkle.merkle_manifest(docs, received={"text": F.when(hit, F.lower("text")).otherwise(F.col("text"))})
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs.collect(), lambda r: r.text.lower() if r.doc_id % 3 == 0 else r.text)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "", "", 0), (2, "Été ÀB\n" * 3, None, "=", None), (2, "Été ÀB\n" * 3, None, "=", None), (5, "A" * 300_000, "en", None, -7), (5, "b", "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("key", F.lit(2))
    got = merkle.merkle_manifest(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs.collect(), lambda r: r.text)
    assert all(r.verified for r in got.collect())


def test_empty_table(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_hash_alike_in_blocks():
    levels = merkle.matrices("".join(digest(str(k)) for k in range(4096)).encode(), 5000)
    assert [len(x) for x in levels] == [4096, 256, 16, 1]
    assert merkle.levels_above(5000) == 4
    assert merkle.fold(digest("77").encode(), merkle.path_in(levels, 77)) == levels[-1].tobytes().decode()
