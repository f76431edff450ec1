"""Merges by key against a plain dictionary; what does not change keeps its files."""

import glob
import random

import pytest

from kairograph.sources.merge import latest, merge, read_merged

SCHEMA = "a long, b string, score double, level int, note string"
RULES = {"score": "greatest", "level": "least", "note": "fill"}


def rows_of(spark, root):
    return {(r["a"], r["b"]): (r["score"], r["level"], r["note"]) for r in read_merged(spark, root, SCHEMA).collect()}


def some(pick, values):
    found = [v for v in values if v is not None]
    return pick(found) if found else None


def plain(table, changes, gone=()):
    for a, b, score, level, note in sorted(changes, key=lambda r: [(v is not None, v) for v in r[2:]]):
        old = table.get((a, b), (None, None, None))
        table[a, b] = some(max, [old[0], score]), some(min, [old[1], level]), old[2] if old[2] is not None else note
    for k in gone:
        table.pop(k, None)
    return table


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng, root, table = random.Random(3), f"file://{tmp_path}/t", {}
    pick = lambda values: rng.choice([*values, None])
    for _ in range(3):
        changes = [(pick(range(40)), pick("xy"), pick([0.5, 1.5, 2.5]), pick([1, 2]), pick("pq")) for _ in range(60)]
        gone = [(pick(range(40)), pick("xy")) for _ in range(5)]
        merge(spark, root, spark.createDataFrame(changes, SCHEMA), ["a", "b"], RULES, spark.createDataFrame(gone, "a long, b string"), buckets=8)
        table = plain(table, changes, gone)
        assert rows_of(spark, root) == table


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(k, "x", 1.0, 1, None) for k in range(200)], SCHEMA)
    assert merge(spark, root, rows, ["a", "b"], RULES, buckets=16) == set(range(16))
    before, files = latest(spark, root), set(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))
    assert merge(spark, root, rows, ["a", "b"], RULES, buckets=16) == set() and latest(spark, root) == before
    assert merge(spark, root, rows.limit(0), ["a", "b"], RULES, buckets=16) == set()
    one = spark.createDataFrame([(7, "x", 3.0, 1, None)], SCHEMA)
    reader = read_merged(spark, root, SCHEMA)
    changed = merge(spark, root, one, ["a", "b"], RULES, buckets=16)
    now = latest(spark, root)
    assert len(changed) == 1 and now[0] == before[0] + 1
    assert {b for b in range(16) if now[1][b] != before[1][b]} == changed
    assert files < set(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))
    assert reader.where("a = 7").first()["score"] == 1.0 and rows_of(spark, root)[7, "x"][0] == 3.0
    assert merge(spark, root, rows.limit(0), ["a", "b"], RULES, rows, buckets=16) == set(range(16)) and rows_of(spark, root) == {}
    merge(spark, root, one, ["a", "b"], RULES, buckets=16)
    assert rows_of(spark, root) == {(7, "x"): (3.0, 1, None)}
    with pytest.raises(ValueError):
        merge(spark, root, rows, ["a", "b"], RULES, buckets=1)


def test_a_merge_that_was_cut_off_leaves_the_version(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    merge(spark, root, spark.createDataFrame([(1, "x", 1.0, 1, None)], SCHEMA), ["a", "b"], RULES, buckets=4)
    spark.createDataFrame([(9, "lost")], "a long, b string").write.parquet(f"{root}/data/2-lost/_bucket=1")
    (tmp_path / "t/commits/version=2/_temporary").mkdir(parents=True)
    assert set(rows_of(spark, root)) == {(1, "x")}
