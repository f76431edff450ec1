import math

import numpy as np
import pytest

from kairograph.llm import embeddings, queries


def reference(rows, least):
    ok = [(k, np.array(v, float) / np.linalg.norm(v), g) for k, v, g in rows if v and g is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    parent = {k: k for k, *_ in rows}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, u, g) in enumerate(ok):
        for b, v, h in ok[i + 1:]:
            if g == h and u @ v >= least:
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: (links[k], find(k), find(k) == k) for k in parent}


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = reference(rows, 0.93)
    got = {r["vec_id"]: tuple(r)[1:] for r in queries.op4_embedding_near_dedup(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize(("block", "tile"), [(16, 7), (3, 1), (1000, 10)])
def test_blocks_and_tiles(spark, monkeypatch, block, tile):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", block * 96)
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (4, 12))
    rows = [(k, (centre[k % 4] + rng.normal(0, 0.22, 12)).tolist(), k % 2) for k in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: tuple(r)[1:] for r in embeddings.near_vectors(df).collect()} == reference(rows, 0.93)


def test_bounds_are_rigorous():
    x = embeddings.unit_rows(np.random.default_rng(0).normal(0, 1, (200, 64)).tolist())
    q = embeddings.Quantised(x)
    near = (q.tile(slice(None)) @ q.tile(slice(None)).T) * (q.scale[:, None] * q.scale[None, :])
    bound = q.error[:, None] * (1 + q.error[None, :]) + q.error[None, :] + embeddings.SLACK
    assert (np.abs(near - x @ x.T) <= bound).all()


def test_edge_cases(spark):
    rows = [(1, None, 1, 0), (2, [], 1, 0), (3, [0.0, 0.0], 1, 0), (4, [1.0, None], 1, 0), (5, [1.0, math.nan], 1, 0), (6, [1.0, 2.0], None, 0), (7, [1.0, 2.0], 1, 0), (8, [2.0, 4.0], 1, 0), (8, [2.0, 4.0], 1, 0), (9, [1e30, 2e30], 1, 0), (None, [1.0, 2.1], 1, 0), (10, [1.0, 2.0, 0.0], 1, 0), (11, [math.inf, 1.0], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    got = embeddings.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert by[7]["n_links"] == 4 and by[9]["component_id"] == 7 and by[None]["component_id"] == 7 and not by[8]["kept"]
    assert all(by[k]["n_links"] == 0 and by[k]["kept"] for k in (1, 2, 3, 4, 5, 6, 10, 11))
    assert embeddings.near_vectors(df.limit(0)).count() == 0
