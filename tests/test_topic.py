"""Ward's rule and classical scaling against the textbook."""

import numpy as np
import pytest

from kairograph.operators import layout, topic

MEMBERS = "id long, grp long, profile array<struct<topic:long,x:double>>"


def textbook_ward(x, parts):
    """Merges the pair of the least rise, from the whole table of pairs."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > parts:
        means, sizes = np.array([x[g].mean(0) for g in groups]), np.array([len(g) for g in groups])
        cost = sizes[:, None] * sizes[None] / (sizes[:, None] + sizes[None]) * ((means[:, None] - means[None]) ** 2).sum(-1)
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(np.unravel_index(cost.argmin(), cost.shape))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def sets(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)}


@pytest.mark.parametrize("seed", range(4))
def test_chains_equal_the_textbook(seed):
    x = np.random.default_rng(seed).normal(0, 1, (90, 5)) + 3 * (np.arange(90) % 4)[:, None]
    for parts in (1, 2, 7, 90):
        assert sets(topic.ward_chain(x, np.ones(90), parts)) == textbook_ward(x, parts)


def test_weights_stand_for_repeated_points():
    x = np.random.default_rng(9).normal(0, 1, (12, 3))
    m = np.array([1, 3, 2, 1, 4, 1, 1, 2, 5, 1, 1, 2])
    many = topic.ward_chain(np.repeat(x, m, axis=0), np.ones(m.sum()), 4)
    assert sets(topic.ward_chain(x, m, 4)) == sets(many[np.cumsum(m) - m])


def rows(x, grp, start=0):
    return [(start + i, grp, [(k, float(v)) for k, v in enumerate(p) if v]) for i, p in enumerate(x)]


def test_groups_are_split(spark):
    draw = np.random.default_rng(3)
    x = np.abs(draw.normal(0, 0.1, (130, 6))) + np.eye(6)[np.arange(130) % 4]
    df = spark.createDataFrame(rows(x, 1) + rows(x[:20], 2, 1000), MEMBERS)
    got = {r["id"]: (r["grp"], r["part"]) for r in topic.split_groups(df, least=60, per_part=40).collect()}
    assert {got[1000 + i] for i in range(20)} == {(2, 0)}
    labels = np.array([got[i][1] for i in range(130)])
    assert sets(labels) == textbook_ward(x, 4) and [labels.tolist().index(k) for k in range(4)] == sorted(labels.tolist().index(k) for k in range(4))


def test_large_groups_are_summed_first(spark):
    """With 50 micro-clusters for 400 members in four far groups the parts are still those groups."""
    x = np.abs(np.random.default_rng(5).normal(0, 0.02, (400, 6))) + np.eye(6)[np.arange(400) % 4]
    got = {r["id"]: r["part"] for r in topic.split_groups(spark.createDataFrame(rows(x, 1), MEMBERS), least=60, per_part=100, micro=50).collect()}
    assert sets(np.array([got[i] for i in range(400)])) == {frozenset(range(k, 400, 4)) for k in range(4)}


def test_scaling_is_exact_up_to_the_landmarks(spark):
    x = np.abs(np.random.default_rng(2).normal(0, 1, (40, 4)))
    df = spark.createDataFrame(rows(x, 1) + rows(x[:1], 2, 100) + rows(np.repeat(x[:1], 3, axis=0), 3, 200), MEMBERS)
    got = {r["id"]: (r["x"], r["y"]) for r in topic.landmark_mds(df).collect()}
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    want, have = layout.classical_mds(1 - unit @ unit.T), np.array([got[i] for i in range(40)])
    for k in (0, 1):
        assert np.allclose(have[:, k], want[:, k], atol=1e-6) or np.allclose(have[:, k], -want[:, k], atol=1e-6)
    assert got[100] == (0.0, 0.0) and np.allclose([got[200], got[201], got[202]], 0, atol=1e-6)


def test_scaling_by_landmarks_keeps_distances(spark):
    """Members placed by landmarks stand where scaling of all would put them."""
    angle = np.random.default_rng(4).uniform(0, np.pi / 2, 300)
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    got = {r["id"]: r["x"] for r in topic.landmark_mds(spark.createDataFrame(rows(x, 1), MEMBERS), landmarks=30).collect()}
    along = np.array([got[i] for i in range(300)])
    want = layout.classical_mds(1 - x @ x.T)[:, 0]
    assert abs(np.corrcoef(along, want)[0, 1]) > 0.99


def test_empty(spark):
    df = spark.createDataFrame([], MEMBERS)
    assert topic.split_groups(df).count() == 0 and topic.landmark_mds(df).count() == 0
