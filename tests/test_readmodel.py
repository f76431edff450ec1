"""What may not reach a map view."""

from kairograph.plans.readmodel import sanitised


def test_broken_rows_go(spark):
    nan, inf = float("nan"), float("inf")
    dots = spark.createDataFrame([(1, 0.0, 0.0, 1, "A"), (2, nan, 0.0, 1, "A"), (3, 0.0, inf, 1, "A"), (4, 1.0, None, 1, "A"), (5, 1.0, 1.0, 2, "B"), (6, 1.0, 1.0, None, None), (7, 1.0, 1.0, 9, "C")], "id long, x double, y double, cluster long, cluster_label string")
    clusters = spark.createDataFrame([(1, 0.0, 0.0), (2, nan, 0.0), (3, 1.0, 1.0)], "id long, cx double, cy double")
    edges = spark.createDataFrame([(1, 3, 2.0, 0.5), (1, 3, nan, 0.5), (1, 2, 2.0, 0.5), (9, 1, 2.0, 0.5), (3, 1, 1.0, None), (1, 3, 1.0, -inf)], "source long, target long, collaboration_weight double, topic_weight double")
    points, known, ties = sanitised(dots, clusters, edges)
    assert sorted((r["id"], r["cluster"], r["cluster_label"]) for r in points.collect()) == [(1, 1, "A"), (5, None, None), (6, None, None), (7, None, None)]
    assert sorted(r["id"] for r in known.collect()) == [1, 3]
    assert sorted(tuple(r)[:3] for r in ties.collect()) == [(1, 3, 2.0), (3, 1, 1.0)]
