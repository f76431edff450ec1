"""The similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kairograph.functions import text as X
from kairograph.operators import grams as G


def drawn(seed, n):
    own = random.Random(seed)
    return [" ".join("".join(own.choice("abcde") for _ in range(own.randint(1, 7))) for _ in range(own.randint(1, 3))) for _ in range(n)]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_equals_all_pairs(spark, least):
    questions = [*drawn(1, 60), "", None, "--", "Zürich Ärzte"]
    names = [(i, n) for i, n in enumerate([*drawn(2, 200), *drawn(1, 20), "", None, "zürich", "Zürich ärzte"])] + [(7, "abc abc")]
    q, n = spark.createDataFrame([(x,) for x in questions], "question string"), spark.createDataFrame(names, "id long, name string")
    got = sorted((r["question"], r["id"], round(r["similarity"], 9)) for r in G.similar_names(q, n, least).collect())
    every = q.where("question IS NOT NULL").distinct().crossJoin(n.where("name IS NOT NULL"))
    every = every.withColumn("s", X.trigram_similarity(X.trigrams(F.col("question")), X.trigrams(F.col("name")))).where(F.col("s") >= least)
    assert got == sorted((r["question"], r["id"], round(r["s"], 9)) for r in every.collect()) and got


def test_few_candidates(spark):
    """At a similarity of 0.8 a small share of all pairs is verified."""
    sets = [spark.createDataFrame([(t,) for t in set(drawn(s, 400))], "key string").withColumn("grams", X.trigrams(F.col("key"))) for s in (3, 4)]
    assert G.candidates(*sets, 0.8).count() < 0.05 * sets[0].count() * sets[1].count()


def test_contained_equals_all_pairs(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcé 😀") for _ in range(n))
    names = [(k % 50, word(rng.randint(0, 30))) for k in range(120)] + [(7, None), (8, "long " * 20_000 + "needle")]
    questions = [word(rng.randint(1, 5)) for _ in range(60)] + ["needle", "", None, "missing"]
    got = G.contained(spark.createDataFrame([(q,) for q in questions], "question string"), spark.createDataFrame(names, "id long, name string"))
    want = [(q, i) for q in sorted({q for q in questions if q}) for i, n in names if n is not None and q in n]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert G.contained(spark.createDataFrame([], "question string"), spark.createDataFrame(names, "id long, name string")).count() == 0
