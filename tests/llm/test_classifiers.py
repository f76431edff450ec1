import pickle

import numpy as np
from pyspark.sql import functions as F

from kairograph.llm import quality, queries, toxicity

BIG = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(np.array(score)[order], return_inverse=True, return_counts=True)
    ranks = np.empty(len(score))
    ranks[order] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    pos = np.array(label) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = queries.op9_toxicity(spark, BIG).join(labels, "doc_id").where("held_out").collect()
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    flagged = [r["toxic"] for r in rows if r["predicted"]]
    assert np.mean(flagged) > 0.9


def insult_and_group(rng, n):
    """Insult or group alone are clean, together toxic; some clean texts hold neither, 20 other terms stand around."""
    rows, y = [], []
    for _ in range(n):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted({toxicity.ALWAYS, *([5] if a else [6]), *([9] if b else [10]), *map(int, rng.integers(100, 400, 20))})))
        y.append(float((a and b) or (not a and not b and rng.random() < 0.3)))
    return rows, np.array(y)


def test_factors_tell_what_weights_miss():
    rng = np.random.default_rng(1)
    machine = toxicity.FactorizationMachine.fit(*insult_and_group(rng, 3000))
    rows, y = insult_and_group(rng, 1000)
    full = auc(machine.score(rows), y)
    machine.factors = machine.factors * 0
    assert full > auc(machine.score(rows), y) + 0.03


def test_factors_count_on_held_out_documents(spark):
    """Without its factors the fitted machine orders held-out documents worse."""
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    machine = toxicity.fit(docs, labels.where(fold != 1))
    rows = docs.join(labels, "doc_id").where(fold == 1).select("text", "toxic").collect()
    terms, y = [toxicity.hashed_terms(r["text"] or "") for r in rows], [r["toxic"] for r in rows]
    full = machine.score(terms)
    machine.factors = machine.factors * 0
    assert auc(full, y) > 0.9 and np.abs(full - machine.score(terms)).max() > 0.05


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "moron " * 50_000, 1.0), (3, "moron", 1.0), (None, "x", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, none).collect()
    assert len(got) == 5 and all(r["score"] is not None and not np.isnan(r["score"]) for r in got)
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 1), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, odd).count() == 5


def test_quality_on_rows_left_out(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = quality.score_quality(docs, labels.where(fold != 1)).join(labels, "doc_id").where(fold == 1).collect()
    assert auc([r["quality_score"] for r in rows], [r["quality"] for r in rows]) > 0.9
    good = [r["quality_keep"] for r in rows if r["quality"] == 1]
    assert np.mean(good) > 0.95


def test_both_views_teach(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = quality.fit(docs, labels)
    assert len(model.taught) == quality.ROUNDS and all(to_text >= 20 and to_meta >= 20 for to_text, to_meta in model.taught)
    assert len(np.concatenate(model.targets[0])) > len(model.targets[0][0]) and len(np.concatenate(model.targets[1])) > len(model.targets[1][0])


def test_a_view_teaches_what_the_other_cannot_tell(spark):
    """Sources tell the label; the few labelled texts do not show it, those that the metadata view labels do."""
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for k in range(1200):
        good = int(rng.integers(0, 2))
        plain = " ".join(["word", "other", "thing"][i] for i in rng.integers(0, 3, 30))
        text = plain + ("" if k < 60 else " ~" * 20 if good else " ^" * 20)
        rows.append((k, text, "good" if good else "bad", "en", 100))
        if k < 60:
            marks.append((k, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    truth = np.array([r[2] == "good" for r in rows[60:]], float)
    score = lambda m: m.models[0].logit(np.array([quality.text_view(r[1]) for r in rows[60:]]))
    assert auc(score(quality.fit(docs, labels)), truth) > auc(score(quality.fit(docs, labels, rounds=0)), truth) + 0.1


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 7), (2, "", "s", "en", 0, 7), (2, "", "s", "en", 0, 7), (None, "a | b " * 40_000, "s", "en", 5, 7)], "doc_id long, text string, source string, lang string, n_chars long, p_text int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["quality_keep"] for r in quality.score_quality(docs, none).collect()] == [True] * 4
    assert quality.drop_low_quality(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    more = spark.createDataFrame([(k, "###" * 9 if k % 2 == 0 else "plain words here", "s", "en", 9, 7) for k in range(40)], docs.schema)
    assert quality.score_quality(docs.union(more), some).count() == 44


def test_repeated_documents_do_not_pass_the_bound(spark):
    docs = spark.range(600).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(6).cast("long").alias("n_chars"))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(3)], "doc_id long, quality int, toxic int")
    assert toxicity.training_texts(docs, labels, 2).count() == 2 and toxicity.training_texts(docs, labels, 3).count() == 3
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array(F.lit(1.0)).alias("x"), F.array(F.lit(1)).alias("slots"), F.lit(1).alias("quality"), F.lit(True).alias("known"))
    assert quality.one_of_each(rows).count() == 3


def test_what_is_sent_to_score_holds_no_rows():
    """The broadcast of a quality model does not grow with the rows it was fitted on, and scores the same."""
    rng, sizes = np.random.default_rng(3), []
    for n in (1000, 8000):
        text, slots = rng.random((n, 5)), np.column_stack([rng.integers(0, 64, n), 64 + rng.integers(0, 16, n), 80 + rng.integers(0, 12, n)])
        model = quality.CoTrained(text, quality.one_hot(slots), (rng.random(n) < 0.5).astype(float))
        data = pickle.dumps(model)
        sizes.append(len(data))
        for x, y in zip(model.score(text, quality.one_hot(slots)), pickle.loads(data).score(text, quality.one_hot(slots)), strict=True):
            assert np.array_equal(x, y)
    assert max(sizes) < 50_000
