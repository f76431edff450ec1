"""Similarity joins over sets of grams: many questions against all names at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .components import settled


def prefixes(sets: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """(key, size, gram): of each set (key, grams) its rarest grams, one more than a partner of ``least`` can do without.

    A partner shares at least ``least`` of the set, so it holds one of these; the same order of rarity on both sides
    makes two such sets meet in them.
    """
    rows = sets.select("key", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(often, "gram", "left")
    place = F.row_number().over(W.partitionBy("key").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    return rows.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("key", "size", "gram")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of sets (key, grams) that share a rare gram and whose sizes allow a similarity of ``least``."""
    often = right.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    a, b = (prefixes(s, often, least).select(F.col("key").alias(k), F.col("size").alias("size_" + k), "gram") for s, k in ((left, "a"), (right, "b")))
    fits = (F.col("size_a") * least <= F.col("size_b") + 1e-9) & (F.col("size_b") * least <= F.col("size_a") + 1e-9)
    return a.join(b, "gram").where(fits).select("a", "b").distinct()


def similar_names(questions: DataFrame, names: DataFrame, least: float = 0.3) -> DataFrame:
    """(question, id, similarity): every question (question) with every name (id, name) of a trigram similarity of ``least``.

    Postings of rare grams bring pairs together, sizes leave out what cannot reach the bound, and each pair is verified
    on its whole sets. Nulls and texts without letters or digits are like nothing. Repeated questions count once, repeated
    ids give a row each.
    """
    left = questions.select("question").where("question IS NOT NULL").distinct().select(F.col("question").alias("key"), X.trigrams(F.col("question")).alias("grams"))
    right = settled(names.where("name IS NOT NULL").select(F.monotonically_increasing_id().alias("key"), "id", X.trigrams(F.col("name")).alias("grams")))
    left, some = settled(left.where(F.size("grams") > 0)), right.where(F.size("grams") > 0)
    pairs = candidates(left, some.select("key", "grams"), least)
    both = pairs.join(left.toDF("a", "x"), "a").join(some.toDF("b", "id", "y"), "b")
    return both.select(F.col("a").alias("question"), "id", similarity("x", "y").alias("similarity")).where(F.col("similarity") >= least)


def similarity(x: str, y: str) -> Column:
    return X.trigram_similarity(F.col(x), F.col(y))


def runs_of(rows: DataFrame, text: str, lengths: list[int], *keep: str) -> DataFrame:
    """``keep`` and gram: the different runs of characters of each text, of each of the ``lengths``."""
    chars = rows.select(*keep, F.split(text, "").alias("chars"))

    def run(n: int) -> Column:
        return F.transform("chars", lambda c, i: F.concat(c, *[F.get("chars", i + k) for k in range(1, n)]))

    return chars.select(*keep, F.explode(F.array_distinct(F.concat(*map(run, lengths)))).alias("gram")).where("gram IS NOT NULL")


def contained(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question, id): every question (question) with every row of names (id, name) that it stands in, as it is written.

    A question meets the names that hold its rarest run of three characters (a shorter question: all of it), and each
    pair is verified; a run is weighed by the names that hold it. Null and empty questions stand in nothing, repeated
    ones count once; repeated names give a row each.
    """
    q = settled(questions.select("question").where("length(question) > 0").distinct().withColumn("size", F.least(F.lit(3), F.length("question"))))
    sizes = sorted(r[0] for r in q.select("size").distinct().collect())
    if not sizes:
        return names.limit(0).select(F.lit("").alias("question"), "id")
    runs = reduce(DataFrame.union, [runs_of(q.where(F.col("size") == n), "question", [n], "question") for n in sizes])
    runs = settled(runs)
    rows = settled(names.where("name IS NOT NULL").select(F.monotonically_increasing_id().alias("key"), "id", "name"))
    postings = settled(runs_of(rows, "name", sizes, "key").join(runs.select("gram").distinct(), "gram", "left_semi"))
    often = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = runs.join(often, "gram", "left").groupBy("question").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("question", "r.gram")
    pairs = postings.join(rarest, "gram").select("question", "key")
    return pairs.join(rows, "key").where(F.contains("name", F.col("question"))).select("question", "id")
