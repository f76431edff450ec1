"""License scan with DataFrame functions only: TF-IDF cosine to templates, then inheritance from directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize
from .license_texts import TEMPLATES

#: Words of a window, words from one to the next, and the least cosine that names a license.
WINDOW, STRIDE, LEAST = 40, 20, 0.6
#: ASCII characters that part words: all but letters, digits, dots and plus signs.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in ".+")
#: Buckets of hashed terms outside the templates, whose counts bound the frequency of each from above.
BUCKETS = 1 << 16
#: Parts that the descendants of a directory are dealt to in the path join.
SALTS = 16


def tokens(c):
    """Lower-case terms; dots at either end belong to no term, letters of other scripts do."""
    plain = F.translate(F.lower(c), PARTING, " " * len(PARTING))
    return F.filter(F.transform(F.split(plain, " +"), lambda t: F.trim(t, F.lit("."))), lambda t: t != "")


def bucket_of(term):
    return F.concat(F.lit("#"), F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("string"))


def parent_of(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", ""))


def weighted(tf):
    return 1 + F.log(tf)


def inverse(df, n):
    return F.log((n + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def pieces_of(files: DataFrame, terms: list[str]) -> DataFrame:
    """(key, piece, w): the pieces of ``files`` (key, text, w, whole) that hold one of ``terms``.

    Pieces are the lines of at most WINDOW words, windows of WINDOW words over the whole text whatever its lines (so
    that a notice wrapped over lines or in the midst of a long one is seen), and the whole of a license file.
    """
    held = lambda w: F.arrays_overlap(w, F.lit(terms))
    lines = F.filter(F.transform(F.split("text", "\r\n|\r|\n"), tokens), lambda w: (F.size(w) <= WINDOW) & held(w))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(STRIDE))
    windows = F.filter(F.transform(starts, lambda at: F.slice("w", at + 1, F.lit(WINDOW))), held)
    whole = F.when(F.col("whole"), F.array("w")).otherwise(F.array().cast("array<array<string>>"))
    return files.where(held(F.col("w"))).select("key", F.posexplode(F.concat(lines, windows, whole)).alias("piece", "w"))


def best_license(files: DataFrame, least: float) -> DataFrame:
    """(key, license, score) of the ``files`` (key, text, whole) that reach ``least``.

    The cosine is over all terms of a piece, with their frequencies over all files. What can't reach ``least`` is left
    out early, without loss: the light terms of a template that together weigh less than ``least`` of it don't suffice
    alone, and terms outside the templates weigh in the length of a piece at least what the count of their bucket says.
    """
    spark = files.sparkSession
    names = [(name, k, t) for name, own in TEMPLATES.items() for k, t in enumerate(own)]
    shapes = spark.createDataFrame(names, "license string, k int, t string").select("license", "k", F.explode(tokens(F.col("t"))).alias("term")).groupBy("license", "k", "term").agg(weighted(F.count("*")).alias("tf"))
    shapes = materialize(shapes, "license-shapes")
    vocabulary = sorted(r["term"] for r in shapes.select("term").distinct().collect())
    files = files.withColumn("w", tokens(F.col("text")))
    n = files.count()
    in_files = files.select(F.explode(F.array_distinct("w")).alias("term"))
    counted = materialize(in_files.select(F.when(F.col("term").isin(vocabulary), F.col("term")).otherwise(bucket_of(F.col("term"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "license-counts")
    known = materialize(shapes.select("term").distinct().join(counted, "term", "left").select("term", inverse(F.col("df"), F.lit(n)).alias("idf")), "license-known")
    shaped = shapes.join(known, "term").withColumn("y", F.col("tf") * F.col("idf"))
    by = Window.partitionBy("license", "k")
    shaped = shaped.withColumn("norm", F.sqrt(F.sum(F.col("y") ** 2).over(by))).withColumn("below", F.sum(F.col("y") ** 2).over(by.orderBy("y", "term")))
    shaped = materialize(shaped.select("license", "k", "term", "y", "norm", (F.col("below") >= (least * F.col("norm")) ** 2 - 1e-9).alias("heavy")), "license-vectors")
    heavy = sorted(r["term"] for r in shaped.where("heavy").select("term").distinct().collect())

    own = ["key", "piece"]
    terms = pieces_of(files, heavy).select(*own, F.explode("w").alias("term")).groupBy(*own, "term").agg(weighted(F.count("*")).alias("tf"))
    buckets = counted.where("startswith(term, '#')").select(F.col("term").alias("bucket"), inverse(F.col("df"), F.lit(n)).alias("least_idf"))
    terms = terms.join(known, "term", "left").withColumn("bucket", F.when(F.col("idf").isNull(), bucket_of(F.col("term")))).join(buckets, "bucket", "left").drop("bucket")
    terms = materialize(terms, "license-terms")
    dots = terms.join(shaped.select("license", "k", "term", "y", "norm"), "term").groupBy(*own, "license", "k").agg(F.sum(F.col("tf") * F.col("idf") * F.col("y")).alias("dot"), F.max("norm").alias("norm"))
    shortest = terms.groupBy(*own).agg(F.sqrt(F.sum((F.col("tf") * F.coalesce("idf", "least_idf")) ** 2)).alias("shortest"))
    open_ = materialize(dots.join(shortest, own).where(F.col("dot") >= (least - 1e-6) * F.col("norm") * F.col("shortest")).drop("shortest"), "license-open")
    terms = materialize(terms.join(open_.select(*own).distinct(), own, "left_semi"), "license-open-terms")
    rare = materialize(terms.where("idf IS NULL").select("term").distinct(), "license-rare")
    seen = in_files.join(rare, "term").groupBy("term").agg(F.count("*").alias("df"))
    seen = seen.select("term", inverse(F.col("df"), F.lit(n)).alias("rare_idf"))
    lengths = terms.join(seen, "term", "left").groupBy(*own).agg(F.sqrt(F.sum((F.col("tf") * F.coalesce("idf", "rare_idf")) ** 2)).alias("own"))
    scored = open_.join(lengths, own).select("key", "license", F.round(F.col("dot") / (F.col("norm") * F.col("own")), 6).alias("score")).where(F.col("score") >= least)
    return scored.groupBy("key").agg(F.min(F.struct(-F.col("score"), "license"))["license"].alias("license"), F.max("score").alias("score"))


def scan_licenses(files: DataFrame, least: float = LEAST, file_id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(id, path, license, score, origin, inherited_from) for every row of ``files``.

    Pieces of every file become sparse TF-IDF vectors (1 + log of the term frequency, inverse frequency over all files
    of this table) over all their terms; the template with the largest cosine of at least ``least`` is the file's own
    license (origin "header", ties: the first name). A license file (a name that begins with LICENSE, LICENCE, COPYING
    or NOTICE) is compared as a whole too. A file without a license of its own inherits from the nearest ancestor
    directory that holds a license file with one (origin "inherited"); else origin is "none".

    Defined cases: null and empty texts have no license of their own; a null path inherits nothing; several license
    files of a directory: the best score, then the first path; repeated rows and ids come out each, by their own text;
    other columns are ignored; an empty table gives an empty result.
    """
    is_license = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"(?i)^(licen[sc]e|copying|notice)"), F.lit(False))
    rows = files.select(F.col(file_id).alias("id"), F.col(path).cast("string").alias("path"), F.col(text).alias("text")).withColumn("whole", is_license)
    rows = rows.withColumn("key", F.md5(F.concat(F.col("whole").cast("string"), F.col("text"))))
    best = best_license(rows.select("key", "text", "whole"), least)
    folder = F.coalesce(parent_of(F.col("path")), F.lit(""))
    found = materialize(rows.select("id", "path", "whole", "key").join(best, "key", "left").withColumn("start", F.when(F.col("license").isNull() & F.col("path").isNotNull(), folder)).drop("key"), "license-own")
    holders = found.where("license IS NOT NULL AND whole").groupBy(folder.alias("dir")).agg(
        F.min(F.struct(-F.col("score"), F.col("path"), F.col("license"))).alias("b")).select("dir", F.col("b.license").alias("dir_license"), F.col("b.path").alias("holder"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")
    holders = materialize(holders.withColumn("salt", F.explode(salts)), "license-holders")
    dirs = found.where("start IS NOT NULL").select("start").distinct()
    parts = F.split("start", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    above = dirs.select("start", F.pmod(F.xxhash64("start"), F.lit(SALTS)).alias("salt"), F.explode(ups).alias("u")).select("start", "salt", "u.*")
    near = above.join(holders, ["dir", "salt"]).groupBy("start").agg(F.max(F.struct("depth", "dir_license", "holder")).alias("b")).select("start", "b.dir_license", "b.holder")
    return found.join(near, "start", "left").select(
        "id", "path", F.coalesce("license", "dir_license").alias("license"), "score",
        F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("holder").alias("inherited_from"))
