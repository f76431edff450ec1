"""Keyed tables that are merged in place: a merge rewrites only the buckets of keys that it changes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import settled

#: What a column holds where the old and the new row meet.
RULES = {
    "new": lambda old, new: new,
    "old": lambda old, new: old,
    "greatest": F.greatest,
    "least": F.least,
    "fill": lambda old, new: F.coalesce(old, new),
    "or": lambda old, new: F.coalesce(old | new, old, new),
}


def latest(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """The last committed version, 0 if none, and the folder of each bucket that holds rows (at most one per bucket)."""
    try:
        commits = spark.read.schema("bucket int, folder string, version long").parquet(f"{root}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    last = commits.agg(F.max("version")).first()[0]
    if last is None:
        return 0, {}
    return last, {r["bucket"]: r["folder"] for r in commits.where(F.col("version") == last).collect() if r["folder"]}


def read_merged(spark: SparkSession, root: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
    """The rows of the last version, of all buckets or of some; a reader keeps its version while others are written."""
    folders = [f for b, f in sorted(latest(spark, root)[1].items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(spark: SparkSession, root: str, changes: DataFrame, keys: list[str], rules: dict[str, str] | None = None, gone: DataFrame | None = None, order: list[str] | None = None, buckets: int = 256) -> set[int]:
    """Merge ``changes`` into the table at ``root`` by ``keys``, drop the keys of ``gone``; returns the rewritten buckets.

    A new key is inserted. Where a key is known each other column follows its rule ("new" unless given); the same rules
    fold rows of ``changes`` that share a key, in ``order`` (by their values where it is not given or ties). A key in
    ``gone`` goes, be it in ``changes`` or not. Buckets are hashes of the keys: the changes are joined with the old rows
    of the buckets that they hit alone, and of these only those in which a row differs are written, to a folder of their
    own. A version is one small file, written last, that names the folder of each bucket; until it stands readers see
    the version before, and a merge that was cut off is simply run again. A merge that changes nothing makes no version.
    One writer at a time: the second of two that began from one version fails when it commits.

    Defined cases: null keys are equal to each other; "greatest" and "least" pass over nulls; an empty table of changes
    changes nothing; columns of ``changes`` beyond the table's are an error of the schema. The number of buckets is fixed by the
    first merge's argument and must stay; it bounds what reaches the driver.
    """
    schema = changes.schema
    rest = [c for c in schema.names if c not in keys]
    rules = {c: (rules or {}).get(c, "new") for c in rest}
    bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), F.lit(buckets)).cast("int")
    version, folders = latest(spark, root)
    if any(b >= buckets for b in folders):
        raise ValueError("the table was made with more buckets")
    place = F.struct(*(order or []), *rest) if rest else F.lit(1)

    def folded(c: str) -> Column:
        rule = rules[c]
        if rule in ("greatest", "least", "or"):
            return {"greatest": F.max, "least": F.min, "or": F.bool_or}[rule](c)
        if rule == "fill":
            return F.min_by(c, F.when(F.col(c).isNotNull(), place))
        return (F.min_by if rule == "old" else F.max_by)(c, place)

    new = changes.groupBy(*keys).agg(*[folded(c).alias(c) for c in rest], F.lit(False).alias("_gone"))
    if gone is not None:
        dead = gone.select(*keys).distinct().withColumn("_dead", F.lit(True))
        new = joined(new, dead, keys).select(*keys, *rest, F.coalesce("_dead", "_gone").alias("_gone"))
    new = settled(new.withColumn("_bucket", bucket))
    hit = {r[0] for r in new.select("_bucket").distinct().collect()}
    if not hit:
        return set()
    old = read_merged(spark, root, schema, hit)
    both = joined(old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in rest], F.lit(True).alias("_known")), new.drop("_bucket"), keys)
    known, named = F.col("_known").isNotNull(), F.col("_gone").isNotNull()
    values = [F.when(known & named, RULES[rules[c]](F.col(f"_old_{c}"), F.col(c))).when(known, F.col(f"_old_{c}")).otherwise(F.col(c)).cast(schema[c].dataType).alias(c) for c in rest]
    same = reduce(lambda a, b: a & b, [v.eqNullSafe(F.col(f"_old_{c}")) for v, c in zip(values, rest, strict=True)], F.lit(True))
    stale = F.coalesce(F.when(F.col("_gone"), known).otherwise(~known | ~same), F.lit(False))
    out = settled(both.select(*keys, *values, bucket.alias("_bucket"), stale.alias("_stale"), F.coalesce("_gone", F.lit(False)).alias("_gone")))
    changed = {r[0] for r in out.where("_stale").select("_bucket").distinct().collect()}
    if not changed:
        return set()
    target = f"{root}/data/{version + 1}-{uuid.uuid4().hex}"
    rows = out.where(F.col("_bucket").isin(*changed) & ~F.col("_gone")).drop("_stale", "_gone")
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(target)
    held = {r[0] for r in spark.read.parquet(target).select("_bucket").distinct().collect()} if not rows.isEmpty() else set()
    now = {b: f for b, f in folders.items() if b not in changed} | {b: f"{target}/_bucket={b}" for b in held}
    pointer = spark.createDataFrame([(b, now.get(b)) for b in sorted(now)] or [(0, None)], "bucket int, folder string")
    pointer.coalesce(1).write.mode("errorifexists").parquet(f"{root}/commits/version={version + 1}")
    return changed


def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The full outer join by keys of which nulls are equal, with the keys once."""
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys], F.lit(True).alias("_right"))
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])
    return a.join(right, on, "full").select(*[F.when(F.col("_right"), F.col(f"_k_{k}")).otherwise(F.col(k)).alias(k) for k in keys], *[c for c in a.columns if c not in keys], *[c for c in b.columns if c not in keys])
