"""Reusable operators over DataFrames: validity, ranking per key, pairs, anchors and the organization tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.adapter import Tables


def valid_on(day: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether [start, end) contains ``day``; null bounds are open, an empty range contains nothing."""
    return F.coalesce(F.col(start) <= day, F.lit(True)) & F.coalesce(day < F.col(end), F.lit(True))


def top_per(df: DataFrame, keys: list, order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in ``order``; with ``rank`` the place is kept in a column of that name."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def coauthor_pairs(t: Tables, among: DataFrame | None = None) -> DataFrame:
    """(publication_id, a, b) with a < b for authors of one publication, of those in ``among`` (a) if it is given.

    Rows are dealt by publication once; both the de-duplication and the self-join run on that partitioning.
    """
    own = t.raw("lineitem").select(F.col("l_orderkey").alias("publication_id"), F.col("l_partkey").alias("a"))
    own = (own if among is None else own.join(among, "a", "left_semi").select("publication_id", "a")).repartition("publication_id").distinct()
    return own.join(own.toDF("publication_id", "b"), "publication_id").where("a < b")


def coauthor_edges(t: Tables, among: DataFrame | None = None) -> DataFrame:
    """(person_a, person_b, paper_count, first_year, last_year) per pair of people, of those in ``among`` (a) if it is given, who share publications."""
    years = t.publications.select(F.col("id").alias("publication_id"), "year")
    return coauthor_pairs(t, among).join(years, "publication_id").groupBy(F.col("a").alias("person_a"), F.col("b").alias("person_b")).agg(
        F.count("*").alias("paper_count"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def doubled(edges: DataFrame, a: str = "person_a", b: str = "person_b") -> DataFrame:
    """Each undirected edge once from either end, as (person_id, other_id, rest): lookups become equi-joins."""
    rest = [c for c in edges.columns if c not in (a, b)]
    ends = F.array(F.struct(F.col(a).alias("person_id"), F.col(b).alias("other_id")), F.struct(F.col(b).alias("person_id"), F.col(a).alias("other_id")))
    return edges.select(F.explode(ends).alias("e"), *rest).select("e.*", *rest)


def anchors(t: Tables) -> DataFrame:
    """The best affiliation of each person: valid on the day first, then primary, then the latest end and start."""
    end = F.when(F.col("valid_from") == F.col("valid_to"), None).otherwise(F.col("valid_to"))
    rows = t.affiliations.withColumn("active", valid_on(t.day))
    return top_per(rows, ["person_id"], [F.desc("active"), F.desc("is_primary"), end.desc_nulls_first(), F.desc_nulls_last("valid_from"), F.desc("id")])


def live_org_links(t: Tables) -> DataFrame:
    return t.org_links.where(valid_on(t.day)).select("child", "parent")


def org_tree(t: Tables) -> DataFrame:
    """(id, parent_id, path) with the path from the root to the organization, by a recursive query with a cycle guard."""
    return t.spark.sql("""
        WITH RECURSIVE links AS (SELECT child, parent FROM {links}), walk AS (
            SELECT o.id, CAST(NULL AS BIGINT) AS parent_id, array(o.id) AS path FROM {orgs} o LEFT ANTI JOIN links l ON l.child = o.id
            UNION ALL
            SELECT l.child, w.id, array_append(w.path, l.child) FROM walk w JOIN links l ON l.parent = w.id WHERE NOT array_contains(w.path, l.child))
        SELECT id, parent_id, path FROM walk""", links=live_org_links(t), orgs=t.organizations.select("id"))


def closure(t: Tables) -> DataFrame:
    """(ancestor, id, distance) for every organization and each organization above it, itself included."""
    return org_tree(t).select("id", F.size("path").alias("n"), F.posexplode("path").alias("k", "ancestor")).select("ancestor", "id", (F.col("n") - 1 - F.col("k")).cast("long").alias("distance"))
