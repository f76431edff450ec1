"""Merges that write: upserts, clean-ups, person merges and erasures as versions of keyed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.components import shared_dir
from ..operators.core import anchors, top_per
from ..sources.merge import merge, read_merged
from .registry import query


def table_of(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


LINKS = "person_id long, org_id long, score double, level int"


@query("e01_merged_links", """SELECT person_id, org_id, max(score)::DOUBLE AS score, min(level)::INTEGER AS level FROM (
    SELECT person_id, org_id, 0.5 + (person_id % 5) / 10.0::DOUBLE AS score, 2 AS level FROM affiliations UNION ALL SELECT person_id, org_id + person_id % 2, 0.7::DOUBLE, 1 FROM anchor) GROUP BY 1, 2""")
def e01_merged(t):
    """Links written, then merged with newer ones: the score grows, the level falls, new links come in."""
    root = table_of(t, "links")
    old = t.affiliations.groupBy("person_id", "org_id").agg((0.5 + F.first("person_id") % 5 / 10).alias("score"), F.lit(2).alias("level"))
    new = anchors(t).select("person_id", (F.col("org_id") + F.col("person_id") % 2).alias("org_id"), F.lit(0.7).alias("score"), F.lit(1).alias("level"))
    for rows in (old, new):
        merge(t.spark, root, rows.select(F.col("person_id").cast("long"), F.col("org_id").cast("long"), "score", "level"), ["person_id", "org_id"], {"score": "greatest", "level": "least"}, buckets=16)
    return read_merged(t.spark, root, LINKS)


WORKS = "id long, title string, year long, venue long"
INCOMING = "SELECT id + 7 AS id, title, year + id % 4 AS year, CASE WHEN id % 5 > 0 THEN venue END AS venue FROM publications WHERE id % 2 = 0"


@query("e04_merged_works", f"""WITH inc AS ({INCOMING}), m AS (SELECT i.*, coalesce(a.id, b.id) AS match FROM inc i LEFT JOIN publications a ON a.id = i.id
    LEFT JOIN (SELECT i.id AS new_id, min(p.id) AS id FROM inc i JOIN publications p ON p.title = i.title AND abs(p.year - i.year) <= 2 GROUP BY 1) b ON b.new_id = i.id),
    up AS (SELECT coalesce(match, id) AS id, arg_min(title, (id)) AS title, arg_min(year, (id)) AS year, arg_min(venue, (id)) FILTER (venue IS NOT NULL) AS venue FROM m GROUP BY 1)
SELECT coalesce(p.id, up.id) AS id, CASE WHEN up.id IS NULL THEN p.title ELSE up.title END AS title, coalesce(p.year, up.year)::BIGINT AS year, coalesce(p.venue, up.venue) AS venue FROM publications p FULL JOIN up ON up.id = p.id""")
def e04_merged(t):
    """Works that come in find their row by identifier, else by equal title within two years (the smallest id), else are new.

    The title is taken over from the first work in order of ids that found the row; year and venue are filled where they are missing.
    """
    p = t.publications.select("id", "title", F.col("year").cast("long"), F.col("venue").cast("long"))
    inc = p.where("id % 2 = 0").select((F.col("id") + 7).alias("id"), "title", (F.col("year") + F.col("id") % 4).alias("year"), F.when(F.col("id") % 5 > 0, F.col("venue")).alias("venue"))
    by_id = p.select("id", F.col("id").alias("own"))
    near = inc.select(F.col("id"), "title", F.col("year").alias("y")).join(p.select(F.col("id").alias("at"), "title", "year"), "title").where("abs(year - y) <= 2").groupBy("id").agg(F.min("at").alias("near"))
    found = inc.join(by_id, "id", "left").join(near, "id", "left").withColumn("row", F.coalesce("own", "near", "id"))
    first = found.groupBy(F.col("row").alias("id")).agg(F.min_by("title", "id").alias("title"), F.min_by("year", "id").alias("year"), F.min_by("venue", F.when(F.col("venue").isNotNull(), F.col("id"))).alias("venue"))
    root = table_of(t, "works")
    for rows in (p, first):
        merge(t.spark, root, rows.select("id", "title", "year", "venue"), ["id"], {"year": "fill", "venue": "fill"}, buckets=16)
    return read_merged(t.spark, root, WORKS)


AUTHORS = "publication_id long, person_id long, position int"
MERGED = "SELECT publication_id, canonical AS person_id, min(position)::INTEGER AS position FROM authors JOIN (SELECT id, min(id) OVER (PARTITION BY firstname, lastname) AS canonical FROM people) ON id = person_id GROUP BY 1, 2"


@query("e21_merged_authors", MERGED)
def e21_merged(t):
    """Links of people who are merged go under the first id of a name, in one version; links that meet keep the earlier position."""
    canonical = top_per(t.people, ["firstname", "lastname"], ["id"]).select("firstname", "lastname", F.col("id").alias("canonical"))
    people = t.people.alias("p").join(canonical.alias("c"), F.col("p.firstname").eqNullSafe(F.col("c.firstname")) & F.col("p.lastname").eqNullSafe(F.col("c.lastname")))
    moved = people.where("id <> canonical").select(F.col("id").alias("person_id"), "canonical")
    links = t.authors.select(F.col("publication_id").cast("long"), F.col("person_id").cast("long"), F.col("position").cast("int"))
    old = links.join(moved, "person_id")
    root = table_of(t, "authors")
    keys, rules = ["publication_id", "person_id"], {"position": "least"}
    merge(t.spark, root, links, keys, rules, buckets=16)
    merge(t.spark, root, old.select("publication_id", F.col("canonical").alias("person_id"), "position"), keys, rules, gone=old, buckets=16)
    return read_merged(t.spark, root, AUTHORS)


@query("e22_erased_authors", "SELECT publication_id, person_id, position::INTEGER AS position FROM authors WHERE person_id % 10 <> 3")
def e22_erased(t):
    """Links after a tenth of the people was erased: their keys are dropped, only buckets that hold such keys are rewritten."""
    links = t.authors.select(F.col("publication_id").cast("long"), F.col("person_id").cast("long"), F.col("position").cast("int"))
    root = table_of(t, "erased")
    keys = ["publication_id", "person_id"]
    merge(t.spark, root, links, keys, buckets=16)
    merge(t.spark, root, links.limit(0), keys, gone=links.where("person_id % 10 = 3"), buckets=16)
    return read_merged(t.spark, root, AUTHORS)
