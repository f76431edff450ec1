"""The read model of a map: its points with all that a view shows of a person, its clusters and the ties between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .atlas import CENTROID, all_fields, centroids
from .client import POINTS, points
from .graph import BRIEF, briefs
from .registry import query
from .relational import IMPACT, OTHER_RANK, RANK_WEIGHTS, cluster_weights, impact_inputs

#: Colours that clusters take in turn.
SLOTS = 12


def finite(*names):
    """Whether all columns are numbers; a null is one that is not there."""
    found = F.lit(True)
    for c in names:
        found = found & F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    return found


def sanitised(dots, clusters, edges):
    """The parts of a map without what would break a view.

    Points and clusters at no finite place go; points of a cluster that is not there lose it with its label, and so do
    edges that lack an end or a finite weight. ``dots`` has x, y, cluster, cluster_label, ``clusters`` id, cx, cy,
    ``edges`` source, target, collaboration_weight, topic_weight; other columns stay.
    """
    clusters = clusters.where(finite("cx", "cy"))
    known = clusters.select(F.col("id").alias("cluster"), F.lit(True).alias("known")).distinct()
    rows = dots.where(finite("x", "y")).join(known, "cluster", "left")
    rows = rows.withColumn("cluster_label", F.when(F.col("known"), F.col("cluster_label"))).withColumn("cluster", F.when(F.col("known"), F.col("cluster"))).drop("known")
    edges = edges.where(finite("collaboration_weight") & (F.col("topic_weight").isNull() | finite("topic_weight")))
    for end in ("source", "target"):
        edges = edges.join(known.select(F.col("cluster").alias(end)), end, "left_semi")
    return rows.select(*dots.columns), clusters, edges.select("source", "target", "collaboration_weight", "topic_weight")


def read_model(t):
    """(points, clusters, edges) of the map, sanitised."""
    p = points(t)
    field = p.join(all_fields(t).withColumnRenamed("person_id", "id"), "id").groupBy("cluster", "field").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("field", F.struct("n", -F.col("field"))).alias("field"))
    named = field.select("cluster", F.concat(F.lit("Field "), F.col("field").cast("string")).alias("field_name"))
    clusters = p.groupBy("cluster").agg(F.count("*").alias("member_count"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).join(named, "cluster", "left")
    clusters = clusters.select(F.col("cluster").alias("id"), F.concat(F.col("field_name"), F.lit(" / "), F.col("cluster").cast("string")).alias("label"), "field_name", "member_count", "cx", "cy", F.pmod("cluster", F.lit(SLOTS)).alias("color_slot"))
    weights = F.create_map(*[F.lit(x) for kv in RANK_WEIGHTS.items() for x in kv])
    own = briefs(t).withColumnRenamed("person_id", "id").join(impact_inputs(t).withColumnRenamed("person_id", "id"), "id", "left")
    base = 4 * F.log1p(F.coalesce("cites", F.lit(0))) + 2.5 * F.log1p(F.coalesce("pubs", F.lit(0)))
    raw = F.when(base > 0, base + 0.6 * F.coalesce(F.try_element_at(weights, F.col("rank")), F.lit(OTHER_RANK))).otherwise(0.0)
    dots = p.join(own, "id").withColumn("raw", raw)
    top = dots.agg(F.max("raw").alias("top"))
    names = t.organizations.select(F.col("id").alias("university_id"), F.col("name").alias("institution"))
    dots = dots.join(F.broadcast(top)).join(names, "university_id", "left").join(clusters.select(F.col("id").alias("cluster"), F.col("label").alias("cluster_label")), "cluster", "left")
    dots = dots.select(
        "id", F.col("name").alias("label"), "x", "y", "institution", F.col("university_id").alias("institution_id"), "rank",
        F.when(F.col("top") > 0, F.least(F.lit(1.0), F.col("raw") / F.col("top"))).otherwise(0.0).alias("impact"), "cluster", "cluster_label", "retired_at", F.col("last_year").alias("last_publication_year"))
    c = centroids(t)
    cosine = c.toDF("a", "topic", "x").join(c.toDF("b", "topic", "y"), "topic").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("topic_weight"))
    edges = cluster_weights(t).where("a <> b AND weight > 0").orderBy(F.desc("weight"), "a", "b").limit(30).join(cosine, ["a", "b"], "left")
    edges = edges.select(F.col("a").cast("long").alias("source"), F.col("b").cast("long").alias("target"), F.col("weight").alias("collaboration_weight"), "topic_weight")
    return sanitised(dots, clusters, edges)


FIELDS = "SELECT cluster, arg_max(field, (n, -field)) AS field FROM (SELECT label AS cluster, coalesce(field, -1) AS field, count(*) AS n FROM embeddings LEFT JOIN (SELECT person_id, arg_max(field, (s, -field)) AS field FROM (SELECT person_id, field, sum(score) AS s FROM person_topics GROUP BY 1, 2) GROUP BY 1) ON person_id = vec_id GROUP BY 1, 2) GROUP BY 1"


@query("n22_map_points", f"WITH r AS ({IMPACT}), b AS ({BRIEF}), p AS (SELECT pt.*, coalesce(raw, 0) AS raw FROM ({POINTS}) pt LEFT JOIN r ON r.person_id = pt.id) SELECT p.id, b.name AS label, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y, o.name AS institution, university_id AS institution_id, rank, round(least(1.0, raw / max(raw) OVER ()), 6)::DOUBLE AS impact, p.cluster, 'Field ' || field || ' / ' || p.cluster AS cluster_label, retired_at, last_year AS last_publication_year FROM p JOIN b ON b.person_id = p.id LEFT JOIN organizations o ON o.id = university_id LEFT JOIN ({FIELDS}) f ON f.cluster = p.cluster LEFT JOIN (SELECT person_id, max(year) AS last_year FROM authors JOIN publications ON id = publication_id GROUP BY 1) l ON l.person_id = p.id")
def n22_points(t):
    dots, _, _ = read_model(t)
    return dots.withColumns({c: F.round(c, 6) for c in ("x", "y", "impact")})


@query("n22_map_clusters", f"SELECT label AS id, 'Field ' || field || ' / ' || label AS label, 'Field ' || field AS field_name, count(*) AS member_count, round(avg(embedding[1]::DOUBLE), 6)::DOUBLE AS cx, round(avg(embedding[2]::DOUBLE), 6)::DOUBLE AS cy, label % {SLOTS} AS color_slot FROM (SELECT label::BIGINT AS label, embedding FROM embeddings) LEFT JOIN ({FIELDS}) f ON f.cluster = label GROUP BY label, field")
def n22_clusters(t):
    _, clusters, _ = read_model(t)
    return clusters.withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query("n22_map_edges", f"WITH c AS ({CENTROID}), s AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS topic FROM c a JOIN c b ON a.topic = b.topic AND a.label < b.label GROUP BY 1, 2), w AS (SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, sum(paper_count)::DOUBLE AS weight FROM edges e JOIN embeddings x ON x.vec_id = person_a JOIN embeddings y ON y.vec_id = person_b WHERE x.label <> y.label GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 30) SELECT a::BIGINT AS source, b::BIGINT AS target, weight AS collaboration_weight, round(topic, 6)::DOUBLE AS topic_weight FROM w LEFT JOIN s USING (a, b)")
def n22_edges(t):
    _, _, edges = read_model(t)
    return edges.withColumn("topic_weight", F.round("topic_weight", 6))
