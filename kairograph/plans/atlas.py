"""The two-view map: edge weights, backbone, communities, layout and quality metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import layout
from ..operators.core import coauthor_edges, doubled
from ..operators.community import communities, sweep_resolution
from ..operators.components import ranked, settled
from ..operators.force import linlog_layout, network_layout, scaled, spring_layout
from ..operators.pairs import closest_pairs, overlap_rates, separation_ratios
from ..operators.spread import cluster_hulls, remove_overlaps
from ..operators.steps import column, flat, ties_among
from ..operators.topic import landmark_mds, split_groups
from .client import POINTS, points
from .graph import all_ties, perspective, ties_on_map
from .oracle import oracle
from .registry import query
from .relational import cluster_weights

EDGES = "SELECT person_a AS a, person_b AS b, paper_count::DOUBLE AS w FROM edges WHERE person_a <> person_b"


def weighted(t):
    """(a, b, w): collapsed canonical edges with positive weight."""
    return coauthor_edges(t).select(F.col("person_a").alias("a"), F.col("person_b").alias("b"), F.col("paper_count").cast("double").alias("w"))


def strengths(t):
    return doubled(weighted(t), "a", "b").groupBy(F.col("person_id").alias("n")).agg(F.sum("w").alias("s"), F.count("*").alias("k"))


STRENGTH = f"SELECT n, sum(w) AS s, count(*) AS k FROM (SELECT a AS n, w FROM ({EDGES}) UNION ALL SELECT b, w FROM ({EDGES})) GROUP BY 1"


@query("n01_collapse_edges", "SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, sum(1.0::DOUBLE) AS w FROM (SELECT from_id, to_id FROM relations UNION ALL SELECT to_id, from_id FROM relations) WHERE from_id <> to_id GROUP BY 1, 2")
def n01(t):
    rows = t.relations.select("from_id", "to_id").union(t.relations.select("to_id", "from_id"))
    return rows.where("from_id <> to_id").groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.sum(F.lit(1.0)).alias("w"))


@query("n02_association_strength", f"SELECT e.a, e.b, round(2 * m * w / (x.s * y.s), 6)::DOUBLE AS strength FROM ({EDGES}) e JOIN ({STRENGTH}) x ON x.n = e.a JOIN ({STRENGTH}) y ON y.n = e.b CROSS JOIN (SELECT sum(w) AS m FROM ({EDGES}))")
def n02(t):
    s = strengths(t)
    m = weighted(t).agg(F.sum("w").alias("m"))
    rows = weighted(t).join(s.select(F.col("n").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("n").alias("b"), F.col("s").alias("sb")), "b")
    return rows.join(F.broadcast(m)).select("a", "b", F.round(2 * F.col("m") * F.col("w") / (F.col("sa") * F.col("sb")), 6).alias("strength"))


def disparity(t, alpha: float):
    s = strengths(t)
    rows = weighted(t).join(s.toDF("a", "sa", "ka"), "a").join(s.toDF("b", "sb", "kb"), "b")
    p = lambda x: F.when(F.col("k" + x) > 1, F.pow(1 - F.col("w") / F.col("s" + x), F.col("k" + x) - 1)).otherwise(1.0)
    return rows.where(((F.col("ka") == 1) & (F.col("kb") == 1)) | (F.least(p("a"), p("b")) < alpha)).select("a", "b", "w")


@query("n03_disparity_filter", f"SELECT e.a, e.b, w FROM ({EDGES}) e JOIN ({STRENGTH}) x ON x.n = e.a JOIN ({STRENGTH}) y ON y.n = e.b WHERE (x.k = 1 AND y.k = 1) OR least(CASE WHEN x.k > 1 THEN pow(1 - w / x.s, x.k - 1) ELSE 1 END, CASE WHEN y.k > 1 THEN pow(1 - w / y.s, y.k - 1) ELSE 1 END) < 0.4")
def n03(t):
    return disparity(t, 0.4)


def inner_ties(t, resolutions: tuple):
    """(graph, resolution, a, b, w): the ties inside each cluster, once for each resolution."""
    label = points(t).select("id", "cluster").distinct()
    ties = ties_on_map(t).join(label.toDF("person_a", "graph"), "person_a").join(label.toDF("person_b", "other"), "person_b").where("graph = other")
    steps = F.explode(F.array(*[F.lit(float(r)) for r in resolutions]))
    return ties.select("graph", steps.alias("resolution"), F.col("person_a").alias("a"), F.col("person_b").alias("b"), F.col("paper_count").cast("double").alias("w"))


def found_communities(t, resolutions: tuple):
    """(id, cluster, resolution, community): every point; those without ties are a community each."""
    own = points(t).select("id", "cluster").distinct().withColumn("resolution", F.explode(F.array(*[F.lit(float(r)) for r in resolutions])))
    got = communities(inner_ties(t, resolutions)).toDF("cluster", "resolution", "id", "community")
    return own.join(got, ["cluster", "resolution", "id"], "left").select("id", "cluster", "resolution", F.coalesce("community", "id").alias("community"))


@query("n04_communities")
def n04(t):
    """Communities inside each cluster, named by their smallest member."""
    return found_communities(t, (1.0,)).select("id", "community")


def cluster_targets(n):
    """The bounds of a readable number of clusters: about one for 40 people, 8 to 30, give or take two."""
    k = F.greatest(F.lit(8), F.least(F.lit(30), F.bround(n / 40)))
    return F.greatest(F.lit(2), k - 2).cast("long"), F.least(n, k + 2).cast("long")


def bounds(nodes):
    """(graph, n, least, most) of ``nodes`` (graph, id)."""
    least, most = cluster_targets(F.col("n"))
    return nodes.groupBy("graph").agg(F.count("*").alias("n")).select("graph", "n", least.alias("least"), most.alias("most"))


@query("n05_resolution_sweep")
def n05(t):
    """The resolution at which each cluster falls into a readable number of communities, all sought at once."""
    nodes = points(t).select(F.col("cluster").alias("graph"), "id").distinct()
    best, _ = sweep_resolution(inner_ties(t, (1.0,)).select("graph", "a", "b", "w"), bounds(nodes), sections=8, most_rounds=2)
    return best.withColumnRenamed("graph", "cluster")


#: Steps of the layouts of the registered plans: clusters, members. The operators default to 600 and 240.
STEPS = (16, 8)


def mapped_edges(t):
    """(graph, a, b, w): the ties between people on the map, as one graph."""
    return ties_on_map(t).select(F.lit(0).cast("long").alias("graph"), F.col("person_a").alias("a"), F.col("person_b").alias("b"), F.col("paper_count").cast("double").alias("w"))


def one_graph(p):
    return p.select(F.lit(0).cast("long").alias("graph"), "id", "cluster", "x", "y")


@query("n06_cluster_layout")
def n06(t):
    """Positions of the clusters themselves from the weights between them."""
    zero = F.lit(0).cast("long").alias("graph")
    nodes = points(t).select(zero, F.col("cluster").alias("id")).distinct()
    ties = cluster_weights(t).where("a <> b").select(zero, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").alias("w"))
    return linlog_layout(nodes, ties, STEPS[0]).select(F.col("id").alias("cluster"), "x", "y")


@query("n07_member_layout")
def n07(t):
    """Positions of the members of each cluster by the ties inside it."""
    nodes = points(t).select(F.col("cluster").alias("graph"), "id").distinct()
    return spring_layout(nodes, inner_ties(t, (1.0,)).select("graph", "a", "b", "w"), STEPS[1]).select("id", F.col("graph").alias("cluster"), "x", "y")


@query("n08_classical_mds")
def n08(t):
    """Clusters placed by the cosines of their mean profiles."""
    means = centroids(t).groupBy(F.lit(0).cast("long").alias("grp"), F.col("label").cast("long").alias("id")).agg(profile_of("topic", "x"))
    return landmark_mds(means).select(F.col("id").alias("cluster"), "x", "y")


@query("n09_normalise_canvas", f"SELECT id, round((x - cx) * 0.88 / span, 6)::DOUBLE AS x, round((y - cy) * 0.88 / span, 6)::DOUBLE AS y FROM ({POINTS}) CROSS JOIN (SELECT avg(x) AS cx, avg(y) AS cy, greatest(max(x) - min(x), max(y) - min(y), 1e-9::DOUBLE) / 2 AS span FROM ({POINTS}))")
def n09(t):
    return normalised(points(t)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def normalised(p):
    """Points around their mean, the larger extent on 0.88 of a canvas of side two."""
    box = p.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)) / 2).alias("span"))
    return p.join(F.broadcast(box)).withColumns({"x": (F.col("x") - F.col("cx")) * 0.88 / F.col("span"), "y": (F.col("y") - F.col("cy")) * 0.88 / F.col("span")}).drop("cx", "cy", "span")


def profile_of(topic: str, x: str):
    """A profile: (topic, x) by rising topic."""
    return F.array_sort(F.collect_list(F.struct(F.col(topic).cast("long").alias("topic"), F.col(x).alias("x")))).alias("profile")


def unit_profiles(t):
    """(id, profile): TF-IDF topic profiles of length one."""
    return n14(t).groupBy(F.col("person_id").alias("id")).agg(profile_of("topic", "x"))


def topic_clusters(t):
    """(id, grp, part): people by dominant field; a field of over max(20, n / 40) people falls into parts of about 40."""
    n = t.raw("embeddings").count()
    fields = all_fields(t).select(F.col("person_id").alias("id"), F.col("field").alias("grp"))
    profiles = unit_profiles(t)
    known = split_groups(fields.where("grp >= 0").join(profiles, "id"), least=max(20, round(n / 40)))
    return known.union(fields.where("grp < 0").select("id", "grp", F.lit(0).cast("long").alias("part")))


@query("n10_topic_clusters")
def n10(t):
    return topic_clusters(t).select(F.col("id").alias("person_id"), F.col("grp").alias("field"), "part")


BRIDGE = f"WITH e AS (SELECT person_a AS n, person_b AS o, paper_count::DOUBLE AS w FROM edges UNION ALL SELECT person_b, person_a, paper_count::DOUBLE FROM edges), p AS ({POINTS}), c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), f AS (SELECT e.n, q.cluster AS k, q.cluster = p.cluster AS own, sum(w) AS w FROM e JOIN p ON p.id = e.n JOIN p q ON q.id = e.o GROUP BY 1, 2, 3), g AS (SELECT *, row_number() OVER (PARTITION BY n, own ORDER BY w DESC, k) AS rn FROM f), a AS (SELECT n, sum(w) AS total, coalesce(sum(w) FILTER (NOT own), 0) AS ext, coalesce(sum(w) FILTER (NOT own AND rn <= 2), 0) AS top, sum(w * cx) / sum(w) AS x, sum(w * cy) / sum(w) AS y FROM g JOIN c ON c.cluster = g.k GROUP BY 1) SELECT n AS id, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y FROM a WHERE ext / total >= 0.5 AND top >= 0.8::DOUBLE * ext"


@query("n11_bridge_nodes", BRIDGE)
def n11(t):
    """Nodes with most weight in two foreign clusters move between the clusters of their neighbours."""
    p = points(t)
    centre = p.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    e = doubled(weighted(t), "a", "b").toDF("id", "other", "w")
    rows = e.join(p.select("id", F.col("cluster").alias("home")), "id").join(p.select(F.col("id").alias("other"), "cluster"), "other")
    rows = rows.groupBy("id", "cluster", (F.col("cluster") == F.col("home")).alias("own")).agg(F.sum("w").alias("w"))
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("id", "own").orderBy(F.desc("w"), "cluster"))).join(centre, "cluster")
    far = F.when(~F.col("own"), F.col("w")).otherwise(0.0)
    out = rows.groupBy("id").agg(F.sum("w").alias("total"), F.sum(far).alias("ext"), F.sum(F.when(F.col("rn") <= 2, far).otherwise(0.0)).alias("top"), (F.sum(F.col("w") * F.col("cx")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("cy")) / F.sum("w")).alias("y"))
    return out.where((F.col("ext") / F.col("total") >= 0.5) & (F.col("top") >= 0.8 * F.col("ext"))).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("n12_remove_overlaps")
def n12(t):
    """Points of a cluster at least 0.05 apart, as far as eight rounds can push them."""
    return remove_overlaps(points(t), 0.05)


@query("n13_dominant_field", "SELECT vec_id AS person_id, coalesce(field, -1) AS field FROM embeddings LEFT JOIN (SELECT person_id, arg_max(field, (s, -field)) AS field FROM (SELECT person_id, field, sum(score) AS s FROM person_topics GROUP BY 1, 2) GROUP BY 1) ON person_id = vec_id")
def n13(t):
    return all_fields(t)


def all_fields(t):
    """Everybody's dominant field, -1 without any topic."""
    return t.raw("embeddings").select(F.col("vec_id").alias("person_id")).join(dominant_field(t), "person_id", "left").select("person_id", F.coalesce("field", F.lit(-1).cast("long")).alias("field"))


def dominant_field(t):
    mass = t.person_topics.groupBy("person_id", "field").agg(F.sum("score").alias("s"))
    return mass.groupBy("person_id").agg(F.max_by("field", F.struct("s", -F.col("field"))).alias("field"))


PROFILE = "SELECT person_id, topic, s * (ln((n + 1.0::DOUBLE) / (df + 1)) + 1) AS x FROM (SELECT person_id, topic, max(score) AS s FROM person_topics GROUP BY 1, 2) JOIN (SELECT topic, count(DISTINCT person_id) AS df FROM person_topics GROUP BY 1) USING (topic) CROSS JOIN (SELECT count(*) AS n FROM embeddings)"


def topic_profiles(t):
    cell = t.person_topics.groupBy("person_id", "topic").agg(F.max("score").alias("s"))
    df = cell.groupBy("topic").agg(F.count("*").alias("df"))
    n = t.raw("embeddings").agg(F.count("*").alias("n"))
    return cell.join(df, "topic").join(F.broadcast(n)).select("person_id", "topic", (F.col("s") * (F.log((F.col("n") + 1.0) / (F.col("df") + 1)) + 1)).alias("x"))


@query("n14_tfidf_profiles", f"SELECT person_id, topic, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY person_id)), 1e-9::DOUBLE), 6)::DOUBLE AS x FROM ({PROFILE})")
def n14(t):
    norm = F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("person_id"))), F.lit(1e-9))
    return topic_profiles(t).select("person_id", "topic", F.round(F.col("x") / norm, 6).alias("x"))


FIELD = "SELECT person_id, field, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY person_id)), 1e-9::DOUBLE) AS x FROM (SELECT person_id, field, sum(score) AS x FROM person_topics GROUP BY 1, 2)"


def field_profiles(t):
    rows = t.person_topics.groupBy("person_id", "field").agg(F.sum("score").alias("x"))
    return rows.withColumn("x", F.col("x") / F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("person_id"))), F.lit(1e-9)))


@query("n15_field_profiles", f"SELECT person_id, field, round(x, 6)::DOUBLE AS x FROM ({FIELD})")
def n15(t):
    return field_profiles(t).withColumn("x", F.round("x", 6))


@query("n16_cluster_targets", f"SELECT cluster, round(0.03 + 0.002::DOUBLE * sqrt(n), 6)::DOUBLE AS footprint, greatest(2, k - 2)::BIGINT AS least, least(n, k + 2)::BIGINT AS most FROM (SELECT *, greatest(8, least(30, round_even(n / 40, 0))) AS k FROM (SELECT cluster, count(*) AS n FROM ({POINTS}) GROUP BY 1))")
def n16(t):
    """The radius of each cluster on the map, and how many clusters it should fall into as a map of its own."""
    sizes = points(t).groupBy("cluster").agg(F.count("*").alias("n"))
    least, most = cluster_targets(F.col("n"))
    return sizes.select("cluster", F.round(0.03 + 0.002 * F.sqrt("n"), 6).alias("footprint"), least.alias("least"), most.alias("most"))


@query("n17_network_layout")
def n17(t):
    """The map from given clusters: cluster and member layouts, bridges, orphans, canvas and gaps."""
    labels = points(t).select(F.lit(0).cast("long").alias("graph"), "id", "cluster").distinct()
    return network_layout(labels, mapped_edges(t), steps=STEPS)[0].select("id", "cluster", "x", "y")


#: Levels of the backbone filter, in the order of preference; the strongest ties come last.
LADDER = (0.05, 0.1, 0.2, 0.5)


def backbones(edges, n: int):
    """(graph, a, b, w): the filter of ``edges`` (a, b, w) at each level as a graph of its own, and the strongest 3 n ties."""
    ends = doubled(edges, "a", "b").groupBy(F.col("person_id").alias("n")).agg(F.sum("w").alias("s"), F.count("*").alias("k"))
    rows = edges.join(ends.toDF("a", "sa", "ka"), "a").join(ends.toDF("b", "sb", "kb"), "b")
    p = lambda x: F.when(F.col("k" + x) > 1, F.pow(1 - F.col("w") / F.col("s" + x), F.col("k" + x) - 1)).otherwise(1.0)
    p_value = F.when((F.col("ka") == 1) & (F.col("kb") == 1), -1.0).otherwise(F.least(p("a"), p("b")))
    levels = F.explode(F.array(*[F.struct(F.lit(g).cast("long").alias("graph"), F.lit(alpha).alias("alpha")) for g, alpha in enumerate(LADDER)])).alias("l")
    kept = rows.select("a", "b", "w", p_value.alias("p"), levels).where("p < l.alpha").select("l.graph", "a", "b", "w")
    strong = ranked(rows.select("a", "b", (F.col("w") / (F.col("sa") * F.col("sb"))).alias("w")), [F.desc("w"), F.asc("a"), F.asc("b")]).where(F.col("place") <= 3 * n)
    total = edges.agg((2 * F.sum("w")).alias("m2"))
    strong = strong.join(F.broadcast(total)).select(F.lit(len(LADDER)).cast("long").alias("graph"), "a", "b", (F.col("w") * F.col("m2")).alias("w"))
    return settled(kept.union(strong))


def network_view(t):
    """The best map: every backbone is searched for a readable number of communities; of those that have one, the map with the clearest clusters."""
    nodes = settled(points(t).select("id").distinct())
    edges = settled(mapped_edges(t))
    n = nodes.count()
    candidates = backbones(edges.select("a", "b", "w"), n)
    graphs = candidates.select("graph").distinct()
    best, labels = sweep_resolution(candidates, bounds(nodes.crossJoin(F.broadcast(graphs))), sections=8, most_rounds=2)
    found = {r["graph"]: r for r in best.collect()}  # one row for each level of the ladder
    fitting = [g for g in sorted(found) if found[g]["fits"]]
    most = max(8, min(30, round(n / 40))) + 2
    fallback = [g for g in sorted(found)]
    chosen = fitting or (fallback[-1:] if fallback and found[fallback[0]]["communities"] > most else fallback[:1])
    own = nodes.crossJoin(F.broadcast(graphs.where(F.col("graph").isin(chosen))))
    own = own.join(labels.withColumnRenamed("node", "id"), ["graph", "id"], "left").select("graph", "id", F.coalesce("community", "id").alias("cluster"))
    ties = edges.drop("graph").crossJoin(F.broadcast(graphs.where(F.col("graph").isin(chosen))))
    placed, _ = network_layout(own, ties.select("graph", "a", "b", "w"), steps=STEPS)
    ratio = separation_ratios(placed) if chosen else {}
    top = min(ratio, key=lambda g: (-ratio[g], g), default=-1)
    tag = "knn" if top == len(LADDER) else f"disparity{LADDER[top]}"
    return placed.where(F.col("graph") == top).select("id", "cluster", "x", "y", F.lit(tag).alias("backbone"), F.lit(float(found[top]["resolution"]) if found else None).cast("double").alias("resolution"), F.lit(ratio.get(top)).cast("double").alias("separation"))


@query("n18_backbone_ladder")
def n18(t):
    return network_view(t)


@query("n19_topic_view")
def n19(t):
    """The map by topics: clusters by the cosines of their mean profiles, members around them by their own."""
    labels = topic_clusters(t).select("id", (F.col("grp") * 1_000_000 + F.col("part")).alias("cluster"))
    members = settled(unit_profiles(t).join(labels, "id"))
    mean = members.select("cluster", F.explode("profile").alias("c")).groupBy("cluster", "c.topic").agg(F.sum("c.x").alias("x"))
    centres = landmark_mds(mean.groupBy(F.lit(0).cast("long").alias("grp"), F.col("cluster").alias("id")).agg(profile_of("topic", "x")))
    local = landmark_mds(members.select("id", F.col("cluster").alias("grp"), "profile"))
    size = local.groupBy("grp").agg(F.count("*").alias("n"), F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-9)).alias("reach"))
    by = F.when(F.col("n") > 1, (0.03 + 0.002 * F.sqrt("n")) / F.col("reach")).otherwise(0.0)
    local = local.join(size, "grp").select(F.col("grp").alias("cluster"), "id", (F.col("x") * by).alias("lx"), (F.col("y") * by).alias("ly"))
    at = local.join(centres.select(F.col("id").alias("cluster"), "x", "y"), "cluster").select(F.lit(0).cast("long").alias("graph"), "id", (F.col("x") + F.col("lx")).alias("x"), (F.col("y") + F.col("ly")).alias("y"))
    apart = remove_overlaps(settled(scaled(at, 2.0 * 0.88).withColumnRenamed("graph", "cluster")), 0.02).drop("cluster")
    return apart.join(labels, "id").select("id", F.expr("cluster div 1000000").alias("field"), (F.col("cluster") % 1_000_000).alias("part"), "x", "y")


METRICS = f"SELECT round((SELECT sum(m) / sum(n) FROM (SELECT label, max(n) AS m, sum(n) AS n FROM (SELECT label, field, count(*) AS n FROM embeddings JOIN (SELECT person_id, arg_max(field, (s, -field)) AS field FROM (SELECT person_id, field, sum(score) AS s FROM person_topics GROUP BY 1, 2) GROUP BY 1) ON person_id = vec_id GROUP BY 1, 2) GROUP BY 1)), 6)::DOUBLE AS purity"


@query("n20_purity", METRICS)
def n20(t):
    labels = t.raw("embeddings").select(F.col("vec_id").alias("person_id"), "label")
    n = labels.join(dominant_field(t), "person_id").groupBy("label", "field").agg(F.count("*").alias("n")).groupBy("label").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return n.agg(F.round(F.sum("m") / F.sum("n"), 6).alias("purity"))


@query("n20_separation", f"SELECT round(median(d) FILTER (p.cluster <> q.cluster) / greatest(median(d) FILTER (p.cluster = q.cluster), 1e-9::DOUBLE), 5)::DOUBLE AS separation FROM (SELECT a.cluster AS c1, b.cluster AS c2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM ({POINTS}) a JOIN ({POINTS}) b ON a.id < b.id)".replace("p.cluster", "c1").replace("q.cluster", "c2"))
def n20b(t):
    """Median distance between clusters over the median within them, by counting pairs of cells."""
    ratio = separation_ratios(one_graph(points(t)))
    return t.spark.createDataFrame([(round(v, 5),) for v in ratio.values()], "separation double")


NEAR = f"SELECT count(*) AS n, count(*) FILTER (a.cluster <> b.cluster) AS far FROM ({POINTS}) a JOIN ({POINTS}) b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.02"


@query("n20_overlap_rate", f"SELECT round(CASE WHEN n = 0 THEN 0 ELSE far / n END, 6)::DOUBLE AS overlap FROM ({NEAR})")
def n20d(t):
    """The share of pairs of different clusters among the pairs of points nearer than 0.02."""
    rate = overlap_rates(one_graph(points(t)))
    return t.spark.createDataFrame([(round(v, 6),) for v in rate.values()], "overlap double")


@query("n20_gold_pairs", f"SELECT from_id, to_id, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6)::DOUBLE AS distance FROM relations JOIN ({POINTS}) p ON p.id = from_id JOIN ({POINTS}) q ON q.id = to_id")
def n20e(t):
    """The distance of pairs that are known to belong together, here advisors and advisees on the map."""
    at = lambda k, x, y: points(t).select(F.col("id").alias(k), F.col("x").alias(x), F.col("y").alias(y))
    rows = t.relations.select("from_id", "to_id").join(at("from_id", "x1", "y1"), "from_id").join(at("to_id", "x2", "y2"), "to_id")
    return rows.select("from_id", "to_id", F.round(F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2), 6).alias("distance"))


@query("n20_fidelity", f"SELECT round(avg(d), 6)::DOUBLE AS fidelity FROM (SELECT d, row_number() OVER (ORDER BY w DESC, a, b) AS rn, count(*) OVER () AS n FROM (SELECT e.a, e.b, w, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM ({EDGES}) e JOIN ({POINTS}) p ON p.id = e.a JOIN ({POINTS}) q ON q.id = e.b)) WHERE rn <= greatest(1, n // 10)")
def n20c(t):
    at = lambda k, x, y: points(t).select(F.col("id").alias(k), F.col("x").alias(x), F.col("y").alias(y))
    rows = weighted(t).join(at("a", "x1", "y1"), "a").join(at("b", "x2", "y2"), "b")
    n = max(1, rows.count() // 10)
    d = F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))
    return rows.orderBy(F.desc("w"), "a", "b").limit(n).agg(F.round(F.avg(d), 6).alias("fidelity"))


@query("n21_cluster_hulls")
def n21(t):
    return cluster_hulls(points(t))


@query("n21_closest_pair", f"SELECT c.cluster, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 9)::DOUBLE AS d FROM (SELECT DISTINCT cluster FROM ({POINTS})) c LEFT JOIN ({POINTS}) a ON a.cluster = c.cluster LEFT JOIN ({POINTS}) b ON b.cluster = a.cluster AND a.id < b.id GROUP BY 1")
def n21b(t):
    """The smallest distance of two points of each cluster."""
    return closest_pairs(points(t).select("cluster", "x", "y")).select("cluster", F.round("d", 9).alias("d"))


@query("a19_collaboration_matrix", f"SELECT least(p.cluster, q.cluster) AS a, greatest(p.cluster, q.cluster) AS b, sum(w)::DOUBLE AS weight FROM ({EDGES}) e JOIN ({POINTS}) p ON p.id = e.a JOIN ({POINTS}) q ON q.id = e.b GROUP BY 1, 2")
def a19(t):
    return cluster_weights(t).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "weight")


CENTROID = "SELECT label, topic, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-9::DOUBLE) AS x FROM (SELECT label, topic, sum(score) / any_value(n) AS x FROM person_topics JOIN embeddings ON vec_id = person_id JOIN (SELECT label AS l, count(*) AS n FROM embeddings GROUP BY 1) ON l = label GROUP BY 1, 2)"


def centroids(t):
    labels = t.raw("embeddings").select(F.col("vec_id").alias("person_id"), "label")
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    x = t.person_topics.join(labels, "person_id").groupBy("label", "topic").agg(F.sum("score").alias("x")).join(n, "label").withColumn("x", F.col("x") / F.col("n"))
    return x.select("label", "topic", (F.col("x") / F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("label"))), F.lit(1e-9))).alias("x"))


@query("a20_cluster_centroids", f"SELECT label, topic, round(x, 6)::DOUBLE AS x FROM ({CENTROID})")
def a20(t):
    return centroids(t).withColumn("x", F.round("x", 6))


@query("a21_centroid_cosines", f"WITH c AS ({CENTROID}) SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6)::DOUBLE AS cosine FROM c a JOIN c b ON a.topic = b.topic AND a.label < b.label GROUP BY 1, 2")
def a21(t):
    c = centroids(t)
    return c.toDF("a", "topic", "x").join(c.toDF("b", "topic", "y"), "topic").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cosine"))


def alter_groups(t):
    """The alters of each person and (person_id, other_id, community): communities among them, at most forty nodes a group."""
    lists = all_ties(t)
    alters = settled(perspective(t, lists=lists))
    members = settled(alters.groupBy(F.col("person_id").alias("ego")).agg(F.array_sort(F.collect_list("other_id")).alias("members")))
    ties = ties_among(members, lists).groupBy("ego").agg(F.array_sort(F.collect_list(F.struct("a", "b", "papers"))).alias("ties"))
    rows = members.join(ties, "ego", "left").select("ego", "members", "ties.a", "ties.b", "ties.papers")

    def run(batches):
        for batch in batches:
            member, size = flat(batch, "members")
            labels, at, done = np.zeros(len(member), np.int64), 0, 0
            (a, n), b, w = flat(batch, "a"), flat(batch, "b")[0], flat(batch, "papers")[0].astype(float)
            for k, m in zip(size.tolist(), n.tolist(), strict=True):
                own, some = member[at : at + k], slice(done, done + m)
                labels[at : at + k] = layout.modularity_communities(k, np.searchsorted(own, a[some]), np.searchsorted(own, b[some]), w[some])
                at, done = at + k, done + m
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(column(batch, "ego"), size)), pa.array(member), pa.array(labels)], ["person_id", "other_id", "community"])

    return alters, rows.mapInArrow(run, "person_id long, other_id long, community long")


@query("g13_alter_communities")
def g13(t):
    return alter_groups(t)[1]


@query("q10_perspective_groups")
def q10(t):
    alters, groups = alter_groups(t)
    return alters.join(groups, ["person_id", "other_id"])
