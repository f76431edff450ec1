"""Graph plans: the organization tree, ego networks, supervision, reachability and duplicate groups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.components import chains, connected_components, reachable, settled
from ..operators.core import anchors, closure, coauthor_edges, doubled, live_org_links, org_tree, top_per, valid_on
from ..operators.steps import second_steps, strongest, tie_lists
from .oracle import DAY, live
from .registry import query
from .relational import COLLEAGUES, colleagues, roster, top_coauthors


@query("g01_org_tree", "SELECT id, parent_id, len(path)::BIGINT - 1 AS depth, array_to_string(path, '>') AS path FROM tree")
def g01(t):
    return org_tree(t).select("id", "parent_id", (F.size("path") - 1).cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def universities_above(t):
    """(id, university_id): the nearest university at or above each organization."""
    kinds = t.organizations.where("kind = 'university'").select(F.col("id").alias("ancestor"))
    return closure(t).join(kinds, "ancestor").groupBy("id").agg(F.min_by("ancestor", "distance").alias("university_id"))


NEAREST = "SELECT c.id, arg_min(anc, d) AS university_id FROM (SELECT id, unnest(path) AS anc, len(path) - generate_subscripts(path, 1) AS d FROM tree) c JOIN organizations o ON o.id = anc AND o.kind = 'university' GROUP BY 1"


@query("g02_nearest_university", NEAREST)
def g02(t):
    return universities_above(t)


@query("g03_institution_of_people", f"SELECT person_id, university_id FROM anchor LEFT JOIN ({NEAREST}) n ON n.id = org_id")
def g03(t):
    return anchors(t).select("person_id", F.col("org_id").alias("id")).join(universities_above(t), "id", "left").select("person_id", "university_id")


@query("g04_parent_and_children", "SELECT o.id, p.parent, (SELECT count(*) FROM live_links l WHERE l.parent = o.id) AS children FROM organizations o LEFT JOIN live_links p ON p.child = o.id")
def g04(t):
    links = live_org_links(t)
    up = links.withColumnRenamed("child", "id")
    down = links.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return t.organizations.select("id").join(up, "id", "left").join(down, "id", "left").select("id", "parent", F.coalesce("children", F.lit(0)).alias("children"))


@query("g05_ancestry_labels", "SELECT id, string_agg(name, ' > ' ORDER BY k) AS ancestry FROM (SELECT id, unnest(path) AS anc, generate_subscripts(path, 1) AS k FROM tree) c JOIN (SELECT id AS oid, name FROM organizations) ON oid = anc GROUP BY 1")
def g05(t):
    names = t.organizations.select(F.col("id").alias("ancestor"), "name")
    rows = closure(t).join(names, "ancestor").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("k"), "name"))).alias("p"))
    return rows.select("id", F.array_join(F.transform("p", lambda x: x["name"]), " > ").alias("ancestry"))


@query("g06_ancestry_links", "SELECT id, path[k] AS parent, path[k + 1] AS child FROM (SELECT id, path, unnest(range(1, len(path))) AS k FROM tree)")
def g06(t):
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(F.get("path", k - 1).alias("parent"), F.get("path", k).alias("child")))
    return org_tree(t).where("size(path) > 1").select("id", F.explode(steps).alias("s")).select("id", "s.parent", "s.child")


@query("g07_expand_person", f"SELECT person_id, 'org' AS kind, org_id AS other FROM anchor UNION ALL SELECT from_id, 'advisor', to_id FROM relations WHERE {live()} UNION ALL SELECT to_id, 'advisee', from_id FROM relations WHERE {live()} UNION ALL SELECT person_id, 'coauthor', other_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY paper_count DESC, other_id) AS rn FROM ties) WHERE rn <= 6")
def g07(t):
    return (anchors(t).select("person_id", F.lit("org").alias("kind"), F.col("org_id").alias("other")).union(supervision(t))
            .union(top_coauthors(t, 6).select("person_id", F.lit("coauthor"), "other_id")))


def supervision(t):
    """(person_id, kind, other): who advises whom on the day, from both ends."""
    r = t.relations.where(valid_on(t.day))
    return r.select(F.col("from_id").alias("person_id"), F.lit("advisor").alias("kind"), F.col("to_id").alias("other")).union(r.select("to_id", F.lit("advisee"), "from_id"))


@query("g08_supervision", f"SELECT from_id AS person_id, 'advisor' AS kind, to_id AS other FROM relations WHERE {live()} UNION ALL SELECT to_id, 'advisee', from_id FROM relations WHERE {live()}")
def g08(t):
    return supervision(t)


@query("g09_expand_org", f"SELECT o.id, coalesce(n, 0)::BIGINT AS members, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n <= 8 THEN 'inline' ELSE 'page' END AS shape, least(coalesce(n, 0), CASE WHEN n <= 8 THEN 8 ELSE 24 END)::BIGINT AS shown FROM organizations o LEFT JOIN (SELECT org_id, count(*) AS n FROM affiliations WHERE {live()} GROUP BY 1) ON org_id = o.id")
def g09(t):
    n = roster(t).groupBy(F.col("org_id").alias("id")).agg(F.count("*").alias("n"))
    rows = t.organizations.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("members"))
    shape = F.when(F.col("members") == 0, "empty").when(F.col("members") <= 8, "inline").otherwise("page")
    return rows.select("id", "members", shape.alias("shape"), F.least("members", F.when(F.col("members") <= 8, F.lit(8)).otherwise(F.lit(24)).cast("long")).alias("shown"))


@query("g10_relations", f"SELECT person_id, other_id, bool_or(active) AS active FROM (SELECT from_id AS person_id, to_id AS other_id, {live()} AS active FROM relations UNION ALL SELECT to_id, from_id, {live()} FROM relations) GROUP BY 1, 2")
def g10(t):
    rows = t.relations.select("from_id", "to_id", valid_on(t.day).alias("active"))
    return doubled(rows, "from_id", "to_id").groupBy("person_id", "other_id").agg(F.bool_or("active").alias("active"))


def all_ties(t):
    """The ties of each person as lists, by the publications that are known."""
    own = t.raw("lineitem").select(F.col("l_orderkey").alias("publication_id"), F.col("l_partkey").alias("person_id"))
    return settled(tie_lists(own, t.publications.select("id")))


HOP2 = "SELECT x.person_id, y.other_id, count(*) AS shared FROM ties x JOIN ties y ON y.person_id = x.other_id AND y.other_id <> x.person_id WHERE NOT EXISTS (SELECT 1 FROM ties d WHERE d.person_id = x.person_id AND d.other_id = y.other_id) GROUP BY 1, 2 HAVING count(*) >= 2"


@query("g12_hop2", f"SELECT person_id, count(*) AS candidates, max(shared) AS most FROM ({HOP2}) GROUP BY 1")
def g12(t):
    """How many people share at least two coauthors with each, but no publication."""
    return second_steps(all_ties(t)).groupBy("person_id").agg(F.sum("candidates").alias("candidates"), F.max("most").alias("most"))


def perspective(t, n: int = 40, lists=None):
    """(person_id, other_id, relation, hop, importance): the alters of every person, at most ``n`` each.

    Before the rows of a person meet, each list of ties and each pair of blocks keeps what can be among the first ``n``.
    """
    lists = lists or all_ties(t)
    adv = supervision(t)
    null = lambda kind: F.lit(None).cast(kind)
    co = strongest(lists, n).select("person_id", "others", F.col("papers").alias("n"), "total", null("string").alias("relation"), F.lit(1).alias("hop"))
    advice = adv.select("person_id", F.array("other"), F.array(F.lit(0)), null("long"), "kind", F.lit(1))
    far = second_steps(lists, n=n, most=10, barred=adv.select("person_id", F.col("other").alias("other_id")).where("person_id IS NOT NULL AND other_id IS NOT NULL"))
    far = far.select("person_id", "others", "shared", null("long"), null("string"), F.lit(2))
    rows = co.union(advice).union(far).repartition("person_id").select("person_id", F.explode(F.arrays_zip("others", "n")).alias("x"), "total", "relation", "hop")
    importance = F.when(F.col("hop") == 2, F.least(0.35 * F.col("x.n") / 10, F.lit(0.35))).when(F.col("relation").isNotNull(), 0.55).otherwise(F.least(F.lit(1.0), F.col("x.n") / F.col("total")))
    rows = rows.select("person_id", F.col("x.others").alias("other_id"), "relation", "hop", importance.alias("importance"))
    rows = rows.groupBy("person_id", "other_id").agg(F.min("relation").alias("relation"), F.max("hop").alias("hop"), F.max("importance").alias("importance")).withColumn("importance", F.round("importance", 6))
    return top_per(rows, ["person_id"], [F.desc("importance"), "other_id"], n)


ADV = f"SELECT from_id AS person_id, to_id AS other_id, 'advisor' AS relation FROM relations WHERE {live()} UNION ALL SELECT to_id, from_id, 'advisee' FROM relations WHERE {live()}"
PERSPECTIVE = f"SELECT person_id, other_id, relation, hop, importance FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY importance DESC, other_id) AS rn FROM (SELECT person_id, other_id, min(relation) AS relation, 1 AS hop, round(max(importance), 6)::DOUBLE AS importance FROM (SELECT b.person_id, other_id, NULL::VARCHAR AS relation, least(1.0, paper_count / n)::DOUBLE AS importance FROM ties b JOIN (SELECT person_id, count(*)::DOUBLE AS n FROM authors GROUP BY 1) c ON c.person_id = b.person_id UNION ALL SELECT person_id, other_id, relation, 0.55::DOUBLE FROM ({ADV})) GROUP BY 1, 2 UNION ALL SELECT h.person_id, h.other_id, NULL, 2, round(least(0.35::DOUBLE * shared / 10, 0.35::DOUBLE), 6)::DOUBLE FROM ({HOP2}) h WHERE NOT EXISTS (SELECT 1 FROM ({ADV}) a WHERE a.person_id = h.person_id AND a.other_id = h.other_id))) WHERE rn <= 40"


@query("g11_perspective", PERSPECTIVE)
def g11(t):
    return perspective(t)


@query("g14_ties_on_map", "SELECT person_a, person_b, paper_count FROM edges WHERE person_a IN (SELECT vec_id FROM embeddings) AND person_b IN (SELECT vec_id FROM embeddings)")
def g14(t):
    return ties_on_map(t)


def ties_on_map(t):
    """The ties between people on the map; others are left out before authors are paired."""
    own = t.raw("embeddings").select(F.col("vec_id").alias("a")).distinct()
    return coauthor_edges(t, own).select("person_a", "person_b", "paper_count")


BRIEF = f"SELECT p.id AS person_id, firstname || ' ' || lastname AS name, org_id, university_id, position_rank AS rank, CASE WHEN active THEN NULL ELSE coalesce(a.valid_to, {DAY}) END AS retired_at FROM people p LEFT JOIN anchor a ON a.person_id = p.id LEFT JOIN ({NEAREST}) n ON n.id = a.org_id"


def briefs(t):
    """One row per person: name, anchor, institution, rank and when they left; a single brief is a filter on it."""
    gone = F.when(F.col("person_id").isNull() | ~F.col("active"), F.coalesce("valid_to", t.day))
    rows = t.people.join(anchors(t).drop("id"), F.col("id") == F.col("person_id"), "left").select(
        F.col("id").alias("person_id"), F.concat(F.col("firstname"), F.lit(" "), F.col("lastname")).alias("name"), "org_id", F.col("position_rank").alias("rank"), gone.alias("retired_at"))
    return rows.join(universities_above(t).withColumnRenamed("id", "org_id"), "org_id", "left").select("person_id", "name", "org_id", "university_id", "rank", "retired_at")


@query("g15_person_briefs", BRIEF)
def g15(t):
    return briefs(t)


@query("g16_career_timeline", "SELECT a.id, person_id, name AS org, valid_from, valid_to, row_number() OVER (PARTITION BY person_id ORDER BY valid_from DESC NULLS LAST, a.id) AS place FROM affiliations a LEFT JOIN organizations o ON o.id = org_id")
def g16(t):
    names = t.organizations.select(F.col("id").alias("org_id"), F.col("name").alias("org"))
    place = F.row_number().over(W.partitionBy("person_id").orderBy(F.desc_nulls_last("valid_from"), "id")).cast("long")
    return t.affiliations.join(names, "org_id", "left").select("id", "person_id", "org", "valid_from", "valid_to", place.alias("place"))


@query("g17_bfs_distances", "WITH RECURSIVE e AS (SELECT from_id AS a, to_id AS b FROM relations UNION SELECT to_id, from_id FROM relations), walk AS (SELECT 1::BIGINT AS id, 0 AS d UNION SELECT b, d + 1 FROM walk JOIN e ON a = id WHERE d < (SELECT count(*) FROM relations)) SELECT id, min(d)::BIGINT AS distance FROM walk GROUP BY 1")
def g17(t):
    ends = doubled(t.relations.select("from_id", "to_id"), "from_id", "to_id").select(F.col("person_id").alias("a"), F.col("other_id").alias("b"))
    return reachable(t.spark.range(1, 2), ends)


@query("g18_reach_without_hub")
def g18(t):
    """What the first person reaches over advising links when person 2 is taken out."""
    ends = doubled(t.relations.where("from_id <> 2 AND to_id <> 2").select("from_id", "to_id"), "from_id", "to_id").select(F.col("person_id").alias("a"), F.col("other_id").alias("b"))
    return reachable(t.spark.range(1, 2), ends)


@query("g19_advisor_chains", "WITH RECURSIVE walk AS (SELECT from_id AS id, from_id AS cur, 0 AS d, [from_id] AS way FROM relations UNION ALL SELECT w.id, r.to_id, d + 1, list_append(way, r.to_id) FROM walk w JOIN relations r ON r.from_id = w.cur WHERE NOT list_contains(way, r.to_id)) SELECT id, max(d)::BIGINT AS steps, arg_max(cur, (d, -cur)) AS top FROM walk GROUP BY 1")
def g19(t):
    return chains(t.relations.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@query("g20_neighbours", "SELECT a.id, string_agg(b.id || '', ',' ORDER BY b.label, b.id) AS neighbours FROM (SELECT person_id AS id, other_id FROM ties) a JOIN (SELECT id, lastname || ' ' || firstname AS label FROM people) b ON b.id = a.other_id GROUP BY 1")
def g20(t):
    names = t.people.select(F.col("id").alias("other_id"), F.concat_ws(" ", "lastname", "firstname").alias("label"))
    rows = doubled(coauthor_edges(t)).select(F.col("person_id").alias("id"), "other_id").join(names, "other_id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("label", "other_id"))).alias("n"))
    return rows.select("id", F.array_join(F.transform("n", lambda x: x["other_id"].cast("string")), ",").alias("neighbours"))


CLUSTERS = "SELECT id, venue, first_value(id) OVER (PARTITION BY venue, island ORDER BY id) AS canonical FROM (SELECT *, sum(gap) OVER (PARTITION BY venue ORDER BY year, id) AS island FROM (SELECT *, CASE WHEN year - lag(year) OVER (PARTITION BY venue ORDER BY year, id) <= 1 THEN 0 ELSE 1 END AS gap FROM publications))"


@query("g21_paper_clusters", CLUSTERS)
def g21(t):
    return paper_clusters(t)


def paper_clusters(t):
    """Papers of one key whose years form a chain with gaps of at most one year; ids of a chain share the smallest."""
    return chained(t.publications)


def chained(papers):
    by = W.partitionBy("venue").orderBy("year", "id")
    rows = papers.withColumn("gap", F.when(F.col("year") - F.lag("year").over(by) <= 1, 0).otherwise(1)).withColumn("island", F.sum("gap").over(by))
    return rows.select("id", "venue", F.min("id").over(W.partitionBy("venue", "island")).alias("canonical"))


@query("g22_person_groups", "WITH RECURSIVE e AS (SELECT x.id AS a, y.id AS b FROM people x JOIN people y ON x.firstname = y.firstname AND x.lastname = y.lastname AND x.id <> y.id JOIN edges ON person_a = least(x.id, y.id) AND person_b = greatest(x.id, y.id)), walk AS (SELECT id, id AS reach FROM people UNION SELECT walk.id, b FROM walk JOIN e ON a = reach) SELECT id, min(reach) AS canonical FROM walk GROUP BY 1 HAVING min(reach) <> id")
def g22(t):
    name = t.people.select("id", F.struct("firstname", "lastname").alias("k"))
    same = coauthor_edges(t).join(name.toDF("person_a", "ka"), "person_a").join(name.toDF("person_b", "kb"), "person_b").where("ka = kb")
    return connected_components(same.select(F.col("person_a").alias("src"), F.col("person_b").alias("dst"))).where("node <> component").select(F.col("node").alias("id"), F.col("component").alias("canonical"))
