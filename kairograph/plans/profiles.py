"""The public composite queries, each for all subjects at once; one subject is a filter on the result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators.core import anchors, coauthor_edges, doubled, live_org_links, org_tree, top_per, valid_on
from .graph import BRIEF, briefs, supervision, ties_on_map, universities_above
from .oracle import live
from .registry import query
from .relational import COLLEAGUES, CONCEPTS, EVIDENCE, ROSTER, a05, a07, colleagues, evidence, impact, impact_inputs, person_concepts, roster, top_coauthors

CLOSEST = f"SELECT person_id, other_id, p, label FROM (SELECT c.*, row_number() OVER (PARTITION BY person_id ORDER BY p, label, other_id) AS rn FROM (SELECT person_id, other_id, arg_min(p, src) AS p FROM (SELECT from_id AS person_id, to_id AS other_id, 0 AS p, 0 AS src FROM relations UNION ALL SELECT to_id, from_id, 1, 1 FROM relations UNION ALL SELECT person_id, other_id, 10 - least(paper_count, 9), 2 FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY paper_count DESC, other_id) AS rn FROM ties) WHERE rn <= 16 UNION ALL SELECT person_id, other_id, 20, 3 FROM ({COLLEAGUES})) GROUP BY 1, 2) c0 JOIN (SELECT id, lastname || ' ' || firstname AS label FROM people) n ON n.id = c0.other_id) c WHERE rn <= 16"
CLOSEST = CLOSEST.replace("SELECT c.*, row_number()", "SELECT person_id, other_id, p::BIGINT AS p, label, row_number()").replace(") c WHERE rn <= 16", ") WHERE rn <= 16")


@query("k11_closest_people", CLOSEST)
def k11(t):
    return closest(t)


def closest(t, n: int = 16):
    """Advisors, advisees, frequent coauthors and colleagues; the first relation of a person wins."""
    row = lambda df, a, b, p, s: df.select(F.col(a).alias("person_id"), F.col(b).alias("other_id"), p.cast("long").alias("p"), F.lit(s).alias("src"))
    rows = row(t.relations, "from_id", "to_id", F.lit(0), 0).union(row(t.relations, "to_id", "from_id", F.lit(1), 1))
    rows = rows.union(row(top_coauthors(t), "person_id", "other_id", 10 - F.least("paper_count", F.lit(9)), 2)).union(row(colleagues(t), "person_id", "other_id", F.lit(20), 3))
    names = t.people.select(F.col("id").alias("other_id"), F.concat_ws(" ", "lastname", "firstname").alias("label"))
    first = rows.groupBy("person_id", "other_id").agg(F.min_by("p", "src").alias("p")).join(names, "other_id")
    return top_per(first, ["person_id"], ["p", "label", "other_id"], n).select("person_id", "other_id", "p", "label")


@query("q01_person_profiles", f"SELECT b.*, coalesce(pubs, 0)::BIGINT AS pubs, coalesce(near, 0)::BIGINT AS near, coalesce(concepts, 0)::BIGINT AS concepts FROM ({BRIEF}) b LEFT JOIN (SELECT person_id AS a, least(count(*), 100) AS pubs FROM authors GROUP BY 1) ON a = b.person_id LEFT JOIN (SELECT person_id AS c, count(*) AS near FROM ({CLOSEST}) GROUP BY 1) ON c = b.person_id LEFT JOIN (SELECT person_id AS d, least(count(*), 15) AS concepts FROM ({CONCEPTS}) GROUP BY 1) ON d = b.person_id")
def q01(t):
    pubs = t.authors.groupBy("person_id").agg(F.least(F.count("*"), F.lit(100)).alias("pubs"))
    near = closest(t).groupBy("person_id").agg(F.count("*").alias("near"))
    concepts = person_concepts(t).groupBy("person_id").agg(F.count("*").alias("concepts"))
    rows = briefs(t)
    for other in (pubs, near, concepts):
        rows = rows.join(other, "person_id", "left")
    return rows.fillna(0, ["pubs", "near", "concepts"])


@query("q02_expand", f"SELECT person_id, count(*) AS nodes FROM (SELECT person_id, org_id FROM anchor UNION SELECT from_id, to_id FROM relations WHERE {live()} UNION SELECT to_id, from_id FROM relations WHERE {live()} UNION SELECT person_id, other_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY paper_count DESC, other_id) AS rn FROM ties) WHERE rn <= 6) GROUP BY 1")
def q02(t):
    rows = anchors(t).select("person_id", F.col("org_id").alias("other")).union(supervision(t).select("person_id", "other")).union(top_coauthors(t, 6).select("person_id", "other_id"))
    return rows.distinct().groupBy("person_id").agg(F.count("*").alias("nodes"))


@query("q03_pages", f"SELECT org_id, n AS total, least(n, 24)::BIGINT AS next_offset, people FROM (SELECT org_id, max(total) AS n, string_agg(person_id || '', ',' ORDER BY rank) AS people FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY sort_key, person_id) AS rank, count(*) OVER (PARTITION BY org_id) AS total FROM ({ROSTER})) WHERE rank <= 24 GROUP BY 1)")
def q03(t):
    total = roster(t).groupBy("org_id").agg(F.count("*").alias("total"))
    page = top_per(roster(t), ["org_id"], ["sort_key", "person_id"], 24, "rank").groupBy("org_id").agg(F.sort_array(F.collect_list(F.struct("rank", "person_id"))).alias("p"))
    return page.join(total, "org_id").select("org_id", "total", F.least("total", F.lit(24)).alias("next_offset"), F.array_join(F.transform("p", lambda x: x["person_id"].cast("string")), ",").alias("people"))


GRAMS = "list_distinct(flatten([[substring('  ' || w || ' ', k, 3) FOR k IN range(1, length(w) + 2)] FOR w IN list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')]))"
SIM = "(len(list_intersect({0}, g))::DOUBLE / len(list_distinct(list_concat({0}, g))))"


def search_people(t, q: str):
    """Everyone whose first, last or full name is like ``q`` by trigrams or holds it, best first."""
    full = F.concat_ws(" ", "firstname", "lastname")
    grams = X.trigrams(F.lit(q))
    sims = [X.trigram_similarity(X.trigrams(c), grams) for c in (F.col("firstname"), F.col("lastname"), full)]
    low = [F.lower(c) for c in (F.col("firstname"), F.col("lastname"), full)]
    has = [F.contains(c, F.lit(q)) for c in low]
    rule = F.when((low[0] == q) | (low[1] == q), 1.0).when(low[2] == q, 0.98).when(F.startswith(low[0], F.lit(q)) | F.startswith(low[1], F.lit(q)), 0.7).when(has[0] | has[1], 0.55).otherwise(0.0)
    rows = t.people.select("id", "firstname", "lastname", F.greatest(*sims).alias("sim"), rule.alias("rule"), (has[0] | has[1] | has[2]).alias("has"))
    return rows.where((F.col("sim") >= 0.3) | F.col("has")).select("id", F.round(F.greatest("sim", "rule"), 6).alias("score"), "firstname", "lastname")


@query("q04_search", f"SELECT id, round(greatest({SIM.format('a')}, {SIM.format('b')}, {SIM.format('c')}, CASE WHEN f = 'blue' OR l = 'blue' THEN 1.0 WHEN f || ' ' || l = 'blue' THEN 0.98 WHEN starts_with(f, 'blue') OR starts_with(l, 'blue') THEN 0.7 WHEN contains(f, 'blue') OR contains(l, 'blue') THEN 0.55 ELSE 0 END::DOUBLE), 6)::DOUBLE AS score, coalesce(n, 0)::BIGINT AS pubs, org_id FROM (SELECT id, lower(firstname) AS f, lower(lastname) AS l, {GRAMS.format('firstname')} AS a, {GRAMS.format('lastname')} AS b, {GRAMS.format(chr(40) + 'firstname || chr(32) || lastname' + chr(41))} AS c, {GRAMS.format(chr(39) + 'blue' + chr(39))} AS g FROM people) s LEFT JOIN (SELECT person_id, count(*) AS n FROM authors GROUP BY 1) u ON u.person_id = s.id LEFT JOIN anchor h ON h.person_id = s.id AND h.active WHERE greatest({SIM.format('a')}, {SIM.format('b')}, {SIM.format('c')}) >= 0.3 OR contains(f || ' ' || l, 'blue')".replace("SELECT id, round", "SELECT s.id, round"))
def q04(t):
    pubs = t.authors.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("pubs"))
    home = anchors(t).where("active").select(F.col("person_id").alias("id"), "org_id")
    return search_people(t, "blue").join(pubs, "id", "left").join(home, "id", "left").select("id", "score", F.coalesce("pubs", F.lit(0)).alias("pubs"), "org_id")


def named(c, q: str, short=None):
    """How well a lower-case name (or its short form) answers ``q``: equal, begins with it, holds it, by rules of search."""
    both = [F.lower(x) for x in (c, short) if x is not None]
    any_of = lambda rule: F.greatest(*[F.coalesce(rule(x), F.lit(False)).cast("int") for x in both]) == 1
    return F.when(any_of(lambda x: x == q), 1.0).when(any_of(lambda x: F.startswith(x, F.lit(q))), 0.7).when(any_of(lambda x: F.contains(x, F.lit(q))), 0.55).otherwise(0.0)


@query("q04_search_organizations", f"""SELECT id, round(greatest({SIM.format('a')}, CASE WHEN {SIM.format('b')} >= 0.3 THEN {SIM.format('b')} ELSE 0 END, CASE WHEN n = 'united' OR s = 'united' THEN 1.0 WHEN starts_with(n, 'united') OR starts_with(s, 'united') THEN 0.7 WHEN contains(n, 'united') OR contains(s, 'united') THEN 0.55 ELSE 0 END::DOUBLE), 6)::DOUBLE AS score
    FROM (SELECT id, lower(name) AS n, lower(coalesce(short_name, '')) AS s, {GRAMS.format('name')} AS a, {GRAMS.format("coalesce(short_name, '')")} AS b, {GRAMS.format(chr(39) + 'united' + chr(39))} AS g FROM organizations WHERE NOT coalesce(is_context_only, false))
    WHERE {SIM.format('a')} >= 0.3 OR {SIM.format('b')} >= 0.3 OR contains(n, 'united') OR contains(s, 'united')""")
def q04_organizations(t):
    return search_organizations(t, "united")


def search_organizations(t, q: str):
    """(id, score): organizations whose name or short name is like ``q`` or holds it; those for context alone stay out."""
    grams = X.trigrams(F.lit(q))
    sim = lambda c: X.trigram_similarity(X.trigrams(F.coalesce(c, F.lit(""))), grams)
    rows = t.organizations.where(~F.coalesce("is_context_only", F.lit(False))).select("id", sim(F.col("name")).alias("a"), sim(F.col("short_name")).alias("b"), named(F.col("name"), q, F.col("short_name")).alias("rule"))
    return rows.where("a >= 0.3 OR b >= 0.3 OR rule > 0").select("id", F.round(F.greatest("a", F.when(F.col("b") >= 0.3, F.col("b")).otherwise(0.0), "rule"), 6).alias("score"))


def aliases(t):
    """(person_id, alias): made-up other names, the last name with an initial and for some the first name twice."""
    short = t.people.where("lastname IS NOT NULL").select(F.col("id").alias("person_id"), F.concat("lastname", F.lit(" "), F.substring("firstname", 1, 1)).alias("alias"))
    return short.union(t.people.where("id % 3 = 0").select("id", F.concat("firstname", F.lit(" "), "firstname")))


ALIASES = "SELECT id AS person_id, lastname || ' ' || substring(firstname, 1, 1) AS alias FROM people WHERE lastname IS NOT NULL UNION ALL SELECT id, firstname || ' ' || firstname FROM people WHERE id % 3 = 0"


@query("q04_search_aliases", f"SELECT person_id, round(max(CASE WHEN sim >= 0.3 THEN sim ELSE 0.45 END), 6)::DOUBLE AS score FROM (SELECT person_id, alias, {SIM.format('a')} AS sim FROM (SELECT person_id, lower(alias) AS alias, {GRAMS.format('alias')} AS a, {GRAMS.format(chr(39) + 'blue' + chr(39))} AS g FROM ({ALIASES}))) WHERE sim >= 0.3 OR contains(alias, 'blue') GROUP BY 1")
def q04_aliases(t):
    """People by their best alias that is like the question or holds it."""
    sim = X.trigram_similarity(X.trigrams(F.col("alias")), X.trigrams(F.lit("blue")))
    rows = aliases(t).withColumn("sim", sim).where((F.col("sim") >= 0.3) | F.contains(F.lower("alias"), F.lit("blue")))
    return rows.groupBy("person_id").agg(F.round(F.max(F.when(F.col("sim") >= 0.3, F.col("sim")).otherwise(0.45)), 6).alias("score"))


@query("q05_universities", f"SELECT o.id, name, (SELECT count(*) FROM live_links l WHERE l.parent = o.id) AS children, coalesce(people, 0)::BIGINT AS people FROM organizations o LEFT JOIN (SELECT anc, count(DISTINCT person_id) AS people FROM (SELECT id, unnest(path) AS anc FROM tree) c JOIN affiliations a ON a.org_id = c.id WHERE {live('a.')} GROUP BY 1) ON anc = o.id WHERE kind = 'university' AND NOT coalesce(is_context_only, false)")
def q05(t):
    rows = t.organizations.where("kind = 'university'").where(~F.coalesce("is_context_only", F.lit(False))).select("id", "name")
    return rows.join(child_counts(t), "id", "left").join(a07(t).withColumnRenamed("org_id", "id"), "id", "left").select("id", "name", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("people", F.lit(0)).alias("people"))


def child_counts(t):
    return live_org_links(t).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))


ORG = f"SELECT o.id, o.name, o.kind, p.parent, (SELECT count(*) FROM live_links l WHERE l.parent = o.id) AS children, coalesce(n, 0)::BIGINT AS roster, coalesce(people, 0)::BIGINT AS people FROM organizations o LEFT JOIN live_links p ON p.child = o.id LEFT JOIN (SELECT org_id, count(*) AS n FROM affiliations WHERE {live()} GROUP BY 1) ON org_id = o.id LEFT JOIN (SELECT anc, count(DISTINCT person_id) AS people FROM (SELECT id, unnest(path) AS anc FROM tree) c JOIN affiliations a ON a.org_id = c.id WHERE {live('a.')} GROUP BY 1) ON anc = o.id"


@query("q06_org_profiles", ORG)
def q06(t):
    rows = t.organizations.select("id", "name", "kind").join(live_org_links(t).withColumnRenamed("child", "id"), "id", "left").join(child_counts(t), "id", "left")
    rows = rows.join(a05(t).toDF("id", "roster"), "id", "left").join(a07(t).withColumnRenamed("org_id", "id"), "id", "left")
    return rows.fillna(0, ["children", "roster", "people"]).select("id", "name", "kind", "parent", "children", "roster", "people")


@query("q07_org_children", "SELECT l.parent AS id, l.child, o.name, row_number() OVER (PARTITION BY l.parent ORDER BY o.name, l.child) AS place FROM live_links l JOIN organizations o ON o.id = l.child")
def q07(t):
    rows = live_org_links(t).join(t.organizations.select(F.col("id").alias("child"), "name"), "child")
    return rows.select(F.col("parent").alias("id"), "child", "name", F.row_number().over(W.partitionBy("parent").orderBy("name", "child")).cast("long").alias("place"))


@query("q08_projection", "SELECT vec_id AS person_id, round(embedding[1]::DOUBLE, 6)::DOUBLE AS x, round(embedding[2]::DOUBLE, 6)::DOUBLE AS y, label::BIGINT AS cluster, coalesce(n, 0)::BIGINT AS pubs FROM embeddings LEFT JOIN (SELECT person_id, count(*) AS n FROM authors GROUP BY 1) ON person_id = vec_id WHERE isfinite(embedding[1]) AND isfinite(embedding[2])")
def q08(t):
    points = t.raw("embeddings").select(F.col("vec_id").alias("person_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("long").alias("cluster"))
    points = points.where((F.abs("x") <= 1e6) & (F.abs("y") <= 1e6))
    pubs = t.authors.groupBy("person_id").agg(F.count("*").alias("pubs"))
    return points.join(pubs, "person_id", "left").select("person_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster", F.coalesce("pubs", F.lit(0)).alias("pubs"))


@query("q09_coauthor_ties", "SELECT person_id, other_id, paper_count FROM ties WHERE person_id IN (SELECT vec_id FROM embeddings) AND other_id IN (SELECT vec_id FROM embeddings)")
def q09(t):
    return doubled(ties_on_map(t)).select("person_id", "other_id", "paper_count")


@query("q12_person_topics", "SELECT person_id, topic, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, topic) AS place FROM person_topics")
def q12(t):
    place = F.row_number().over(W.partitionBy("person_id").orderBy(F.desc("score"), "topic")).cast("long")
    return t.person_topics.select("person_id", "topic", F.round("score", 6).alias("score"), place.alias("place"))


@query("q13_person_concepts", f"SELECT person_id, concept_id, row_number() OVER (PARTITION BY person_id ORDER BY total DESC, concept_id) AS place FROM ({CONCEPTS}) QUALIFY place <= 15")
def q13(t):
    return person_concepts(t).select("person_id", "concept_id", F.col("rank").alias("place"))


AWARDS = "SELECT l_partkey AS person_id, l_orderkey AS award_id, min(l_shipdate)::DATE AS awarded FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"


def awards(t):
    return t.raw("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("person_id"), F.col("l_orderkey").alias("award_id")).agg(F.to_date(F.min("l_shipdate")).alias("awarded"))


@query("q14_person_awards", f"SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY awarded DESC NULLS LAST, award_id) AS place FROM ({AWARDS})")
def q14(t):
    return awards(t).withColumn("place", F.row_number().over(W.partitionBy("person_id").orderBy(F.desc_nulls_last("awarded"), "award_id")).cast("long"))


@query("q15_person_grants", "SELECT person_id, s_suppkey AS funder_id, coalesce(s_name, 'Unknown funder') AS funder, round(amount, 2)::DOUBLE AS amount FROM (SELECT l_partkey AS person_id, l_suppkey, sum(l_extendedprice) AS amount FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) LEFT JOIN supplier ON s_suppkey = l_suppkey")
def q15(t):
    own = t.raw("lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("person_id"), F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_extendedprice").alias("amount"))
    return own.join(t.raw("supplier").select("s_suppkey", "s_name"), "s_suppkey", "left").select("person_id", F.col("s_suppkey").alias("funder_id"), F.coalesce("s_name", F.lit("Unknown funder")).alias("funder"), F.round("amount", 2).alias("amount"))


@query("q16_person_publications", "SELECT person_id, publication_id, c_name AS venue, place FROM (SELECT person_id, publication_id, venue, row_number() OVER (PARTITION BY person_id ORDER BY year DESC, publication_id DESC) AS place FROM authors JOIN publications ON id = publication_id) LEFT JOIN customer ON c_custkey = venue WHERE place <= 100")
def q16(t):
    own = t.authors.join(t.publications.select(F.col("id").alias("publication_id"), "year", "venue"), "publication_id")
    rows = top_per(own, ["person_id"], [F.desc("year"), F.desc("publication_id")], 100, "place")
    names = t.raw("customer").select(F.col("c_custkey").alias("v"), F.col("c_name"))
    return rows.join(names, F.col("venue") == F.col("v"), "left").select("person_id", "publication_id", F.col("c_name").alias("venue"), "place")


@query("q17_org_identifiers", "SELECT id, provider, external_id FROM (SELECT id, 'name' AS provider, name AS external_id, 0 AS k FROM organizations UNION ALL SELECT id, 'short', short_name, 1 FROM organizations WHERE short_name IS NOT NULL)")
def q17(t):
    pairs = F.array(F.struct(F.lit("name").alias("provider"), F.col("name").alias("external_id")), F.struct(F.lit("short").alias("provider"), F.col("short_name").alias("external_id")))
    return t.organizations.select("id", F.explode(pairs).alias("e")).select("id", "e.*").where("external_id IS NOT NULL")


@query("q18_relationship_export", "SELECT person_id, other_id, direction, valid_from, valid_to FROM (SELECT from_id AS person_id, to_id AS other_id, 'out' AS direction, valid_from, valid_to FROM relations UNION ALL SELECT to_id, from_id, 'in', valid_from, valid_to FROM relations)")
def q18(t):
    return t.relations.select(F.col("from_id").alias("person_id"), F.col("to_id").alias("other_id"), F.lit("out").alias("direction"), "valid_from", "valid_to").union(
        t.relations.select("to_id", "from_id", F.lit("in"), "valid_from", "valid_to"))


def export(t):
    """One JSON document per person with everything known about them."""
    lists = {
        "publications": t.authors.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("publication_id", "position"))).alias("publications")),
        "timeline": t.affiliations.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("valid_from", "org_id", "valid_to"))).alias("timeline")),
        "awards": awards(t).groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("awarded", "award_id"))).alias("awards"))}
    rows = briefs(t)
    for other in lists.values():
        rows = rows.join(other, "person_id", "left")
    return rows.select("person_id", F.to_json(F.struct("*")).alias("document"))


@query("q11_person_export")
def q11(t):
    return export(t)


@query("s16_json_export")
def s16(t):
    return export(t).select("person_id", F.length("document").cast("long").alias("bytes"), F.sha2("document", 256).alias("digest"))
