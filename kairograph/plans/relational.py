"""Filters, joins, aggregates, windows and ordered reads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.components import ranked
from ..operators.core import anchors, closure, coauthor_edges, coauthor_pairs, doubled, live_org_links, org_tree, top_per, valid_on
from ..operators.grams import contained
from .oracle import DAY, live
from .registry import query

ONE = "count(*)::BIGINT"


@query("a01_coauthor_edges", "SELECT * FROM edges")
def a01(t):
    return coauthor_edges(t)


@query("a02_fractional_weight", "WITH k AS (SELECT publication_id, count(*) AS k FROM authors GROUP BY 1), w AS (SELECT a AS x, b AS y, 1.0::DOUBLE / (k - 1) AS w FROM pairs JOIN k USING (publication_id) UNION ALL SELECT least(from_id, to_id), greatest(from_id, to_id), 5.0::DOUBLE FROM relations) SELECT x AS person_a, y AS person_b, round(least(sum(w), 20.0), 6)::DOUBLE AS weight FROM w GROUP BY 1, 2")
def a02(t):
    k = t.authors.groupBy("publication_id").agg(F.count("*").alias("k"))
    shared = coauthor_pairs(t).join(k, "publication_id").select("a", "b", (F.lit(1.0) / (F.col("k") - 1)).alias("w"))
    advised = t.relations.select(F.least("from_id", "to_id"), F.greatest("from_id", "to_id"), F.lit(5.0))
    return shared.union(advised).groupBy(F.col("a").alias("person_a"), F.col("b").alias("person_b")).agg(F.round(F.least(F.sum("w"), F.lit(20.0)), 6).alias("weight"))


@query("a03_distinct_people_per_org", "SELECT org_id, count(DISTINCT person_id) AS people FROM affiliations GROUP BY 1")
def a03(t):
    return t.affiliations.groupBy("org_id").agg(F.countDistinct("person_id").alias("people"))


@query("a04_child_counts", "SELECT parent, count(*) AS children FROM live_links GROUP BY 1")
def a04(t):
    return live_org_links(t).groupBy("parent").agg(F.count("*").alias("children"))


@query("a05_roster_counts", f"SELECT org_id, count(*) AS members FROM affiliations WHERE {live()} GROUP BY 1")
def a05(t):
    return t.affiliations.where(valid_on(t.day)).groupBy("org_id").agg(F.count("*").alias("members"))


ROLLUP = f"SELECT anc AS id, count(*) FILTER (len(path) >= 2 AND path[-2] = anc) AS child_count, count(*) FILTER (tree.id <> anc) AS descendant_count, count(*) FILTER (tree.id <> anc AND kind = 'lab') AS lab_count FROM (SELECT id, path, unnest(path) AS anc FROM tree) tree JOIN organizations o ON o.id = tree.id GROUP BY 1"


@query("a06_tree_rollups", ROLLUP)
def a06(t):
    kinds = t.organizations.select("id", "kind")
    below = F.col("distance") > 0
    return closure(t).join(kinds, "id").groupBy(F.col("ancestor").alias("id")).agg(
        F.count_if(F.col("distance") == 1).alias("child_count"), F.count_if(below).alias("descendant_count"), F.count_if(below & (F.col("kind") == "lab")).alias("lab_count"))


@query("a07_subtree_people", f"SELECT anc AS org_id, count(DISTINCT person_id) AS people FROM (SELECT id, unnest(path) AS anc FROM tree) c JOIN affiliations a ON a.org_id = c.id WHERE {live('a.')} GROUP BY 1")
def a07(t):
    members = t.affiliations.where(valid_on(t.day)).select("person_id", F.col("org_id").alias("id")).distinct()
    return members.join(closure(t), "id").groupBy(F.col("ancestor").alias("org_id")).agg(F.countDistinct("person_id").alias("people"))


@query("a08_impact_inputs", "SELECT person_id, count(*) AS pubs, coalesce(sum(cited_by), 0)::BIGINT AS cites, max(year) AS last_year FROM authors JOIN publications ON id = publication_id GROUP BY 1")
def a08(t):
    return impact_inputs(t)


def impact_inputs(t):
    own = t.authors.select("person_id", F.col("publication_id").alias("id"))
    return own.join(t.publications, "id").groupBy("person_id").agg(F.count("*").alias("pubs"), F.coalesce(F.sum("cited_by"), F.lit(0)).alias("cites"), F.max("year").alias("last_year"))


#: The weight of each position in the impact score.
RANK_WEIGHTS = {
    "dean": 1.0, "executive": 0.98, "board_member": 0.96, "department_head": 0.94, "principal_investigator": 0.92, "group_leader": 0.90, "full_professor": 0.88,
    "emeritus_professor": 0.86, "associate_professor": 0.78, "assistant_professor": 0.68, "adjunct_professor": 0.55, "lecturer": 0.50, "research_scientist": 0.48,
    "staff_scientist": 0.46, "research_fellow": 0.42, "visiting": 0.40, "postdoc": 0.32, "engineer": 0.28, "technician": 0.25, "phd_student": 0.18,
    "visiting_student": 0.15, "masters_student": 0.12, "undergraduate": 0.08}
OTHER_RANK = 0.40


def impact(t):
    """(person_id, impact) scaled by the maximum over all people, as one aggregate joined back."""
    weights = F.create_map(*[F.lit(x) for kv in RANK_WEIGHTS.items() for x in kv])
    ranks = anchors(t).select("person_id", "position_rank")
    base = 4 * F.log1p(F.greatest(F.col("cites"), F.lit(0))) + 2.5 * F.log1p(F.greatest(F.col("pubs"), F.lit(0)))
    rows = impact_inputs(t).join(ranks, "person_id", "left").select("person_id", base.alias("b"), F.coalesce(F.try_element_at(weights, F.col("position_rank")), F.lit(OTHER_RANK)).alias("w"))
    rows = rows.select("person_id", F.when(F.col("b") > 0, F.col("b") + 0.6 * F.col("w")).otherwise(F.lit(0.0)).alias("raw"))
    top = rows.agg(F.max("raw").alias("top"))
    return rows.join(F.broadcast(top)).select("person_id", F.when(F.col("top") > 0, F.least(F.lit(1.0), F.col("raw") / F.col("top"))).otherwise(F.lit(0.0)).alias("impact"))


WEIGHT_CASE = "CASE position_rank " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in RANK_WEIGHTS.items()) + f" ELSE {OTHER_RANK}::DOUBLE END"
IMPACT = f"SELECT person_id, CASE WHEN b > 0 THEN b + 0.6::DOUBLE * ({WEIGHT_CASE}) ELSE 0 END AS raw FROM (SELECT person_id, 4 * ln(1 + greatest(coalesce(sum(cited_by), 0), 0)) + 2.5::DOUBLE * ln(1 + count(*)) AS b FROM authors JOIN publications ON id = publication_id GROUP BY 1) LEFT JOIN (SELECT person_id, position_rank FROM anchor) USING (person_id)"


@query("a09_impact", f"SELECT person_id, round(least(1.0, raw / max(raw) OVER ()), 6)::DOUBLE AS impact FROM ({IMPACT})")
def a09(t):
    return impact(t).withColumn("impact", F.round("impact", 6))


@query("w03_global_maximum", f"SELECT person_id, round(raw, 6)::DOUBLE AS raw, round(max(raw) OVER (), 6)::DOUBLE AS top FROM ({IMPACT})")
def w03(t):
    weights = F.create_map(*[F.lit(x) for kv in RANK_WEIGHTS.items() for x in kv])
    rows = impact_inputs(t).join(anchors(t).select("person_id", "position_rank"), "person_id", "left")
    raw = 4 * F.log1p("cites") + 2.5 * F.log1p("pubs") + 0.6 * F.coalesce(F.try_element_at(weights, F.col("position_rank")), F.lit(OTHER_RANK))
    rows = rows.select("person_id", raw.alias("raw"))
    return rows.join(F.broadcast(rows.agg(F.max("raw").alias("top")))).select("person_id", F.round("raw", 6).alias("raw"), F.round("top", 6).alias("top"))


@query("a10_person_topics", "SELECT a.person_id, p.venue AS topic_id, round(avg(coalesce(p.cited_by / 500.0::DOUBLE, 0.5)), 6)::DOUBLE AS score, count(DISTINCT a.publication_id) AS works_count FROM authors a JOIN publications p ON p.id = a.publication_id GROUP BY 1, 2")
def a10(t):
    own = t.authors.join(t.publications.select(F.col("id").alias("publication_id"), "venue", "cited_by"), "publication_id")
    return own.groupBy("person_id", F.col("venue").alias("topic_id")).agg(F.round(F.avg(F.coalesce(F.col("cited_by") / 500.0, F.lit(0.5))), 6).alias("score"), F.countDistinct("publication_id").alias("works_count"))


CONCEPTS = "SELECT a.person_id, p.venue % 50 AS concept_id, sum(p.cited_by)::BIGINT AS total, count(*) AS n FROM authors a JOIN publications p ON p.id = a.publication_id GROUP BY 1, 2"


def person_concepts(t):
    own = t.authors.join(t.publications.select(F.col("id").alias("publication_id"), "venue", "cited_by"), "publication_id")
    rows = own.groupBy("person_id", (F.col("venue") % 50).alias("concept_id")).agg(F.sum("cited_by").alias("total"), F.count("*").alias("n"))
    return top_per(rows, ["person_id"], [F.desc("total"), "concept_id"], 15, "rank")


@query("a11_person_concepts", f"SELECT person_id, concept_id, round(total / n, 6)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY total DESC, concept_id) AS rank FROM ({CONCEPTS})) WHERE rank <= 15")
def a11(t):
    return person_concepts(t).select("person_id", "concept_id", F.round(F.col("total") / F.col("n"), 6).alias("score"), "rank")


@query("w01_concept_rank", f"SELECT person_id, concept_id, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY total DESC, concept_id) AS rank FROM ({CONCEPTS})) WHERE rank <= 15")
def w01(t):
    return person_concepts(t).drop("n")


@query("a12_mega_papers", "SELECT publication_id, count(*) AS authors FROM authors GROUP BY 1 HAVING count(*) >= 10")
def a12(t):
    return t.authors.groupBy("publication_id").agg(F.count("*").alias("authors")).where("authors >= 10")


@query("a13_ids_per_name", "SELECT lower(firstname || ' ' || lastname) AS name, array_to_string(list_sort(list(id)), ',') AS ids FROM people GROUP BY 1 HAVING count(*) > 1")
def a13(t):
    rows = t.people.groupBy(F.lower(F.concat_ws(" ", "firstname", "lastname")).alias("name")).agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    return rows.select("name", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("a14_sole_author_papers", "SELECT publication_id, min(person_id) AS person_id FROM authors GROUP BY 1 HAVING count(*) = 1 AND bool_or(is_corresponding)")
def a14(t):
    return t.authors.groupBy("publication_id").agg(F.min("person_id").alias("person_id"), F.count("*").alias("n"), F.bool_or("is_corresponding").alias("c")).where("n = 1 AND c").drop("n", "c")


@query("a15_conditional_max", "SELECT person_id, max(CASE WHEN is_primary THEN 1.0 WHEN valid_to IS NULL THEN 0.45 ELSE 0 END)::DOUBLE AS score FROM affiliations GROUP BY 1")
def a15(t):
    return t.affiliations.groupBy("person_id").agg(F.max(F.when(F.col("is_primary"), 1.0).when(F.col("valid_to").isNull(), 0.45).otherwise(0.0)).alias("score"))


@query("a16_greatest_least", "SELECT from_id, to_id, least(from_id, to_id) AS low, greatest(from_id, to_id) AS high, coalesce(least(valid_from, DATE '1997-01-01'), DATE '1997-01-01') AS since FROM relations")
def a16(t):
    day = F.lit("1997-01-01").cast("date")
    return t.relations.select("from_id", "to_id", F.least("from_id", "to_id").alias("low"), F.greatest("from_id", "to_id").alias("high"), F.least("valid_from", day).alias("since"))


@query("a17_unique_names", "SELECT lower(firstname || ' ' || lastname) AS name, min(id) AS id FROM people GROUP BY 1 HAVING count(*) = 1")
def a17(t):
    return unique_names(t)


def unique_names(t):
    return t.people.groupBy(F.lower(F.concat_ws(" ", "firstname", "lastname")).alias("name")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


EVIDENCE = "SELECT s.id AS snapshot_id, s.url, s.fetched_at, o.id AS org_id FROM snapshots s JOIN organizations o ON o.id = 10001 + s.id % (SELECT count(*) FROM supplier)"


def evidence(t):
    """(snapshot_id, url, fetched_at, org_id): each page speaks for one lab."""
    n = t.raw("supplier").agg(F.count("*").alias("labs"))
    rows = t.snapshots.join(F.broadcast(n)).select(F.col("id").alias("snapshot_id"), "url", "fetched_at", (F.lit(10001) + F.col("id") % F.col("labs")).alias("org_id"))
    return rows.join(t.organizations.select(F.col("id").alias("org_id")), "org_id", "left_semi")


@query("a18_sources_per_org", f"SELECT org_id, string_agg(url, '|' ORDER BY fetched_at DESC, snapshot_id) AS sources, count(*) AS n FROM ({EVIDENCE}) GROUP BY 1")
def a18(t):
    newest = F.sort_array(F.collect_list(F.struct((-F.unix_date("fetched_at")).alias("d"), "snapshot_id", "url")))
    return evidence(t).groupBy("org_id").agg(F.array_join(F.transform(newest, lambda x: x["url"]), "|").alias("sources"), F.count("*").alias("n"))


@query("a22_member_counts", "SELECT label AS cluster, count(*) AS members, min(vec_id) AS first FROM embeddings GROUP BY 1")
def a22(t):
    return t.raw("embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("members"), F.min("vec_id").alias("first"))


@query("a23_legend_top6", "SELECT org_id, count(*) AS people FROM anchor GROUP BY 1 ORDER BY people DESC, org_id LIMIT 6")
def a23(t):
    return anchors(t).groupBy("org_id").agg(F.count("*").alias("people")).orderBy(F.desc("people"), "org_id").limit(6)


@query("a24_year_domain", "SELECT min(last_year) AS first, max(last_year) AS last, (max(last_year) - min(last_year) + 1)::BIGINT AS years FROM (SELECT person_id, max(year) AS last_year FROM authors JOIN publications ON id = publication_id GROUP BY 1)")
def a24(t):
    return impact_inputs(t).agg(F.min("last_year").alias("first"), F.max("last_year").alias("last")).withColumn("years", F.size(F.sequence("first", "last")).cast("long"))


@query("a25_densest_cluster", "SELECT label AS cluster, count(*) AS members, round(avg(embedding[1]::DOUBLE), 6)::DOUBLE AS cx, round(avg(embedding[2]::DOUBLE), 6)::DOUBLE AS cy FROM embeddings GROUP BY 1 HAVING count(*) >= 2 ORDER BY members DESC, cluster LIMIT 1")
def a25(t):
    rows = t.raw("embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    rows = rows.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("members"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))
    return rows.where("members >= 2").orderBy(F.desc("members"), "cluster").limit(1)


@query("w02_distinct_on", "SELECT person_id, org_id, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY valid_from, id) AS rn FROM affiliations) WHERE rn = 1")
def w02(t):
    return top_per(t.affiliations, ["person_id"], ["valid_from", "id"]).select("person_id", "org_id", "valid_from")


# filters and projections


@query("s03_active_run", "SELECT id, url FROM snapshots WHERE expires_at > DATE '1998-06-01' ORDER BY id DESC LIMIT 1")
def s03(t):
    return t.snapshots.where(F.col("expires_at") > t.day).orderBy(F.desc("id")).limit(1).select("id", "url")


@query("s07_merged_search", "SELECT id, min(k) AS found_by FROM (SELECT id, 0 AS k FROM titles WHERE contains(lower(title), 'the') UNION ALL SELECT id, 1 FROM titles WHERE contains(lower(title), 'and')) GROUP BY 1")
def s07(t):
    hits = [t.titles.where(F.contains(F.lower("title"), F.lit(w))).select("id", F.lit(k).alias("found_by")) for k, w in enumerate(("the", "and"))]
    return hits[0].union(hits[1]).groupBy("id").agg(F.min("found_by").alias("found_by"))


@query("s12_snapshot_read_back", "SELECT s.id, s.hash, length(html) AS chars FROM snapshots s LEFT JOIN pages ON page_id = s.id AND sha256(html) = s.hash")
def s12(t):
    body = t.raw("pages").select(F.col("page_id").alias("id"), F.sha2("html", 256).alias("hash"), F.length("html").cast("long").alias("chars"))
    return t.snapshots.select("id", "hash").join(body, ["id", "hash"], "left")


@query("s11_snapshot_sink")
def s11(t):
    """Pages that are new by (url, digest), with the day they expire."""
    known = t.snapshots.where(F.col("fetched_at") <= F.lit("1997-07-01").cast("date")).select("url", "hash")
    return t.snapshots.dropDuplicates(["url", "hash"]).join(known, ["url", "hash"], "left_anti")


@query("p01_as_of", f"SELECT id, person_id, org_id FROM affiliations WHERE {live()}")
def p01(t):
    return t.affiliations.where(valid_on(t.day)).select("id", "person_id", "org_id")


@query("p02_in_list", "SELECT id, name FROM organizations WHERE kind IN ('university', 'department')")
def p02(t):
    return t.organizations.where(F.col("kind").isin("university", "department")).select("id", "name")


@query("p03_other_endpoint", "SELECT person_id, other_id, paper_count FROM ties")
def p03(t):
    return doubled(coauthor_edges(t)).select("person_id", "other_id", "paper_count")


@query("p04_either_end", "SELECT from_id, to_id FROM relations WHERE from_id < 100 OR to_id < 100")
def p04(t):
    return t.relations.where("from_id < 100 OR to_id < 100").select("from_id", "to_id")


@query("p05_null_safe_equality", "SELECT a.id, b.id AS other FROM affiliations a JOIN affiliations b ON a.person_id = b.person_id AND a.id < b.id AND a.valid_to IS NOT DISTINCT FROM b.valid_to")
def p05(t):
    a = t.affiliations.select("id", "person_id", "valid_to")
    b = a.toDF("other", "person_id", "end")
    return a.join(b, "person_id").where((F.col("id") < F.col("other")) & F.col("valid_to").eqNullSafe(F.col("end"))).select("id", "other")


@query("p06_literal_wildcards", "SELECT id FROM titles WHERE contains(title, '%') OR contains(title, '_')")
def p06(t):
    return t.titles.where(F.contains("title", F.lit("%")) | F.contains("title", F.lit("_"))).select("id")


@query("p07_prefix_or_substring", "SELECT id, CASE WHEN starts_with(lower(lastname), 'b') THEN 0.7 ELSE 0.55 END::DOUBLE AS score FROM people WHERE contains(lower(lastname), 'b')")
def p07(t):
    last = F.lower("lastname")
    return t.people.where(F.contains(last, F.lit("b"))).select("id", F.when(F.startswith(last, F.lit("b")), 0.7).otherwise(0.55).alias("score"))


@query("p08_reverse_contains", "SELECT t.id, n.name FROM titles t JOIN (SELECT DISTINCT substring(p_type, 1, 3) AS name FROM part) n ON contains(lower(t.title), lower(n.name))")
def p08(t):
    names = t.raw("part").select(F.substring("p_type", 1, 3).alias("name")).distinct()
    titles = t.titles.select("id", F.lower("title").alias("name"))
    found = contained(names.select(F.lower("name").alias("question")), titles)
    return found.join(names.withColumn("question", F.lower("name")), "question").select("id", "name")


@query("p09_year_window", "SELECT id, year FROM publications WHERE year BETWEEN 1996 AND 2000")
def p09(t):
    return t.publications.where(F.col("year").between(1996, 2000)).select("id", "year")


@query("p10_not_context_only", "SELECT id, kind FROM organizations WHERE NOT coalesce(is_context_only, false)")
def p10(t):
    return t.organizations.where(~F.coalesce("is_context_only", F.lit(False))).select("id", "kind")


@query("p11_finite_guard", "SELECT vec_id, label FROM embeddings WHERE isfinite(embedding[1]) AND abs(embedding[1]) <= 1e6 AND label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) > 1)")
def p11(t):
    rows = t.raw("embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"))
    alive = rows.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return rows.where(~F.isnan("x") & (F.abs("x") <= 1e6)).join(alive, "label", "left_semi").select("vec_id", "label")


@query("p12_first_non_empty", "SELECT id, coalesce(nullif(short_name, ''), nullif(name, ''), 'Organization not linked') AS label FROM organizations")
def p12(t):
    return t.organizations.select("id", F.coalesce(F.nullif("short_name", F.lit("")), F.nullif("name", F.lit("")), F.lit("Organization not linked")).alias("label"))


@query("p15_filtered_page", "SELECT id, label FROM (SELECT p.id, firstname || ' ' || lastname AS label, row_number() OVER (ORDER BY firstname || ' ' || lastname, p.id) AS rn FROM people p WHERE contains(lower(firstname || ' ' || lastname), 'a')) WHERE rn BETWEEN 51 AND 100")
def p15(t):
    label = F.concat_ws(" ", "firstname", "lastname")
    return t.people.select("id", label.alias("label")).where(F.contains(F.lower("label"), F.lit("a"))).orderBy("label", "id").offset(50).limit(50)


@query("p16_since_year", "SELECT p.id FROM people p LEFT JOIN (SELECT person_id, max(year) AS y FROM authors JOIN publications ON id = publication_id GROUP BY 1) ON person_id = p.id WHERE coalesce(y, 9999) >= 2000")
def p16(t):
    last = impact_inputs(t).select(F.col("person_id").alias("id"), "last_year")
    return t.people.join(last, "id", "left").where(F.coalesce("last_year", F.lit(9999)) >= 2000).select("id")


@query("p17_viewport", "SELECT vec_id FROM embeddings WHERE (embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.1) OR vec_id = 0")
def p17(t):
    x, y = F.col("embedding")[0], F.col("embedding")[1]
    return t.raw("embeddings").where((x.between(-0.1, 0.1) & y.between(-0.1, 0.1)) | (F.col("vec_id") == 0)).select("vec_id")


# joins


@query("j01_inner", "SELECT publication_id, person_id, year FROM authors JOIN publications ON id = publication_id")
def j01(t):
    return t.authors.join(t.publications.select(F.col("id").alias("publication_id"), "year"), "publication_id").select("publication_id", "person_id", "year")


@query("j02_left_outer", "SELECT p.id, c_name AS venue FROM publications p LEFT JOIN customer ON c_custkey = venue AND c_acctbal > 0")
def j02(t):
    venues = t.raw("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("venue"), "c_name")
    return t.publications.join(venues, "venue", "left").select("id", F.col("c_name").alias("venue"))


@query("j03_identity_pivot", "SELECT person_id, max(CASE WHEN k = 0 THEN org_id END) AS lab0, max(CASE WHEN k = 1 THEN org_id END) AS lab1, max(CASE WHEN k = 2 THEN org_id END) AS lab2 FROM (SELECT person_id, org_id, org_id % 3 AS k FROM affiliations) GROUP BY 1")
def j03(t):
    rows = t.affiliations.select("person_id", "org_id", (F.col("org_id") % 3).alias("k"))
    return rows.groupBy("person_id").pivot("k", [0, 1, 2]).agg(F.max("org_id")).toDF("person_id", "lab0", "lab1", "lab2")


@query("j04_pairs", "SELECT publication_id, a, b FROM pairs")
def j04(t):
    return coauthor_pairs(t).select("publication_id", "a", "b")


@query("j05_anchor_strict", "SELECT person_id, org_id, id AS affiliation_id FROM anchor WHERE active")
def j05(t):
    return anchors(t).where("active").select("person_id", "org_id", F.col("id").alias("affiliation_id"))


@query("j06_anchor_batch", "SELECT person_id, org_id, active FROM anchor")
def j06(t):
    return anchors(t).select("person_id", "org_id", "active")


@query("j07_lateral_top1", f"SELECT person_id, concept_id AS top_concept FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY total DESC, concept_id) AS rn FROM ({CONCEPTS})) WHERE rn = 1")
def j07(t):
    return person_concepts(t).where("rank = 1").select("person_id", F.col("concept_id").alias("top_concept"))


@query("j08_lateral_aggregate", "SELECT p.id, coalesce(n, 0)::BIGINT AS pubs, y AS last_year FROM people p LEFT JOIN (SELECT person_id, count(*) AS n, max(year) AS y FROM authors JOIN publications ON id = publication_id GROUP BY 1) ON person_id = p.id")
def j08(t):
    return t.people.select("id").join(impact_inputs(t).withColumnRenamed("person_id", "id"), "id", "left").select("id", F.coalesce("pubs", F.lit(0)).alias("pubs"), "last_year")


@query("j09_ancestors_in_order", "SELECT id, ancestor, k FROM (SELECT id, unnest(path) AS ancestor, generate_subscripts(path, 1)::BIGINT AS k FROM tree)")
def j09(t):
    return org_tree(t).select("id", F.posexplode("path").alias("k", "ancestor")).select("id", "ancestor", (F.col("k") + 1).cast("long").alias("k"))


@query("j10_disjunctive", "SELECT DISTINCT r.from_id, r.to_id, b.other_id FROM relations r JOIN ties b ON b.person_id IN (r.from_id, r.to_id)")
def j10(t):
    ends = t.relations.select("from_id", "to_id", F.explode(F.array("from_id", "to_id")).alias("person_id"))
    return ends.join(doubled(coauthor_edges(t)).select("person_id", "other_id"), "person_id").select("from_id", "to_id", "other_id").distinct()


@query("j11_semi", "SELECT p.id, p.id IN (SELECT person_id FROM authors WHERE is_corresponding) AS leads FROM people p")
def j11(t):
    lead = t.authors.where("is_corresponding").select(F.col("person_id").alias("id")).distinct().withColumn("leads", F.lit(True))
    return t.people.select("id").join(lead, "id", "left").select("id", F.coalesce("leads", F.lit(False)).alias("leads"))


@query("j12_anti", "SELECT id FROM people p WHERE NOT EXISTS (SELECT 1 FROM affiliations a WHERE a.person_id = p.id AND a.valid_to IS NOT NULL)")
def j12(t):
    return t.people.join(t.affiliations.where("valid_to IS NOT NULL").select(F.col("person_id").alias("id")), "id", "left_anti").select("id")


@query("j13_case_keyed", "SELECT person_id, firstname || ' ' || lastname AS other, paper_count FROM ties JOIN people ON id = other_id")
def j13(t):
    names = t.people.select(F.col("id").alias("other_id"), F.concat_ws(" ", "firstname", "lastname").alias("other"))
    return doubled(coauthor_edges(t)).join(names, "other_id").select("person_id", "other", "paper_count")


# ordered reads


@query("k01_top_coauthors", "SELECT person_id, other_id, paper_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY paper_count DESC, other_id) AS rank FROM ties) WHERE rank <= 16")
def k01(t):
    return top_coauthors(t)


def top_coauthors(t, n: int = 16):
    return top_per(doubled(coauthor_edges(t)), ["person_id"], [F.desc("paper_count"), "other_id"], n, "rank").select("person_id", "other_id", "paper_count", "rank")


ROSTER = f"SELECT org_id, person_id, lower(lastname) || chr(9) || lower(firstname) AS sort_key FROM affiliations a JOIN people p ON p.id = person_id WHERE {live('a.')}"


def roster(t):
    keys = t.people.select(F.col("id").alias("person_id"), F.concat(F.lower("lastname"), F.lit("\t"), F.lower("firstname")).alias("sort_key"))
    return t.affiliations.where(valid_on(t.day)).select("org_id", "person_id").join(keys, "person_id").select("org_id", "person_id", "sort_key")


@query("k02_roster_page", f"SELECT org_id, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY sort_key, person_id) AS rank FROM ({ROSTER})) WHERE rank BETWEEN 25 AND 48")
def k02(t):
    return top_per(roster(t), ["org_id"], ["sort_key", "person_id"], 48, "rank").where("rank > 24").select("org_id", "person_id", "rank")


@query("k03_keyset_page", f"SELECT org_id, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY sort_key, person_id) AS rank FROM ({ROSTER}) WHERE (sort_key, person_id) > ('m' || chr(9), 0)) WHERE rank <= 24")
def k03(t):
    after = F.struct(F.col("sort_key").alias("a"), F.col("person_id").alias("b")) > F.struct(F.lit("m\t").alias("a"), F.lit(0).cast("long").alias("b"))
    return top_per(roster(t).where(after), ["org_id"], ["sort_key", "person_id"], 24, "rank").select("org_id", "person_id", "rank")


@query("k04_publications_then_filter", "SELECT person_id, publication_id, rank FROM (SELECT person_id, publication_id, title, row_number() OVER (PARTITION BY person_id ORDER BY year DESC, publication_id DESC) AS rank FROM authors JOIN publications ON id = publication_id) WHERE rank <= 100 AND NOT contains(title, 'NOT SPECIFIED')")
def k04(t):
    own = t.authors.join(t.publications.select(F.col("id").alias("publication_id"), "year", "title"), "publication_id")
    return top_per(own, ["person_id"], [F.desc("year"), F.desc("publication_id")], 100, "rank").where(~F.contains("title", F.lit("NOT SPECIFIED"))).select("person_id", "publication_id", "rank")


def colleagues(t, n: int = 8):
    """The first ``n`` colleagues of every person: all members of an organization share one order, so the first n + 1
    of it hold the first n others of each, and an organization of m members makes m (n + 1) pairs rather than m * m."""
    home = anchors(t).where("active").select("person_id", "org_id")
    mates = top_per(roster(t).distinct(), ["org_id"], ["sort_key", "person_id"], n + 1).select("org_id", F.col("person_id").alias("other_id"), "sort_key")
    return top_per(home.join(mates, "org_id").where("person_id <> other_id"), ["person_id"], ["sort_key", "other_id"], n, "rank").select("person_id", "other_id", "rank")


COLLEAGUES = f"SELECT person_id, other_id, rank FROM (SELECT h.person_id, m.other_id, row_number() OVER (PARTITION BY h.person_id ORDER BY sort_key, other_id) AS rank FROM (SELECT person_id, org_id FROM anchor WHERE active) h JOIN (SELECT DISTINCT org_id, person_id AS other_id, sort_key FROM ({ROSTER})) m ON m.org_id = h.org_id AND m.other_id <> h.person_id) WHERE rank <= 8"


@query("k05_colleagues", COLLEAGUES)
def k05(t):
    return colleagues(t)


@query("k06_search_order", "SELECT id, row_number() OVER (ORDER BY CASE WHEN starts_with(lower(lastname), 'b') THEN 0.7 ELSE 0.55 END DESC, lastname, firstname, id) AS place FROM people WHERE contains(lower(lastname), 'b')")
def k06(t):
    score = F.when(F.startswith(F.lower("lastname"), F.lit("b")), 0.7).otherwise(0.55)
    rows = t.people.where(F.contains(F.lower("lastname"), F.lit("b"))).withColumn("score", score)
    return ranked(rows, [F.desc("score"), F.asc("lastname"), F.asc("firstname"), F.asc("id")]).select("id", "place")


@query("k07_top40_alters", "SELECT person_id, other_id, importance FROM (SELECT b.person_id, other_id, round(least(1.0, paper_count / n), 6)::DOUBLE AS importance, row_number() OVER (PARTITION BY b.person_id ORDER BY least(1.0, paper_count / n) DESC, other_id) AS rn FROM ties b JOIN (SELECT person_id, count(*)::DOUBLE AS n FROM authors GROUP BY 1) c ON c.person_id = b.person_id) WHERE rn <= 40")
def k07(t):
    n = t.authors.groupBy("person_id").agg(F.count("*").alias("n"))
    rows = doubled(coauthor_edges(t)).join(n, "person_id").select("person_id", "other_id", F.least(F.lit(1.0), F.col("paper_count") / F.col("n")).alias("importance"))
    return top_per(rows, ["person_id"], [F.desc("importance"), "other_id"], 40).withColumn("importance", F.round("importance", 6))


@query("k08_nulls_last", "SELECT id, row_number() OVER (PARTITION BY org_id ORDER BY valid_to DESC NULLS LAST, id) AS place FROM affiliations")
def k08(t):
    return t.affiliations.select("id", F.row_number().over(W.partitionBy("org_id").orderBy(F.desc_nulls_last("valid_to"), "id")).cast("long").alias("place"))


@query("k09_universities_by_people", f"SELECT o.id, o.name, count(DISTINCT person_id) AS people FROM organizations o JOIN (SELECT id, unnest(path) AS anc FROM tree) c ON c.anc = o.id JOIN affiliations a ON a.org_id = c.id AND {live('a.')} WHERE o.kind = 'university' GROUP BY 1, 2 ORDER BY people DESC, name")
def k09(t):
    return a07(t).join(t.organizations.where("kind = 'university'"), F.col("org_id") == F.col("id")).select("id", "name", "people").orderBy(F.desc("people"), "name")


@query("k10_cluster_edges", "SELECT * FROM (SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, sum(paper_count)::DOUBLE AS weight FROM edges e JOIN embeddings x ON x.vec_id = person_a JOIN embeddings y ON y.vec_id = person_b WHERE x.label <> y.label GROUP BY 1, 2) WHERE weight > 0 ORDER BY weight DESC, a, b LIMIT 30")
def k10(t):
    return cluster_weights(t).where("a <> b AND weight > 0").orderBy(F.desc("weight"), "a", "b").limit(30)


def cluster_weights(t):
    """(a, b, weight) between the clusters of the mapped people, a <= b."""
    of = lambda k, c: t.raw("embeddings").select(F.col("vec_id").alias(k), F.col("label").alias(c))
    rows = coauthor_edges(t).join(of("person_a", "x"), "person_a").join(of("person_b", "y"), "person_b")
    return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("paper_count").cast("double").alias("weight"))


@query("k12_canonical_row", "SELECT venue, arg_max(id, (cited_by, -id)) AS id FROM publications GROUP BY 1")
def k12(t):
    return t.publications.groupBy("venue").agg(F.max_by("id", F.struct("cited_by", -F.col("id"))).alias("id"))


@query("k13_strongest_edges", "SELECT person_a, person_b, paper_count FROM edges ORDER BY paper_count DESC, person_a, person_b LIMIT (SELECT 3 * count(*) FROM people)")
def k13(t):
    n = 3 * t.people.count()
    return coauthor_edges(t).orderBy(F.desc("paper_count"), "person_a", "person_b").limit(n).select("person_a", "person_b", "paper_count")


# set operations


@query("u02_ordered_dedupe", "SELECT org_id, min(id) AS first_id FROM affiliations GROUP BY 1")
def u02(t):
    return top_per(t.affiliations, ["org_id"], ["id"]).select("org_id", F.col("id").alias("first_id"))


@query("u03_union_with_precedence", "SELECT person_id, other_id, arg_min(relation, k) AS relation FROM (SELECT from_id AS person_id, to_id AS other_id, 'advisor' AS relation, 0 AS k FROM relations UNION ALL SELECT to_id, from_id, 'advisee', 1 FROM relations UNION ALL SELECT person_id, other_id, 'coauthor', 2 FROM ties) GROUP BY 1, 2")
def u03(t):
    parts = [t.relations.select(F.col("from_id").alias("person_id"), F.col("to_id").alias("other_id"), F.lit("advisor").alias("relation"), F.lit(0).alias("k")),
             t.relations.select("to_id", "from_id", F.lit("advisee"), F.lit(1)), doubled(coauthor_edges(t)).select("person_id", "other_id", F.lit("coauthor"), F.lit(2))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("person_id", "other_id").agg(F.min_by("relation", "k").alias("relation"))


@query("u04_page_union", f"SELECT org_id, count(*) AS people, max(rank) AS next FROM (SELECT DISTINCT org_id, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY sort_key, person_id) AS rank FROM ({ROSTER})) WHERE rank <= 30) GROUP BY 1")
def u04(t):
    rows = top_per(roster(t), ["org_id"], ["sort_key", "person_id"], 30, "rank")
    pages = rows.where("rank <= 20").union(rows.where("rank > 10")).dropDuplicates(["org_id", "person_id", "rank"])
    return pages.groupBy("org_id").agg(F.count("*").alias("people"), F.max("rank").alias("next"))


LINKS = f"SELECT 'p' || from_id AS a, 'p' || to_id AS b, 'report' AS relation, 4 AS k FROM relations WHERE {live()} UNION ALL SELECT 'p' || person_id, 'o' || org_id, 'placement', 3 FROM anchor UNION ALL SELECT 'o' || child, 'o' || parent, 'org_parent', 2 FROM live_links UNION ALL SELECT 'p' || person_a, 'p' || person_b, 'coauthor', 1 FROM edges"


def all_links(t):
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    return (t.relations.where(valid_on(t.day)).select(name("p", "from_id").alias("a"), name("p", "to_id").alias("b"), F.lit("report").alias("relation"), F.lit(4).alias("k"))
            .union(anchors(t).select(name("p", "person_id"), name("o", "org_id"), F.lit("placement"), F.lit(3)))
            .union(live_org_links(t).select(name("o", "child"), name("o", "parent"), F.lit("org_parent"), F.lit(2)))
            .union(coauthor_edges(t).select(name("p", "person_a"), name("p", "person_b"), F.lit("coauthor"), F.lit(1))))


@query("u05_link_merge", f"SELECT least(a, b) AS a, greatest(a, b) AS b, arg_max(relation, k) AS relation, count(DISTINCT relation) AS kinds FROM ({LINKS}) GROUP BY 1, 2")
def u05(t):
    return all_links(t).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max_by("relation", "k").alias("relation"), F.countDistinct("relation").alias("kinds"))
