"""Ingest and entity resolution as set-based plans: matching, upserts, clean-up, merges and erasure."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators.components import shared_dir
from ..operators.core import anchors, coauthor_edges, doubled, org_tree, top_per, valid_on
from ..operators.cv import cv_entries
from ..operators.grams import contained
from ..operators.page_forms import FORMS, read_profiles
from .graph import chained
from .oracle import DAY, live
from .registry import query
from .relational import EVIDENCE, evidence, unique_names


@query("e01_upsert_greatest", "SELECT person_id, org_id, max(score)::DOUBLE AS score FROM (SELECT person_id, org_id, 0.5::DOUBLE AS score FROM affiliations UNION ALL SELECT person_id, org_id, 0.9::DOUBLE FROM anchor) GROUP BY 1, 2")
def e01(t):
    """Old and new links under one key keep the greater score."""
    old = t.affiliations.select("person_id", "org_id", F.lit(0.5).alias("score"))
    return old.union(anchors(t).select("person_id", "org_id", F.lit(0.9))).groupBy("person_id", "org_id").agg(F.max("score").alias("score"))


@query("e02_link_topics", "SELECT person_id, topic, round(score, 6)::DOUBLE AS score, k = 1 AS is_primary FROM (SELECT vec_id AS person_id, unnest(embedding[1:12])::DOUBLE AS score, generate_subscripts(embedding[1:12], 1) AS k, generate_subscripts(embedding[1:12], 1) - 1 AS topic FROM embeddings) WHERE score >= 0.05")
def e02(t):
    """The first twelve of the list, then those with a score of 0.05 or more; the first of the list is primary."""
    rows = t.raw("embeddings").select(F.col("vec_id").alias("person_id"), F.posexplode(F.slice("embedding", 1, 12)).alias("topic", "score"))
    rows = rows.select("person_id", F.col("topic").cast("long").alias("topic"), F.col("score").cast("double").alias("score"))
    return rows.where("score >= 0.05").select("person_id", "topic", F.round("score", 6).alias("score"), (F.col("topic") == 0).alias("is_primary"))


@query("e03_work_concepts", "SELECT person_id, topic, place FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, topic) AS place FROM (SELECT *, topic % 8 = 0 AS root, bool_and(topic % 8 = 0) OVER (PARTITION BY person_id) AS alone FROM person_topics WHERE score >= 0.1::FLOAT) WHERE NOT root OR alone) WHERE place <= 8")
def e03(t):
    """Concepts over the threshold, roots only where nothing else is left, eight at most."""
    rows = t.person_topics.where(F.col("score") >= F.lit(0.1).cast("float")).withColumn("root", F.col("topic") % 8 == 0)
    rows = rows.withColumn("only", F.bool_and("root").over(W.partitionBy("person_id"))).where("NOT root OR only")
    return top_per(rows, ["person_id"], [F.desc("score"), "topic"], 8, "place").select("person_id", "topic", "place")


INCOMING = "SELECT id + 7 AS new_id, title, year + id % 4 AS year, venue, date FROM publications"


@query("e04_publication_upsert", f"WITH inc AS ({INCOMING}) SELECT i.new_id, coalesce(CASE WHEN i.new_id % 3 = 0 THEN a.id END, d.id, m.id) AS match_id, CASE WHEN i.new_id % 3 = 0 AND a.id IS NOT NULL THEN 'id' WHEN d.id IS NOT NULL THEN 'date' WHEN m.id IS NOT NULL THEN 'title' ELSE 'new' END AS tier FROM inc i LEFT JOIN publications a ON a.id = i.new_id LEFT JOIN (SELECT venue, date, min(id) AS id FROM publications WHERE id % 2 = 0 GROUP BY 1, 2) d ON d.venue = i.venue AND d.date = i.date LEFT JOIN publications m ON m.title = i.title AND abs(m.year - i.year) <= 2")
def e04(t):
    """Match by identifier, then by a second key, then by equal title within two years; the rest is new."""
    p = t.publications
    inc = p.select((F.col("id") + 7).alias("new_id"), "title", (F.col("year") + F.col("id") % 4).alias("year"), "venue", "date")
    by_id = p.select(F.col("id").alias("new_id"), F.col("id").alias("a"))
    by_date = p.where("id % 2 = 0").groupBy("venue", "date").agg(F.min("id").alias("d"))
    by_title = p.select("title", F.col("id").alias("m"), F.col("year").alias("y"))
    rows = inc.join(by_id, "new_id", "left").join(by_date, ["venue", "date"], "left").join(by_title, "title", "left")
    title = F.when(F.abs(F.col("y") - F.col("year")) <= 2, F.col("m"))
    own = F.when(F.col("new_id") % 3 == 0, F.col("a"))
    tier = F.when(own.isNotNull(), "id").when(F.col("d").isNotNull(), "date").when(title.isNotNull(), "title").otherwise("new")
    return rows.select("new_id", F.coalesce(own, "d", title).alias("match_id"), tier.alias("tier"))


@query("e05_eligible_works", "SELECT p.id FROM publications p JOIN (SELECT publication_id, count(*) AS n FROM authors GROUP BY 1) ON publication_id = p.id WHERE year >= 1997 AND n < 10")
def e05(t):
    n = t.authors.groupBy(F.col("publication_id").alias("id")).agg(F.count("*").alias("n"))
    return t.publications.where("year >= 1997").join(n.where("n < 10"), "id").select("id")


@query("e06_authorship_links", "SELECT publication_id, position, person_id, lead FROM (SELECT publication_id, person_id, position, lead, row_number() OVER (PARTITION BY publication_id, position ORDER BY person_id) AS rn FROM (SELECT l_orderkey AS publication_id, l_partkey AS person_id, min(l_linenumber)::BIGINT AS position, bool_or(l_linestatus = 'O') AS lead FROM lineitem GROUP BY 1, 2) WHERE position <= 4) WHERE rn = 1")
def e06(t):
    """One link per person and paper with the flags or-ed, then one person per position; later positions fall."""
    one = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("publication_id"), F.col("l_partkey").alias("person_id")).agg(F.min("l_linenumber").cast("long").alias("position"), F.bool_or(F.col("l_linestatus") == "O").alias("lead"))
    return top_per(one.where("position <= 4"), ["publication_id", "position"], ["person_id"]).select("publication_id", "position", "person_id", "lead")


@query("e07_author_resolution", "WITH u AS (SELECT lower(firstname || ' ' || lastname) AS name, min(id) AS id FROM people GROUP BY 1 HAVING count(*) = 1) SELECT s_suppkey AS author, coalesce(p.id, u.id) AS person_id, CASE WHEN p.id IS NOT NULL THEN 'id' WHEN u.id IS NOT NULL THEN 'name' ELSE 'create' END AS how FROM supplier LEFT JOIN people p ON p.id = s_suppkey AND s_suppkey % 2 = 0 LEFT JOIN u ON u.name = lower(s_name)")
def e07(t):
    rows = t.raw("supplier").select(F.col("s_suppkey").alias("author"), F.lower("s_name").alias("name"))
    by_id = t.people.where("id % 2 = 0").select(F.col("id").alias("author"), F.col("id").alias("a"))
    rows = rows.join(by_id, "author", "left").join(unique_names(t).withColumnRenamed("id", "b"), "name", "left")
    return rows.select("author", F.coalesce("a", "b").alias("person_id"), F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "name").otherwise("create").alias("how"))


HINT = "'supplier#' || lpad((length(q) % 10 + 1)::VARCHAR, 9, '0')"
PLACES = "SELECT DISTINCT person_id AS id, lower(name) AS place FROM affiliations a JOIN organizations o ON o.id = a.org_id"
MATCHES = f"""SELECT q, id, round(CASE WHEN q = name THEN 20 WHEN contains(q, name) OR contains(name, q) THEN 8 ELSE 3 * shared END
    + CASE WHEN EXISTS (SELECT 1 FROM ({PLACES}) x WHERE x.id = m.id AND contains(place, {HINT})) THEN 12 ELSE 0 END + least(coalesce(works, 0) / 50::DOUBLE, 4), 6)::DOUBLE AS score
FROM (SELECT q, id, name, count(*) AS shared FROM (SELECT q, unnest(list_distinct(string_split(q, ' '))) AS w FROM (SELECT DISTINCT CASE WHEN length(name) % 2 = 0 THEN name ELSE name || ' jr' END AS q FROM known))
      JOIN (SELECT id, name, unnest(list_distinct(string_split(name, ' '))) AS w FROM known) USING (w) GROUP BY 1, 2, 3) m LEFT JOIN (SELECT person_id AS id, count(*) AS works FROM authors GROUP BY 1) USING (id)"""
KNOWN = "known AS (SELECT id, lower(concat_ws(' ', firstname, lastname)) AS name FROM people)"


def hint_of(q):
    """The institution that an incoming name comes from (made up: one of ten labs by the length of the name)."""
    return F.concat(F.lit("supplier#"), F.lpad((F.length(q) % 10 + 1).cast("string"), 9, "0"))


def places_of(t):
    """(id, places): the lower-case names of the organizations of a person."""
    names = t.organizations.select(F.col("id").alias("org_id"), F.lower("name").alias("place"))
    return t.affiliations.select(F.col("person_id").alias("id"), "org_id").distinct().join(names, "org_id").groupBy("id").agg(F.collect_set("place").alias("places"))


def name_matches(t):
    """(q, id, score): people and incoming names that share a word, so that scoring meets no cross product.

    Equal names weigh 20, one inside the other 8, else 3 for each common word; an institution that holds the hint adds
    12, works add up to 4.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    known = t.people.select("id", F.lower(F.concat_ws(" ", "firstname", "lastname")).alias("name"))
    incoming = known.select(F.when(F.length("name") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" jr"))).alias("q")).distinct()
    left = incoming.select("q", F.explode(words(F.col("q"))).alias("w"))
    right = known.select("id", "name", F.explode(words(F.col("name"))).alias("w"))
    shared = left.join(right, "w").groupBy("q", "id", "name").agg(F.count("*").alias("shared"))
    score = F.when(F.col("q") == F.col("name"), 20).when(F.contains("q", F.col("name")) | F.contains("name", F.col("q")), 8).otherwise(3 * F.col("shared"))
    works = t.authors.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("works"))
    bonus = F.when(F.exists("places", lambda x: F.contains(x, hint_of(F.col("q")))), 12).otherwise(0)
    rows = shared.join(works, "id", "left").join(places_of(t), "id", "left")
    return rows.select("q", "id", F.round(score + bonus + F.least(F.coalesce("works", F.lit(0)) / 50, F.lit(4.0)), 6).alias("score"))


@query("e08_best_author", f"WITH {KNOWN} SELECT q, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rn FROM ({MATCHES})) WHERE rn = 1 AND score >= 8")
def e08(t):
    return top_per(name_matches(t).where("score >= 8"), ["q"], [F.desc("score"), "id"])


RECORDS = "SELECT id, firstname || CASE WHEN id % 2 = 0 THEN ' q' ELSE '' END AS given, lastname || CASE WHEN id % 3 = 0 THEN '-smith' ELSE '' END AS family, firstname AS f, lastname AS l FROM people WHERE id % 20 = 1"
RECORD_SCORES = f"""SELECT q, id, CASE WHEN family = last THEN 20 WHEN contains(family, last) THEN 8 ELSE 0 END + CASE WHEN given = first OR starts_with(given, first || ' ') THEN 15 ELSE 0 END + place AS score, place
FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM ({PLACES}) x WHERE x.id = m.id AND (contains(place, {HINT}) OR contains({HINT}, place))) THEN 14 ELSE 0 END AS place
      FROM (SELECT DISTINCT n.*, r.* FROM (SELECT DISTINCT lower(firstname || ' ' || lastname) AS q, lower(firstname) AS first, lower(lastname) AS last FROM people) n JOIN ({RECORDS}) r ON r.f = n.first OR r.l = n.last) m)"""


def record_scores(t):
    """(q, id, score, place): names and researcher records that share a given or a family name.

    An equal family name weighs 20, one that holds it 8; an equal first given name 15; a known institution 14 (``place``).
    """
    n = F.col("id")
    records = t.people.where("id % 20 = 1").select(
        "id", F.concat("firstname", F.when(n % 2 == 0, " q").otherwise("")).alias("given"), F.concat("lastname", F.when(n % 3 == 0, "-smith").otherwise("")).alias("family"), F.array("firstname", "lastname").alias("names"))
    targets = t.people.where("lastname IS NOT NULL").select(F.lower(F.concat_ws(" ", "firstname", "lastname")).alias("q"), F.lower("firstname").alias("first"), F.lower("lastname").alias("last")).distinct()
    left = targets.select("*", F.posexplode(F.array("first", "last")).alias("side", "w"))
    right = records.select("id", "given", "family", F.posexplode("names").alias("side", "w"))
    pairs = left.join(right, ["side", "w"]).select("q", "first", "last", "id", "given", "family").distinct().join(places_of(t), "id", "left")
    family = F.when(F.col("family") == F.col("last"), 20).when(F.contains("family", F.col("last")), 8).otherwise(0)
    given = F.when((F.col("given") == F.col("first")) | F.startswith("given", F.concat("first", F.lit(" "))), 15).otherwise(0)
    hint = hint_of(F.col("q"))
    place = F.when(F.exists("places", lambda x: F.contains(x, hint) | F.contains(hint, x)), F.when(F.length(hint) > 10, 14).otherwise(10)).otherwise(0)
    return pairs.withColumn("place", place).select("q", "id", (family + given + F.col("place")).alias("score"), "place")


@query("e09_best_with_margin", f"SELECT q, id, best FROM (SELECT q, arg_max(id, (score, -id)) AS id, max(score)::INTEGER AS best, arg_max(place, (score, -id)) AS place, arg_max(score, (score, -id), 2)[2] AS second FROM ({RECORD_SCORES}) GROUP BY 1) WHERE best >= 20 AND (second IS NULL OR best - second >= 3 OR place > 0)")
def e09(t):
    """The best record of 20 points or more, if it leads the second by three or its institution is known."""
    rows = top_per(record_scores(t), ["q"], [F.desc("score"), "id"], 2, "rank")
    first = lambda c: F.max_by(c, -F.col("rank"))
    two = rows.groupBy("q").agg(first("id").alias("id"), F.max("score").alias("best"), first("place").alias("place"), F.when(F.count("*") > 1, F.min("score")).alias("second"))
    return two.where((F.col("best") >= 20) & (F.col("second").isNull() | (F.col("best") - F.col("second") >= 3) | (F.col("place") > 0))).select("q", "id", "best")


@query("e10_pick_institution", "SELECT person_id, arg_max(org_id, (org_id % 5 = 0, valid_from, -id)) AS org_id FROM affiliations GROUP BY 1")
def e10(t):
    """Education first (here every fifth lab), else the latest."""
    return t.affiliations.groupBy("person_id").agg(F.max_by("org_id", F.struct(F.col("org_id") % 5 == 0, F.col("valid_from"), -F.col("id"))).alias("org_id"))


@query("e11_lineage_links", "SELECT path[k + 1] AS child, path[k] AS parent, count(*) AS uses FROM (SELECT path, unnest(range(1, len(path))) AS k FROM tree) GROUP BY 1, 2")
def e11(t):
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(F.get("path", k).alias("child"), F.get("path", k - 1).alias("parent")))
    return org_tree(t).where("size(path) > 1").select(F.explode(steps).alias("s")).groupBy("s.child", "s.parent").agg(F.count("*").alias("uses"))


@query("e12_resolve_organization", "SELECT c_custkey, arg_min(o.id, (CASE WHEN lower(o.name) = q THEN 0 ELSE 1 END, o.id)) AS org_id FROM (SELECT c_custkey, lower(n_name) AS q FROM customer JOIN nation ON n_nationkey = c_nationkey) JOIN organizations o ON contains(lower(o.name), q) GROUP BY 1")
def e12(t):
    """Free text to the best organization; the distinct texts are few, so they are resolved once and joined back."""
    q = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("q"))
    names = t.organizations.select("id", F.lower("name").alias("name"))
    hits = contained(q.select(F.col("q").alias("question")), names).withColumnRenamed("question", "q").join(names, "id")
    best = hits.groupBy("q").agg(F.min_by("id", F.struct(F.when(F.col("name") == F.col("q"), 0).otherwise(1), "id")).alias("org_id"))
    return q.join(best, "q").select("c_custkey", "org_id")


@query("e13_timeline_insert", "SELECT n.* FROM (SELECT l_partkey AS person_id, l_suppkey + 10000 AS org_id, min(l_shipdate)::DATE AS valid_from FROM lineitem GROUP BY 1, 2) n WHERE NOT EXISTS (SELECT 1 FROM affiliations a WHERE a.person_id = n.person_id AND a.org_id = n.org_id AND a.valid_to IS NULL)")
def e13(t):
    """New rows that no existing row equals, nulls counting as equal."""
    new = t.raw("lineitem").groupBy(F.col("l_partkey").alias("person_id"), (F.col("l_suppkey") + 10000).alias("org_id")).agg(F.to_date(F.min("l_shipdate")).alias("valid_from")).withColumn("end", F.lit(None).cast("date"))
    old = t.affiliations.select(F.col("person_id").alias("p"), F.col("org_id").alias("o"), "valid_to")
    same = (F.col("person_id") == F.col("p")) & (F.col("org_id") == F.col("o")) & F.col("valid_to").eqNullSafe(F.col("end"))
    return new.join(old, same, "left_anti").drop("end")


@query("e14_roster_membership", "SELECT p.id, CASE WHEN a.person_id IS NULL THEN 'create' WHEN a.valid_to IS NULL THEN 'keep' ELSE 'secondary' END AS action FROM people p LEFT JOIN anchor a ON a.person_id = p.id")
def e14(t):
    rows = t.people.select("id").join(anchors(t).select(F.col("person_id"), "valid_to"), F.col("id") == F.col("person_id"), "left")
    return rows.select("id", F.when(F.col("person_id").isNull(), "create").when(F.col("valid_to").isNull(), "keep").otherwise("secondary").alias("action"))


@query("e15_fill_if_null", "SELECT o.id, coalesce(short_name, upper(substring(name, 1, 4))) AS short_name FROM organizations o")
def e15(t):
    return t.organizations.select("id", F.coalesce("short_name", F.upper(F.substring("name", 1, 4))).alias("short_name"))


@query("e16_profile_parsers")
def e16(t):
    """Title, language and first paragraph per page, by the form of its host."""
    html = F.col("html")
    return t.raw("pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), X.clean_title(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)).alias("title"),
                                 F.regexp_extract(html, r'<html[^>]*lang="([a-z]+)"', 1).alias("lang"), X.clean_title(F.regexp_extract(html, r"(?s)<p>([^<]+)</p>", 1)).alias("first"))


LIFE = "' has written about markets and firms for many years.'"


@query("e16_profile_fields", f"""SELECT id AS page_id, 'h' || id % 4 || '.example.org' AS host, CASE id % 4 WHEN 0 THEN 'Professor of ' || firstname || ' · Chair' WHEN 1 THEN 'Chair of ' || firstname || ' · Professor' WHEN 2 THEN 'Lecturer in ' || firstname ELSE 'Dean · Professor of ' || firstname END AS title,
    firstname || ' ' || lastname || {LIFE} AS biography, CASE WHEN id % 4 < 3 THEN 'https://own.example.com/' || id END AS site, NULL::VARCHAR AS orcid FROM people WHERE length(firstname || ' ' || lastname || {LIFE}) >= 60""")
def e16_fields(t):
    """Fields of made-up profile pages of four hosts, a page for each person, read by the form of the host."""
    n, first = F.col("id").cast("string"), F.col("firstname")
    life = F.concat("firstname", F.lit(" "), "lastname", F.expr(LIFE))
    site = F.concat(F.lit("https://own.example.com/"), n)
    one = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    link = lambda label: one('<a href="https://twitter.com/x">', label, '</a><a href="', site, '">', label, "</a>")
    kind = F.col("id") % 4
    html = F.when(kind == 0, one('<div class="hs-font-lead field-hs-person-title"><div>Professor of ', first, '</div><div>Chair</div></div><div class="hb-three-column-w-image__main-body"><div class="body text-with-summary"><p>', life, "</p></div></div>", link("website")))
    html = html.when(kind == 1, one('<div class="c-node-faculty__endowed-title">Chair of ', first, '</div><div class="c-node-faculty__jaorhfp-title">Professor</div><div class="bio-content"><div>', life, "</div></div>", link("Homepage")))
    html = html.when(kind == 2, one('<div class="display-position">Lecturer in ', first, '</div><div class="display-homepage"><div><a href="', site, '">x</a></div></div><div class="field--name-field-bio"><div class="field__item">', life, "</div></div>"))
    html = html.otherwise(one('<section class="post-content"><p class="intro-text"><strong>Dean | Professor of ', first, "</strong></p><p>Short.</p><p>", life, "</p></section>"))
    pages = t.people.where(F.length(life) >= 60).select(F.col("id").alias("page_id"), one("https://h", kind.cast("string"), ".example.org/p").alias("url"), html.alias("html"))
    return read_profiles(pages, {f"h{k}.example.org": form for k, form in enumerate(FORMS)})


#: An anchor with its address, whatever stands beside it and however it is quoted, and its label with tags inside.
ANCHOR = r"""(?is)(<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)[^>]*>.*?</a\s*>)"""


def anchors_of(pages):
    """(page_id, place, href, label) of all anchors of pages, in order."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("place", "a"))
    href = F.regexp_extract("a", r"""(?is)^<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return rows.select("page_id", "place", X.unescape(F.trim(F.regexp_replace(href, "^[\"']|[\"']$", ""))).alias("href"), F.trim(F.regexp_replace(X.strip_tags(F.col("a")), r"\s+", " ")).alias("label"))


@query("e17_best_link")
def e17(t):
    """The best anchor of each page: the best score, then the shortest address."""
    rows = anchors_of(t.raw("pages"))
    score = F.when(F.lower("href").rlike(r"\bcv\b|vitae") | F.lower("label").rlike(r"\bcv\b|vitae"), 3).when(F.lower("href").rlike(r"\.pdf$"), 1).otherwise(0)
    return top_per(rows.withColumn("score", score), ["page_id"], [F.desc("score"), F.length("href"), "href", "place"]).select("page_id", "href", "score")


@query("e18_dated_lines")
def e18(t):
    """Lines of conversations that hold a year or a range of years, with the rest of the line."""
    rows = t.raw("conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    year = F.regexp_extract("line", r"\b((?:19|20)\d{2})\b", 1)
    return rows.where(year != "").select("conv_id", "turn", year.alias("first_year"), F.regexp_extract("line", r"\b(?:19|20)\d{2}\s*[-–]\s*((?:19|20)\d{2})\b", 1).alias("last_year"), F.trim("line").alias("line"))


@query("e18_cv_entries")
def e18_entries(t):
    """Positions and degrees out of made-up curricula: a line for each affiliation, then a degree and a list of papers."""
    names = t.organizations.select(F.col("id").alias("org_id"), "name")
    rows = t.affiliations.join(names, "org_id").select("person_id", F.struct(
        "valid_from", "id", F.concat(F.year("valid_from").cast("string"), F.lit("–"), F.coalesce(F.year("valid_to").cast("string"), F.lit("present")), F.lit(" "), "name", F.lit(" University, "), F.initcap(F.replace("position_rank", F.lit("_"), F.lit(" ")))).alias("line")).alias("x"))
    jobs = rows.groupBy("person_id").agg(F.array_sort(F.collect_list("x"))["line"].alias("jobs"))
    n = F.col("person_id").cast("string")
    rest = F.array(F.lit("Education"), F.concat(F.lit("College "), n, F.lit(", Ph.D. in Economics, 1990")), F.lit("Publications"), F.lit("1999–2001 Journal of Nothing, Editor"))
    lines = jobs.select(F.col("person_id").alias("doc"), F.posexplode(F.concat(F.array(F.lit("Academic Positions")), "jobs", rest)).alias("place", "line"))
    return cv_entries(lines)


@query("e19_record_flattening", "SELECT event_id, unnest(json_keys(props)) AS k, (props ->> ('$.' || unnest(json_keys(props))))::BIGINT AS v FROM events")
def e19(t):
    return t.raw("events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v"))


@query("e20_cleanup", "WITH kept AS (SELECT * FROM authors WHERE position <= 4 AND publication_id IN (SELECT publication_id FROM authors GROUP BY 1 HAVING count(*) < 10)) SELECT publication_id, count(*) AS authors FROM kept GROUP BY 1")
def e20(t):
    """Papers of ten and more authors go, late positions go, and papers without authors go with them."""
    small = t.authors.groupBy("publication_id").agg(F.count("*").alias("n")).where("n < 10").select("publication_id")
    return t.authors.join(small, "publication_id", "left_semi").where("position <= 4").groupBy("publication_id").agg(F.count("*").alias("authors"))


#: Publications for the clean-up; every fiftieth is made up to be a file that no one wrote as a paper.
KEPT_PAPERS = "SELECT id FROM publications WHERE id % 50 <> 0"
MERGED = f"""WITH alive AS (SELECT * FROM authors WHERE position <= 4 AND publication_id IN ({KEPT_PAPERS}) AND publication_id IN (SELECT publication_id FROM authors GROUP BY 1 HAVING count(*) < 10)),
    p AS (SELECT id, venue, year, CASE WHEN year - lag(year) OVER (PARTITION BY venue ORDER BY year, id) <= 1 THEN 0 ELSE 1 END AS gap FROM publications WHERE id IN (SELECT publication_id FROM alive)),
    i AS (SELECT id, venue, sum(gap) OVER (PARTITION BY venue ORDER BY year, id) AS island FROM p), c AS (SELECT id, min(id) OVER (PARTITION BY venue, island) AS canonical FROM i),
    r AS (SELECT canonical, id, person_id, position, max(CASE WHEN id = canonical THEN position ELSE 0 END) OVER (PARTITION BY canonical) AS own, row_number() OVER (PARTITION BY canonical, person_id ORDER BY id, position) AS k FROM alive JOIN c ON id = publication_id)
SELECT canonical AS publication_id, person_id, CASE WHEN id = canonical THEN position ELSE own + row_number() OVER (PARTITION BY canonical, id = canonical ORDER BY id, position) END AS position FROM r WHERE k = 1"""


@query("e20_merged_papers", MERGED)
def e20_merged(t):
    """The whole clean-up: mega papers, junk titles, late positions and papers left without authors go, then clusters merge.

    The smallest id of a cluster keeps its authors at their positions; people whom only its duplicates name follow
    behind them, in order of the duplicates and of the positions there.
    """
    made_up = F.when(F.col("id") % 50 == 0, "readme.txt").otherwise(F.col("title"))
    papers = t.publications.where(~X.is_junk_title(made_up)).select(F.col("id").alias("publication_id"))
    small = t.authors.groupBy("publication_id").agg(F.count("*").alias("n")).where("n < 10").select("publication_id")
    alive = t.authors.where("position <= 4").join(small, "publication_id", "left_semi").join(papers, "publication_id", "left_semi")
    left = t.publications.join(alive.select(F.col("publication_id").alias("id")).distinct(), "id", "left_semi")
    rows = alive.join(chained(left).select(F.col("id").alias("publication_id"), "canonical"), "publication_id")
    first = F.col("publication_id") == F.col("canonical")
    rows = rows.withColumn("own", F.max(F.when(first, F.col("position")).otherwise(0)).over(W.partitionBy("canonical")))
    rows = top_per(rows, ["canonical", "person_id"], ["publication_id", "position"]).withColumn("first", first)
    place = F.row_number().over(W.partitionBy("canonical", "first").orderBy("publication_id", "position"))
    return rows.select(F.col("canonical").alias("publication_id"), "person_id", F.when(F.col("first"), F.col("position")).otherwise(F.col("own") + place).cast("long").alias("position"))


@query("e21_person_merge", "WITH m AS (SELECT id, min(id) OVER (PARTITION BY firstname, lastname) AS canonical FROM people) SELECT publication_id, canonical AS person_id, min(position) AS position FROM authors JOIN m ON id = person_id GROUP BY 1, 2")
def e21(t):
    """Links move to the smallest id of a name; links that become equal collapse to the earliest position."""
    remap = t.people.select(F.col("id").alias("person_id"), F.min("id").over(W.partitionBy("firstname", "lastname")).alias("canonical"))
    return t.authors.join(remap, "person_id").groupBy("publication_id", F.col("canonical").alias("person_id")).agg(F.min("position").alias("position"))


@query("e22_erasure_plan", "SELECT p.id, coalesce(sole, 0)::BIGINT AS sole_papers, coalesce(links, 0)::BIGINT AS links, coalesce(homes, 0)::BIGINT AS homes FROM people p LEFT JOIN (SELECT person_id, count(*) AS links, count(*) FILTER (n = 1) AS sole FROM authors JOIN (SELECT publication_id, count(*) AS n FROM authors GROUP BY 1) USING (publication_id) GROUP BY 1) a ON a.person_id = p.id LEFT JOIN (SELECT person_id, count(*) AS homes FROM affiliations GROUP BY 1) h ON h.person_id = p.id")
def e22(t):
    """What goes when a person is erased, for every person."""
    n = t.authors.groupBy("publication_id").agg(F.count("*").alias("n"))
    own = t.authors.join(n, "publication_id").groupBy(F.col("person_id").alias("id")).agg(F.count_if(F.col("n") == 1).alias("sole_papers"), F.count("*").alias("links"))
    homes = t.affiliations.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("homes"))
    return t.people.select("id").join(own, "id", "left").join(homes, "id", "left").fillna(0).select("id", "sole_papers", "links", "homes")


GONE = "SELECT id FROM people WHERE id % 10 = 3"
LEFT_AUTHORS = f"SELECT * FROM authors WHERE person_id NOT IN ({GONE})"
LEFT_PAPERS = f"SELECT p.id, venue, (SELECT count(*) FROM authors a WHERE a.publication_id = p.id) AS before FROM publications p WHERE id IN (SELECT publication_id FROM ({LEFT_AUTHORS})) OR id NOT IN (SELECT publication_id FROM authors)"


def erased(t, gone):
    """The tables without the people of ``gone`` (id): each an anti-join; papers that only they wrote go with them."""
    no = lambda df, c: df.join(gone.select(F.col("id").alias(c)), c, "left_anti")
    authors = no(t.authors, "person_id")
    written = t.authors.select(F.col("publication_id").alias("id")).distinct()
    orphans = written.join(authors.select(F.col("publication_id").alias("id")), "id", "left_anti")
    return {"people": no(t.people, "id"), "authors": authors, "publications": t.publications.join(orphans, "id", "left_anti"),
            "affiliations": no(t.affiliations, "person_id"), "relations": no(no(t.relations, "from_id"), "to_id"), "topics": no(t.person_topics, "person_id")}


@query("e22_erasure", f"""SELECT 'people' AS item, count(*) AS rows_left, sum(id)::BIGINT AS ids FROM people WHERE id NOT IN ({GONE})
    UNION ALL SELECT 'authors', count(*), sum(person_id)::BIGINT FROM ({LEFT_AUTHORS}) UNION ALL SELECT 'publications', count(*), sum(id)::BIGINT FROM ({LEFT_PAPERS})
    UNION ALL SELECT 'affiliations', count(*), sum(person_id)::BIGINT FROM affiliations WHERE person_id NOT IN ({GONE})
    UNION ALL SELECT 'relations', count(*), sum(from_id)::BIGINT FROM relations WHERE from_id NOT IN ({GONE}) AND to_id NOT IN ({GONE})
    UNION ALL SELECT 'topics', count(*), sum(person_id)::BIGINT FROM person_topics WHERE person_id NOT IN ({GONE})""")
def e22_erasure(t):
    """What every table holds after a tenth of the people was erased."""
    keys = {"people": "id", "authors": "person_id", "publications": "id", "affiliations": "person_id", "relations": "from_id", "topics": "person_id"}
    rows = None
    for item, df in erased(t, t.people.where("id % 10 = 3").select("id")).items():
        one = df.agg(F.lit(item).alias("item"), F.count("*").alias("rows_left"), F.sum(keys[item]).cast("long").alias("ids"))
        rows = one if rows is None else rows.union(one)
    return rows


@query("e23_expired_snapshots", f"SELECT id, url FROM snapshots WHERE expires_at <= {DAY} AND id NOT IN (SELECT snapshot_id FROM ({EVIDENCE}) WHERE org_id % 2 = 0)")
def e23(t):
    used = evidence(t).where("org_id % 2 = 0").select(F.col("snapshot_id").alias("id"))
    return t.snapshots.where(F.col("expires_at") <= t.day).join(used, "id", "left_anti").select("id", "url")


@query("e24_title_repair", "SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM titles WHERE title <> trim(regexp_replace(title, '\\s+', ' ', 'g'))")
def e24(t):
    return t.titles.select("id", "title", X.collapse(F.col("title")).alias("new")).where("title <> new").select("id", F.col("new").alias("title"))


@query("e24_repaired_titles", "SELECT id, CASE id % 4 WHEN 1 THEN title || ' & more' WHEN 2 THEN 'A paper on ' || title ELSE title END AS title FROM publications WHERE id % 4 > 0")
def e24_repaired(t):
    """Titles that clean-up changes, with what they become; three of four are made up to need it (references, thanks, marks)."""
    kind = F.col("id") % 4
    dirty = F.when(kind == 1, F.concat("title", F.lit("  &amp;&nbsp;more "))).when(kind == 2, F.concat(F.lit("A paper on "), "title", F.lit(" We thank everyone."))).when(kind == 3, F.concat("title", F.lit("\u2736 Corresponding author"))).otherwise(F.col("title"))
    rows = t.publications.select("id", dirty.alias("title"))
    return rows.select("id", "title", X.clean_title(F.col("title")).alias("new")).where("new <> '' AND new <> title").select("id", F.col("new").alias("title"))


@query("e25_topic_lineage", "SELECT id, path[1] AS domain, CASE WHEN len(path) >= 2 THEN path[2] END AS field, CASE WHEN len(path) >= 3 THEN path[3] END AS leaf FROM tree")
def e25(t):
    return org_tree(t).select("id", F.get("path", F.lit(0)).alias("domain"), F.get("path", F.lit(1)).alias("field"), F.get("path", F.lit(2)).alias("leaf"))


@query("e26_targets", f"SELECT id FROM people WHERE id NOT IN (SELECT person_id FROM affiliations WHERE {live()}) OR id NOT IN (SELECT from_id FROM relations)")
def e26(t):
    home = t.affiliations.where(valid_on(t.day)).select(F.col("person_id").alias("id")).distinct().withColumn("home", F.lit(True))
    advised = t.relations.select(F.col("from_id").alias("id")).distinct().withColumn("advised", F.lit(True))
    return t.people.select("id").join(home, "id", "left").join(advised, "id", "left").where("home IS NULL OR advised IS NULL").select("id")


@query("s08_roster_scrape")
def s08(t):
    """Links and their labels out of every page."""
    return anchors_of(t.raw("pages")).select("page_id", "place", "label")


@query("s05_json_source", "SELECT event_id, user_id, event_type, value FROM events")
def s05(t):
    """Records written as JSON lines in the shared folder and read back by a declared schema."""
    return json_records(t).select("event_id", "user_id", "event_type", "value")


def json_records(t):
    rows = t.raw("events").select("event_id", "user_id", "event_type", "value", F.year("ts").alias("year"))
    path = f"{shared_dir(t.spark)}/records-{uuid.uuid4().hex}"
    rows.write.json(path)
    return t.spark.read.schema(rows.schema).json(path)


@query("s06_filtered_records", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE year(ts) >= 2000 AND event_type IN ('click', 'purchase', 'view') AND NOT coalesce(value > 90, false)) WHERE rn <= 20")
def s06(t):
    """Records of a user by pushed filters (first year, kinds, a flag), at most twenty each."""
    rows = json_records(t).where((F.col("year") >= 2000) & F.col("event_type").isin("click", "purchase", "view") & ~F.coalesce(F.col("value") > 90, F.lit(False)))
    return top_per(rows, ["user_id"], ["event_id"], 20).select("user_id", "event_id")


@query("a26_pipeline_counters", "SELECT event_type, count(*) AS seen, count(*) FILTER (value > 50) AS kept, count(*) FILTER (value IS NULL OR value <= 50) AS skipped, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a26(t):
    """The counters of a run in one pass."""
    kept = F.coalesce(F.col("value") > 50, F.lit(False))
    return t.raw("events").groupBy("event_type").agg(F.count("*").alias("seen"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"), F.countDistinct("user_id").alias("users"))


@query("p13_clamped_page", "SELECT event_id, greatest(0, least(50, coalesce(CASE WHEN event_id % 5 > 0 THEN event_id - 40 END, 10)))::BIGINT AS search_limit, greatest(0, least(100, event_id - 20))::BIGINT AS page_limit, greatest(0, event_id - 30)::BIGINT AS page_offset, trim(event_type) <> '' AND length(event_type) <= 200 AS asked FROM events")
def p13(t):
    """Limits and offsets of requests within their bounds, with the defaults; blank and overlong questions ask nothing."""
    n = F.col("event_id")
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c)).cast("long")
    return t.raw("events").select("event_id", clamp(F.coalesce(F.when(n % 5 > 0, n - 40), F.lit(10)), 50).alias("search_limit"), clamp(n - 20, 100).alias("page_limit"), F.greatest(F.lit(0), n - 30).cast("long").alias("page_offset"),
                                    ((F.trim("event_type") != "") & (F.length("event_type") <= 200)).alias("asked"))


@query("s09_text_values", "SELECT c_custkey, c_mktsegment AS first, c_name AS second FROM customer")
def s09(t):
    """Values read back out of quoted text rows; doubled quotes stand for one."""
    q = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    rows = t.raw("customer").select("c_custkey", F.concat_ws(", ", q(F.col("c_mktsegment")), q(F.col("c_name"))).alias("row"))
    parts = F.regexp_extract_all("row", F.lit("'((?:[^']|'')*)'"), F.lit(1))
    return rows.select("c_custkey", F.replace(parts[0], F.lit("''"), F.lit("'")).alias("first"), F.replace(parts[1], F.lit("''"), F.lit("'")).alias("second"))
