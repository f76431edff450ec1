"""Scalar functions applied to whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.grams import similar_names
from .registry import query

MASK = 0x1F3A5C7E9B2D4F60
SQUASH = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("f01_full_name", "SELECT id, coalesce(nullif(trim(coalesce(firstname, '') || ' ' || coalesce(lastname, '')), ''), '(unnamed)') AS name FROM people")
def f01(t):
    return t.people.select("id", X.full_name(F.col("firstname"), F.col("lastname")).alias("name"))


@query("f02_person_role", "SELECT event_id, nullif(trim(event_type), '') AS role FROM events")
def f02(t):
    return t.raw("events").select("event_id", X.blank_to_null(F.col("event_type")).alias("role"))


@query("f03_parse_full_name", f"SELECT id, w[1] AS first, CASE WHEN len(w) > 2 THEN array_to_string(w[2:len(w) - 1], ' ') END AS middle, w[len(w)] AS last FROM (SELECT id, string_split({SQUASH.format('title')}, ' ') AS w FROM titles)")
def f03(t):
    return t.titles.select("id", X.name_parts(F.col("title")).alias("n")).select("id", "n.*")


@query("f04_normalize_name", "SELECT id, lower(firstname || ' ' || lastname) AS name FROM people")
def f04(t):
    return t.people.select("id", F.lower(X.full_name(F.col("firstname"), F.col("lastname"))).alias("name"))


@query("f05_unescape_name")
def f05(t):
    return t.raw("pages").select("page_id", F.lower(X.clean_title(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))).alias("name"))


@query("f06_org_label", "SELECT id, CASE WHEN short_name IS NOT NULL THEN short_name WHEN starts_with(name, 'Supplier#') THEN substring(name, 10) ELSE name END AS label FROM organizations")
def f06(t):
    return t.organizations.select("id", F.coalesce("short_name", F.when(F.startswith("name", F.lit("Supplier#")), F.substring("name", 10, 1000)).otherwise(F.col("name"))).alias("label"))


@query("f07_org_sublabel", "SELECT o.id, kind || ' · ' || coalesce(n, 0) || CASE WHEN coalesce(n, 0) = 1 THEN ' unit' ELSE ' units' END AS sublabel FROM organizations o LEFT JOIN (SELECT parent, count(*) AS n FROM live_links GROUP BY 1) ON parent = o.id")
def f07(t):
    from .relational import a04

    n = F.coalesce("children", F.lit(0))
    unit = F.when(n == 1, " unit").otherwise(" units")
    return t.organizations.join(a04(t).withColumnRenamed("parent", "id"), "id", "left").select("id", F.concat("kind", F.lit(" · "), n.cast("string"), unit).alias("sublabel"))


@query("f08_plural_detail", "SELECT publication_id, n || CASE WHEN n = 1 THEN ' author' ELSE ' authors' END AS detail FROM (SELECT publication_id, count(*) AS n FROM authors GROUP BY 1)")
def f08(t):
    rows = t.authors.groupBy("publication_id").agg(F.count("*").alias("n"))
    return rows.select("publication_id", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " author").otherwise(" authors")).alias("detail"))


@query("f09_short_name", "SELECT id, CASE WHEN regexp_matches(title, '\\(([^()]+)\\)\\s*$') THEN regexp_extract(title, '\\(([^()]+)\\)\\s*$', 1) WHEN len(string_split(title, ' ')) <= 4 THEN title END AS short FROM titles")
def f09(t):
    inner = F.regexp_extract("title", r"\(([^()]+)\)\s*$", 1)
    return t.titles.select("id", F.when(inner != "", inner).when(F.size(F.split("title", " ")) <= 4, F.col("title")).alias("short"))


#: Ordered rules of organization kinds by name.
KIND_RULES = ((r"department|dept", "department"), (r"school|faculty", "school"), (r"\blab\b|laborator", "lab"), (r"institute|cent(er|re)", "institute"), (r"universit|college|academy", "university"))


def org_kind(name, is_root, is_leaf):
    out = None
    for pattern, kind in KIND_RULES[:4]:
        hit = F.lower(name).rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    higher = F.lower(name).rlike(KIND_RULES[4][0])
    return out.when(is_root & higher, "university").when(is_root, "institute").when(is_leaf, "department").otherwise("school")


@query("f10_org_kind", "SELECT o.id, CASE WHEN regexp_matches(lower(name), 'department|dept') THEN 'department' WHEN regexp_matches(lower(name), 'school|faculty') THEN 'school' WHEN regexp_matches(lower(name), '\\blab\\b|laborator') THEN 'lab' WHEN regexp_matches(lower(name), 'institute|cent(er|re)') THEN 'institute' WHEN parent_id IS NULL AND regexp_matches(lower(name), 'universit|college|academy') THEN 'university' WHEN parent_id IS NULL THEN 'institute' WHEN NOT EXISTS (SELECT 1 FROM live_links l WHERE l.parent = o.id) THEN 'department' ELSE 'school' END AS kind FROM organizations o JOIN tree ON tree.id = o.id")
def f10(t):
    from ..operators.core import live_org_links, org_tree

    inner = live_org_links(t).select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    rows = t.organizations.select("id", "name").join(org_tree(t).select("id", "parent_id"), "id").join(inner, "id", "left")
    return rows.select("id", org_kind(F.col("name"), F.col("parent_id").isNull(), F.col("inner").isNull()).alias("kind"))


RANK_SQL = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}', 'i') THEN '{r}'" for p, r in X.RANK_RULES) + " END"
ROLES = "(SELECT id, replace(position_rank, '_', ' ') AS role FROM affiliations)"


@query("f11_position_rank", f"SELECT id, {RANK_SQL.format('role')} AS rank FROM {ROLES}")
def f11(t):
    return t.affiliations.select("id", X.position_rank(F.replace("position_rank", F.lit("_"), F.lit(" "))).alias("rank"))


@query("f12_affiliation_kind", f"SELECT id, CASE WHEN contains(role, 'founder') THEN 'founding' WHEN contains(role, 'board') OR (contains(role, 'director') AND NOT contains(role, 'managing')) THEN 'governance' WHEN contains(role, 'visiting') THEN 'visiting' WHEN regexp_matches(role, 'ph\\.d|phd|m\\.a\\.|m\\.s\\.|b\\.a\\.|b\\.s\\.|degree|student') THEN 'education' ELSE 'employment' END AS kind FROM {ROLES}")
def f12(t):
    role = F.replace("position_rank", F.lit("_"), F.lit(" "))
    return t.affiliations.select("id", X.affiliation_kind(role, F.lit("employment")).alias("kind"))


@query("f13_client_rank_order", f"SELECT id, CASE WHEN regexp_matches(role, 'emerit') THEN 1 WHEN regexp_matches(role, 'assistant') THEN 3 WHEN regexp_matches(role, 'associate') THEN 2 WHEN regexp_matches(role, 'full professor|\\bprofessor\\b') THEN 0 WHEN regexp_matches(role, 'visiting') THEN 4 WHEN regexp_matches(role, 'lecturer') THEN 5 WHEN regexp_matches(role, 'postdoc') THEN 6 WHEN regexp_matches(role, 'phd') THEN 7 ELSE 99 END::BIGINT AS place FROM {ROLES}")
def f13(t):
    role, out = F.replace("position_rank", F.lit("_"), F.lit(" ")), None
    for pattern, place in (("emerit", 1), ("assistant", 3), ("associate", 2), (r"full professor|\bprofessor\b", 0), ("visiting", 4), ("lecturer", 5), ("postdoc", 6), ("phd", 7)):
        out = (F if out is None else out).when(role.rlike(pattern), F.lit(place).cast("long"))
    return t.affiliations.select("id", out.otherwise(F.lit(99).cast("long")).alias("place"))


CLEAN = "trim(split_part(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), chr(160), ' '), '\\s+', ' ', 'g')), '✶', 1))"
JUNK = "(length({0}) < 4 OR " + " OR ".join(f"regexp_matches({{0}}, '{p}', 'i')" for p in (x.replace("{", "{{").replace("}", "}}") for x in X.JUNK_TITLES)) + ")"


@query("f14_clean_title", f"SELECT id, {CLEAN.format('title')} AS title FROM titles")
def f14(t):
    return t.titles.select("id", X.clean_title(F.col("title")).alias("title"))


@query("f15_junk_title", f"SELECT id, {JUNK.format(CLEAN.format('title'))} AS junk FROM titles")
def f15(t):
    return t.titles.select("id", X.is_junk_title(F.col("title")).alias("junk"))


@query("f16_displayable", f"SELECT id FROM titles WHERE NOT {JUNK.format(CLEAN.format('title'))} AND NOT starts_with(lower({CLEAN.format('title')}), 'replication data for:')")
def f16(t):
    return t.titles.where(~X.is_junk_title(F.col("title")) & ~F.startswith(F.lower(X.clean_title(F.col("title"))), F.lit("replication data for:"))).select("id")


DEDUPE = "trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(" + CLEAN + "), '^replication (data|materials|package) for:\\s*', ''), '\\*+$', '')), '\\.\\s*nber working paper.*$', ''), '\\s+#\\d+$', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'))"


@query("f17_dedupe_title", f"SELECT id, {DEDUPE.format('title')} AS title FROM titles")
def f17(t):
    return t.titles.select("id", X.dedupe_title(F.col("title")).alias("title"))


@query("f18_titles_equivalent", "SELECT id, title = lag OR (length(CASE WHEN length(title) <= length(lag) THEN title ELSE lag END) >= 30 AND starts_with(CASE WHEN length(title) <= length(lag) THEN lag ELSE title END, CASE WHEN length(title) <= length(lag) THEN title ELSE lag END)) AS same FROM (SELECT t.id, t.title, u.title AS lag FROM titles t JOIN titles u ON u.id = t.id - 1)")
def f18(t):
    before = t.titles.select((F.col("id") + 1).alias("id"), F.col("title").alias("other"))
    return t.titles.join(before, "id").select("id", X.titles_equivalent(F.col("title"), F.col("other")).alias("same"))


SAME = "a <> '' AND b <> '' AND (a = b OR (least(length(a), length(b)) >= 30 AND CASE WHEN length(a) <= length(b) THEN starts_with(b, a) ELSE starts_with(a, b) END))"


@query("f19_likely_same_paper", f"SELECT id, ({SAME}) AND coalesce(abs(y - z) <= 2, true) AS same FROM (SELECT t.id, {DEDUPE.format('t.title')} AS a, {DEDUPE.format('u.title')} AS b, CASE WHEN t.id % 6 > 0 THEN p.year END AS y, q.year AS z FROM titles t JOIN titles u ON u.id = t.id - 1 JOIN publications p ON p.id = t.id JOIN publications q ON q.id = u.id)")
def f19(t):
    """Neighbours by id; every sixth year is unknown."""
    rows = t.titles.join(t.publications.select("id", "year"), "id")
    before = rows.select((F.col("id") + 1).alias("id"), F.col("title").alias("other"), F.col("year").alias("then"))
    year = F.when(F.col("id") % 6 > 0, F.col("year"))
    return rows.join(before, "id").select("id", X.likely_same_paper(F.col("title"), year, F.col("other"), F.col("then")).alias("same"))


DOI = "'https://doi.org/10.1093/' || CASE WHEN id % 4 = 0 THEN '978' ELSE 'jep' END || lpad(id::VARCHAR, 10, '0') || CASE WHEN id % 8 < 5 THEN '-' || lpad((id % 10000)::VARCHAR, 3 + (id % 2)::INTEGER, '0') ELSE '' END"
KINDS = "['article', 'Book-Chapter', 'dataset', 'letter', 'article', 'paratext', 'preprint'][(id % 7)::INTEGER + 1]"


def dois(t):
    """(id, doi, kind): made-up identifiers and kinds of the publications; every fourth stands in the space of books."""
    n = F.col("id")
    text = lambda c, size: F.lpad(c.cast("string"), size, "0")
    tail = F.when(n % 8 < 5, F.concat(F.lit("-"), F.when(n % 2 == 0, text(n % 10000, 3)).otherwise(text(n % 10000, 4)))).otherwise("")
    doi = F.concat(F.lit("https://doi.org/10.1093/"), F.when(n % 4 == 0, "978").otherwise("jep"), text(n, 10), tail)
    kinds = F.array(*[F.lit(k) for k in ("article", "Book-Chapter", "dataset", "letter", "article", "paratext", "preprint")])
    return t.publications.select("id", doi.alias("doi"), F.get(kinds, (n % 7).cast("int")).alias("kind"))


@query("f20_book_chapter_doi", f"SELECT id, regexp_matches(replace(doi, 'https://doi.org/', ''), '978\\d{{10}}-\\d{{3,4}}$') AS chapter FROM (SELECT id, {DOI} AS doi FROM publications)")
def f20(t):
    return dois(t).select("id", X.is_chapter_doi(F.col("doi")).alias("chapter"))


@query("f21_should_skip", f"SELECT id, CASE WHEN {JUNK.format(CLEAN.format('title'))} THEN 'junk' WHEN regexp_matches(doi, '978\\d{{10}}-\\d{{3,4}}$') THEN 'chapter' WHEN lower(kind) IN ('book-chapter', 'reference-entry', 'paratext', 'letter', 'editorial', 'erratum', 'correction') THEN 'type' END AS reason FROM titles JOIN (SELECT id, {DOI} AS doi, {KINDS} AS kind FROM publications) USING (id)")
def f21(t):
    return t.titles.join(dois(t), "id").select("id", X.skip_reason(F.col("title"), F.col("doi"), F.col("kind")).alias("reason"))


ORCID = "printf('%04d-%04d-%04d-%03d%s', id % 10000, (id * 7) % 10000, (id * 13) % 10000, id % 1000, CASE WHEN id % 11 = 10 THEN 'x' ELSE (id % 11)::VARCHAR END)"
CHECK = "(12 - list_reduce(list_prepend(0, [d::INTEGER FOR d IN string_split(substring(replace(o, '-', ''), 1, 15), '')]), lambda a, d: (a + d) * 2) % 11) % 11"


@query("f22_orcid", f"SELECT id, CASE WHEN upper(o[19]) = CASE WHEN c = 10 THEN 'X' ELSE c::VARCHAR END THEN upper(o) END AS orcid FROM (SELECT id, o, {CHECK} AS c FROM (SELECT id, {ORCID} AS o FROM publications))")
def f22(t):
    n = F.col("id")
    text = F.format_string("id %04d-%04d-%04d-%03d%s.", n % 10000, (n * 7) % 10000, (n * 13) % 10000, n % 1000, F.when(n % 11 == 10, "x").otherwise((n % 11).cast("string")))
    return t.publications.select("id", X.canonical_orcid(text).alias("orcid"))


@query("f23_strip_html")
def f23(t):
    return t.raw("pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("f24_redact_contacts")
def f24(t):
    return t.raw("documents").select("doc_id", X.redact_contacts(F.col("text")).alias("text"))


@query("f25_last_segment", "SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS tail FROM pages")
def f25(t):
    return t.raw("pages").select("page_id", F.substring_index(F.rtrim("url", F.lit("/")), "/", -1).alias("tail"))


@query("f26_url_guard", "SELECT page_id, regexp_matches(url, '^https?://[^/@?#:]+(:[0-9]+)?([/?#]|$)') AND NOT regexp_matches(url, '^https?://(0|10|127|169\\.254|172\\.(1[6-9]|2[0-9]|3[01])|192\\.168)\\.[0-9.]+([:/?#]|$)') AS safe, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def f26(t):
    url = F.col("url")
    return t.raw("pages").select("page_id", X.is_public_url(url).alias("safe"), F.try_parse_url(url, F.lit("HOST")).alias("host"))


GRAMS = "list_distinct(flatten([[substring('  ' || w || ' ', k, 3) FOR k IN range(1, length(w) + 2)] FOR w IN list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')]))"
SIMILARITY = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


@query("f27_trigram_similarity", f"SELECT id, round({SIMILARITY.format('g', 'q')}, 6)::DOUBLE AS similarity FROM (SELECT id, {GRAMS.format('title')} AS g, {GRAMS.format(chr(39) + 'the thing of the nation' + chr(39))} AS q FROM titles)")
def f27(t):
    q = X.trigrams(F.lit("the thing of the nation"))
    return t.titles.select("id", F.round(X.trigram_similarity(X.trigrams(F.col("title")), q), 6).alias("similarity"))


NAMED = f"SELECT id, firstname || ' ' || lastname AS name, {GRAMS.format(chr(40) + 'firstname || chr(32) || lastname' + chr(41))} AS g FROM people WHERE lastname IS NOT NULL"
ASKED = f"SELECT question, {GRAMS.format('question')} AS q FROM (SELECT DISTINCT lastname AS question FROM people WHERE lastname IS NOT NULL)"


@query("f27_similar_names", f"SELECT question, id, round({SIMILARITY.format('g', 'q')}, 6)::DOUBLE AS similarity FROM ({NAMED}) JOIN ({ASKED}) ON {SIMILARITY.format('g', 'q')} >= 0.3")
def f27b(t):
    """Every last name asked against all full names."""
    asked = t.people.where("lastname IS NOT NULL").select(F.col("lastname").alias("question"))
    names = t.people.where("lastname IS NOT NULL").select("id", F.concat_ws(" ", "firstname", "lastname").alias("name"))
    return similar_names(asked, names).withColumn("similarity", F.round("similarity", 6))


@query("f28_sort_key", "SELECT id, lower(lastname) || chr(9) || lower(firstname) AS sort_key FROM people")
def f28(t):
    return t.people.select("id", F.concat(F.lower("lastname"), F.lit("\t"), F.lower("firstname")).alias("sort_key"))


@query("f29_first_token", "SELECT id, lower(split_part(title, ' ', 1)) AS token FROM titles")
def f29(t):
    return t.titles.select("id", F.lower(F.split_part("title", F.lit(" "), F.lit(1))).alias("token"))


@query("f30_palette_slot")
def f30(t):
    return t.organizations.select("id", X.palette_slot(F.col("name"), 12).alias("slot"))


@query("f31_id_codec", "SELECT id, id AS back FROM people")
def f31(t):
    coded = t.people.select("id", X.encode_id("p", F.col("id"), MASK).alias("token"))
    return coded.select("id", X.decode_id(F.col("token"), MASK).alias("back"))


@query("f32_content_hash", "SELECT page_id, sha256(html) AS hash FROM pages")
def f32(t):
    return t.raw("pages").select("page_id", F.sha2("html", 256).alias("hash"))


@query("f33_affiliation_hints")
def f33(t):
    words = F.array_distinct(F.filter(F.split(F.lower("title"), " "), lambda w: F.length(w) > 5))
    return t.titles.select("id", F.array_join(words, ",").alias("hints"), F.contains(F.lower("title"), F.lit("tion")).alias("hinted"))


@query("f34_date_only", "SELECT event_id, ts::DATE AS day FROM events")
def f34(t):
    return t.raw("events").select("event_id", F.to_date("ts").alias("day"))


@query("f35_year_bounds", "SELECT id, make_date(year, 1, 1) AS starts, make_date(year, 12, 31) AS ends FROM publications")
def f35(t):
    y = F.col("year").cast("int")
    return t.publications.select("id", F.make_date(y, F.lit(1), F.lit(1)).alias("starts"), F.make_date(y, F.lit(12), F.lit(31)).alias("ends"))


@query("f36_partial_date", "SELECT id, make_date(year, greatest(1, least(12, id % 15)), greatest(1, least(28, id % 32))) AS day FROM publications")
def f36(t):
    clamp = lambda c, top: F.greatest(F.lit(1), F.least(F.lit(top), c)).cast("int")
    return t.publications.select("id", F.make_date(F.col("year").cast("int"), clamp(F.col("id") % 15, 12), clamp(F.col("id") % 32, 28)).alias("day"))


@query("f37_date_prefix", "SELECT id, try_cast(substring(CASE WHEN id % 5 = 0 THEN '1998-13-01' ELSE strftime(date, '%Y-%m-%dT00:00') END, 1, 10) AS DATE) AS day FROM publications")
def f37(t):
    text = F.when(F.col("id") % 5 == 0, "1998-13-01").otherwise(F.concat(F.col("date").cast("string"), F.lit("T00:00")))
    return t.publications.select("id", F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").alias("day"))


@query("f38_snapshot_expiry", "SELECT id, expires_at, expires_at <= DATE '1998-09-01' AS expired FROM snapshots")
def f38(t):
    return t.snapshots.select("id", "expires_at", (F.col("expires_at") <= F.lit("1998-09-01").cast("date")).alias("expired"))


@query("f39_impact_terms", "SELECT id, round(4 * ln(1 + greatest(cited_by, 0)), 6)::DOUBLE AS term FROM publications")
def f39(t):
    return t.publications.select("id", F.round(4 * F.log1p(F.greatest("cited_by", F.lit(0))), 6).alias("term"))


@query("f40_normalised_score", "SELECT event_id, round(greatest(0, least(1, coalesce(CASE WHEN value > 1 THEN value / 100 ELSE value END, 0))), 6)::DOUBLE AS score FROM events")
def f40(t):
    v = F.when(F.col("value") > 1, F.col("value") / 100).otherwise(F.col("value"))
    return t.raw("events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v, F.lit(0.0)))), 6).alias("score"))


@query("f41_importance", "SELECT person_a, person_b, round(least(0.35, 0.35 * paper_count / 10), 6)::DOUBLE AS importance FROM edges")
def f41(t):
    from ..operators.core import coauthor_edges

    return coauthor_edges(t).select("person_a", "person_b", F.round(F.least(F.lit(0.35), 0.35 * F.col("paper_count") / 10), 6).alias("importance"))


@query("f42_radius_scale", "SELECT id, round(2 + 6 * sqrt(cited_by / 500.0), 6)::DOUBLE AS radius, round(greatest(0.25, least(1.0, 0.25 + cited_by / 400.0)), 6)::DOUBLE AS opacity FROM publications")
def f42(t):
    c = F.col("cited_by")
    return t.publications.select("id", F.round(2 + 6 * F.sqrt(c / 500.0), 6).alias("radius"), F.round(F.greatest(F.lit(0.25), F.least(F.lit(1.0), 0.25 + c / 400.0)), 6).alias("opacity"))


@query("f43_impact_bucket", "SELECT id, CASE WHEN cited_by >= 300 THEN 'high' WHEN cited_by >= 100 THEN 'middle' ELSE 'low' END AS bucket FROM publications")
def f43(t):
    return t.publications.select("id", F.when(F.col("cited_by") >= 300, "high").when(F.col("cited_by") >= 100, "middle").otherwise("low").alias("bucket"))


@query("f44_polar_layout", "SELECT vec_id, round(cos(2 * pi() * (rn - 0.5::DOUBLE) / n), 6)::DOUBLE AS x, round(sin(2 * pi() * (rn - 0.5::DOUBLE) / n), 6)::DOUBLE AS y FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def f44(t):
    from pyspark.sql import Window as W

    by = W.partitionBy("label")
    angle = 2 * F.pi() * (F.row_number().over(by.orderBy("vec_id")) - 0.5) / F.count("*").over(by)
    return t.raw("embeddings").select("vec_id", F.round(F.cos(angle), 6).alias("x"), F.round(F.sin(angle), 6).alias("y"))


@query("f45_path_arrays", "SELECT id, array_to_string(path, '>') AS path, list_contains(path, 1000) AS below_1000, list_position(path, id)::BIGINT AS place FROM tree")
def f45(t):
    from ..operators.core import org_tree

    return org_tree(t).select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.array_contains("path", 1000).alias("below_1000"), F.array_position("path", F.col("id")).alias("place"))
