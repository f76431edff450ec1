"""Rules of titles, ranks, addresses, curricula and links on hand-made rows; expected values are written out."""

import datetime
import html

import pytest
from pyspark.sql import functions as F

from kairograph.functions import text as X
from kairograph.operators.components import ranked
from kairograph.operators.cv import cv_entries
from kairograph.plans.ingest import anchors_of


def applied(spark, values, rule):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, c string").select("k", rule(F.col("c")).alias("r")).orderBy("k").collect()
    return [r["r"] for r in rows]


@pytest.mark.parametrize(("title", "junk"), [
    ("model.tab", True), ("clean.SQL", True), ("est.sas", True), ("talk.odp", True), ("talk.pptx", True), ("run.ado", False), ("data.zip", False), ("1. Introduction", True), ("1.Introduction", False), ("Chapter 3", False),
    ("poster_session", True), ("Slides for class", True), ("README.txt", True), ("app_paper one", True), ("app paper one", False), ("Supplemental material", True), ("Supplementals", False), ("abc", True), ("Trade and growth", False), (None, None)])
def test_junk_titles(spark, title, junk):
    assert applied(spark, [title], X.is_junk_title) == [junk]


def test_ranks(spark):
    want = {
        "Ph.D. student": "phd_student", "M.A.": "masters_student", "B.S.": "undergraduate", "post doc": "postdoc", "Postdoctoral Fellow": "postdoc", "Staff  Scientist": "research_scientist", "Assistant\tProfessor of X": "assistant_professor",
        "Professor Emerita": "emeritus_professor", "Adjunct lecturer": "adjunct_professor", "Instructor": "lecturer", "predoc": "research_fellow", "Prof of law": "full_professor", "Visiting student": "visiting_student", "PhD": "phd_student",
        "PI of the lab": "principal_investigator", "advisory board": "board_member", "Dean": "dean", "gardener": None, "profane": None}
    assert dict(zip(want, applied(spark, list(want), X.position_rank), strict=True)) == want


def test_titles_are_cleaned(spark):
    want = {
        "Trade &amp; growth ✶ thanks": "Trade & growth", "A title long enough We thank our hosts": "A title long enough", "Short We thank nobody here": "Short We thank nobody here",
        "Prices&nbsp;and\n wages": "Prices and wages", "Caf&eacute; &#233; &#xE9; &unknown; &": "Café é é &unknown; &"}
    assert dict(zip(want, applied(spark, list(want), X.clean_title), strict=True)) == want


def test_references_are_decoded_as_in_the_standard(spark):
    values = ["&lt;p&gt; &amp;amp; &copy; &hellip; &alpha;&beta; &#8364; &#x1F600; &#0; &#xD800; &#1114112;", "a & b && c; &; &#; &#x;", "&copy no end", "x" * 1000 + "&quot;", ""]
    assert applied(spark, values, X.unescape) == [html.unescape(v) for v in values]


def test_same_papers(spark):
    long = "the long run effects of early trade policy"
    rows = [("Replication data for: A b", 2000, "A B*", 2002, True), ("A b #12", None, "a, b", 1990, True), ("A b", 2000, "A b", 2003, False), (long, 2000, long + " in europe", 2001, True), ("A b", 2000, "A b c", 2000, False), ("!!!", 2000, "!!!", 2000, False),
            (f"{long}. NBER Working Paper 12", 2000, long, 2000, True)]
    df = spark.createDataFrame([r[:4] for r in rows], "a string, y int, b string, z int").select(X.likely_same_paper(F.col("a"), F.col("y"), F.col("b"), F.col("z")).alias("r"))
    assert [r["r"] for r in df.collect()] == [r[4] for r in rows]


def test_works_to_skip(spark):
    rows = [("Fine title", "https://doi.org/10.1/9781234567890-012", "article", "chapter"), ("Fine title", "10.1/9781234567890-01", "article", None), ("Fine title", None, "Erratum", "type"), ("x.do", None, "article", "junk"), ("Replication data for a paper", None, "dataset", None)]
    df = spark.createDataFrame([r[:3] for r in rows], "t string, d string, k string").select(X.skip_reason(F.col("t"), F.col("d"), F.col("k")).alias("r"))
    assert [r["r"] for r in df.collect()] == [r[3] for r in rows]


def test_only_public_addresses(spark):
    want = {
        "http://example.org": True, "https://example.org:8080/a?b#c": True, "ftp://example.org": False, "http://": False, "http://user@example.org/": False, "http://u:p@example.org/": False, "http://example.org:0/": False, "http://example.org:70000/": False,
        "http://8.8.8.8/": True, "http://10.1.2.3/": False, "http://127.0.0.1:80/": False, "http://169.254.169.254/latest": False, "http://172.16.0.1": False, "http://172.31.255.255/": False, "http://172.32.0.1/": True, "http://192.168.1.1/": False,
        "http://[::1]/": False, "http://[fe80::1]/": False, "http://[2606:4700::1]/": True, "http://0.0.0.0/": False, "http://224.0.0.1/": False, "http://a\nb/": False, "http://192.0.2.7/": False}
    assert dict(zip(want, applied(spark, list(want), X.is_public_url), strict=True)) == want


def test_curricula(spark):
    text = """Jane Doe
2019–present Stanford University Assistant Professor of Economics
2019–present Stanford University Assistant Professor of Economics
Positions
Affiliate Member, Center for Growth, 2015 - 2018
2010-2012 Data Analyst, Bank of England
no dates here
Education
Harvard University, Ph.D. in Economics, 2015
2008 – 2010 M.A. in Statistics, London School
B.A. (2008)
Publications
2001–2002 Not a Position, University"""
    lines = spark.createDataFrame([("d", k, x) for k, x in enumerate(text.split("\n"))], "doc string, place int, line string")
    got = [(r["section"], r["title"], r["organization"], r["kind"], r["rank"], r["starts"] and r["starts"].year, r["ends"] and r["ends"].year) for r in cv_entries(lines).orderBy("place").collect()]
    assert got == [
        ("employment", "Assistant Professor of Economics", "Stanford University", "employment", "assistant_professor", 2019, None),
        ("employment", "Center for Growth", "Affiliate Member", "employment", None, 2015, 2018),
        ("employment", "Data Analyst", "Bank of England", "employment", None, 2010, 2012),
        ("education", "Ph.D. in Economics", "Harvard University", "education", "phd_student", 2015, 2015),
        ("education", "School", "M.A. in Statistics, London", "education", None, 2008, 2010),
    ]
    assert all(r["ends"] is None or r["ends"] == datetime.date(r["ends"].year, 12, 31) for r in cv_entries(lines).collect())
    assert cv_entries(lines.limit(0)).count() == 0


def test_links_however_written(spark):
    page = """<a href="/a">One</a> <A class=x HREF='/b?x=1&amp;y=2'><b>Two</b> more</A><a href=/c>Three</a><a name="n">none</a><abbr href="/z">no</abbr><a
 target="_blank" href="/my-cv.pdf">CV</a>"""
    rows = anchors_of(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("place").collect()
    assert [(r["href"], r["label"]) for r in rows] == [("/a", "One"), ("/b?x=1&y=2", "Two more"), ("/c", "Three"), ("/my-cv.pdf", "CV")]


def test_places_without_one_task(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("x"))
    got = {r["id"]: r["place"] for r in ranked(df, [F.desc("x"), F.asc("id")]).collect()}
    order = sorted(range(1000), key=lambda k: (-(k * 7919 % 101), k))
    assert got == {k: i + 1 for i, k in enumerate(order)}
