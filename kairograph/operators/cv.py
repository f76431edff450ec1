"""Positions and degrees out of the lines of curricula vitae, with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .core import top_per

#: Headers of sections, whatever the case; a section that is neither ends the reading.
EMPLOYMENT = r"(?i)^(?:employment|appointments|academic appointments|academic positions|professional experience|positions held|positions|experience|work history)\s*$"
EDUCATION = r"(?i)^(?:education|degrees|academic background|training)\s*$"
STOP = r"(?i)^(?:publications|working papers|journal publications|research|awards|honors|grants|teaching|references|other publications|under review)\b"
#: Years and ranges of years.
YEAR = r"(?:19|20)\d{2}"
LEADING = rf"(?i)^({YEAR})\s*[-–—]\s*(?:({YEAR}|present|current|now)\s+)?(.+)$"
INLINE = rf"(?i)^(.*?)({YEAR})\s*[-–—]\s*({YEAR}|present|current|now)(.*)$"
#: What a role looks like, and words that mark an organization, in the order they are tried.
ROLE = (
    r"(?i)\b((?:Visiting\s+)?(?:Assistant|Associate)\s+Professor(?:\s+of\s+[^,;]+)?|Professor(?:\s+Emeritus|\s+of\s+[^,;]+)?|Postdoctoral(?:\s+Research)?\s+Fellow|"
    r"Research\s+Affiliate|Affiliate\s+Member|Ph\.?D\.?(?:\s+in\s+[^,;]+)?|A\.?B\.?(?:\s+in\s+[^,;]+)?|M\.?A\.?(?:\s+in\s+[^,;]+)?)\b")
MARKERS = ("university", "college", "institute", "school", "department", "laboratory", "faculty", "gsb", "haas", "economics", "business", "center", "centre")


def stripped(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def cut_at(text: Column, at: Column) -> Column:
    """(title, organization) of a text that is cut before character ``at``; null where one of them would be empty."""
    organization, title = stripped(F.substr(text, F.lit(1), at - 1), " ,;"), stripped(F.substr(text, at), " ,;")
    return F.when((at > 0) & (organization != "") & (title != ""), F.struct(title.alias("title"), organization.alias("organization")))


def title_and_organization(text: Column) -> Column:
    """An organization ends where a role begins, else where the first marker does, else it is the marked part of a list."""
    tried = [cut_at(text, F.regexp_instr(text, F.lit(ROLE)))]
    for marker in MARKERS:
        at = F.locate(marker, F.lower(text))
        tried.append(F.when(at > 1, cut_at(text, at)))
    marked = lambda p: F.lower(p).rlike("|".join(MARKERS))

    def of_list(parts: Column) -> Column:
        n = F.size(parts)
        last = F.array_max(F.filter(F.transform(parts, lambda p, k: F.when(marked(p), k)), lambda k: k.isNotNull()))
        at = F.coalesce(last, n - 1)
        organization = F.get(parts, at)
        title = F.array_join(F.filter(parts, lambda p, k: k != at), ", ")
        return F.when((n > 1) & (F.lower(title) != F.lower(organization)), F.struct(title.alias("title"), organization.alias("organization")))

    parts = F.filter(F.transform(F.split(text, r"\s{2,}|\s*,\s*"), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(*tried, X.let(parts, of_list), F.struct(text.alias("title"), F.lit("").alias("organization")))


def cv_entries(lines: DataFrame) -> DataFrame:
    """(doc, place, section, title, organization, kind, rank, starts, ends) of ``lines`` (doc, place, line).

    The section of a line is that of the last header above it (employment before the first); nothing is read from the
    first other section on. A line counts if it begins with or holds a range of years ("present" has no end), or, among
    the degrees, a year. Entries of equal title and dates collapse to the first.
    """
    rows = lines.withColumn("line", F.trim("line")).where("line <> ''")
    employment, education = F.col("line").rlike(EMPLOYMENT), F.col("line").rlike(EDUCATION)
    above = W.partitionBy("doc").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    stop = ~employment & ~education & F.col("line").rlike(STOP)
    section = F.last(F.when(employment, "employment").when(education, "education"), ignorenulls=True).over(above)
    rows = rows.withColumn("section", F.coalesce(section, F.lit("employment"))).withColumn("over", F.max(stop).over(above)).where(~F.col("over") & ~employment & ~education)
    leading = lambda k: F.regexp_extract("line", LEADING, k)
    inline = lambda k: F.regexp_extract("line", INLINE, k)
    years = F.regexp_extract_all("line", F.lit(rf"\b({YEAR})\b"), F.lit(1))
    single = F.element_at(F.when(F.size(years) > 0, years), -1)
    inline_body = stripped(F.concat(inline(1), inline(4)), " ,;–-")
    single_body = stripped(F.regexp_replace("line", rf"\b{YEAR}\b", ""), " ,;()–-")
    entry = lambda start, end, body: F.struct(start.alias("start"), end.alias("end"), stripped(body, " .;").alias("body"))
    found = F.when(leading(1) != "", entry(leading(1), F.coalesce(F.nullif(leading(2), F.lit("")), F.lit("present")), leading(3))).when(
        (inline(2) != "") & (F.length(inline_body) >= 4), entry(inline(2), inline(3), inline_body)).when(
        (F.col("section") == "education") & single.isNotNull() & (F.length(single_body) >= 4), entry(single, single, single_body))
    rows = rows.select("doc", "place", "section", found.alias("e")).where("length(e.body) >= 4")
    rows = rows.select("doc", "place", "section", title_and_organization(F.col("e.body")).alias("t"), F.make_date(F.col("e.start").cast("int"), F.lit(1), F.lit(1)).alias("starts"), F.make_date(F.col("e.end").try_cast("int"), F.lit(12), F.lit(31)).alias("ends"))
    rows = rows.select("doc", "place", "section", "t.title", "t.organization", X.affiliation_kind(F.col("t.title"), F.col("section")).alias("kind"), X.position_rank(F.col("t.title")).alias("rank"), "starts", "ends")
    rows = rows.withColumn("lower_title", F.lower("title"))
    return top_per(rows, ["doc", "lower_title", "starts", "ends"], ["place"]).drop("lower_title")
