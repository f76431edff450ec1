"""Profile pages of known hosts into title, biography, own site and researcher id, by column expressions alone."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


class Form(NamedTuple):
    """Where a host keeps what: each pattern has one group; ``block`` and ``body`` narrow the page first."""

    block: str
    titles: str
    body: str
    texts: str
    least: int
    site: str
    described: bool
    no_text: tuple = ()
    no_site: tuple = ()


SOCIAL = ("twitter.com", "facebook.com", "linkedin.com", "youtube.com")
ALL = "(?s)(.*)"


def of_class(tag: str, name: str, inner: str) -> str:
    """A pattern of an element that has a class beginning with ``name``, wherever its attribute stands."""
    return rf"""(?is)<{tag}\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?(?:{name})[^"']*["'][^>]*>{inner}"""


def labelled(label: str) -> str:
    """A pattern of the address of an anchor whose label holds ``label``."""
    return rf"""(?is)<a\b[^>]*\bhref\s*=\s*["'](https?://[^"']+)["'][^>]*>[^<]*(?:{label})[^<]*</a"""


#: Class names, words and lengths of the known kinds of pages.
FORMS = {
    "columns": Form(of_class("div", "field-hs-person-title", r"(.*?)(?=<div class=|<footer|</body|\z)"), r"(?is)<div>([^<]+)</div>", of_class("div", "hb-three-column-w-image__main-body", r"(.*?)(?=<footer|<aside|<div class=.hb-related-content|\z)"),
                    of_class("div", "text-with-summary", "(.*?)</div>"), 30, labelled("website"), True, ("[at]", "phone :", "campus map", "connect with us", "job market", "admissions", "peer advisors"), (*SOCIAL, "mailchimp", "listserv")),
    "faculty-node": Form(ALL, of_class("div", "c-node-faculty__endowed-title|c-node-faculty__jaorhfp-title", "([^<]+)</div>"), ALL, of_class("div", "bio-content", r"(.*?)</div>\s*</div>"), 30, labelled("Personal Website|Homepage|Faculty Website"), True, (), SOCIAL),
    "display-fields": Form(ALL, of_class("div", "display-position", "([^<]*)</div>"), ALL, r"(?is)field--name-field-bio[^>]*>.*?<div\b[^>]*field__item[^>]*>(.*?)</div>", 30, of_class("div", "display-homepage", r"""\s*<div[^>]*>\s*<a\b[^>]*\bhref\s*=\s*["'](https?://[^"']+)"""), False, (), SOCIAL),
    "posts": Form(of_class("p", "intro-text", r"\s*<strong>(.*?)</strong>"), r"([^|]+)", of_class("section", "post-content", "(.*?)</section>"), r"""(?is)<p\b(?![^>]*intro-text)[^>]*>(.*?)</p>""", 60, labelled("Website|Homepage"), False,
                  ("phone number", "email ", "click here", "download cv"), (*SOCIAL, "instagram.com", "/cdn-cgi/l/email-protection")),
}


def read_form(form: Form, html: Column) -> Column:
    """(title, biography, site) of a page by ``form``; what is missing or implausible is null.

    Titles are joined by a dot; the biography is the first text that is long enough and holds no word of a notice, else
    the description of the page where the form has one; the site is the first plausible address.
    """
    some = lambda c: F.when(c != "", c)
    free = lambda c, words: ~F.lower(c).rlike("|".join("\\Q" + w + "\\E" for w in words)) if words else F.lit(True)
    good = lambda c: (F.length(c) >= form.least) & free(c, form.no_text)
    every = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    title = F.filter(F.transform(every(F.regexp_extract(html, form.block, 1), form.titles), lambda c: X.collapse(X.strip_tags(c))), lambda c: c != "")
    paragraphs = lambda c: X.strip_tags(F.regexp_replace(c, r"(?i)</p\s*>|<br\s*/?>", "\n"))
    found = F.get(F.filter(F.transform(every(F.regexp_extract(html, form.body, 1), form.texts), paragraphs), good), F.lit(0))
    described = X.collapse(X.strip_tags(F.regexp_extract(html, r"""(?i)<meta\s+name=["']description["']\s+content=["']([^"']+)""", 1)))
    biography = F.coalesce(found, F.when(good(described), described)) if form.described else found
    site = F.get(F.filter(every(html, form.site), lambda c: free(c, form.no_site)), F.lit(0))
    return F.struct(some(F.array_join(title, " · ")).alias("title"), biography.alias("biography"), site.alias("site"))


def read_profiles(pages: DataFrame, hosts: dict[str, str]) -> DataFrame:
    """(page_id, host, title, biography, site, orcid) of ``pages`` (page_id, url, html) whose host has a form in ``hosts``.

    Pages of other hosts and without an address are left out; a null page has nulls.
    """
    host = F.try_parse_url("url", F.lit("HOST"))
    got = None
    for name, form in hosts.items():
        one = read_form(FORMS[form], F.col("html"))
        got = F.when(host == name, one) if got is None else got.when(host == name, one)
    rows = pages.where(host.isin(list(hosts))).select("page_id", host.alias("host"), got.alias("p"), X.canonical_orcid(F.col("html")).alias("orcid"))
    return rows.select("page_id", "host", "p.title", "p.biography", "p.site", "orcid")
