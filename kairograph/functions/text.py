"""Text functions as column expressions."""

from __future__ import annotations

import json
from html.entities import html5
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def full_name(*parts: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit("")), F.lit("(unnamed)"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_parts(c: Column) -> Column:
    """first, middle and last of a full name; a single token is both first and last."""
    p = F.split(collapse(c), " ")
    n = F.size(p)
    return F.struct(p[0].alias("first"), F.when(n > 2, F.array_join(F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).alias("middle"), F.element_at(p, -1).alias("last"))


#: Titles that are files or fragments rather than papers, whatever the case.
JUNK_TITLES = (
    r"\.(do|tab|dta|r|sql|sas|m|py)$",
    r"\.(pptx?|pdf|docx?|key|odp)$",
    r"^(poster|slides|handout|abstract)[ _]",
    r"^readme(\.txt)?$",
    r"^header\.do$",
    r"^(app|appx)_(paper|fig|tab)",
    r"^(paper|appx)_(fig|tab)_",
    r"^mrc_",
    r"^supplemental\b",
    r"^online appendix\b",
    r"^\d{1,2}\.\s+\S",
)
#: What begins an acknowledgement that was glued to a title.
THANKS = (" The authors thank ", " Acknowledgments ", " Acknowledgements ", " We thank ", " I thank ")
#: Kinds of works that are no research output, and the digital identifiers of book chapters.
SKIPPED_TYPES = ("book-chapter", "reference-entry", "paratext", "letter", "editorial", "erratum", "correction")
CHAPTER_DOI = r"978\d{10}-\d{3,4}$"

_ENTITY = r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&)"


def unescape(c: Column) -> Column:
    """Character references decoded: numeric ones, and all named ones of the HTML standard."""
    names = F.from_json(F.lit(json.dumps({"&" + k: v for k, v in html5.items()})), "map<string,string>")

    def decoded(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#([0-9]+)", 1)
        code = F.when(digits != "", digits.try_cast("bigint")).otherwise(F.conv(F.nullif(F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]+)", 1), F.lit("")), 16, 10).try_cast("bigint"))
        odd = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(odd, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
        return F.when(F.startswith(x, F.lit("&#")), F.coalesce(char, x)).when(F.startswith(x, F.lit("&")), F.coalesce(F.element_at(names, x), x)).otherwise(x)

    parts = F.transform(F.regexp_extract_all(c, F.lit("(?s)" + _ENTITY), F.lit(1)), decoded)
    return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)


def clean_title(c: Column) -> Column:
    """References decoded, white space collapsed, cut at a star mark or at the first acknowledgement beyond 15 characters."""
    def cut(t: Column) -> Column:
        out = None
        for mark in THANKS:
            at = F.locate(mark, t)
            short = F.trim(F.substr(t, F.lit(1), at - 1))
            out = F.when(at > 16, short) if out is None else out.when(at > 16, short)
        return out.otherwise(t)

    plain = collapse(F.replace(unescape(c), F.lit("\u00a0"), F.lit(" ")))
    return let(F.trim(F.substring_index(plain, "✶", 1)), cut)


def is_junk_title(c: Column) -> Column:
    def junk(t: Column) -> Column:
        out = F.length(t) < 4
        for pattern in JUNK_TITLES:
            out = out | t.rlike("(?i)" + pattern)
        return out

    return let(clean_title(c), junk)


def is_chapter_doi(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, "^https://doi.org/", "")).rlike(CHAPTER_DOI), F.lit(False))


def skip_reason(title: Column, doi: Column, kind: Column) -> Column:
    """Why a work is no research output: 'junk', 'chapter' or 'type'; null if it stays."""
    return F.when(is_junk_title(F.trim(title)), "junk").when(is_chapter_doi(F.trim(doi)), "chapter").when(F.lower(kind).isin(*SKIPPED_TYPES), "type")


def dedupe_title(c: Column) -> Column:
    """The form under which titles of one paper are equal."""
    t = F.regexp_replace(F.lower(clean_title(c)), r"^replication (data|materials|package) for:\s*", "")
    t = F.trim(F.regexp_replace(t, r"\*+$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\.\s*nber working paper.*$", ""), r"\s+#\d+$", "")
    return F.trim(F.regexp_replace(t, r"(?U)[^\w]+", " "))


def likely_same_paper(title: Column, year: Column, other: Column, then: Column) -> Column:
    """Equivalent forms of both titles, and years at most two apart where both are known."""
    same = let(dedupe_title(title), lambda a: let(dedupe_title(other), lambda b: (a != "") & (b != "") & titles_equivalent(a, b)))
    return same & F.coalesce(F.abs(year - then) <= 2, F.lit(True))


def titles_equivalent(a: Column, b: Column) -> Column:
    x, y = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(x) >= 30) & F.startswith(y, x))


#: Ordered rules of position ranks, whatever the case; the first match wins.
RANK_RULES = (
    (r"emeritus|emerita", "emeritus_professor"),
    (r"adjunct", "adjunct_professor"),
    (r"assistant\s+professor", "assistant_professor"),
    (r"associate\s+professor", "associate_professor"),
    (r"lecturer|instructor", "lecturer"),
    (r"post[-\s]?doc(toral)?|postdoctoral", "postdoc"),
    (r"predoctoral|predoc|research\s+fellow|senior\s+fellow", "research_fellow"),
    (r"research\s+scientist|staff\s+scientist", "research_scientist"),
    (r"\bprofessor\b|\bprof\b", "full_professor"),
    (r"ph\.?d\.?\s+student|doctoral\s+student", "phd_student"),
    (r"visiting\s+student", "visiting_student"),
    (r"\bph\.?d\.?\b", "phd_student"),
    (r"\bm\.?a\.?\b|\bmasters?\b", "masters_student"),
    (r"\bb\.?a\.?\b|\bb\.?s\.?\b|undergraduate", "undergraduate"),
    (r"principal\s+investigator|\bpi\b", "principal_investigator"),
    (r"board\s+member|advisory\s+board", "board_member"),
    (r"\bdean\b", "dean"),
)
#: What makes a title one of education, outside a section of its own.
EDUCATION_MARKS = ("ph.d", "phd", "m.a.", "m.s.", "b.a.", "b.s.", "degree", "student")


def position_rank(c: Column, rules=RANK_RULES) -> Column:
    out = None
    for pattern, rank in rules:
        hit = c.rlike("(?i)" + pattern)
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out


def affiliation_kind(title: Column, section: Column) -> Column:
    has = lambda w: F.contains(F.lower(title), F.lit(w))
    marks = has(EDUCATION_MARKS[0])
    for mark in EDUCATION_MARKS[1:]:
        marks = marks | has(mark)
    return F.when(section == "education", "education").when(has("founder"), "founding").when(has("board") | (has("director") & ~has("managing")), "governance").when(has("visiting"), "visiting").when(marks, "education").otherwise("employment")


#: Blocks of IPv4 addresses that are not public.
PRIVATE_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")


def is_public_url(c: Column) -> Column:
    """http or https, a host, no credentials, no control characters, a valid port, and no private or reserved address."""
    form = r"^https?://([^/?#@\[\]:]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]*))?(?:[/?#]|$)"
    host, port = F.lower(F.regexp_extract(c, form, 1)), F.regexp_extract(c, form, 2)
    quad = F.transform(F.split(F.when(host.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), host), r"\."), lambda x: x.cast("long"))
    number = F.aggregate(quad, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    private = F.lit(False)
    for block in map(ip_network, PRIVATE_BLOCKS):
        private = private | number.between(int(block.network_address), int(block.broadcast_address))
    six = host.rlike(r"^\[(::|::1|::ffff:.*|fc.*|fd.*|fe[89a-f].*|ff.*|2001:db8:.*|100::.*)\]$")
    in_range = (port == "") | F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))
    return c.rlike(form) & ~c.rlike(r"[\r\n\t]") & in_range & ~F.coalesce(private, F.lit(False)) & ~six


def orcid_check_digit(digits: Column) -> Column:
    """ISO 7064 mod 11-2 over the first 15 digits."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, k: (a + F.substr(digits, k, F.lit(1)).cast("int")) * 2)
    r = (12 - total % 11) % 11
    return F.when(r == 10, "X").otherwise(r.cast("string"))


def canonical_orcid(c: Column) -> Column:
    """The first identifier in a text in upper case if its check digit holds, else null."""
    found = F.upper(F.regexp_extract(c, r"(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dx])", 1))
    digits = F.replace(found, F.lit("-"), F.lit(""))
    return F.when((found != "") & (F.substring(digits, 16, 1) == F.when(found != "", orcid_check_digit(digits))), found)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-case alphanumeric words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"(?U)[^\p{Alnum}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<![\d-])(?:\+?\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"


def redact_contacts(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[redacted]"), PHONE, "[redacted]")


def strip_tags(c: Column) -> Column:
    lines = F.split(F.replace(unescape(F.regexp_replace(c, r"(?s)<[^>]+>", " ")), F.lit("\u00a0"), F.lit(" ")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), "\n")


def palette_slot(c: Column, slots: int) -> Column:
    """h = 31 h + code over 32-bit integers, then its absolute value modulo the slots."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + x + 2147483648, F.lit(4294967296)) - 2147483648)
    return F.abs(h) % slots


def encode_id(kind: str, c: Column, mask: int) -> Column:
    """Opaque token of an id: base 36 of the id xor a mask; all-digit tokens get an underscore."""
    token = F.lower(F.conv(c.bitwiseXOR(F.lit(mask).cast("long")).cast("string"), 10, 36))
    return F.concat(F.lit(kind + ":"), F.when(token.rlike(r"^\d+$"), F.concat(F.lit("_"), token)).otherwise(token))


def decode_id(c: Column, mask: int) -> Column:
    """The id of a token; an all-decimal tail is taken as a raw id, anything malformed as null."""
    tail = F.substring_index(c, ":", -1)
    coded = F.conv(F.ltrim(tail, F.lit("_")), 36, -10).try_cast("bigint").bitwiseXOR(F.lit(mask).cast("long"))
    return F.when(tail.rlike(r"^\d{1,18}$"), tail.try_cast("bigint")).when(tail.rlike(r"^_?[0-9a-z]+$"), coded)
