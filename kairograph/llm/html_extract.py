"""Main text of pages by wrapper induction: same-host DOM trees are aligned by simple tree matching."""

from __future__ import annotations

import html
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts

#: HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg xmp".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body html li dd dt td th tr tbody thead tfoot caption legend".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
           "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"}}
#: Elements and names of class, id or role that never belong to an article.
OUTSIDE = set("nav aside footer form button select input dialog menu head search label annotation annotation-xml".split()) | RAW
#: Of these elements the text belongs to an article that they stand in.
RUNNING = {"dialog", "label", "search"}
OUTSIDE_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond disqus toolbar pagination pager skip complementary contentinfo dialog search".split())
#: The names that are outside within an article too, and of an article itself: adverts and what readers say.
SAID_BY_OTHERS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments commentlist respond disqus".split())
INSIDE_NAMES = SAID_BY_OTHERS | set("sidebar cookie cookies consent newsletter subscribe navbar breadcrumb breadcrumbs pagination pager".split())
#: Headings and paragraphs carry slugs as ids, so within an article only other elements are judged by their id.
SLUGGED = set("h1 h2 h3 h4 h5 h6 p a span li dt dd figure table".split())
#: Elements of running text: one that never changes beside some that do is a passage, not template.
PASSAGES = set("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption".split())
#: Parts that may stand beside those in one name, as in "sidebar-left"; any other part makes it another name ("has-sidebar").
BESIDE_NAMES = set("left right top bottom site page box list section area wrapper container block bar item widget primary secondary".split())

#: Page heads: outside an article, unless they stand in one.
HEADS = {"header", "site-header", "page-header", "topbar", "top-bar"}

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
#: The same without quotes, from the first tag on whose quotes never close: no tag is read to the end of the page twice.
PLAIN_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|(?!)(())()|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
#: Pages that share this part of their blocks are near copies.
NEAR = 0.8
#: Part of the pages of a host that hold a place of its template.
PRESENT = 0.75
#: Pages that must agree on a text before it is template, and pages that are no near copies on a host with a template.
AGREE = 3
#: Skeletons of a host that one task merges at once.
MERGED = 32

NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)


class Node:
    __slots__ = ("children", "names", "outside", "tag")

    def __init__(self, tag: str, attributes: str = "", within: bool = False):
        """``within``: the element stands in an article, where fewer things are outside."""
        self.tag, self.children = tag, []
        self.names = ""
        self.outside = tag in OUTSIDE and not (within and tag in RUNNING)
        if attributes and not attributes.isspace():
            found = [(k.lower(), v.strip("\"'").lower()) for k, v in NAMES.findall(attributes)]
            self.names = " ".join(v for _, v in found)
            if tag not in ("html", "body", "main"):
                words = SAID_BY_OTHERS if tag == "article" else INSIDE_NAMES if within else OUTSIDE_NAMES
                judged = " ".join(v for k, v in found if not (within and k == "id" and tag in SLUGGED))
                self.outside = self.outside or tag != "article" and bool(HIDDEN.search(attributes)) or any(names_outside(x, words) for x in judged.split())


def names_outside(name: str, words: set[str] = OUTSIDE_NAMES) -> bool:
    """Whether a whole name, or every part of it but neutral ones, says that something is not the article."""
    parts = {p.rstrip("0123456789") for p in re.split("[_-]+", name)} - {""}
    return name in words or not parts.isdisjoint(words) and parts <= words | BESIDE_NAMES


def parse(source: str) -> Node:
    """A forgiving parse: omitted end tags, stray end tags and cut-off pages give a tree, never an error."""
    root = Node("#root")
    stack, at, size = [root], 0, len(source)
    opened: Counter = Counter()
    token = TOKEN

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while at < size:
        m = token.search(source, at)
        if not m:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at:m.start()])
        at = m.end()
        if m[5]:
            token = PLAIN_TOKEN
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in SIBLING and any(opened[x] for x in SIBLING[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLING[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPE.get(tag, ()):
                    break
        node = Node(tag, m[3] or m[6] or "", opened["article"] > 0)
        if (tag == "header" or not HEADS.isdisjoint(node.names.split())) and not opened["article"] + opened["main"]:
            node.outside = True
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else size
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


class Slot:
    """A place in the skeleton of a page: one block element; siblings keep their order, equal kinds too."""

    __slots__ = ("children", "held", "kind", "number", "parent")

    def __init__(self, kind: str, parent: Slot | None = None):
        self.kind, self.parent, self.number, self.held = kind, parent, -1, 0.0
        self.children: list[Slot] = []

    def child(self, kind: str) -> Slot:
        self.children.append(x := Slot(kind, self))
        return x

    def walk(self) -> list[Slot]:
        """This place and all below it, parents first, in order."""
        out, work = [], [self]
        while work:
            out.append(x := work.pop())
            work.extend(reversed(x.children))
        return out


def read_page(source: str) -> tuple[Slot, list[tuple[Slot, str]]]:
    """The skeleton of a page, and (place, text) of its blocks in page order, without what is never an article.

    An article is one place of the skeleton: what stands in it is told from the page by its element, so the blocks in
    it have places of their own that hang below nothing and are never template.
    """
    root = Slot("#root")
    out: list[tuple[Slot, str]] = []
    line: list[str] = []

    def close(slot: Slot) -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append((slot, text))

    work: list = [(parse(source), None, root)]
    while work:
        x, closing, slot = work.pop()
        if isinstance(x, str):
            line.append(x)
        elif closing is not None:
            close(closing)
        elif not x.outside:
            inner = slot
            if x.tag == "br":
                line.append(" ")
            if x.tag in BLOCK:
                close(slot)
                kind = f"{x.tag} {re.sub(r'[0-9]+', '0', x.names)}".rstrip()
                if slot.kind == "#story":
                    inner = slot
                else:
                    inner = slot.child(kind)
                    if x.tag == "article":
                        inner = Slot("#story", inner)
                work.append((x, inner, slot))
            work.extend((c, None, inner) for c in reversed(x.children))
    close(root)
    return root, out


def shapes(root: Slot, known: dict) -> dict[int, int]:
    """The shape of each place: two places have the same number if and only if the trees below them are equal."""
    out: dict[int, int] = {}
    for x in reversed(root.walk()):
        out[id(x)] = known.setdefault((x.kind, tuple(out[id(c)] for c in x.children)), len(known))
    return out


def trimmed(a: list[int], b: list[int]) -> tuple[int, int]:
    """How many equal shapes begin, and then end, two lists of siblings; a largest mapping always pairs those."""
    most = min(len(a), len(b))
    head = next((k for k in range(most) if a[k] != b[k]), most)
    tail = next((k for k in range(most - head) if a[-1 - k] != b[-1 - k]), most - head)
    return head, tail


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the largest mapping of two skeletons that keeps parents and order, and its pairs.

    A level is the table of all siblings of one side by all of the other, a row at a time; siblings of equal shape at
    both ends of a level are paired at once, and equal pairs of shapes are looked at once. Time grows with the square
    of the siblings that are left, memory with their number times its root.
    """
    if a.kind != b.kind:
        return 0, []
    known: dict = {}
    shape_a, shape_b = shapes(a, known), shapes(b, known)
    kind_of, below = {}, {}
    for (kind, children), k in known.items():
        kind_of[k], below[k] = kind, children
    total = {}
    for k in range(len(known)):  # children are numbered before their parents
        total[k] = 1 + sum(total[c] for c in below[k])
    size: dict[tuple[int, int], int] = {}

    def weight(x: int, y: int) -> int:
        return total[x] if x == y else size[x, y] if kind_of[x] == kind_of[y] else 0

    def rows(left: list[int], right: list[int], first: np.ndarray):
        kinds = {k: i for i, k in enumerate(dict.fromkeys(right))}
        at = np.fromiter((kinds[k] for k in right), np.int64, len(right))
        cache: dict[int, np.ndarray] = {}
        row = first
        for x in left:
            if x not in cache:
                cache[x] = np.array([weight(x, y) for y in kinds], np.int64)[at]
            best = row.copy()
            np.maximum(best[1:], row[:-1] + cache[x], out=best[1:])
            row = np.maximum.accumulate(best)
            yield row

    def level(x: int, y: int) -> tuple[int, list[int], list[int]]:
        head, tail = trimmed(below[x], below[y])
        return head, list(below[x][head:len(below[x]) - tail]), list(below[y][head:len(below[y]) - tail])

    work = [(shape_a[id(a)], shape_b[id(b)])]
    while work:
        x, y = work[-1]
        if x == y or (x, y) in size:
            work.pop()
            continue
        head, left, right = level(x, y)
        named: dict[str, set[int]] = {}
        for k in right:
            named.setdefault(kind_of[k], set()).add(k)
        missing = [(k, o) for k in set(left) for o in named.get(kind_of[k], ()) if k != o and (k, o) not in size]
        if missing:
            work.extend(missing)
            continue
        tail = len(below[x]) - head - len(left)
        ends = sum(total[k] for k in below[x][:head]) + sum(total[k] for k in below[x][len(below[x]) - tail:])
        last = None
        if left and right:
            for last in rows(left, right, np.zeros(len(right) + 1, np.int64)):
                pass
        size[x, y] = 1 + ends + (int(last[-1]) if last is not None else 0)
        work.pop()

    def chosen(left: list[int], right: list[int]) -> list[tuple[int, int]]:
        """The pairs of one level, from rows kept at every root-th step and made again between them."""
        step = max(1, int(len(left) ** 0.5))
        kept = [np.zeros(len(right) + 1, np.int64)]
        for k, row in enumerate(rows(left, right, kept[0]), 1):
            if k % step == 0:
                kept.append(row)
        out, j = [], len(right)
        for block in range((len(left) - 1) // step, -1, -1):
            table = [kept[block], *rows(left[block * step:(block + 1) * step], right, kept[block])]
            for i in range(len(table) - 1, 0, -1):
                j = int(np.searchsorted(table[i][:j + 1], table[i][j]))  # the first place with this sum
                if j and table[i][j] > table[i - 1][j]:
                    out.append((block * step + i - 1, j - 1))
                    j -= 1
        return out[::-1]

    pairs, work = [], [(a, b)]
    while work:
        pairs.append(pair := work.pop())
        x, y = pair
        head, left, right = level(shape_a[id(x)], shape_b[id(y)])
        tail = len(x.children) - head - len(left)
        own = list(zip(x.children[:head], y.children[:head], strict=True))
        if left and right:
            own += [(x.children[head + i], y.children[head + j]) for i, j in chosen(left, right)]
        own += zip(x.children[len(x.children) - tail:], y.children[len(y.children) - tail:], strict=True)
        work.extend(reversed(own))
    top = shape_a[id(a)], shape_b[id(b)]
    return weight(*top), pairs


def add(template: Slot, page: Slot) -> None:
    """Merge a skeleton into ``template``: what matches is one place that sums ``held``, the rest stands beside it."""
    work = match(template, page)[1]
    known = {id(y): x for x, y in work}
    while work:
        x, y = work.pop()
        x.held += y.held
        old, x.children = iter(x.children), []
        for c in y.children:
            if (same := known.get(id(c))) is None:
                work.append((x.child(c.kind), c))
            else:
                for other in old:
                    x.children.append(other)
                    if other is same:
                        break
        x.children.extend(old)


def numbered(root: Slot) -> Slot:
    for k, slot in enumerate(root.walk()):
        slot.number = k
    return root


def merged(sources: list[str]) -> Slot:
    """The skeleton of several pages: what matches is one place, what one page has alone stands beside it."""
    template = Slot("#root")
    for source in sources:
        add(template, read_page(source)[0])
    return numbered(template)


def bound(level: int) -> float:
    """Places on a smaller part of the pages are let go by the merges of a level; under PRESENT on every level."""
    return PRESENT * (1 - 0.5 ** level)


def merged_parts(parts: list[tuple[str, list[float] | None, int]], level: int) -> tuple[Slot, list[float], int]:
    """The merged skeleton of packed ones (tree, held, pages), with the pages that can hold each of its places, and all.

    ``held`` are such numbers of the level before, None for one skeleton of all its pages. A part that lacks a place
    may have let it go on less than ``bound(level - 1)`` of its pages, which counts for the place; one that is let go
    here is thus on less than ``bound(level)`` of the pages, and none that PRESENT of them hold is ever lost.
    """
    template, before, total = Slot("#root"), bound(level - 1), sum(n for *_, n in parts)
    for tree, held, n in parts:
        part = unpacked(tree)
        for k, x in enumerate(part.walk()):
            x.held = (n if held is None else held[k]) - before * n
        add(template, part)
    least = (bound(level) - before - 1e-9) * total
    for x in template.walk():
        x.children = [c for c in x.children if c.held >= least]
    return numbered(template), [x.held + before * total for x in template.walk()], total


def packed(template: Slot) -> str:
    """A skeleton as JSON: [number of the parent, kind] of each place in order."""
    return json.dumps([[x.parent.number if x.parent else -1, x.kind] for x in template.walk()])


def unpacked(source: str) -> Slot:
    places = []
    for k, (parent, kind) in enumerate(json.loads(source)):
        places.append(slot := places[parent].child(kind) if k else Slot(kind))
        slot.number = k
    return places[0]


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


class Templates:
    """Skeletons by their packed form, each unpacked once while it is among the last ones used."""

    def __init__(self):
        self.cache: dict = {}

    def get(self, key):
        if key not in self.cache:
            if len(self.cache) >= 256:
                self.cache.clear()
            self.cache[key] = unpacked(key)
        return self.cache[key]


def read_pages(pages: DataFrame) -> DataFrame:
    """(host, mark, k, skeleton, slots, hashes, blocks, n): the different pages of ``pages`` (host, k, mark, html).

    skeleton is packed; slots are its places with a text of their own, hashes those of the texts; blocks has a hash of
    each different block, also within an article; k is the smallest, n the number of rows of the page.
    """

    def run(batches):
        digest = lambda text: xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1
        for piece, rows in texts(batches, "html"):
            out: list[tuple] = []
            for source in rows:
                page, blocks = read_page(source)
                numbered(page)
                own: dict[int, list[str]] = {}
                for slot, text in blocks:
                    if slot.number >= 0:
                        own.setdefault(slot.number, []).append(text)
                out.append((packed(page), list(own), [digest("\n".join(x)) for x in own.values()], sorted({digest(text) for _, text in blocks})))
            kinds = [pa.string(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in ("host", "mark", "k")], *[pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]], ["host", "mark", "k", "skeleton", "slots", "hashes", "blocks"])

    read = map_batches(pages.select("host", "mark", "k", "html"), run, f"host string, mark long, k {pages.schema['k'].dataType.simpleString()}, skeleton string, slots array<long>, hashes array<long>, blocks array<long>")
    return read.groupBy("host", "mark").agg(F.min("k").alias("k"), F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("skeleton", "slots", "hashes", "blocks")])


def in_order(*last):
    """Order of pages: by page_id, null last, then by a hash of the html."""
    return F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), *last)


def hosts_with_template(pages: DataFrame) -> DataFrame:
    """(host) with AGREE pages that are no near copies: the first, the first that is none of it, and so on, of all pages."""
    rest = pages.where("size(blocks) > 0").select("host", in_order("mark").alias("at"), "blocks")
    common = F.size(F.array_intersect("blocks", "first"))
    for _ in range(AGREE - 1):
        first = rest.groupBy("host").agg(F.min_by("blocks", "at").alias("first"))
        rest = rest.join(first, "host").where(common < NEAR * (F.size("blocks") + F.size("first") - common)).drop("first")
        rest = materialize(rest, "html-others")  # a join by itself, so Spark can split a large host
    return rest.select("host").distinct()


def merged_templates(pages: DataFrame) -> DataFrame:
    """(host, template): the skeletons of all ``pages`` (host, k, skeleton, n) of a host merged, MERGED of them at once.

    Every round deals the parts of a host to as few groups as that takes, so a host of any size spreads over tasks.
    """
    parts = pages.groupBy("host", "skeleton").agg(F.min(in_order()).alias("at"), F.sum("n").alias("n"))
    parts = materialize(parts.select("host", F.col("skeleton").alias("tree"), F.lit(None).cast("array<double>").alias("held"), "n", "at"), "html-skeletons")
    level = 0
    while level == 0 or parts.groupBy("host").count().where("count > 1").limit(1).count():
        level += 1

        def merge(batches, level=level):
            for batch in batches:
                out = [merged_parts([(x["tree"], x["held"], x["n"]) for x in rows], level) for rows in batch.column("rows").to_pylist()]
                columns = [batch.column("host"), pa.array([packed(x[0]) for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.float64())), pa.array([x[2] for x in out], pa.int64()), batch.column("at")]
                yield pa.RecordBatch.from_arrays(columns, ["host", "tree", "held", "n", "at"])

        groups = F.ceil(F.col("count") / MERGED)
        dealt = parts.join(parts.groupBy("host").count(), "host").withColumn("bucket", F.pmod(F.xxhash64("tree"), groups)).repartition("host", "bucket")
        rows = dealt.groupBy("host", "bucket").agg(F.sort_array(F.collect_list(F.struct("at", "tree", "held", "n"))).alias("rows"), F.min("at").alias("at"))
        parts = materialize(map_batches(rows.select("host", "rows", "at"), merge, parts.schema), "html-merged")
    return parts.select("host", F.col("tree").alias("template"))


def slot_statistics(pages: DataFrame) -> DataFrame:
    """(host, slot, low, high, n, different): how the ``pages`` of a host (with its template) fill the template's places.

    low and high are the extremes of a hash of the text, so they are equal if all texts are; n counts the pages that
    hold the place, all of them for the root, and different the different ones.
    """

    def run(batches):
        templates, places, kept = Templates(), {}, 0
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, template, skeleton, slots, hashes, n in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "skeleton", "slots", "hashes", "n")), strict=True):
                if (template, skeleton) not in places:
                    page = numbered(unpacked(skeleton))
                    if kept > 200_000:
                        places, kept = {}, 0
                    own = {b.number: a.number for a, b in match(templates.get(template), page)[1]}
                    places[template, skeleton], kept = own, kept + len(own) + 100
                own, texts_of = places[template, skeleton], dict(zip(slots, hashes, strict=True))
                texts_of.setdefault(0, 0)
                for slot, h in texts_of.items():
                    if slot in own:
                        x = sums.setdefault((host, own[slot]), [h, h, 0, 0])
                        x[:] = min(x[0], h), max(x[1], h), x[2] + n, x[3] + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *[pa.array([x[i] for x in sums.values()], pa.int64()) for i in range(4)]], ["host", "slot", "low", "high", "n", "different"])

    rows = map_batches(pages.select("host", "template", "skeleton", "slots", "hashes", "n"), run, "host string, slot long, low long, high long, n long, different long")
    return rows.groupBy("host", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("different").alias("different"))


def constant_places(template: Slot, same: set[int], varying: set[int]) -> list[int]:
    """The places of ``same`` that are template: an element of running text beside a varying one of its kind is not."""
    beside = {(x.parent.number, x.kind) for x in template.walk() if x.number in varying and x.parent}
    return [x.number for x in template.walk() if x.number in same and not (x.parent and x.kind.split()[0] in PASSAGES and (x.parent.number, x.kind) in beside)]


def constant_slots(slots: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, template, constant): the places of each host whose text is template, each decided by itself.

    Such a text is the same wherever it stands, on AGREE different pages and PRESENT of the pages of the host at least.
    """
    agree = (F.col("low") == F.col("high")) & (F.col("different") >= AGREE)
    total = slots.where("slot = 0").select("host", F.col("n").alias("pages"))
    marked = slots.join(total, "host").withColumn("same", agree & (F.col("n") >= PRESENT * F.col("pages")))
    lists = marked.groupBy("host").agg(F.collect_list(F.when(F.col("same"), F.col("slot"))).alias("same"), F.collect_list(F.when(F.col("low") != F.col("high"), F.col("slot"))).alias("varying"))

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("template", "same", "varying")), strict=True)
            found = [constant_places(unpacked(t), set(same), set(varying)) for t, same, varying in rows]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("template"), pa.array(found, pa.list_(pa.int64()))], ["host", "template", "constant"])

    return map_batches(templates.join(lists, "host"), run, "host string, template string, constant array<long>")


def main_text(source: str, template: Slot | None = None, constant: set[int] = frozenset()) -> str:
    """Blocks of a page in page order, one per line, without what its host's template holds as constant."""
    page, blocks = read_page(source)
    fixed = {id(b) for a, b in match(template, page)[1] if a.number in constant} if constant else set()
    return "\n".join(text for slot, text in blocks if id(slot) not in fixed)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    The skeletons of all pages of a host are merged to its template, all its pages are aligned with it by simple tree
    matching; only places that less than PRESENT of the pages hold are let go. Each place is decided by itself: where
    the text never changes it is template, where it varies content, and so is what the template does not know. What an <article> holds is content, but for adverts, comments, forms and asides; outside
    one, elements, names and roles that are never an article (menus, adverts, forms and the like, which vary too) are
    left out. A constant paragraph or item beside varying ones of its kind is a passage that repeats, and stays.

    Defined cases: null and empty html give the empty text; a null or odd url belongs to the host ""; on a host of
    fewer than AGREE pages that are no near copies nothing is template; markup that never closes ends the page, quotes
    that never close are not heeded from there on; repeated rows come out each; ties of page_id: by a hash of
    the html; nesting of any depth; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html")).withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    full = rows.where("length(html) > 0")
    read = materialize(read_pages(full.select("host", F.col("page_id").alias("k"), F.xxhash64("html").alias("mark"), "html")), "html-read")
    hosts = materialize(hosts_with_template(read), "html-hosts")
    known = merged_templates(read.join(hosts, "host", "left_semi"))
    slots = materialize(slot_statistics(read.join(known, "host")), "html-slots")
    wrappers = materialize(constant_slots(slots, known).where("size(constant) > 0"), "html-wrappers")

    def run(batches):
        cache = Templates()
        for piece, own in texts(batches, "html"):
            out = []
            for text, template, constant in zip(own, piece.column("template").to_pylist(), piece.column("constant").to_pylist(), strict=True):
                out.append(main_text(text, template and cache.get(template), set(constant or ())) if text else "")
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_batches(rows.join(wrappers, "host", "left"), run, f"page_id {kind}, url string, text string, n_chars long")
