import base64
import hashlib
import html
import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from kairograph.llm import html_extract, queries, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body><header><h2>Site {0}</h2></header><div class="cookie-notice">We use cookies</div>
<nav><ul><li><a href=/a>Home {0}</a></li><li>About</li></ul></nav><div class=ad>Buy {0}</div><div id="wrap"><article><header><h1>Title {0} &amp; more</h1></header><p>First   <b>bold</b> text&nbsp;{0}.<p>Same passage everywhere.
<ul><li>one {0}<li>two</ul><form><input>Sign up</form><aside>Side</aside><pre>a  b
c {0}</pre><div class="comments"><p>reader says</p></div></article></div><footer>&copy; site</footer></body></html>"""


def text_of(k):
    return f"Title {k} & more\nFirst bold text {k}.\nSame passage everywhere.\none {k}\ntwo\na b c {k}"


def test_extraction(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE.format(k), 0) for k in range(8)] + [(20, "http://alone.example/", PAGE.format(20), 0), (21, None, PAGE.format(21), 0)]
    rows += [(30, "http://h0.example/x", None, 0), (31, "http://h0.example/x", "", 0), (32, "http://h0.example/y", "<p>odd <b>page</p", 0), (None, "http://h0.example/z", PAGE.format(9), 0), (4, "http://h0.example/4", PAGE.format(4), 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.extract_main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for k in [*range(8), 20, 21]:
        assert by[k]["text"] == text_of(k) and by[k]["n_chars"] == len(text_of(k))
    assert by[30]["text"] == by[31]["text"] == "" and by[32]["text"] == "odd page" and by[None]["text"] == text_of(9)
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


PLAIN = """<html><body><div class="top"><span>Site of the day</span></div><h1>Head {0}</h1><div class="content has-sidebar"><div class="c2"><h2>Part {0}</h2><p>{0} text {0} which differs</p><p>Every page says this.</p><ul><li>item {0}</ul></div></div>
<div class="box4">All rights by the publisher</div><div class="sidebar-left">Side {0}</div></body></html>"""


def plain_text(k):
    return f"Head {k}\nPart {k}\n{k} text {k} which differs\nEvery page says this.\nitem {k}"


def test_the_wrapper_decides_on_pages_without_article(spark):
    """Constant blocks go only by the template of the host; the headline beside the story stays; an odd page spoils nothing."""
    rows = [(0, "http://p/0", "<table><tr><td>odd first page</table>")] + [(k, f"http://p/{k}", PLAIN.format(f"x{k}y")) for k in range(1, 9)] + [(50, "http://single/", PLAIN.format("z"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(1, 9):
        assert got[k] == plain_text(f"x{k}y")
        assert html_extract.main_text(rows[k][2]) == f"Site of the day\n{got[k]}\nAll rights by the publisher"
    assert got[0] == "odd first page" and got[50] == html_extract.main_text(PLAIN.format("z"))


def test_copies_make_no_template(spark):
    rows = [(k, f"http://p/{k}", PLAIN.format(k // 6)) for k in range(12)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {html_extract.main_text(PLAIN.format(k)) for k in (0, 1)}


def trees(rng, depth=0):
    return ("t", [(k, trees(rng, depth + 1)[1]) for k in rng.sample("abcd", rng.randint(0, 3 if depth < 3 else 0))])


def slots_of(tree):
    root = html_extract.Slot(tree[0])
    work = [(root, tree[1])]
    while work:
        slot, children = work.pop()
        work += [(slot.child(kind), own) for kind, own in children]
    return root


def simple_tree_matching(a, b):
    """The textbook recursion."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + simple_tree_matching(x, y))
    return best[-1][-1] + 1


def test_matching_equals_the_textbook():
    rng = random.Random(5)
    for _ in range(400):
        a, b = trees(rng), trees(rng)
        size, pairs = html_extract.match(slots_of(a), slots_of(b))
        assert size == len(pairs) == simple_tree_matching(a, b) and all(x.kind == y.kind for x, y in pairs)


def test_skeletons_merge_and_travel():
    one, two = "<div class=a><p>x</p></div><div class=b>y</div>", "<div class=a><ul><li>x</ul></div><div class=c>y</div><div class=b>z</div>"
    both = html_extract.merged([one, two])
    assert [x.kind for x in both.walk()] == ["#root", "div a", "ul", "li", "p", "div c", "div b"]
    assert html_extract.packed(html_extract.unpacked(html_extract.packed(both))) == html_extract.packed(both)


@pytest.mark.parametrize("name,outside", [("sidebar", True), ("sidebar-left", True), ("has-sidebar", False), ("content", False), ("comment-list2", True), ("cookie-notice", True), ("shadow", False), ("no-ads-please", False)])
def test_whole_names_decide(name, outside):
    assert html_extract.names_outside(name) == outside


def test_long_and_broken_pages():
    for source in ("<p>" * 3000 + "x", "<div>" * 900 + "deep", "<a href='unclosed>text", "<!-- never closed", "< not a tag >", "</p></div>end", "<script>only"):
        assert isinstance(html_extract.main_text(source, html_extract.merged([source]), {0}), str)


@pytest.mark.parametrize("depth", [10, 210, 5000])
def test_nesting_changes_nothing(depth):
    source = "<div>" * depth + "<nav>MENU</nav><p>story</p>" + "</div>" * depth
    assert html_extract.main_text(source) == "story"
    template = html_extract.merged([source])
    assert len(template.walk()) == depth + 2 and html_extract.main_text(source, template, {depth + 1}) == ""


def test_very_long_page(spark):
    """40,000 blocks of which every kind differs; time stays near linear."""
    body = "".join(f"<div class='k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}'>line {k}</div>" for k in range(17_000)) * 2
    pages = spark.createDataFrame([(k, "http://l/", f"<div class=h>Head</div><p>page {k}</p>{body}") for k in range(3)], "page_id long, url string, html string")
    for r in html_extract.extract_main_text(pages).collect():
        assert len(r["text"].split("\n")) == 34_002 and r["text"].startswith("Head")


def article_of(source):
    """An extractor of its own for pages whose article holds nothing but blocks and inline marks."""
    inner = source.partition("<article>")[2].partition("</article>")[0]
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|pre|table|tr|td|section)\b[^>]*>", inner)
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts) if t)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_an_independent_extractor(spark, folder):
    sf_dir = f"/root/testdata/{folder}"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op5_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article_of(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def reference(rows):
    top = {}
    data = {k: (h or "").encode() for k, _, h in rows}
    for k, b in data.items():
        top[b] = max(top.get(b, k), k)
    return {k: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top[b] == k else "revisit", None if top[b] == k else top[b]) for k, b in data.items()}


def test_warc_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert {r["page_id"]: tuple(r)[1:] for r in queries.op6_warc(spark, sf_dir).collect()} == reference(rows)


@pytest.fixture
def odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "http://a/\r\nX: y é", "", "x"), (3, "u", "same \r\n\r\n WARC/1.1", "x"), (4, "u", "same \r\n\r\n WARC/1.1", "x"), (5, "u", "é" * 200_000, "x"), (6, "u", "same \r\n\r\n WARC/1.1", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_warc_edge_cases(spark, odd_pages):
    want = reference([tuple(r)[:3] for r in odd_pages.collect()])
    assert {r["page_id"]: tuple(r)[1:] for r in warc.archived_pages(odd_pages).collect()} == want
    assert warc.archived_pages(odd_pages.limit(0)).count() == 0
    assert warc.archived_pages(odd_pages, least=10).where("page_id = 1 AND record_type = 'response'").count() == 1
    again = odd_pages.where("page_id = 6").union(odd_pages.where("page_id = 6"))
    assert [r["record_type"] for r in warc.archived_pages(again).collect()] == ["response"] * 2


def test_warc_predicates_and_payloads(spark, odd_pages):
    warc.register(spark)
    back = warc.archive(odd_pages)
    full = {r["record_id"]: r["payload"] for r in back.where("warc_type = 'response'").collect()}
    assert full["urn:page:5"].decode() == "é" * 200_000 and len(full) == 3
    plan = back.where("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert back.where(F.col("record_id").isin("urn:page:3", "urn:page:4")).count() == 2
    reader = warc.WarcReader({"path": "/nowhere", "payload": "false"})
    assert list(reader.pushFilters([])) == []


def test_warc_digests_and_big_payloads(tmp_path):
    """A payload of 30 MB is read in time that grows with its length; headers alone leave it undecoded."""
    body = bytes(range(256)) * 120_000
    row = {"warc_type": "response", "record_id": "urn:x", "warc_date": None, "target_uri": "u", "refers_to": None, "payload": body, "payload_bytes": len(body), "payload_digest": warc.bare_digest(body)}
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(warc.record_bytes(row), 1) * 2)
    reader = warc.WarcReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 2 and all(r["payload"] == body for r in rows)


def test_warc_leaves_no_folders_of_jobs(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "v", "x"), (3, "w", "y")], "page_id long, url string, html string")
    assert warc.archive(pages, f"file://{tmp_path}/w").count() == 3
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_") and p.is_dir()]
    writer = warc.WarcWriter({"path": f"file://{tmp_path}/v"})
    (tmp_path / "v" / f"_{writer.job}").mkdir(parents=True)
    writer.abort([None])
    assert list((tmp_path / "v").iterdir()) == []


def test_warc_reads_members_without_lengths(tmp_path):
    import gzip

    row = {"warc_type": "response", "record_id": "urn:x", "warc_date": None, "target_uri": "u", "refers_to": None, "payload": b"body" * 50_000, "payload_bytes": 200_000, "payload_digest": warc.bare_digest(b"body" * 50_000)}
    data = warc.record_bytes(row)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data) * 3)
    (tmp_path / "b.warc").write_bytes(data * 2)
    reader = warc.WarcReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 5 and all(r["payload"] == row["payload"] for r in rows)
    reader.wanted = {"warc_type": {"revisit"}}
    assert [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == []


def extract(spark, sources):
    rows = [(k, f"http://h/{k}", source) for k, source in enumerate(sources)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_each_place_is_decided_by_itself(spark):
    """A constant block goes beside varying ones of its tag and however long it is; pages change by the template."""
    same_tag = [f"<body><div>story {k} of the day</div><div><p>All rights reserved.</p></div></body>" for k in range(6)]
    assert extract(spark, same_tag) == [f"story {k} of the day" for k in range(6)]
    long = [f"<body><h1>Head {k}</h1><div>short {k}</div><section>{'Terms of this site. ' * 23}</section></body>" for k in range(6)]
    assert extract(spark, long) == [f"Head {k}\nshort {k}" for k in range(6)]
    assert sum(html_extract.main_text(x) != y for x, y in zip(same_tag + long, extract(spark, same_tag) + extract(spark, long), strict=True)) == 12


def test_a_place_of_few_pages_is_content(spark):
    """Four near copies with a longer story on a host of twelve pages: their last block is no template."""
    story = [f"<body><div>a{k} b</div><div>c{k} d</div><div class=end>Imprint</div></body>" for k in range(8)]
    story += [f"<body><div>x</div><div>y</div><div>z</div><div><p>only here</p></div><div class=end>Imprint</div><div>{k}</div></body>" for k in range(4)]
    got = extract(spark, story)
    assert all("only here" in t for t in got[8:]) and not any("Imprint" in t for t in got)


def test_near_copies_are_one_page(spark):
    pages = [f"<body><div>{'</div><div>'.join(f'part {k}' for k in range(40))}</div><p>version {v}</p></body>" for v in range(5)]
    assert extract(spark, pages) == [html_extract.main_text(p) for p in pages]


def test_inside_an_article(spark):
    inner = '<h2 id="related">Related work {0}</h2><section id="sharing2"><p>On sharing</p></section><div class="search">search {0}</div><p><label>Note</label> <math><mi>x</mi></math></p><p>Fixed.</p>'
    page = '<body><div>Shop</div><article><h1 id="comment">Title {0}</h1>' + inner + '<div class="comments">said</div><div class="ad">buy</div><form>f</form></article><article class="comment"><p>reader {0}</p></article></body>'
    pages = [page.format(k) for k in range(6)]
    assert extract(spark, pages) == [f"Title {k}\nRelated work {k}\nOn sharing\nsearch {k}\nNote x\nFixed." for k in range(6)]


def test_matching_of_repeated_kinds_equals_the_textbook():
    rng = random.Random(11)

    def tree(depth=0):
        return ("t" if depth == 0 else rng.choice("ab"), [tree(depth + 1) for _ in range(rng.randint(0, 5 if depth < 3 else 0))])

    for _ in range(300):
        a, b = tree(), tree()
        size, pairs = html_extract.match(slots_of(a), slots_of(b))
        assert size == len(pairs) == simple_tree_matching(a, b) and all(x.kind == y.kind for x, y in pairs)
        place = {id(x): k for k, (x, _) in enumerate(pairs)}
        assert all(x.parent is None or pairs[place[id(x.parent)]][1] is y.parent for x, y in pairs)
        for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False):
            if x.parent is u.parent:
                assert x.parent.children.index(x) < x.parent.children.index(u) and y.parent.children.index(y) < y.parent.children.index(v)


@pytest.mark.parametrize("opener", ["<!", "<?", "<!--", "<a '>' ", "<a \"", "<b x='\">", "</", "<script>", "<p ", "&", "<"])
def test_openers_that_never_close_take_linear_time(opener):
    begun = time.perf_counter()
    html_extract.main_text("<p>story</p>" + opener * (1_000_000 // len(opener)))
    assert time.perf_counter() - begun < 20


def test_all_pages_of_a_host_make_its_template(spark):
    """A host that begins with near copies, or with pages that lack a block of its template, has one all the same."""
    copies = [f"<body><div>{'</div><div>'.join(f'part {k}' for k in range(40))}</div><p>version {v}</p></body>" for v in range(13)]
    pages = [f"<body><div>story {k}</div><section>Terms of use</section></body>" for k in range(60)]
    assert extract(spark, copies + pages)[13:] == [f"story {k}" for k in range(60)]
    early = [f"<body><h1>Head {k}</h1><div>short {k}</div></body>" for k in range(3)]
    late = [f"<body><h1>Head {k}</h1><div>short {k}</div><section>Terms of use</section></body>" for k in range(3, 15)]
    assert extract(spark, early + late) == [f"Head {k}\nshort {k}" for k in range(15)]


def test_three_different_pages_are_enough(spark):
    """Also if their hashes fall into one class of 63: different pages are counted exactly."""
    every = (f"<body><div>story {k}</div><section>Terms of use</section></body>" for k in range(1000))
    pages = [x for x in every if xxhash.xxh64_intdigest(x) % 63 == 7][:3]
    assert all("Terms" not in t for t in extract(spark, pages))


def test_merges_in_rounds_lose_no_place_and_stay_small(spark):
    """Every page has kinds of its own between those of the template; three quarters of the pages hold the last block."""
    letters = lambda k: "".join(chr(97 + k // 26 ** i % 26) for i in range(3))
    pages = [f"<body><h1>Head {k}</h1><div class=x{letters(k)}>own {k}</div><p>text {k}</p>" + "<section>Terms of use</section>" * (k % 4 > 0) + "</body>" for k in range(1200)]
    got = extract(spark, pages)
    assert got == [f"Head {k}\nown {k}\ntext {k}" for k in range(1200)]
    rows = spark.createDataFrame([("h", k, html_extract.packed(html_extract.numbered(html_extract.read_page(p)[0])), 1) for k, p in enumerate(pages)], "host string, k long, skeleton string, n long")
    (found,) = html_extract.merged_templates(rows).collect()
    kinds = [x.kind for x in html_extract.unpacked(found["template"]).walk()]
    assert kinds == ["#root", "body", "h1", "p", "section"]
