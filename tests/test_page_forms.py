"""Profile pages by hand with the fields that are expected of them."""

from kairograph.operators.page_forms import FORMS, read_profiles

LONG = "She studies markets, firms and the people who work in them, with data of many years."


def test_fields_of_each_form(spark):
    hosts = {f"{k}.example.org": k for k in FORMS}
    pages = [
        (1, "https://columns.example.org/a", f'<div id="x" class="hs-font-lead field-hs-person-title f"><div> Professor </div><div>Director &amp; Chair</div></div><div class="hb-three-column-w-image__main-body z"><div class="body text-with-summary"><p>{LONG}</p><p>More <b>bold</b>.</p></div></div><a href="https://twitter.com/x">website</a><a class="k" href="https://ada.example.com">Lovelace website</a> 0000-0002-1825-0097'),
        (2, "https://columns.example.org/b", f'<meta name="description" content="{LONG}"><div class="text-with-summary">Campus map and other long lines of a footer.</div>'),
        (3, "https://faculty-node.example.org/c", f'<div class="c-node-faculty__endowed-title">The Chair of Things</div><div class="c-node-faculty__jaorhfp-title">Professor</div><div class="bio-content"><div>{LONG}</div></div><a href="https://c.example.com">Personal Website</a>'),
        (4, "https://display-fields.example.org/d", f'<div class="display-position">Lecturer</div><div class="display-homepage"><div class="field_value"><a href="https://d.example.com">d</a></div></div><div class="field--name-field-bio"><div class="field__item">{LONG}</div></div>'),
        (5, "https://posts.example.org/e", f'<section class="post-content"><p class="intro-text"><strong>Professor | <i>Dean</i> | </strong></p><p>Click here for the phone number and a rather long line of other things to read.</p><p>{LONG}</p></section>'),
        (6, "https://posts.example.org/f", None), (7, "https://elsewhere.example.org/g", "<p>x</p>"), (8, None, "<p>x</p>")]
    got = {r["page_id"]: (r["title"], r["biography"], r["site"], r["orcid"]) for r in read_profiles(spark.createDataFrame(pages, "page_id long, url string, html string"), hosts).collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 6}
    assert got[1] == ("Professor · Director & Chair", LONG + "\nMore  bold .", "https://ada.example.com", "0000-0002-1825-0097")
    # a tag becomes a blank, and blanks inside a line stay
    assert got[2] == (None, LONG, None, None)
    assert got[3] == ("The Chair of Things · Professor", LONG, "https://c.example.com", None)
    assert got[4] == ("Lecturer", LONG, "https://d.example.com", None)
    assert got[5] == ("Professor · Dean", LONG, None, None) and got[6] == (None, None, None, None)
