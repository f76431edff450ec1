"""Hand-sized fixtures for what the star schema cannot show."""

import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kairograph.functions import text as X
from kairograph.operators import layout
from kairograph.operators.components import connected_components, reachable
from kairograph.operators.core import valid_on
from kairograph.plans.oracle import VIEWS, oracle
from kairograph.plans.scalars import MASK


def test_range_edges(spark):
    d = datetime.date
    rows = [("start", d(2000, 1, 1), d(2000, 2, 1)), ("last", d(1999, 1, 1), d(2000, 1, 2)), ("end", d(1999, 1, 1), d(2000, 1, 1)), ("open", None, None), ("empty", d(2000, 1, 1), d(2000, 1, 1))]
    df = spark.createDataFrame(rows, "k string, valid_from date, valid_to date")
    assert {r[0] for r in df.where(valid_on(F.lit("2000-01-01").cast("date"))).collect()} == {"start", "last", "open"}


def test_components_and_distances(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (9, 9)], "src long, dst long")
    assert dict(connected_components(links).collect()) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    assert dict(reachable(spark.range(1, 2), chain).collect()) == {1: 0, 2: 1, 3: 2, 4: 3}


def test_text_functions(spark):
    row = spark.range(1).select(
        X.full_name(F.lit(""), F.lit("")).alias("none"), X.name_parts(F.lit(" Ada  Mary de Luz ")).alias("n"), X.name_parts(F.lit("Plato")).alias("one"),
        X.is_junk_title(F.lit("readme.txt")).alias("junk"), X.is_junk_title(F.lit("A theory of fine things")).alias("fine"),
        X.titles_equivalent(F.lit("a very long title that goes on and on"), F.lit("a very long title that goes on and on further")).alias("prefix"), X.titles_equivalent(F.lit("short"), F.lit("shorter")).alias("short"),
        X.position_rank(F.lit("Assistant Professor of Physics")).alias("r1"), X.position_rank(F.lit("Professor emeritus")).alias("r2"), X.position_rank(F.lit("gardener")).alias("r3"),
        X.canonical_orcid(F.lit("see 0000-0002-1825-0097.")).alias("good"), X.canonical_orcid(F.lit("0000-0002-1825-0098")).alias("bad"), X.canonical_orcid(F.lit("0000-0002-1694-233x")).alias("x"),
        X.redact_contacts(F.lit("mail a.b@c.org or +1 (555) 123-4567")).alias("pii"), X.strip_tags(F.lit("<p>a&nbsp;b</p>\n\n<b>c</b> ")).alias("tags"), X.trigrams(F.lit("Cat")).alias("grams")).first()
    assert row["none"] == "(unnamed)" and tuple(row["n"]) == ("Ada", "Mary de", "Luz") and tuple(row["one"]) == ("Plato", None, "Plato")
    assert row["junk"] and not row["fine"] and row["prefix"] and not row["short"]
    assert (row["r1"], row["r2"], row["r3"]) == ("assistant_professor", "emeritus_professor", None)
    assert (row["good"], row["bad"], row["x"]) == ("0000-0002-1825-0097", None, "0000-0002-1694-233X")
    assert row["pii"] == "mail [redacted] or [redacted]" and row["tags"] == "a b\nc" and row["grams"] == ["  c", " ca", "cat", "at "]


def test_id_codec(spark):
    rows = spark.createDataFrame([(0,), (1,), (2**63 - 1,), (42,)], "id long").select("id", X.encode_id("p", F.col("id"), MASK).alias("t")).withColumn("back", X.decode_id(F.col("t"), MASK)).collect()
    assert all(r["id"] == r["back"] for r in rows) and len({r["t"] for r in rows}) == 4
    odd = spark.createDataFrame([("p:100",), ("p:%%",), ("",)], "t string").select(X.decode_id(F.col("t"), MASK)).collect()
    assert [r[0] for r in odd] == [100, None, None]


def test_palette_slot_is_the_string_hash(spark):
    def slot(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return abs(h) % 12

    names = ["", "a", "University of Somewhere Else", "zz" * 40]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(X.palette_slot(F.col("n"), 12)).collect()
    assert [r[0] for r in got] == [slot(n) for n in names]


def test_two_cliques_make_two_communities():
    a, b = np.array([0, 0, 1, 3, 3, 4, 2]), np.array([1, 2, 2, 4, 5, 5, 3])
    labels = layout.modularity_communities(6, a, b, np.array([1, 1, 1, 1, 1, 1, 0.1]))
    assert len(set(labels[:3])) == len(set(labels[3:])) == 1 and labels[0] != labels[3]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=30))
def test_hull_holds_all_points(points):
    p = np.array(points, float)
    hull = layout.convex_hull(p)
    if len(hull) >= 3:
        edge = np.roll(hull, -1, axis=0) - hull
        cross = edge[:, None, 0] * (p[None, :, 1] - hull[:, None, 1]) - edge[:, None, 1] * (p[None, :, 0] - hull[:, None, 0])
        assert (cross >= -1e-9).all()


def test_layouts():
    assert len(layout.convex_hull(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]]))) == 4
    d = np.array([[0, 3, 4], [3, 0, 5], [4, 5, 0]], float)
    xy = layout.classical_mds(d)
    assert np.allclose(np.sqrt(((xy[:, None] - xy[None, :]) ** 2).sum(-1)), d)


def test_oracle_names_its_views():
    assert oracle("SELECT * FROM edges").count(" AS (") == 4 and oracle("SELECT 1") == "SELECT 1" and "edges" in VIEWS


def test_profiles_count_in_all_components(spark, tmp_path):
    """Zeros before every vector change neither topic clusters nor map positions; fields of up to 60 stay whole."""
    from pathlib import Path

    from kairograph.plans.registry import QUERIES

    sf = Path("/root/testdata/sf0.01")
    for f in sf.iterdir():
        if f.name != "embeddings.parquet":
            (tmp_path / f.name).symlink_to(f)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    kind = vectors.schema["embedding"].dataType
    zeros = F.array_repeat(F.lit(0.0), 8).cast(kind)
    vectors.withColumn("embedding", F.concat(zeros, "embedding").cast(kind)).write.parquet(str(tmp_path / "embeddings.parquet"))
    parts = [{r["person_id"]: (r["field"], r["part"]) for r in QUERIES["n10_topic_clusters"](spark, d).collect()} for d in (str(sf), str(tmp_path))]
    assert parts[0] == parts[1]
    sizes = {}
    for field, part in parts[0].values():
        sizes.setdefault(field, []).append(part)
    assert all((len(set(p)) > 1) == (len(p) > max(20, round(len(parts[0]) / 40))) for p in sizes.values())
    at = [{r["cluster"]: (abs(r["x"]), abs(r["y"])) for r in QUERIES["n08_classical_mds"](spark, d).collect()} for d in (str(sf), str(tmp_path))]
    assert at[0].keys() == at[1].keys() and all(np.allclose(at[0][k], at[1][k], atol=1e-6) for k in at[0])
    assert len({tuple(np.round(v, 9)) for v in at[1].values()}) > 1
