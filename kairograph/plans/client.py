"""Computations of the map view: boxes, focus, order, tie lines and colours."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators.components import ranked
from ..operators.core import coauthor_edges, doubled
from ..operators.pairs import closest_pairs
from ..operators.session import replay
from .graph import ties_on_map
from .registry import query
from .relational import all_links, top_coauthors


def points(t):
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("long").alias("cluster"))


POINTS = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::BIGINT AS cluster FROM embeddings"


@query("c01_bounding_box", f"SELECT cluster, min(x) AS x0, CASE WHEN max(x) > min(x) THEN max(x) ELSE min(x) + 1 END AS x1, min(y) AS y0, CASE WHEN max(y) > min(y) THEN max(y) ELSE min(y) + 1 END AS y1 FROM ({POINTS}) GROUP BY 1")
def c01(t):
    wide = lambda c: F.when(F.max(c) > F.min(c), F.max(c)).otherwise(F.min(c) + 1)
    return points(t).groupBy("cluster").agg(F.min("x").alias("x0"), wide("x").alias("x1"), F.min("y").alias("y0"), wide("y").alias("y1"))


#: The screen, its margin, and the rule for small maps: so many pixels between the nearest points, so much closer at most.
SCREEN = (800, 600)
MARGIN, GAP, FEW, CLOSER = 24, 46, 250, 3

FIT = f"SELECT cluster, count(*) AS n, avg(x) AS mx, avg(y) AS my, (min(x) + CASE WHEN max(x) > min(x) THEN max(x) ELSE min(x) + 1 END) / 2 AS cx, (min(y) + CASE WHEN max(y) > min(y) THEN max(y) ELSE min(y) + 1 END) / 2 AS cy, least({SCREEN[0] - 2 * MARGIN} / CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END, {SCREEN[1] - 2 * MARGIN} / CASE WHEN max(y) > min(y) THEN max(y) - min(y) ELSE 1 END) AS fit FROM ({POINTS}) GROUP BY 1"
CLOSEST = f"SELECT a.cluster, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM ({POINTS}) a JOIN ({POINTS}) b ON a.cluster = b.cluster AND a.id < b.id GROUP BY 1"


@query("c02_fit_scale", f"SELECT cluster, round(s, 4)::DOUBLE AS scale, round(CASE WHEN s > fit THEN {SCREEN[0] / 2} - s * mx ELSE {SCREEN[0] / 2} - s * cx END, 4)::DOUBLE AS tx, round(CASE WHEN s > fit THEN {SCREEN[1] / 2} + s * my ELSE {SCREEN[1] / 2} + s * cy END, 4)::DOUBLE AS ty FROM (SELECT *, CASE WHEN n BETWEEN 2 AND {FEW} AND d > 1e-9 THEN greatest(fit, least({GAP} / d, fit * {CLOSER})) ELSE fit END AS s FROM ({FIT}) LEFT JOIN ({CLOSEST}) USING (cluster))")
def c02(t):
    """The view of each cluster: its box fits the screen; small maps come closer until their nearest points part."""
    p = points(t)
    wide = lambda c: F.when(F.max(c) > F.min(c), F.max(c) - F.min(c)).otherwise(1.0)
    room = [SCREEN[k] - 2 * MARGIN for k in (0, 1)]
    box = p.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), *[(F.min(c) + wide(c) / 2).alias("c" + c) for c in "xy"], F.least(room[0] / wide("x"), room[1] / wide("y")).alias("fit"))
    near = closest_pairs(p.join(box.where(F.col("n") <= FEW), "cluster", "left_semi").select("cluster", "x", "y"))
    rows = box.join(near, "cluster", "left")
    s = F.when(F.col("n").between(2, FEW) & (F.col("d") > 1e-9), F.greatest("fit", F.least(GAP / F.col("d"), F.col("fit") * CLOSER))).otherwise(F.col("fit"))
    rows = rows.withColumn("s", s)
    mid = lambda c: F.col("s") * F.when(F.col("s") > F.col("fit"), F.col("m" + c)).otherwise(F.col("c" + c))
    return rows.select("cluster", F.round("s", 4).alias("scale"), F.round(SCREEN[0] / 2 - mid("x"), 4).alias("tx"), F.round(SCREEN[1] / 2 + mid("y"), 4).alias("ty"))


@query("c03_focus_anchor", f"SELECT cluster, round(avg(x), 6)::DOUBLE AS x, round(avg(y), 6)::DOUBLE AS y FROM ({POINTS}) GROUP BY 1")
def c03(t):
    return points(t).groupBy("cluster").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query("c04_near_radius", f"SELECT p.id, greatest(0.25, least(0.8, 0.55 * (1 + coalesce(n, 0) / 40.0)))::DOUBLE AS radius FROM ({POINTS}) p LEFT JOIN (SELECT person_id, count(*) AS n FROM ties GROUP BY 1) ON person_id = p.id")
def c04(t):
    n = doubled(coauthor_edges(t)).groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n"))
    return points(t).select("id").join(n, "id", "left").select("id", F.round(F.greatest(F.lit(0.25), F.least(F.lit(0.8), 0.55 * (1 + F.coalesce("n", F.lit(0)) / 40))), 9).alias("radius"))


@query("c05_drawing_order", f"SELECT id, row_number() OVER (PARTITION BY cluster ORDER BY (abs(x) < 0.05), id) AS place FROM ({POINTS})")
def c05(t):
    return points(t).select("id", F.row_number().over(W.partitionBy("cluster").orderBy(F.abs("x") < 0.05, "id")).cast("long").alias("place"))


@query("c06_tie_lines", f"SELECT person_a, person_b, paper_count, a.x AS x0, b.x AS x1 FROM edges JOIN ({POINTS}) a ON a.id = person_a JOIN ({POINTS}) b ON b.id = person_b")
def c06(t):
    at = lambda k, x: points(t).select(F.col("id").alias(k), F.col("x").alias(x))
    return ties_on_map(t).join(at("person_a", "x0"), "person_a").join(at("person_b", "x1"), "person_b").select("person_a", "person_b", "paper_count", "x0", "x1")


@query("c07_brand_colour")
def c07(t):
    exact = F.when(F.col("name") == "EUROPE", "#003399").when(F.lower("name").rlike("america"), "#b22234")
    return t.organizations.select("id", F.coalesce(exact, F.concat(F.lit("slot"), X.palette_slot(F.col("name"), 12).cast("string"))).alias("colour"))


SAG = 0.08
ENDS = f"SELECT person_a, person_b, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM edges JOIN ({POINTS}) a ON a.id = person_a JOIN ({POINTS}) b ON b.id = person_b"


@query("c08_curved_path", f"SELECT person_a, person_b, round(x0, 4)::DOUBLE AS x0, round(y0, 4)::DOUBLE AS y0, round(CASE WHEN len > 0 THEN (x0 + x1) / 2 - (y1 - y0) / len * {SAG}::DOUBLE END, 4)::DOUBLE AS qx, round(CASE WHEN len > 0 THEN (y0 + y1) / 2 + (x1 - x0) / len * {SAG}::DOUBLE END, 4)::DOUBLE AS qy, round(x1, 4)::DOUBLE AS x1, round(y1, 4)::DOUBLE AS y1 FROM ({ENDS})")
def c08(t):
    """Each tie as a curve: its ends and the point that bends it, set off the middle to one side; none for ends of one place."""
    at = lambda k, n: points(t).select(F.col("id").alias(k), F.col("x").alias("x" + n), F.col("y").alias("y" + n))
    rows = ties_on_map(t).join(at("person_a", "0"), "person_a").join(at("person_b", "1"), "person_b")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(dx**2 + dy**2)
    bent = lambda mid, off: F.when(length > 0, mid / 2 + off / length * SAG)
    rows = rows.withColumns({"qx": bent(F.col("x0") + F.col("x1"), -dy), "qy": bent(F.col("y0") + F.col("y1"), dx)})
    return rows.select("person_a", "person_b", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "qx", "qy", "x1", "y1")])


@query("c09_option_order", "SELECT id, row_number() OVER (ORDER BY k, label, id) AS place FROM (SELECT id, 0 AS k, name AS label FROM organizations UNION ALL SELECT -id, 1, lastname || ' ' || firstname FROM people)")
def c09(t):
    rows = t.organizations.select("id", F.lit(0).alias("k"), F.col("name").alias("label")).union(t.people.select(-F.col("id"), F.lit(1), F.concat_ws(" ", "lastname", "firstname")))
    return ranked(rows, [F.asc("k"), F.asc("label"), F.asc("id")]).select("id", "place")


@query("c13_name_backfill", "SELECT id, w[1] AS firstname, CASE WHEN len(w) > 1 THEN w[len(w)] ELSE w[1] END AS lastname FROM (SELECT p_partkey AS id, string_split(trim(p_name), ' ') AS w FROM part)")
def c13(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), X.name_parts(F.col("p_name")).alias("n")).select("id", F.col("n.first").alias("firstname"), F.col("n.last").alias("lastname"))


def session_actions(t):
    """Events as the actions of graph sessions: a visitor is a session, what an event is about stands in its props."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 24
    own = F.when(F.col("event_type") == "view", F.when(k % 3 == 0, "expand").otherwise("merge")).when(F.col("event_type") == "click", F.when(k % 4 == 0, "select").otherwise("focus"))
    own = own.when(F.col("event_type") == "purchase", F.when(k % 2 == 0, "page").otherwise("open")).when(F.col("event_type") == "error", F.when(k % 2 == 0, "prune").otherwise("collapse"))
    others = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (k * i + F.col("event_id")) % 24)
    return t.raw("events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.coalesce(own, F.lit("expand")).alias("action"),
        k.alias("node"), others.alias("others"), F.concat(F.lit("c"), k % 2).alias("cohort"), (k % 3).cast("int").alias("place"))


@query("x04_session_canvas")
def x04(t):
    """What each visitor's graph shows in the end: the actions folded in order, one task for each session."""
    return replay(session_actions(t), idle_s=7 * 86_400)
