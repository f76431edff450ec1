"""Integrity checks as queries that return what is wrong, or how much of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.limiter import limit_table
from .registry import query
from .relational import evidence

#: child table, its key, parent table, its key
REFERENCES = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
              ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
              ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"))


@query("o_v01_orphans", " UNION ALL ".join(f"SELECT '{c}.{k}' AS reference, count(*) AS orphans FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {q} FROM {p} WHERE {q} IS NOT NULL)" for c, k, p, q in REFERENCES))
def v01(t):
    def orphans(child, key, parent, other):
        rows = t.raw(child).select(F.col(key).alias("k")).where("k IS NOT NULL").join(t.raw(parent).select(F.col(other).alias("k")), "k", "left_anti")
        return rows.agg(F.count("*").alias("orphans")).select(F.lit(f"{child}.{key}").alias("reference"), "orphans")

    return reduce(DataFrame.union, [orphans(*r) for r in REFERENCES])


@query("o_v02_shape_checks", "SELECT 'finite' AS rule, count(*) AS bad FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 UNION ALL SELECT 'scheme', count(*) FROM pages WHERE NOT regexp_matches(url, '^https?://') UNION ALL SELECT 'expiry', count(*) FROM snapshots WHERE expires_at <= fetched_at")
def v02(t):
    count = lambda df, name: df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("rule"), "bad")
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return count(t.raw("embeddings").where(odd), "finite").union(count(t.raw("pages").where(~F.col("url").rlike("^https?://")), "scheme")).union(count(t.snapshots.where("expires_at <= fetched_at"), "expiry"))


@query("o_v03_overlapping_ranges", "SELECT DISTINCT id FROM (SELECT id, valid_from, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY org_id ORDER BY valid_from, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM affiliations WHERE valid_to IS NULL OR valid_from < valid_to) WHERE before > valid_from")
def v03(t):
    """Ranges of one key that overlap an earlier one, by the running maximum of ends; empty ranges never overlap."""
    before = W.partitionBy("org_id").orderBy("valid_from", "id").rowsBetween(W.unboundedPreceding, -1)
    rows = t.affiliations.where("valid_to IS NULL OR valid_from < valid_to").withColumn("before", F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))).over(before))
    return rows.where("before > valid_from").select("id")


@query("o_v03_primary_overlap", "SELECT person_id, count(*) AS n FROM affiliations WHERE is_primary GROUP BY 1 HAVING count(*) > 1")
def v03b(t):
    return t.affiliations.where("is_primary").groupBy("person_id").agg(F.count("*").alias("n")).where("n > 1")


@query("o_v04_row_checks", "SELECT page_id, regexp_matches(url, '^https?://') AS scheme_ok, length(html) > 0 AS body_ok, page_id >= 0 AS id_ok FROM pages")
def v04(t):
    return t.raw("pages").select("page_id", F.col("url").rlike("^https?://").alias("scheme_ok"), (F.length("html") > 0).alias("body_ok"), (F.col("page_id") >= 0).alias("id_ok"))


@query("o_v05_duplicate_keys", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v05(t):
    return t.raw("lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.count("*").alias("n")).where("n > 1")


LIMIT, WINDOW = 1, 60_000_000
FOLD = f"WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS stamp, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events), f AS (SELECT event_id, event_type, k, true AS allowed, [stamp] AS kept FROM e WHERE k = 1 UNION ALL SELECT event_id, event_type, k, len(old) < {LIMIT}, CASE WHEN len(old) < {LIMIT} THEN list_append(old, stamp) ELSE old END FROM (SELECT e.*, list_filter(f.kept, lambda s: s > e.stamp - {WINDOW}) AS old FROM f JOIN e ON e.event_type = f.event_type AND e.k = f.k + 1))"


@query("x01_rate_limit_window", f"{FOLD} SELECT event_id, allowed FROM f")
def x01(t):
    """Whether each event passes a limit of one a minute for its type; what is denied does not count."""
    rows = t.raw("events").select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return limit_table(rows, LIMIT, WINDOW).select(F.col("id").alias("event_id"), "allowed")


#: A made-up forwarding chain for each event: the table has none.
CHAIN = ["203.0.113.7", "2001:db8::{n}", "999.1.1.{n}", "10.0.0.{n}", "fe80:::1", "unknown", "::ffff:10.1.2.{n}", "1.2.3"]
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FOUR = rf"{OCTET}(\.{OCTET}){{3}}"
GROUP = "[0-9a-fA-F]{1,4}"
#: An address of eight groups, or of at most seven around one double colon, the last two of which may be four octets.
SIX = rf"(({GROUP}:){{7}}{GROUP}|({GROUP}:){{6}}{FOUR}|(?=[^:]*(:[^:]+)*::)(?!.*::.*::)(?!(:*+[0-9a-fA-F]++){{8}})({GROUP}(:{GROUP}){{0,6}})?::(({GROUP}:){{0,5}}{FOUR}|{GROUP}(:{GROUP}){{0,6}})?)"


def last_address(chain):
    """The last valid IPv4 or IPv6 address of a comma-separated chain, null without one."""
    found = F.filter(F.transform(F.split(chain, ","), lambda a: F.trim(a)), lambda a: a.rlike(f"^({FOUR}|{SIX})$"))
    return F.try_element_at(found, F.lit(-1))


@query("c10_client_address")
def c10(t):
    """The last valid address of a forwarding chain of one to eight entries."""
    n = (F.col("user_id") % 256).cast("string")
    entries = F.array(*[F.replace(F.lit(c), F.lit("{n}"), n) for c in CHAIN])
    chain = F.array_join(F.slice(entries, 1, (F.col("event_id") % len(CHAIN) + 1).cast("int")), ", ")
    return t.raw("events").select("event_id", last_address(chain).alias("address"))


@query("c11_audit_hash", "SELECT event_id, substring(sha256(user_id || ''), 1, 12) AS hash FROM events")
def c11(t):
    return t.raw("events").select("event_id", F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 12).alias("hash"))
