"""The adapter as DuckDB views, for the SQL that checks the plans."""

from __future__ import annotations

import re

from ..sources.adapter import AS_OF, RANKS

DAY = f"DATE '{AS_OF}'"

VIEWS = {
    "people": "SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS firstname, nullif(split_part(p_name, ' ', 2), '') AS lastname, p_size::BIGINT AS size FROM part",
    "publications": "SELECT o_orderkey AS id, 'Order ' || o_orderpriority || ' ' || o_orderkey AS title, year(o_orderdate)::BIGINT AS year, o_orderdate::DATE AS date, floor(o_totalprice / 1000)::BIGINT AS cited_by, o_custkey AS venue FROM orders",
    "authors": "SELECT publication_id, person_id, pos AS position, pos = 1 AS is_corresponding FROM (SELECT publication_id, person_id, row_number() OVER (PARTITION BY publication_id ORDER BY line, person_id) AS pos FROM (SELECT l_orderkey AS publication_id, l_partkey AS person_id, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2))",
    "organizations": "SELECT (r_regionkey + 1000)::BIGINT AS id, r_name AS name, NULL::VARCHAR AS short_name, 'university' AS kind, false AS is_context_only FROM region UNION ALL SELECT (n_nationkey + 2000)::BIGINT, n_name, substring(n_name, 1, 3), 'department', NULL FROM nation UNION ALL SELECT (s_suppkey + 10000)::BIGINT, s_name, NULL, 'lab', s_suppkey % 11 = 0 FROM supplier",
    "org_links": "SELECT (n_nationkey + 2000)::BIGINT AS child, (n_regionkey + 1000)::BIGINT AS parent, DATE '1995-01-01' AS valid_from, NULL::DATE AS valid_to FROM nation UNION ALL SELECT (s_suppkey + 10000)::BIGINT, (s_nationkey + 2000)::BIGINT, DATE '1995-01-01', CASE WHEN s_suppkey % 7 = 0 THEN DATE '2000-01-01' END FROM supplier",
    "affiliations": "SELECT person_id * 100000 + supp AS id, person_id, supp + 10000 AS org_id, valid_from, CASE WHEN (person_id + supp) % 3 = 0 THEN last END AS valid_to, row_number() OVER (PARTITION BY person_id ORDER BY valid_from DESC, supp) = 1 AS is_primary, [" + ", ".join(f"'{r}'" for r in RANKS) + f"][person_id % {len(RANKS)} + 1] AS position_rank FROM (SELECT l_partkey AS person_id, l_suppkey AS supp, min(l_shipdate)::DATE AS valid_from, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1, 2)",
    "relations": "SELECT p_partkey AS from_id, p_partkey // 10 AS to_id, CASE WHEN p_partkey % 8 = 0 THEN DATE '1996-01-01' END AS valid_from, CASE WHEN p_partkey % 8 = 0 THEN DATE '1999-01-01' END AS valid_to FROM part WHERE p_partkey % 4 = 0 AND p_partkey // 10 <> p_partkey AND p_partkey // 10 >= 1",
    "person_topics": "SELECT person_id, topic, topic % 8 AS field, score FROM (SELECT vec_id AS person_id, unnest(embedding)::DOUBLE AS score, generate_subscripts(embedding, 1) - 1 AS topic FROM embeddings) WHERE score > 0",
    "snapshots": "SELECT page_id AS id, url, sha256(html) AS hash, (DATE '1997-06-01' + page_id::INTEGER)::DATE AS fetched_at, (DATE '1997-06-01' + page_id::INTEGER + 365)::DATE AS expires_at FROM pages",
    "titles": "SELECT doc_id AS id, split_part(text, chr(10), 1) AS title FROM documents",
    "pairs": "SELECT a.person_id AS a, b.person_id AS b, a.publication_id FROM authors a JOIN authors b ON a.publication_id = b.publication_id AND a.person_id < b.person_id",
    "edges": "SELECT a AS person_a, b AS person_b, count(*) AS paper_count, min(year) AS first_year, max(year) AS last_year FROM pairs JOIN publications ON id = publication_id GROUP BY 1, 2",
    "ties": "SELECT person_a AS person_id, person_b AS other_id, paper_count, last_year FROM edges UNION ALL SELECT person_b, person_a, paper_count, last_year FROM edges",
    "anchor": f"SELECT * FROM (SELECT *, coalesce(valid_from <= {DAY}, true) AND coalesce({DAY} < valid_to, true) AS active, row_number() OVER (PARTITION BY person_id ORDER BY (coalesce(valid_from <= {DAY}, true) AND coalesce({DAY} < valid_to, true)) DESC, is_primary DESC, CASE WHEN valid_from = valid_to THEN NULL ELSE valid_to END DESC NULLS FIRST, valid_from DESC NULLS LAST, id DESC) AS rn FROM affiliations) WHERE rn = 1",
    "live_links": f"SELECT child, parent FROM org_links WHERE coalesce(valid_from <= {DAY}, true) AND coalesce({DAY} < valid_to, true)",
    "tree": "SELECT o.id, coalesce(l1.parent, NULL) AS parent_id, CASE WHEN l1.parent IS NULL THEN [o.id] WHEN l2.parent IS NULL THEN [l1.parent, o.id] ELSE [l2.parent, l1.parent, o.id] END AS path FROM organizations o LEFT JOIN live_links l1 ON l1.child = o.id LEFT JOIN live_links l2 ON l2.child = l1.parent",
}


def live(prefix: str = "", day: str = DAY) -> str:
    """The as-of condition."""
    return f"(coalesce({prefix}valid_from <= {day}, true) AND coalesce({day} < {prefix}valid_to, true))"


def oracle(body: str) -> str:
    """``body`` with the views it names, and those they name, as common table expressions."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    add(body)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if own:
        return f"WITH {own[1] or ''}{views}{', ' * bool(views)}{body[own.end():]}"
    return f"WITH {views} {body}" if views else body
