"""DuckDB SQL for the corpus queries that SQL can state over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
freq AS (SELECT t, count(*) AS often FROM (SELECT unnest(w) AS t FROM d) GROUP BY 1),
parts AS (SELECT *, string_split(g, ' ') AS ts FROM (SELECT DISTINCT n, g FROM win)),
rare AS (SELECT n, g, ts, arg_min(k, (often, k)) AS k, arg_min(t, (often, k)) AS t FROM (SELECT n, g, ts, unnest(ts) AS t, unnest(range(0, n)) AS k FROM parts) JOIN freq USING (t) GROUP BY n, g, ts HAVING count(*) = n),
places AS (SELECT doc_id, w, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
close AS (SELECT DISTINCT doc_id, n, g FROM (SELECT doc_id, w, n, g, ts, p - k + unnest(range(-2, 3)) AS s FROM places JOIN rare USING (t))
          WHERE len(list_filter(range(0, n), lambda k: list_contains(w[greatest(1, s + k - 2):greatest(0, s + k + 2)], ts[k + 1]))) = n),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM close JOIN win USING (n, g) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
walk AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT walk.vec_id, l.b FROM walk JOIN l ON l.a = walk.r),
c AS (SELECT vec_id, min(r) AS component_id FROM walk GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id"""

_BITS = "from_hex(sha1(coalesce(html, '')))::BIT::VARCHAR"
_BASE32 = "array_to_string([substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[i]::INTEGER + 8 * bits[i + 1]::INTEGER + 4 * bits[i + 2]::INTEGER + 2 * bits[i + 3]::INTEGER + bits[i + 4]::INTEGER, 1) FOR i IN range(1, 160, 5)], '')"

OP6 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {_BITS} AS bits, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p"""

_VALUE = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _VALUE + ")"
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {_LEAF.format('text')} AS leaf,
    {_LEAF.format(f"(CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN {_LOWER} ELSE text END)")} AS now FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM d),
up AS (SELECT tree, 0 AS lvl, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
    UNION ALL SELECT tree, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 16),
tops AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
above AS (SELECT 0 AS lvl, pos, subroot AS digest, count(*) OVER () AS n FROM tops
    UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM above WHERE n > 1 GROUP BY lvl, pos // 16),
runs AS (SELECT tree, lvl, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM up WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT NULL, lvl, pos // 16, list(digest ORDER BY pos) FROM above WHERE n > 1 GROUP BY ALL),
low AS (SELECT doc_id, tree, leaf, pos AS own, 0 AS lvl, pos, now AS digest, '' AS proof FROM leaves
    UNION ALL SELECT doc_id, f.tree, leaf, own, f.lvl + 1, pos // 16, sha256(array_to_string(list_concat(ds[:pos % 16], [digest], ds[pos % 16 + 2:]), '')), proof || array_to_string(list_concat(ds[:pos % 16], ds[pos % 16 + 2:]), '')
    FROM low f JOIN runs r ON r.tree = f.tree AND r.lvl = f.lvl AND r.run = f.pos // 16),
half AS (SELECT low.* EXCLUDE (pos), subroot, tops.pos FROM low JOIN tops USING (tree) WHERE lvl = (SELECT max(lvl) FROM up WHERE up.tree = low.tree)),
high AS (SELECT doc_id, tree, own, leaf, subroot, 0 AS lvl, pos, digest, proof FROM half
    UNION ALL SELECT doc_id, f.tree, own, leaf, subroot, f.lvl + 1, pos // 16, sha256(array_to_string(list_concat(ds[:pos % 16], [digest], ds[pos % 16 + 2:]), '')), proof || array_to_string(list_concat(ds[:pos % 16], ds[pos % 16 + 2:]), '')
    FROM high f JOIN runs r ON r.tree IS NULL AND r.lvl = f.lvl AND r.run = f.pos // 16)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM high CROSS JOIN (SELECT digest AS root, lvl AS last FROM above WHERE n = 1) WHERE lvl = last"""

_GRAM = "SELECT lang, {0} AS words, unnest([array_to_string(w[i:i + {0} - 1], ' ') FOR i IN range(1, len(w) - {0} + 2)]) AS phrase FROM pieces WHERE len(w) >= {0}"

OP13 = f"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.replace('text', "coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM ({" UNION ALL ".join(_GRAM.format(k) for k in (1, 2, 3, 4))}) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words > 1),
cuts AS (SELECT c.lang, phrase, a, k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < words),
best AS (SELECT x.lang, x.phrase, a, arg_min({{'l': p.f, 'r': q.f, 's': 2000000::HUGEINT * a // (p.f + q.f)}}, (2000000::HUGEINT * a // (p.f + q.f), k)) AS b
    FROM cuts x JOIN f p ON p.lang = x.lang AND p.phrase = first JOIN f q ON q.lang = x.lang AND q.phrase = rest GROUP BY 1, 2, 3),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < words AND s + m - 1 <= words) GROUP BY 1, 2),
kept AS (SELECT lang, phrase, a, b.l AS l, b.r AS r, b.s::BIGINT AS score FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES = {"op3_benchmark_decontamination": OP3, "op4_embedding_near_dedup": OP4, "op6_warc": OP6, "op11_merkle_manifest": OP11, "op13_collocations": OP13}
