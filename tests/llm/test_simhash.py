import numpy as np
import pytest
import xxhash

from kairograph.llm import simhash


def reference(rows, words, most):
    fps = {}
    for key, text in rows:
        tokens = (text or "").encode().lower().split()
        shingles = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
        counts = np.zeros(64, int)
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            counts += [h >> b & 1 for b in range(64)]
        fps[key] = sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if bin(fps[a] ^ fps[b]).count("1") <= most:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: (f"{fps[k]:016x}", find(k)) for k in keys}


@pytest.mark.parametrize("words", [4, 5])
def test_matches_brute_force(spark, sf_dir, words):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = reference([tuple(r) for r in docs.select("doc_id", "text").collect()], words, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs, words).collect()}
    assert got == want


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "one", 5), (3, "one", 5), (4, "word " * 50_000, 5), (None, "x y z", 5), (6, "ONE", 5), (7, "A b\tC d e", 1), (8, "a B c d\ne", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.simhash_components(docs).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(rows) and by[2] == 1 and by[6] == 3 and by[8] == 7
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] or 0) for r in kept.collect()) == [0, 1, 3, 4, 7]


def test_thresholds_cover_all_pairs():
    rng = np.random.default_rng(0)
    fps = rng.integers(-2**63, 2**63 - 1, 300)
    bits = simhash.as_bits(fps).astype(float)
    for parts in range(1, 6):
        groups = simhash.group_bits(bits, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, chosen = simhash.thresholds(fps, 10_000, groups, 4)
        assert sum(chosen) == 4 - parts + 1


def jaccard_pairs(rows, words, least):
    sets = {k: frozenset(simhash.shingle_hashes(t or "", words).tolist()) for k, t in rows}
    holders = {}
    for k, s in sets.items():
        for h in s:
            holders.setdefault(h, []).append(k)
    pairs = {(a, b) for ids in holders.values() if len(ids) < 400 for i, a in enumerate(ids) for b in ids[i + 1:]}
    return {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= least * len(sets[p[0]] | sets[p[1]])}, sets


def test_similar_pairs_are_found_and_others_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    want, sets = jaccard_pairs(rows, 5, 0.8)
    found = [of[a] == of[b] for a, b in want]
    assert want and np.mean(found) >= 0.9
    near, _ = jaccard_pairs(rows, 5, 0.4)
    linked = {x for p in near for x in p}
    assert all(of[k] == k for k, s in sets.items() if s and k not in linked)


def test_links_by_similarity_are_exact(spark):
    """Pairs of two random texts: ``common`` shingles of both, ``own`` ones of each; exactly those from 0.8 on link."""
    cases = [(80, 10), (320, 40), (82, 9), (85, 7), (79, 10), (75, 12), (300, 50), (70, 15)]
    rng, rows, pairs = np.random.default_rng(1), [], []
    for common, own in cases:
        for _ in range(150):
            head = rng.integers(10**12, size=common + 4).tolist()
            for _ in range(2):
                rows.append((len(rows), " ".join(map(str, head + rng.integers(10**12, size=own).tolist()))))
            pairs.append((len(rows) - 2, common / (common + 2 * own) >= 0.8))
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [of[k] == of[k + 1] for k, _ in pairs]
    assert np.mean([x for x, (_, near) in zip(linked, pairs, strict=True) if near]) > 0.995
    assert not any(x for x, (_, near) in zip(linked, pairs, strict=True) if not near)


def test_repeats_inside_a_text_do_not_hide_a_link(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base + base[-50:] * 20))]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    assert {r["component_id"] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_the_pigeonhole_search_finds_near_copies(spark, monkeypatch):
    """Of texts of 2,000 words and copies with one other word; minima find nothing here."""
    rng, rows = np.random.default_rng(2), []
    for k in range(60):
        words = rng.integers(10**12, size=2000).astype(str).tolist()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:900], "other", *words[901:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "hubs_of", lambda rows: rows.selectExpr("node", "node AS hub").distinct())
    monkeypatch.setattr(simhash, "open_pairs", lambda *_: spark.createDataFrame([], "a long, b long"))
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert np.mean([of[2 * k + 1] == of[2 * k] for k in range(60)]) > 0.9
    assert all(of[2 * k] == 2 * k for k in range(60))
