import hashlib
import random
import re

from kairograph.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def reference(docs, items, size=10):
    windows = []
    for key, text in items:
        own = words(text)
        windows += [(key, tuple(own[i:i + size])) for i in range(max(1, len(own) - size + 1)) if own]
    out = {}
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        places = {}
        for i, w in enumerate(own):
            places.setdefault(w, []).append(i)
        for item, w in windows:
            for i in places.get(w[0], ()):
                if tuple(own[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
        out[key] = len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
    return out


def test_query_matches_brute_force(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    want = reference([tuple(r) for r in read("documents").select("doc_id", "text").collect()], [tuple(r) for r in read("benchmark").collect()])
    got = {r[0]: tuple(r)[1:6] for r in queries.op3_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == want and any(x[4] for x in want.values())


def test_edge_cases(spark):
    item = "a b c d e f g h i j k"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " * 30_000 + item, 0), (3, "Short One", 0), (None, item, 0), (5, "a b c d e X f g h i j", 0), (6, "a b c d e", 0), (7, "f g h i j k", 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (1, item), (2, "short one!"), (3, None), (4, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination(docs, bench).collect()}
    assert len(got) == 8
    assert got[3, 30_011]["n_hit"] == 11 and got[3, 30_011]["items"] == ["1"]
    assert got[3, 2]["n_hit"] == 2 and got[None, 11]["contaminated"]
    assert got[5, 11]["n_hit"] == 0 and got[5, 11]["n_near_items"] == 1
    assert not got[6, 5]["contaminated"] and not got[1, 0]["contaminated"]
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    kept = decontaminate.drop_contaminated(docs.withColumnRenamed("item_id", "text_key"), bench)
    assert kept.columns == ["doc_id", "text", "text_key"]
    #: by their own texts: the contaminated row without id goes, the clean row that shares no text stays
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6, 7]
    both = spark.createDataFrame([(1, item, 0), (1, "clean words", 0), (None, item, 0), (None, None, 0), (2, "clean words", 0)], docs.schema)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontaminate.drop_contaminated(both, bench).collect()) == [(0, ""), (1, "clean words"), (2, "clean words")]


def test_near_matches_equal_brute_force(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 40)))) for k in range(60)]
    items = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))) for k in range(8)]
    want = {}
    for key, text in docs:
        own, n = text.split(), 0
        for _, item in items:
            w = item.split()
            parts = [w[i:i + 4] for i in range(max(1, len(w) - 3))]
            n += any(all(any(own[p] == t for p in range(max(0, s + k - 1), min(len(own), s + k + 2))) for k, t in enumerate(x)) for x in parts for s in range(-1, len(own) + 1))
        want[key] = n
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = decontaminate.match_index(decontaminate.materialize(index, "test"), spark.createDataFrame(items, "item_id long, text string"), size=4, slop=1)
    assert {r["doc_id"]: r["n_near_items"] for r in found.collect()} == want and any(want.values())


def test_one_index_serves_all_benchmarks(spark, monkeypatch):
    """Small chunks and shards give the same result; the index holds all terms."""
    docs = spark.createDataFrame([(k, f"x{k} a b c d e f{k % 2} z") for k in range(50)], "doc_id long, text string")
    index = decontaminate.materialize(decontaminate.build_index(docs), "test")
    assert sum(sum(r["counts"]) for r in index.select("counts").collect()) == 400
    monkeypatch.setattr(decontaminate, "CHUNK", 1)
    for words in ("a b c d e f0", "e f1 z", "b c d", "nowhere"):
        got = {r["doc_id"]: r["n_hit"] for r in decontaminate.match_index(index, spark.createDataFrame([("i", words), ("j", "c d e")], "item_id string, text string"), size=3).collect()}
        want = decontaminate_reference(docs, words)
        assert got == want


def decontaminate_reference(docs, words):
    return {k: x[1] for k, x in reference([tuple(r) for r in docs.collect()], [("i", words), ("j", "c d e")], 3).items()}
