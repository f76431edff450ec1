import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kairograph.llm import bpe, queries, simhash
from kairograph.llm.common import materialize

from .test_decontaminate import reference as contaminated
from .test_secret_scan import reference as secrets
from .test_simhash import jaccard_pairs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input and the output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), "test")
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_columns_and_rows(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, *_ in steps] == [n for n, _ in corpus_pipeline.STAGES]
    for _, before, after in steps[:-1]:
        assert after.columns == columns
        old, new = rows(before), rows(after)
        assert set(new) <= set(old) and after.count() == len(new)


def test_quality_rejects_bad_and_keeps_good(spark, steps):
    _, before, after = steps[0]
    kept = rows(after)
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([k in kept for k, q in marks.items() if q == 1]) > 0.97
    assert np.mean([k in kept for k, q in marks.items() if q == 0]) < 0.2


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    old, new = rows(before), rows(after)
    texts = [(k, r["text"]) for k, r in old.items()]
    pairs, _ = jaccard_pairs(texts, 5, 0.8)
    assert not any(a in new and b in new and old[a]["text"] == old[b]["text"] for a, b in pairs)
    assert np.mean([not (a in new and b in new) for a, b in pairs] or [1]) >= 0.9
    near, _ = jaccard_pairs(texts, 5, 0.4)
    alone = set(old) - {x for p in near for x in p}
    assert all(k in new for k in alone if len(old[k]["text"].split()) > 5)


def test_contaminated_documents_go(spark, steps):
    _, before, after = steps[2]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = contaminated([(k, r["text"]) for k, r in rows(before).items()], bench)
    assert set(rows(after)) == {k for k, x in want.items() if not x[4]}


def test_secrets_are_masked(steps):
    _, before, after = steps[3]
    old, new = rows(before), rows(after)
    assert set(old) == set(new)
    for k, r in new.items():
        assert not secrets(r["text"]) and r["n_chars"] == len(r["text"])
        if not secrets(old[k]["text"]):
            assert r["text"] == old[k]["text"]


def test_tokens_equal_the_library(steps):
    _, before, after = steps[4]
    library, new = Tokenizer.from_file(queries.VOCABULARY), rows(after)
    for k, r in rows(before).items():
        ids = np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(new[k]["token_ids"]) == ids and new[k]["round_trip"] and new[k]["ids_sha256"] == hashlib.sha256(ids).hexdigest()


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, equal ids with other texts, clashing names and empty tables."""
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, 0, 0), (2, text + " more", 0, 0), (1, "something else", 0, 0), (1, text, 0, 0), (None, text, 0, 0), (3, None, 0, 0), (4, "", 0, 0), (5, "x", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key int, place int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, text), (1, "something else"), (1, text), (3, ""), (5, "x")]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    coded = bpe.encode_and_check(docs, queries.VOCABULARY).collect()
    assert len(coded) == len(rows) and all(r["round_trip"] for r in coded) and sum(r["n_tokens"] == 0 for r in coded) == 2
    assert bpe.encode_and_check(docs.limit(0), queries.VOCABULARY).count() == 0
