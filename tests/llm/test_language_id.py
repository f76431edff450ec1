import zlib
from collections import Counter

import numpy as np
import pytest

from kairograph.llm import language_id as L
from kairograph.llm import queries


def plain_vector(text):
    """The sum of the bound vectors, run by run."""
    out = np.zeros(L.DIMENSIONS)
    words = "".join(c if L.letter_table()[ord(c)] else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " " if words else " "
    for a, b, c in zip(line, line[1:], line[2:], strict=False):
        out += np.roll(L.letter_vector(ord(a), L.DIMENSIONS), 2) * np.roll(L.letter_vector(ord(b), L.DIMENSIONS), 1) * L.letter_vector(ord(c), L.DIMENSIONS).astype(int)
    return out


TEXTS = ["", "  1 2 ", "a", "Ça va?  L'été 12 fois", "ЖÖ 漢字 नमस्ते", "aaaa " * 40, "the quick brown fox\n\njumps"]


def test_bundle_equals_plain_sums():
    got, lettered = L.bundle(TEXTS)
    assert lettered.tolist() == [False, False, True, True, True, True, True]
    for own, text in zip(got, TEXTS, strict=True):
        assert np.array_equal(own, plain_vector(text) if text.strip(" 12") else own * 0)


def test_parts_of_long_texts_lose_no_run(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog, 17 times; " * 50
    want, _ = L.bundle([text, "x y", text[:100]])
    monkeypatch.setattr(L, "_CHARACTERS", 37)
    monkeypatch.setattr(L, "_RUNS", 11)
    got, _ = L.bundle([text, "x y", text[:100]])
    assert np.array_equal(got, want)


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    known = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].text]
    assert np.mean(known) >= 0.97


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    unit = lambda v: v / max(np.sqrt((v**2).sum()), 1e-300)
    vectors = {r.doc_id: unit(plain_vector(r.text or "")) for r in docs}
    sums = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            sums[r.lang] = sums.get(r.lang, 0) + vectors[r.doc_id]
    names = sorted(sums)
    for r in queries.QUERIES["op12_language_id"](spark, sf_dir).collect():
        cosines = [float(unit(sums[x]) @ vectors[r.doc_id]) for x in names]
        assert abs(r.score - max(0, max(cosines))) < 1e-5
        assert r.lang_pred == "und" or cosines[names.index(r.lang_pred)] >= max(cosines) - 1e-5


def test_language_and_other_columns_are_not_read_for_scores(spark):
    rows = [(k, t, l) for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40)]
    one = L.predict_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    other = [(k, t, "xx" if k in held else l) for k, t, l in rows]
    two = L.predict_held_out(spark.createDataFrame(other, "doc_id long, text string, lang string"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert Counter(r.lang_pred for r in one.collect()) == {"en": 40, "de": 40}


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, held_out string, profile int"
    rows = [(1, "der hund", "de", "a", "b", 1), (1, "der hund", "de", "a", "b", 1), (None, "the dog", "en", None, None, None), (6, None, "en", "a", "b", 1), (7, "", None, "a", "b", 1), (8, "12 + 3", "fr", "a", "b", 1), (9, "der hund " * 60_000, None, "a", "b", 1)]
    got = {(r.doc_id, r.lang_pred) for r in L.predict_held_out(spark.createDataFrame(rows, schema)).collect()}
    assert {(6, "und"), (7, "und"), (8, "und"), (9, "de"), (1, "de"), (None, "en")} == got


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert L.predict_held_out(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r)[2:] for r in L.predict_held_out(spark.createDataFrame([(1, "a b", None)], schema)).collect()] == [("und", 0.0)]


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(k, "ab cd", f"l{k}") for k in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        L.identify_languages(docs, L.language_profiles(docs), most_languages=3)
