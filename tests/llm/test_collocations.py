import re
from collections import Counter

import numpy as np
import pytest

from kairograph.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, most=2000):
    """Counts phrase by phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    f = {x: a for x, a in f.items() if a >= least}
    out = {}
    for (lang, w), a in f.items():
        longer = [b for (other, v), b in f.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if len(w) == 1 or any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:most], 1))


def drawn(seed, n):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "cÉ", "d-e", "nul\x00l", "f g", "ſ", "İ", "ж", "'t"]
    gaps = [" ", "\t", "  ", ". ", ",", "\n", "\x0b", "?! ", " \r\n"]
    weights = np.array([9, 1, 1, 1, 0.3, 0.3, 0.2, 0.2, 0.2]) / 13.2
    return [("".join(w + g for w, g in zip(rng.choice(words, k), rng.choice(gaps, k, p=weights), strict=True)), rng.choice(["en", "de", "und"])) for k in rng.integers(0, 60, n)]


@pytest.mark.parametrize("shard_words", [7, 200, 1 << 21])
def test_equals_brute_force(spark, shard_words, monkeypatch):
    rows = [*drawn(1, 150), (None, "en"), ("", None), ("a b c " * 30, None), ("x y x y x y x", "fr")] + [("same words here", "en")] * 4
    docs = spark.createDataFrame([(k, t, None if l is None else str(l)) for k, (t, l) in enumerate(rows)], SCHEMA).repartition(3)
    monkeypatch.setattr(C, "BUCKET_WORDS", 500)
    got = C.collocations(docs, least=4, shard_words=shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)


def test_first_phrases_of_each_language(spark):
    rows = drawn(2, 100)
    docs = spark.createDataFrame([(k, t, str(l)) for k, (t, l) in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, C.collocations(docs, most=3, least=3).collect())) == brute(rows, 3, 3)


def test_empty_tables_and_rare_words(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, "only once said", "en"), (2, None, None)], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, "word. " * 40, "en")], SCHEMA)).collect() == []


def test_other_columns_and_long_texts(spark):
    text = "Alpha beta, gamma delta epsilon\n" * 30_000
    docs = spark.createDataFrame([(1, text, "en", "x", 1, 2)], SCHEMA + ", phrase string, n int, shard int")
    assert sorted(map(tuple, C.collocations(docs).collect())) == [("en", 1, "alpha beta", 30000, 30000, 30000, 150000, 1000000), ("en", 2, "gamma delta epsilon", 30000, 30000, 30000, 150000, 1000000)]


def test_texts_are_read_in_parts(monkeypatch):
    text = "One two,three  four\tfive. " * 20
    want, got = [C.Numbers("en", [None]) for _ in range(2)]
    whole = np.concatenate(C.numbered(text, want))
    monkeypatch.setattr(C, "_READ", 5)
    assert np.array_equal(np.concatenate(C.numbered(text, got)), whole)


def test_lists_come_back():
    at, ids = np.array([3, 5, 8, 9]), np.array([7, 2, 7, 1])
    assert [x.tolist() for x in C.from_lists(C.by_id(at, ids))] == [at.tolist(), ids.tolist()]
    assert C.unpack(C.pack(np.array([5, -3, 1 << 60]))).tolist() == [5, -3, 1 << 60]
    with pytest.raises(OverflowError):
        C.extend((np.array([0]), np.array([1 << 40])), (np.array([1]), np.array([5])), 1, 1 << 40)
