import json
import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kairograph.llm import bpe, queries

ODD = [
    "", " ", "\n\n  \t x", "don't we'll I'M they've", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "ﬁn naïve ２３ ²³ Ⅷ ½", "日本語テキスト 한국어 עברית العربية",
    "\x00\x01\x1c\x1d\x1e\x1f\x85  　x", "👩‍👩‍👧‍👦 flags 🇩🇪", "é combining ​ zero", "x" * 5000, "ab" * 3000, "é" * 900, "   " * 50 + "end", "᠎﻿",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "12345678901234567890" * 30, "!?" * 400, " " * 700, "ſK",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.VOCABULARY)


def expected(library, texts):
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_codec_equals_library(library):
    codec = bpe.Codec(open(queries.VOCABULARY, encoding="utf-8").read())
    for text, ids in zip(ODD, expected(library, ODD), strict=True):
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text[:40])
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_query_equals_library(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op7_bpe(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, ids in zip(rows, expected(library, [r["text"] for r in rows]), strict=True):
        x = got[r["doc_id"]]
        back = library.decode(ids, skip_special_tokens=False)
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 1), (2, "a b", 2), (2, "a b", 2), (None, "long " * 40_000, 3)], "doc_id long, text string, token_ids int")
    out = bpe.decode(bpe.encode(docs, queries.VOCABULARY), queries.VOCABULARY).collect()
    assert [r["decoded"] for r in out] == ["", "", "a b", "a b", "long " * 40_000]
    assert bpe.encode(docs.limit(0), queries.VOCABULARY).count() == 0


def test_other_kinds_of_vocabularies_are_refused():
    spec = json.loads(open(queries.VOCABULARY, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(spec | change))
