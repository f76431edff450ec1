import math
import re
from collections import Counter

from kairograph.llm import licenses, queries
from kairograph.llm.license_texts import TEMPLATES


def terms(text):
    return [t for t in (re.sub(r"^\.+|\.+$", "", t) for t in re.split(r"[\x00-*,\-/:-@\[-`{-\x7f]+", text.lower())) if t]


def reference(rows, least=licenses.LEAST):
    """{row number: (license, score)} by plain TF-IDF cosines of all pieces with all templates."""
    n, df = len(rows), Counter()
    for _, text, _ in rows:
        df.update(set(terms(text or "")))

    def vector(words):
        return {t: (1 + math.log(c)) * (math.log((n + 1) / (df[t] + 1)) + 1) for t, c in Counter(words).items()}

    shapes = [(name, v, math.sqrt(sum(x * x for x in v.values()))) for name, own in TEMPLATES.items() for v in (vector(terms(t)) for t in own)]
    out = {}
    for row, (_, text, whole) in enumerate(rows):
        words = terms(text or "")
        pieces = [w for w in map(terms, re.split("\r\n|\r|\n", text or "")) if len(w) <= 40] + [words[k:k + 40] for k in range(0, max(1, len(words)), 20)] + [words] * whole
        found = []
        for p in {tuple(w) for w in pieces if w}:
            v = vector(p)
            norm = math.sqrt(sum(x * x for x in v.values()))
            for name, shape, length in shapes:
                if (score := round(sum(x * shape[t] for t, x in v.items() if t in shape) / (norm * length), 6)) >= least:
                    found.append((-score, name))
        if found:
            out[row] = min(found)[1], -min(found)[0]
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, (name, score) in want.items():
        assert got[k][0] == name and abs(got[k][1] - score) < 2e-6


ROWS = [
    (1, "a/LICENSE", "Released under the MIT License.\nmore", 0), (2, "a/b/c/x.py", "code", 0), (3, "a/b/LICENSE.txt", "x\nLicensed under the Apache License, Version 2.0.", 0), (4, "a/b/y.py", None, 0),
    (5, "a/z.py", "This work is licensed under the GNU General Public License, version 3.", 0), (6, "q/w.py", "", 0), (7, None, "code", 0), (8, "top.py", "no notice here", 0), (2, "a/b/c/x.py", "code", 0),
    (9, "a/n.py", "word " * 60_000 + "licensed to nobody", 0), (10, "a/b/c/COPYING", "copyright of bananas", 0), (11, "m/cc.txt", "Licensed under CC BY-NC 4.0.", 0),
    (12, "a/f1.py", "the mit museum shop asked visitors from all over the world to show a driving license before they were let in to see the old machines", 0),
    (13, "a/f2.py", "copyright disputes about all rights of musicians reserved for later", 0),
    (14, "m/affero.py", "This work is licensed under the GNU Affero General Public License, version 3.", 0), (15, "m/two/LICENSE", TEMPLATES["BSD-2-Clause"][1], 0), (16, "m/two/x.c", "int main", 0),
    (17, "m/wrap.c", "/* Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation\n * files (the Software), to deal in the Software without\n * restriction */", 0),
    (18, "t/LICENSE", "Licensed under the ISC License.", 0), (19, "t/LICENSE.b", "Released under the MIT License.", 0), (20, "t/x", "x", 0), (None, "t/y", "Licensed under the ISC License.", 0), (5, "q/other.py", "plain", 0)]


def test_headers_and_inheritance(spark):
    files = spark.createDataFrame(ROWS, "doc_id long, path string, text string, license int")
    got = licenses.scan_licenses(files).collect()
    assert len(got) == len(ROWS)
    by = {r["path"]: (r["license"], r["origin"], r["inherited_from"]) for r in got}
    assert by["a/LICENSE"] == ("MIT", "header", None) and by["a/b/LICENSE.txt"][0] == "Apache-2.0" and by["a/z.py"][0] == "GPL-3.0" and by["m/cc.txt"][0] == "CC-BY-NC-4.0"
    assert by["a/b/c/x.py"] == by["a/b/y.py"] == ("Apache-2.0", "inherited", "a/b/LICENSE.txt") and by["a/n.py"] == ("MIT", "inherited", "a/LICENSE")
    assert by["q/w.py"] == by[None] == by["top.py"] == by["q/other.py"] == (None, "none", None)
    assert by["a/f1.py"][1] == by["a/f2.py"][1] == "inherited"  # words of a notice in other prose are none
    assert by["m/affero.py"][0] == "AGPL-3.0" and by["m/two/LICENSE"][0] == "BSD-2-Clause" and by["m/two/x.c"] == ("BSD-2-Clause", "inherited", "m/two/LICENSE")
    assert by["m/wrap.c"][:2] == ("MIT", "header") and by["t/y"][:2] == ("ISC", "header")
    assert by["t/x"] == ("ISC", "inherited", "t/LICENSE")  # equal scores: the first path
    assert licenses.scan_licenses(files.limit(0)).count() == 0
    rows = [(p, t, bool(re.match(r"(?i)(licen[sc]e|copying|notice)", (p or "").rpartition("/")[2]))) for _, p, t, _ in ROWS]
    want = reference(rows)
    same({r["path"]: (r["license"], r["score"]) for r in got if r["origin"] == "header"}, {rows[k][0]: v for k, v in want.items()})


def test_query_equals_brute_force(spark, sf_dir):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op8_license_scan(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    want = reference([(k, t, k % 50 == 0) for k, t in texts])
    same({k: (r["license"], r["score"]) for k, r in got.items() if r["origin"] == "header"}, {texts[k][0]: v for k, v in want.items()})
    plan = queries.op8_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
