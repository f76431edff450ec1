"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts
from .decontaminate import words_of

#: Every hashed term has a weight and factors; so many hash values keep both within 24 MB, whatever the corpus.
BUCKETS = 1 << 20
#: The term that every text holds; its weight is the bias.
ALWAYS = zlib.crc32(b"") % BUCKETS
#: Beginnings of words that count as terms beside the words: compounds and inflected forms share them.
STEMS = (4, 5, 6)
#: Default bound of the labelled rows that the model is fitted on, taken by hash order.
TRAIN_ROWS = 20_000
FACTORS, BATCH = 4, 64
#: Rounds over the rows for the weights alone, then with the factors of the terms whose weight is not zero by then.
EPOCHS, PAIR_EPOCHS = 5, 5
#: Follow-the-leader rate, its offset and the L1 bound under which the weight of a term stays zero.
RATE, OFFSET, LEAST = 1.0, 1.0, 7.0
#: Step of the factors, their first spread and their decay for each row.
FACTOR_RATE, SPREAD, DECAY = 0.02, 0.02, 1e-2


def terms_of(text: str) -> list[str]:
    """The distinct words of a whole text and, in angle brackets, their beginnings of STEMS characters."""
    words = [w.decode("utf-8", "replace") for w in set(words_of(text))]
    found = {f"<{w[:n]}>" for n in STEMS for w in words if len(w) >= n}
    return [*words, *found]


def hashed_terms(text: str) -> list[int]:
    """The distinct hash values of the terms of a whole text, with ALWAYS, in order."""
    return sorted({ALWAYS, *(zlib.crc32(t.encode()) % BUCKETS for t in terms_of(text))})


class FactorizationMachine:
    """score = sum of term weights + sum over term pairs of the product of their factors; one weight is the bias."""

    def __init__(self, weights: np.ndarray, factors: np.ndarray):
        self.weights, self.factors = weights, factors

    @classmethod
    def fit(cls, rows: list, labels: np.ndarray) -> FactorizationMachine:
        """A machine from the hashed terms of labelled rows: weights by follow-the-leader steps, factors by AdaGrad.

        Weights of terms that tell nothing stay zero by the L1 bound; such terms get no factors either, so that pairs
        of them, of which a long text holds very many, add no noise.
        """
        n = len(labels)
        rng = np.random.default_rng(7)
        w, v = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
        lead, seen, moved = np.zeros(BUCKETS), np.zeros(BUCKETS), np.full((BUCKETS, FACTORS), 1e-8)
        rows = [np.asarray(r, dtype=np.int32) for r in rows]
        for epoch in range(EPOCHS + PAIR_EPOCHS if n else 0):
            if epoch == EPOCHS:
                told = np.flatnonzero(w)
                told = told[told != ALWAYS]
                v[told] = rng.normal(0, SPREAD, (len(told), FACTORS))
                paired = np.zeros(BUCKETS, bool)
                paired[told] = True
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                own = order[at:at + BATCH]
                sizes = np.array([len(rows[k]) for k in own])
                ids, place = np.unique(np.concatenate([rows[k] for k in own]), return_inverse=True)
                begin, of = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(own)), sizes)
                z = np.add.reduceat(w[ids][place], begin)
                if epoch >= EPOCHS:
                    active = np.flatnonzero(paired[ids][place])
                    at_term, at_row = place[active], of[active]
                    each = v[ids[at_term]]
                    s = np.stack([np.bincount(at_row, each[:, f], len(own)) for f in range(FACTORS)], 1)
                    z += 0.5 * ((s**2).sum(1) - np.bincount(at_row, (each**2).sum(1), len(own)))
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]
                gw = np.bincount(place, g[of])
                if epoch >= EPOCHS and len(active):
                    terms, k = np.unique(at_term, return_inverse=True)
                    gv = np.stack([np.bincount(k, g[at_row] * (s[at_row, f] - each[:, f]) + DECAY * each[:, f]) for f in range(FACTORS)], 1)
                    moved[ids[terms]] += gv**2
                    v[ids[terms]] -= FACTOR_RATE * gv / np.sqrt(moved[ids[terms]])
                lead[ids] += gw - (np.sqrt(seen[ids] + gw**2) - np.sqrt(seen[ids])) / RATE * w[ids]
                seen[ids] += gw**2
                w[ids] = np.where(np.abs(lead[ids]) <= LEAST, 0.0, -(lead[ids] - np.sign(lead[ids]) * LEAST) * RATE / (OFFSET + np.sqrt(seen[ids])))
        return cls(w.astype(np.float32), v.astype(np.float32))

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities of label 1 for the hashed terms of texts."""
        out = np.empty(len(rows))
        for k, own in enumerate(rows):
            v = self.factors[own].astype(np.float64)
            out[k] = self.weights[own].sum(dtype=np.float64) + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def training_texts(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(toxic, text) of at most ``train_rows`` labelled doc_ids, one row each: of repeated ones the smallest text."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("first")).select("first.toxic", "first.text")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """A machine fitted on at most ``train_rows`` rows of ``labels`` (doc_id, toxic), with all terms of their texts."""

    def run(batches):
        for piece, rows in texts(batches):
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array([hashed_terms(t) for t in rows], pa.list_(pa.int32()))], ["toxic", "terms"])

    rows = map_batches(training_texts(docs, labels, train_rows), run, "toxic int, terms array<int>").toArrow()
    ends = np.concatenate(([0], np.cumsum(rows["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)))) if len(rows) else [0]
    flat = rows["terms"].combine_chunks().flatten().to_numpy() if len(rows) else []
    own, toxic = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], np.array(rows["toxic"].to_pylist(), dtype=float)
    order = sorted(range(len(own)), key=lambda k: (own[k].tobytes(), toxic[k]))
    return FactorizationMachine.fit([own[k] for k in order], toxic[order])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels are read only of rows whose crc32(doc_id as text) mod 3 is not 1; those rows are held_out. Scores use
    nothing but the text. ``train_rows`` bounds the labelled rows that the model is fitted on.

    Defined cases: null and empty texts get the score of a text without terms; a null doc_id is not held out and
    never trains; repeated labels of a doc_id count once, the larger one; repeated rows are scored each; without
    labelled rows all scores are 0.5; an empty table gives an empty result.
    """
    fold = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(fold() != 1), train_rows))

    def run(batches):
        model = machine.value
        for piece, rows in texts(batches):
            yield pa.RecordBatch.from_arrays([*piece.select(["doc_id", "held_out"]).columns, pa.array(model.score([hashed_terms(t) for t in rows]))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
