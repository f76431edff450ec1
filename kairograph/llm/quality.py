"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts

#: Default bound of the labelled rows that the classifiers are fitted on, taken by hash order; no other bound on rows.
LABELLED_ROWS = 16_000
#: Rounds of exchange; rows that each view teaches the other in a round, as a share of the labelled rows; ridge.
ROUNDS, TAUGHT, RIDGE = 4, 1 / 8, 1e-2
SOURCE_SLOTS, LANG_SLOTS, LENGTH_SLOTS = 64, 16, 12

MARKS = b"|!*#$%&@~^_<>{}[]()/\\=+;:.,?-'\""
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def text_view(text: str) -> list[float]:
    """Numbers that describe the whole text: marks, case, digits, repetition, words and lines."""
    data = text.encode("utf-8", "replace")
    n = max(len(data), 1)
    words, lines = data.split(), data.split(b"\n")
    share = lambda k: float(np.log1p(200.0 * k / n))
    n_words = max(len(words), 1)
    return [
        *[share(data.count(m)) for m in (MARKS[i:i + 1] for i in range(len(MARKS)))],
        share(n - len(data.translate(None, _UPPER))), share(n - len(data.translate(None, _DIGITS))), share(len(lines) - 1),
        float(np.log1p(len(data))), len(data) / n_words / 10, len(set(words)) / n_words, len(set(lines)) / len(lines), float(not words),
    ]


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Slots of the one-hot metadata view: hashed source, hashed language, length class."""
    return [
        zlib.crc32((source or "").encode()) % SOURCE_SLOTS, SOURCE_SLOTS + zlib.crc32((lang or "").encode()) % LANG_SLOTS,
        SOURCE_SLOTS + LANG_SLOTS + min(LENGTH_SLOTS - 1, max(0, n_chars or 0).bit_length() * LENGTH_SLOTS // 24)]


def one_hot(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), SOURCE_SLOTS + LANG_SLOTS + LENGTH_SLOTS))
    for k in range(slots.shape[1] if len(slots) else 0):
        out[np.arange(len(slots)), slots[:, k]] = 1
    return out


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.sd = x.mean(0), np.maximum(x.std(0), 1e-3)
        a = np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))])
        self.w = np.zeros(a.shape[1])
        ridge = np.full(a.shape[1], RIDGE * len(x) / 100 + 1e-3)
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -25, 25)))
            step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.sd) @ self.w[:-1] + self.w[-1], -25, 25)

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


class CoTrained:
    """A text view and a metadata view that teach each other, and a calibrated combination of both."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.constant = None
        #: (rows taught to the text view, rows taught to the metadata view) of each round
        self.taught: list[tuple[int, int]] = []
        if len(y) < 10 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 1.0
            return
        self.held = np.arange(len(y)) % 4 == 3
        self.labelled = (text, meta), y
        self.rows = [[v[~self.held]] for v in (text, meta)]
        self.targets = [[y[~self.held]], [y[~self.held]]]
        self.refit()

    def __getstate__(self) -> dict:
        """What scoring needs: the rows that were fitted on stay on the driver."""
        return {k: v for k, v in self.__dict__.items() if k not in ("labelled", "rows", "targets", "held")}

    def refit(self) -> None:
        """Fit both views on what they were taught; calibrate each, then both together, on labelled rows held back."""
        views, y = self.labelled
        self.models = [Logistic().fit(np.concatenate(r), np.concatenate(t)) for r, t in zip(self.rows, self.targets, strict=True)]
        z = [m.logit(v[self.held])[:, None] for m, v in zip(self.models, views, strict=True)]
        self.platt = [Logistic().fit(k, y[self.held]) for k in z]
        self.joint = Logistic().fit(np.column_stack([p.logit(k) for p, k in zip(self.platt, z, strict=True)]), y[self.held])

    def learn(self, text: np.ndarray, meta: np.ndarray, teacher: np.ndarray, p: np.ndarray) -> None:
        """Rows with pseudo-labels ``p`` (calibrated, so a weak view teaches softly) of the view ``teacher`` (0 or 1)."""
        for view, own in enumerate((text, meta)):
            told = teacher == 1 - view
            self.rows[view].append(own[told])
            self.targets[view].append(p[told])
        self.taught.append((int((teacher == 1).sum()), int((teacher == 0).sum())))
        self.refit()

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: text view, metadata view, both."""
        if self.constant is not None:
            return (np.full(len(text), self.constant),) * 3
        own = [p.logit(m.logit(v)[:, None]) for p, m, v in zip(self.platt, self.models, (text, meta), strict=True)]
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        return sigmoid(own[0]), sigmoid(own[1]), self.joint.prob(np.column_stack(own))


def views(batch, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    meta = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)
    return np.array([text_view(t) for t in rows], dtype=float), np.array([meta_view(*m) for m in meta]).reshape(-1, 3)


def stacked(lists, kind) -> np.ndarray:
    """A list column, of equal lists without nulls, as a matrix."""
    flat = pa.chunked_array([lists]) if isinstance(lists, pa.Array) else lists
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in flat.chunks]
    return np.concatenate(flat or [np.zeros(0)]).astype(kind).reshape(len(lists), -1 if len(lists) else 0)


def described(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, quality, known, x, slots) of every row: both views of whole texts, with the labels ``marks`` has."""

    def run(batches):
        for piece, rows in texts(batches):
            a, b = views(piece, rows)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(list(a.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(b.astype(np.int32)), pa.list_(pa.int32()))], ["doc_id", "x", "slots"])

    columns = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    return map_batches(columns, run, f"doc_id {kind}, x array<float>, slots array<int>").join(marks, "doc_id", "left")


def most_confident(free: DataFrame, model: CoTrained, counts: dict) -> DataFrame:
    """The rows of ``free`` that each view is surest of: counts[label] for each view and label, over all rows.

    A task keeps no more than these of what it reads, so the final choice sees little.
    """
    shared = free.sparkSession.sparkContext.broadcast(model)
    most = max(counts.values())

    def run(batches):
        own, kept = shared.value, []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, slots = stacked(batch.column("x"), float), stacked(batch.column("slots"), int)
            for view, p in enumerate(own.score(x, one_hot(slots))[:2]):
                for label in (0, 1):
                    sure = p if label else 1 - p
                    at = np.argsort(-sure, kind="stable")[:most]
                    kept.append(pa.table({
                        "row": batch.column("row").take(pa.array(at)), "view": np.full(len(at), view, np.int32), "label": np.full(len(at), label, np.int32), "sure": sure[at], "p": p[at],
                        "x": batch.column("x").take(pa.array(at)), "slots": batch.column("slots").take(pa.array(at))}))
            if len(kept) >= 64:
                kept = best(kept)
        for t in best(kept):
            yield from t.to_batches()

    def best(tables):
        if not tables:
            return []
        own = pa.concat_tables(tables).sort_by([("view", "ascending"), ("label", "ascending"), ("sure", "descending"), ("row", "ascending")])
        key = own["view"].to_numpy() * 2 + own["label"].to_numpy()
        place = np.arange(len(key)) - np.searchsorted(key, key)
        return [own.filter(pa.array(place < most))]

    rows = map_batches(free, run, "row long, view int, label int, sure double, p double, x array<float>, slots array<int>")
    by = Window.partitionBy("view", "label").orderBy(F.desc("sure"), "row")
    limit = F.when(F.col("label") == 1, counts[1]).otherwise(counts[0])
    return rows.withColumn("place", F.row_number().over(by)).where((F.col("place") <= most) & (F.col("place") <= limit))


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of the labelled rows to fit on one for each doc_id, so repeated documents do not pass the bound of the sample."""
    first = F.min(F.struct("row", "x", "slots", "quality")).alias("first")
    return rows.where("known").groupBy("doc_id").agg(first).select("doc_id", "first.*")


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> CoTrained:
    """Co-trained classifiers. At most ``labelled_rows`` labelled rows are used; all rows without label are candidates.

    In each round both views score every free row on Spark; the rows that a view is surest of, for each label in
    proportion to its share, go with its calibrated probabilities to the other view. Only the labelled rows and the
    chosen ones reach the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).select("doc_id", F.lit(True).alias("known"))
    rows = materialize(described(docs, known.join(F.broadcast(sample), "doc_id", "left")).withColumn("row", F.monotonically_increasing_id()), "quality-views")
    got = one_of_each(rows).toArrow().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    n = len(text_view(""))
    x = stacked(got["x"], float) if len(got) else np.zeros((0, n))
    slots = stacked(got["slots"], int) if len(got) else np.zeros((0, 3), int)
    model = CoTrained(x, one_hot(slots), np.array(got["quality"].to_pylist(), dtype=float))
    if model.constant is not None:
        return model
    free, done = rows.where("quality IS NULL").select("row", "x", "slots"), []
    n_taught, share = max(20, int(len(got) * TAUGHT)), float(np.mean(got["quality"].to_pylist()))
    counts = {1: max(5, round(n_taught * share)), 0: max(5, round(n_taught * (1 - share)))}
    for _ in range(rounds):
        left = free.where(~F.col("row").isin(done)) if done else free
        chosen = most_confident(left, model, counts).select("row", "view", "p", "x", "slots").toArrow().sort_by([("view", "ascending"), ("row", "ascending")])
        if not len(chosen):
            break
        model.learn(stacked(chosen["x"], float), one_hot(stacked(chosen["slots"], int)), chosen["view"].to_numpy(), chosen["p"].to_numpy())
        done += sorted(set(chosen["row"].to_pylist()))
    model.labelled = model.rows = None  # fitted: what was fitted on need not stay on the driver
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text, source, lang, n_chars, ...) with p_text, p_meta, quality_score and quality_keep.

    ``labelled_rows`` bounds the labelled rows that the classifiers are fitted on. The views are calibrated on every
    fourth of them, which no view is fitted on.

    Defined cases: null texts count as empty, null metadata as their own class; repeated labels of a doc_id count
    once, the larger one; repeated rows are scored each; existing columns of the four result names are replaced;
    without labels of both kinds every row gets the share of good labels (1 if there are none); an empty table gives
    an empty result.
    """
    names = ["p_text", "p_meta", "quality_score", "quality_keep"]
    rest = docs.drop(*names)
    model = docs.sparkSession.sparkContext.broadcast(fit(rest, labels, labelled_rows, rounds))

    def run(batches):
        own = model.value
        for piece, rows in texts(batches):
            x, slots = views(piece, rows)
            p = own.score(x, one_hot(slots))
            yield pa.RecordBatch.from_arrays([*piece.columns, *map(pa.array, p), pa.array(p[2] >= threshold)], [*piece.schema.names, *names])

    schema = rest.selectExpr("*", "0D AS p_text", "0D AS p_meta", "0D AS quality_score", "true AS quality_keep").schema
    return map_batches(rest, run, schema)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; all columns stay."""
    return score_quality(docs, labels, threshold).where("quality_keep").select(*docs.columns)
