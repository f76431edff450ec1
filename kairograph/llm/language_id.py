"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is bound to one vector by multiplying their
vectors, each rotated by its place; a text is the sum of the vectors of its runs, a language the sum of the unit vectors
of its texts. A text has the language whose sum is nearest by cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

DIMENSIONS = 1024
_SPACE = 32
#: Unit vectors are summed as whole numbers of this fraction, so that sums don't depend on the order of tasks.
_UNIT = 1 << 20
#: Runs whose vectors are held at once, texts that are bundled at once, characters of a text that are read at once.
_RUNS, _TEXTS, _CHARACTERS = 1 << 13, 256, 1 << 20


@cache
def letter_table() -> np.ndarray:
    """For every code point 0 (none), 1 (mark or the like that stays inside words) or 2 (letter)."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LM":
            table[code] = 2 if kind == "L" else 1
    return table


@cache
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a letter, the same in every task."""
    return np.random.default_rng([12, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def codes_of(text: str) -> tuple[np.ndarray, bool]:
    """The letters of a lower-cased text as code points, words parted by one space, and whether it has a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letter_table()[codes]
    codes = np.concatenate([[_SPACE], np.where(kind > 0, codes, _SPACE), [_SPACE]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])], bool((kind == 2).any())


def bind(runs: np.ndarray, dimensions: int) -> np.ndarray:
    """(runs, dimensions): the vectors of runs of three letters."""
    letters, places = np.unique(np.stack([runs >> 42, (runs >> 21) & 0x1FFFFF, runs & 0x1FFFFF]), return_inverse=True)
    book = np.stack([letter_vector(int(c), dimensions) for c in letters])
    first, second, third = places.reshape(3, -1)
    return np.roll(book, 2, 1)[first] * np.roll(book, 1, 1)[second] * book[third]


def bundle(group: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the run vectors of each text, and whether it has a letter.

    Runs are counted first and bound once each. Letters are read in parts of bounded size, a very long text in several
    that share two letters, so that no run is lost.
    """
    out, lettered = np.zeros((len(group), dimensions), np.float64), np.zeros(len(group), bool)
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, text in enumerate(group):
        codes, lettered[k] = codes_of(text)
        for start in range(0, max(0, len(codes) - 2), _CHARACTERS):
            waiting.append((k, codes[start : start + _CHARACTERS + 2].astype(np.int64)))
            size += len(waiting[-1][1])
            if size >= _CHARACTERS:
                add_runs(waiting, out)
                waiting, size = [], 0
    add_runs(waiting, out)
    return out, lettered


def add_runs(waiting: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
    """Add the vectors of all runs of the (row, code points) pairs to the rows of ``out``."""
    if not waiting:
        return
    row = np.repeat([k for k, _ in waiting], [len(c) - 2 for _, c in waiting])
    runs, place = np.unique(np.concatenate([(c[:-2] << 42) | (c[1:-1] << 21) | c[2:] for _, c in waiting]), return_inverse=True)
    cells, counts = np.unique(row * len(runs) + place, return_counts=True)
    row, place = np.divmod(cells, len(runs))
    first, last = row[0], row[-1] + 1
    for start in range(0, len(runs), _RUNS):
        own = (place >= start) & (place < start + _RUNS)
        table = np.zeros((last - first, min(_RUNS, len(runs) - start)), np.float32)
        table[row[own] - first, place[own] - start] = counts[own]
        out[first:last] += table @ bind(runs[start : start + _RUNS], out.shape[1]).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors**2).sum(1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def groups(batches: Iterator, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch, group in texts(batches, column, 1 << 20):
        for k in range(0, len(group), _TEXTS):
            yield batch.slice(k, _TEXTS), group[k : k + _TEXTS]


def language_profiles(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, n, profile): texts and the summed unit vectors of each language of ``docs`` (text, lang).

    Every task sums what it reads; one row for each language and task is shuffled. Rows with a null language or a
    text without letters teach nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        often: dict[str, int] = {}
        for batch, group in groups(batches, "text"):
            vectors, lettered = bundle(group, dimensions)
            whole = np.rint(unit(vectors) * _UNIT).astype(np.int64)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs[lettered]):
                own = lettered & (langs == lang)
                sums[lang] = sums.get(lang, 0) + whole[own].sum(0)
                often[lang] = often.get(lang, 0) + int(own.sum())
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "n": list(often.values()), "sums": [s.tolist() for s in sums.values()]})

    parts = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, n long, sums array<long>")
    cells = parts.select("lang", "n", F.posexplode("sums").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return cells.groupBy("lang").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("profile"))


def identify_languages(docs: DataFrame, profiles: DataFrame, most_languages: int = 2000, least_texts: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, any others) with lang_pred and score, the cosine with the nearest profile (0 at least).

    Profiles go to all tasks (8 kB each); more than ``most_languages`` of them are an error, none is left out. Ties
    go to the smaller name. Null texts, texts without a letter and all texts where no language was learned are ``und``
    with score 0. Very long texts are read in parts. An empty table gives no rows.
    """
    learned = profiles.where(F.col("n") >= least_texts).select("lang", "profile").limit(most_languages + 1).collect()
    if len(learned) > most_languages:
        raise ValueError(f"more than {most_languages} languages: clean the column of languages or raise most_languages")
    learned.sort(key=lambda r: r["lang"])
    names = np.array([r["lang"] for r in learned] or ["und"], object)
    table = unit(np.array([r["profile"] for r in learned] or [[0] * DIMENSIONS], np.float64))
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in groups(batches, "text"):
            vectors, lettered = bundle(group, table.shape[1])
            cosines = np.round(unit(vectors) @ table.T, 12)
            best = cosines.argmax(1)
            score = np.where(lettered, np.clip(cosines[np.arange(len(group)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(np.where(lettered, names[best], "und").tolist(), pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def predict_held_out(docs: DataFrame, parts: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; rows whose crc32(doc_id) is 0 mod ``parts`` teach nothing.

    A null doc_id is not held out, and teaches. Repeated rows are rows of their own. Other columns are not looked at.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text", "lang")
    profiles = materialize(language_profiles(rows.where(~F.col("held_out"))), "language-profiles")
    return identify_languages(rows.select("doc_id", "held_out", "text"), profiles)
