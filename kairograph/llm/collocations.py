"""Phrase collocations by vertical positional inverted lists.

The corpus is cut into shards of neighbouring texts. A shard keeps, for each word, the list of its positions; pieces of
text are parted by a free position, so a phrase never crosses them. The occurrences of a frequent phrase are merge-joined
with the postings of the words right behind it, which gives the lists of the phrases that are longer by one word; the
lengths of these lists, summed over all shards, are exact frequencies. Shards send their list lengths packed by
buckets of phrases, and get back which of them are frequent; lists never leave their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, places, texts

#: Words of a shard; a text is never cut, so a longer one is a longer shard.
SHARD_WORDS = 1 << 20
#: Words of the corpus for each bucket of phrases.
BUCKET_WORDS = 1 << 19
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of a text as they are cut: small letters, a line feed for every end of a piece, a space between words.
_BYTES = bytes.maketrans(_LETTERS + _BREAKS + b"\t", _LETTERS.lower() + b"\n" * len(_BREAKS) + b" ")
_READ = 1 << 22
#: Parts of a language that are ranked before the whole.
_PARTS = 64


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, best in rising order, as compressed differences."""
    return zstandard.ZstdCompressor(3).compress(np.diff(numbers.astype(np.int64), prepend=0).tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64))


class Numbers(dict):
    """Numbers of the words of one language in a shard, given at first sight; ``names`` is shared by all languages."""

    def __init__(self, lang: str, names: list):
        super().__init__({b"\n": 0, b"": -1})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append((self.lang, word))
        return number


def numbered(text: str, numbers: Numbers) -> list[np.ndarray]:
    """The words of a text by number, 0 where a piece ends."""
    data, found, start = text.encode("utf-8", "surrogatepass").translate(_BYTES), [], 0
    while start < len(data):
        end = data.find(b" ", start + _READ)
        end = len(data) if end < 0 else end
        tokens = data[start:end].replace(b"\n", b" \n ").split(b" ")
        own = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        found.append(own[own >= 0])
        start = end + 1
    return [*found, np.zeros(1, np.int32)]


def read_shards(docs: DataFrame, shard_words: int) -> DataFrame:
    """(shard, no, lang, word, n, lengths, positions): a row for each word of a shard, and one (no = 0) with its lists.

    ``lengths`` has the list lengths of the words 1, 2, … and ``positions`` their lists, one after the other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0
        names, by_lang, held, size = [None], {}, [], 0

        def flush() -> pa.RecordBatch:
            at = np.concatenate(held)
            lengths = np.bincount(at, minlength=len(names))
            lists = np.argsort(at, kind="stable")[lengths[0] :]
            rows = len(names)
            return pa.RecordBatch.from_pydict({
                "shard": np.full(rows, base + count), "no": np.arange(rows, dtype=np.int32), "lang": [None, *(lang for lang, _ in names[1:])],
                "word": [None, *(word.decode("utf-8", "surrogatepass") for _, word in names[1:])], "n": lengths,
                "lengths": [pack(lengths[1:]), *[None] * (rows - 1)], "positions": [pack(lists), *[None] * (rows - 1)]}, kind)

        for batch, group in texts(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), group, strict=True):
                if lang not in by_lang:
                    by_lang[lang] = Numbers(lang, names)
                own = numbered(text, by_lang[lang])
                held += own
                size += sum(map(len, own))
                if size >= shard_words:
                    yield flush()
                    count, names, by_lang, held, size = count + 1, [None], {}, [], 0
        if held:
            yield flush()

    kind = pa.schema([("shard", pa.int64()), ("no", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("lengths", pa.binary()), ("positions", pa.binary())])
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return materialize(rows.mapInArrow(run, "shard long, no int, lang string, word string, n long, lengths binary, positions binary"), "collocation-shards")


def by_position(ids: np.ndarray, lengths: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ids) in rising position from lists; a negative id leaves its list out."""
    ids = np.repeat(ids, lengths)
    kept = ids >= 0
    positions, ids = positions[kept], ids[kept]
    order = np.argsort(positions)
    return positions[order], ids[order]


def by_id(positions: np.ndarray, ids: np.ndarray) -> dict[str, bytes]:
    """The lists of (positions, ids), packed."""
    order = np.argsort(ids, kind="stable")
    own, lengths = np.unique(ids, return_counts=True)
    return {"ids": pack(own), "lengths": pack(lengths), "positions": pack(positions[order])}


def from_lists(lists: dict | None) -> tuple[np.ndarray, np.ndarray] | None:
    return lists and by_position(unpack(lists["ids"]), unpack(lists["lengths"]), unpack(lists["positions"]))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found): where ``keys`` stand in ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def extend(phrases: tuple, words: tuple, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys): occurrences of phrases of ``k`` words merge-joined with the postings right behind them.

    A key is phrase * ``size`` + word, with ``size`` frequent words.
    """
    at, behind = find(words[0], phrases[0] + k)
    if len(phrases[1]) and (int(phrases[1].max()) + 1) * size >= 1 << 63:
        raise OverflowError("too many frequent phrases and words for a number of 64 bits")
    return phrases[0][behind], phrases[1][behind] * size + words[1][at[behind]]


_LISTS = "struct<ids:binary,lengths:binary,positions:binary>"
_EXTENDED = f"shard long, bucket int, keys binary, counts binary, words {_LISTS}, phrases {_LISTS}"


def longer(k: int, size: int, buckets: int):
    """The cogrouped step from frequent phrases of ``k`` - 1 words to candidates of ``k`` + 1, for one shard.

    Left is the shard's state, right what is frequent of what it sent. Gives the list lengths of the candidates by
    buckets and, where a longer step follows, the state that it needs (bucket -1).
    """
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c.name: pa.array([], c.type) for c in kind}, schema=kind)
        state = left.to_pylist()[0]
        if k == 1:
            lengths = unpack(state["lengths"])
            ids = np.full(len(lengths) + 1, -1, np.int64)
            ids[right.column("no").to_numpy()] = right.column("id").to_numpy()
            words = phrases = by_position(ids[1:], lengths, unpack(state["positions"]))
        else:
            words = from_lists(state["words"])
            shorter = from_lists(state["phrases"]) or words
            keys = np.concatenate([unpack(x) for x in right.column("keys").to_pylist()])
            ids = np.concatenate([unpack(x) for x in right.column("ids").to_pylist()])
            order = np.argsort(keys)
            positions, own = extend(shorter, words, k - 1, size)
            at, frequent = find(keys[order], own)
            phrases = positions[frequent], ids[order][at[frequent]]
        positions, own = extend(phrases, words, k, size)
        _, suffix = find(phrases[0], positions + 1)  # a frequent phrase ends in a frequent one
        positions, own = positions[suffix], own[suffix]
        keys, counts = np.unique(own, return_counts=True)
        to = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(to, kind="stable")
        used, starts = np.unique(to[order], return_index=True)
        rows = [{"shard": key[0].as_py(), "bucket": b, "keys": pack(keys[own]), "counts": pack(counts[own])} for b, own in zip(used.tolist(), np.split(order, starts[1:]), strict=True)] if len(used) else []
        if k < 3 and rows:
            kept = np.isin(words[0], np.concatenate([positions + k, positions + k + 1]))
            starts = np.isin(phrases[0], positions)
            single = by_id(words[0], words[1]) if k == 1 else by_id(words[0][kept], words[1][kept])
            rows.append({"shard": key[0].as_py(), "bucket": -1, "words": single, "phrases": None if k == 1 else by_id(phrases[0][starts], phrases[1][starts])})
        return pa.Table.from_pylist(rows, schema=kind)

    lists = pa.struct([("ids", pa.binary()), ("lengths", pa.binary()), ("positions", pa.binary())])
    kind = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", lists), ("phrases", lists)])
    return run


def count_lists(extended: DataFrame, least: int, buckets: int) -> DataFrame:
    """(shard, keys, ids, counts): what is frequent, packed, for each shard that holds it, and once with shard -1.

    A phrase is one entry of a shard, so a bucket holds a frequent phrase no more often than there are shards.
    """
    def run(key: tuple, sent: pa.Table) -> pa.Table:
        bucket, shards = key[0].as_py(), sent.column("shard").to_pylist()
        keys = [unpack(x) for x in sent.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x) for x in sent.column("counts").to_pylist()])
        ends = np.cumsum([len(x) for x in keys])
        own, place = np.unique(np.concatenate(keys), return_inverse=True)
        order = np.argsort(place, kind="stable")
        sums = np.add.reduceat(counts[order], np.searchsorted(place[order], np.arange(len(own))))
        ids = np.where(sums >= least, (np.cumsum(sums >= least) - 1) * buckets + bucket, -1)
        rows = [(-1, own[ids >= 0], ids[ids >= 0], sums[ids >= 0])]
        for shard, at in zip(shards, np.split(place, ends[:-1]), strict=True):
            at = at[ids[at] >= 0]
            rows.append((shard, own[at], ids[at], sums[at]))
        return pa.Table.from_pylist([{"shard": s, "keys": pack(x), "ids": pack(y), "counts": pack(z)} for s, x, y, z in rows if len(x)], schema=kind)

    kind = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
    sent = extended.where("bucket >= 0").select("bucket", "shard", "keys", "counts")
    return materialize(sent.groupBy("bucket").applyInArrow(run, "shard long, keys binary, ids binary, counts binary"), "collocation-counts")


def unfolded(counted: DataFrame, size: int) -> DataFrame:
    """(id, head, tail, f): every frequent phrase with the phrase and the word it is made of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                head, tail = np.divmod(unpack(row["keys"]), size)
                yield pa.RecordBatch.from_pydict({"id": unpack(row["ids"]), "head": head, "tail": tail, "f": unpack(row["counts"])})

    return counted.where("shard < 0").mapInArrow(run, "id long, head long, tail long, f long")


def frequent_phrases(docs: DataFrame, least: int = 30, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to 4 words that occur ``least`` times, and (lang, n) of all languages."""
    read = read_shards(docs, shard_words)
    words = read.where("no > 0")
    counts = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "collocation-words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    single = counts.where(F.col("f") >= least).withColumn("tree", F.lit(""))
    single = materialize(places(single, "tree", ["lang", "word"]).select(F.col("pos").alias("id"), "lang", F.col("word").alias("phrase"), "f"), "collocation-phrases")
    size = max(1, single.count())
    buckets = -(-int(counts.agg(F.coalesce(F.sum("f"), F.lit(1))).first()[0]) // BUCKET_WORDS)
    state = read.where("no = 0").select(F.col("shard").alias("home"), "lengths", "positions")
    frequent = words.join(single.withColumnRenamed("phrase", "word"), ["lang", "word"]).select("shard", "no", "id")
    found, last = single.withColumn("words", F.lit(1)), single
    for k in (1, 2, 3):
        extended = materialize(state.groupBy("home").cogroup(frequent.groupBy("shard")).applyInArrow(longer(k, size, buckets), _EXTENDED), "collocation-lists")
        counted = count_lists(extended, least, buckets)
        state, frequent = extended.where("bucket < 0").select(F.col("shard").alias("home"), "words", "phrases"), counted.where("shard >= 0").select("shard", "keys", "ids")
        head = last.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first"))
        tail = single.select(F.col("id").alias("tail"), F.col("phrase").alias("second"))
        last = unfolded(counted, size).join(head, "head").join(tail, "tail").select("id", "lang", F.concat_ws(" ", "first", "second").alias("phrase"), "f")
        last = materialize(last, "collocation-phrases")
        found = found.union(last.withColumn("words", F.lit(k + 1)))
    return found.select("lang", "phrase", "words", "f"), totals


def exact(c: str, digits: int = 20):
    return F.col(c).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, most: int = 2000, least: int = 30, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of 2 to 4 words of each language.

    A is the frequency of the phrase, l and r those of its parts at the cut of the lowest score floor(2000000 a /
    (l + r)), n the words of the language. A phrase inside a longer one that has 80 % of its frequency is left out.

    Null languages are ``und``; null and empty texts have no words; repeated rows count again; ties of the score go to
    the smaller cut, ties of rank to the more frequent, then the smaller phrase in UTF-8 bytes. Texts of any length
    are read whole. Tables without a phrase of ``least`` occurrences give no rows. Other columns are not looked at.
    """
    found, totals = frequent_phrases(docs, least, shard_words)
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("often"))
    phrases = found.where("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    piece = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": piece(F.lit(1), F.col("k")), "rest": piece(F.col("k") + 1, F.col("words") - F.col("k"))})
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr("cast(cast(2000000 AS decimal(7,0)) * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0))) AS bigint)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("best"))
    inner = F.explode(F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), s -> array_join(slice(w, s, n), ' '))))"))
    within = phrases.where("words > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.select("lang", "phrase", "best.*").join(within, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (exact("longer") * F.lit(100) < exact("a") * F.lit(80)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))  # the first of each part first, so that the last task of a language sees few rows
    best = kept.withColumn("place", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= most).drop("place")
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
