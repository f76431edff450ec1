"""Byte-level BPE encoding and decoding with contiguous rank arrays."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, texts

#: Words of up to so many bytes are merged over contiguous rank arrays, longer ones with a heap of ranks.
SHORT = 160
#: Words whose tokens a task remembers; it starts anew beyond that.
REMEMBERED = 250_000

#: Fixed value: the pattern that splits text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by the public byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        cut = spec.get("pre_tokenizer") or {}
        odd_tokens = [t["content"] for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
        if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or odd_tokens:
            raise ValueError("only byte-level vocabularies without normaliser, prefix space and options of added tokens are supported")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token_bytes = {i: raw(t) for t, i in vocab.items()}
        self.first = [vocab[c] for c in sorted(letters, key=letters.get)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [self.first[b] for b in data]
        if len(ids) > SHORT:
            return self.merge_long(ids)
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            at = ranks.index(low)
            ids[at] = merged[low]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | ids[at], NEVER)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 32 | ids[at + 1], NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order with a heap and links, so that the work stays near-linear."""
        get, n = self.ranks.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := get(ids[x] << 32 | ids[y], NEVER)) < NEVER:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def pack(self, word: str) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        data = np.array(self.merge(word.encode("utf-8", "replace")), "<u4").tobytes()
        if len(word) <= SHORT:
            self.known[word] = data
        return data

    def plain(self, text: str) -> bytes:
        known, words = self.known, self.words(text)
        found = list(map(known.get, words))
        if None in found:
            found = [known.get(w) or self.pack(w) if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers; added tokens are cut out first."""
        if not self.special or not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.plain(text[at:m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: list = []


def codec_of(source) -> Codec:
    """The codec of a broadcast vocabulary, built once for each Python worker."""
    if not _CODECS or _CODECS[0] is not source:
        _CODECS[:] = [source, Codec(source.value)]
    return _CODECS[1]


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver; its size is that of the file (some MB), whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with token_ids (binary: little-endian unsigned 32-bit integers) of the whole text, all columns kept.

    Ids equal those of the tokenizers library for the same file without added special tokens, truncation or
    padding; strings of added tokens inside a text are single tokens.

    Defined cases: null and empty texts give no ids; repeated rows are encoded each; an existing column named
    token_ids is replaced; an empty table gives an empty result.
    """
    source = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches):
        codec = codec_of(source)
        for piece, rows in texts(batches, text):
            ids = pa.array([codec.encode(t) for t in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*piece.columns, ids], [*piece.schema.names, "token_ids"])

    rest = docs.drop("token_ids")
    return map_batches(rest, run, rest.withColumn("token_ids", F.lit(None).cast("binary")).schema)


def encode_and_check(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip, token_ids) per row of ``docs`` (doc_id, text).

    One pass encodes and decodes; round_trip tells whether the whole text came back. Cases as for ``encode``.
    """
    source = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches):
        codec = codec_of(source)
        for piece, rows in texts(batches):
            ids = [codec.encode(t) for t in rows]
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([codec.decode(x) == t for x, t in zip(ids, rows, strict=True)]), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids_sha256", "round_trip", "token_ids"])

    rows = docs.select("doc_id", "text")
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, round_trip boolean, token_ids binary")


def decode(encoded: DataFrame, path: str, to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its token_ids in column ``to``; special tokens stay, null ids give null."""
    source = broadcast_vocabulary(encoded.sparkSession, path)

    def run(batches):
        codec = codec_of(source)
        for batch in batches:
            if batch.num_rows:
                out = pa.array([None if x is None else codec.decode(x) for x in batch.column("token_ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, to])

    rest = encoded.drop(to)
    return map_batches(rest, run, rest.withColumn(to, F.lit(None).cast("string")).schema)


def round_trip_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: encodes each whole text and decodes it again."""
    source = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches):
        codec = codec_of(source)
        for piece, rows in texts(batches):
            ids = [codec.encode(t) for t in rows]
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
