"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_batches, materialize, texts

#: Unused positions before each document, so that no phrase or near match runs from one into another.
GAP = 64
#: Bytes of text of a shard, and windows that one task searches a shard for, about.
SHARD_BYTES, CHUNK = 8 << 20, 100_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed byte planes of their differences, which are small inside a list of positions."""
    planes = np.diff(numbers.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u4").ravel(), dtype=np.uint32).astype(np.int64)


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of ``docs``: a row per shard with the postings of all its terms.

    A shard is a bounded run of rows of one partition. It holds the ids and word counts of its rows, its terms in
    order with the sorted positions of each, and for routing the hash and count of each term. The index knows nothing
    of any benchmark: written once, it serves all.
    """

    def run(batches):
        for piece, rows in texts(batches, most=SHARD_BYTES):
            each = [words_of(t) for t in rows]
            n = np.fromiter(map(len, each), np.int64, len(each))
            begin = GAP + np.concatenate(([0], np.cumsum(n + GAP)[:-1]))
            number: dict[bytes, int] = {}
            terms = np.fromiter((number.setdefault(w, len(number)) for x in each for w in x), np.int32, int(n.sum()))
            at = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(terms))
            order = np.argsort(terms, kind="stable")
            counts = np.bincount(terms, minlength=len(number))
            yield pa.RecordBatch.from_pydict({
                "shard": [uuid.uuid4().hex], "ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(piece.column("doc_id").type)), "n_words": [n.tolist()], "starts": [squeezed(begin)],
                "terms": [zstandard.ZstdCompressor(level=1).compress(b" ".join(number))], "hashes": [[term_hash(w) for w in number]], "counts": pa.array([counts.tolist()], pa.list_(pa.int32())), "own_counts": [squeezed(counts)], "positions": [squeezed(at[order])]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"shard string, ids array<{kind}>, n_words array<long>, starts binary, terms binary, hashes array<long>, counts array<int>, own_counts binary, positions binary")


class Shard:
    """One row of the index, ready to be searched."""

    def __init__(self, starts: bytes, n_words: list, terms: bytes, counts: bytes, positions: bytes):
        self.starts, self.n_words = unsqueezed(starts), np.array(n_words, np.int64)
        self.counts, self.positions = unsqueezed(counts), unsqueezed(positions)
        self.number = {t: k for k, t in enumerate(zstandard.ZstdDecompressor().decompress(terms).split(b" "))} if len(self.counts) else {}
        self.first = np.cumsum(self.counts) - self.counts
        self.span = int((self.starts + self.n_words).max(initial=0)) + 2 * GAP
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.span + self.positions

    def table(self, windows: list[list[bytes]], size: int) -> np.ndarray:
        """Term numbers, a row for each window, -1 beyond its length and -2 for terms that are not here."""
        out = np.full((len(windows), size), -1, np.int64)
        for k, w in enumerate(windows):
            out[k, :len(w)] = [self.number.get(t, -2) for t in w]
        return out

    def search(self, table: np.ndarray, lengths: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all places where each term stands within ``slop`` words of its place in the window.

        Lists are intersected from the rarest term on, with all windows at once.
        """
        live = np.flatnonzero((table != -2).all(axis=1)) if len(self.counts) else []
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        count = np.where(table >= 0, self.counts[np.maximum(table, 0)], np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")
        rare = order[live, 0]
        n = count[live, rare]
        which = np.repeat(live, n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[np.repeat(self.first[table[live, rare]], n) + offset] - np.repeat(rare, n)
        if slop:  # the rarest term may itself stand off its place
            shifts = np.arange(-slop, slop + 1)
            which, start = np.repeat(which, len(shifts)), (start[:, None] + shifts).ravel()
        for k in range(1, table.shape[1]):
            place = order[which, k]
            more = place < lengths[which]
            base = np.maximum(table[which, place], 0) * self.span + start + place
            low = np.searchsorted(self.keys, base - slop, "left")
            high = np.searchsorted(self.keys, base + slop, "right")
            ok = (high > low) | ~more
            which, start = which[ok], start[ok]
        return which, start


def benchmark_windows(benchmark: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """(window, terms, items, number): the distinct windows of all items with the hashes of their terms."""

    def run(batches):
        for piece, rows in texts(batches):
            out: dict[tuple, None] = {}
            for key, t in zip(piece.column("item").to_pylist(), rows, strict=True):
                own = words_of(t)
                out |= {(b" ".join(own[i:i + size]), key): None for i in range(max(1, len(own) - size + 1)) if own}
            hashes = [sorted({term_hash(t) for t in w.split(b" ")}) for w, _ in out]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array([k for _, k in out], pa.string())], ["window", "terms", "item"])

    rows = map_batches(benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")), run, "window binary, terms array<long>, item string")
    items = F.array_distinct(F.collect_list(F.struct("item")))
    return rows.groupBy("window").agg(F.any_value("terms").alias("terms"), items.alias("items")).withColumn("number", F.monotonically_increasing_id())


def routed(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(shard, number): each window goes to the shards that hold its rarest term, if all its terms are indexed."""
    asked = windows.select("number", F.explode("terms").alias("h"))
    postings = index.select("shard", F.explode(F.arrays_zip("hashes", "counts")).alias("p")).select("shard", F.col("p.hashes").alias("h"), F.col("p.counts").alias("n"))
    postings = materialize(postings.join(asked.select("h").distinct(), "h", "left_semi"), "positions-asked")
    often = postings.groupBy("h").agg(F.sum("n").alias("often"))
    rarest = asked.join(often, "h", "left").groupBy("number").agg(F.min(F.struct("often", "h"))["h"].alias("h"), F.bool_and(F.col("often").isNotNull()).alias("all_there")).where("all_there")
    return rarest.select("number", "h").join(postings.select("h", "shard"), "h").select("shard", "number")


def search_index(index: DataFrame, windows: DataFrame, size: int, slop: int) -> DataFrame:
    """(shard, place, spans, items, near) of the documents with matches: merged spans of words and lists of items.

    ``place`` is the number of the document in its shard, items and near hold structs of the item ids with exact and
    with near matches. A task searches one shard for at most about CHUNK windows.
    """
    pairs = materialize(routed(index, windows), "positions-routed")
    parts = pairs.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = pairs.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("number"), F.col("parts")))
    lists = dealt.join(windows.select("number", "window", "items"), "number").groupBy("shard", "part").agg(F.collect_list(F.struct("window", "items")).alias("asked"))
    lists = materialize(lists, "positions-lists")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: E731, B023
                shard, asked = Shard(get("starts"), get("n_words"), get("terms"), get("own_counts"), get("positions")), get("asked")
                words = [x["window"].split(b" ") for x in asked]
                table, lengths = shard.table(words, size), np.array([len(w) for w in words], np.int64)
                exact, near = {}, {}
                which, start = shard.search(table, lengths, 0)
                place = np.searchsorted(shard.starts, start, "right") - 1
                for doc, w, a in zip(place.tolist(), which.tolist(), start.tolist(), strict=True):
                    spans, items = exact.setdefault(doc, ([], set()))
                    spans.append((a - int(shard.starts[doc]), a - int(shard.starts[doc]) + len(words[w])))
                    items.update(x["item"] for x in asked[w]["items"])
                if slop:
                    which, start = shard.search(table, lengths, slop)
                    for doc, w in set(zip((np.searchsorted(shard.starts, start + slop, "right") - 1).tolist(), which.tolist(), strict=True)):
                        near.setdefault(doc, set()).update(x["item"] for x in asked[w]["items"])
                own = sorted(exact.keys() | near.keys())
                listed = lambda ids: [{"item": i} for i in sorted(ids, key=str)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([get("shard")] * len(own), pa.string()), pa.array(own, pa.int32()),
                    pa.array([[{"a": a, "b": b} for a, b in union_of(exact[d][0])] if d in exact else [] for d in own], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    *[pa.array([listed(x) for x in found], pa.list_(pa.struct([("item", pa.string())]))) for found in ([exact[d][1] if d in exact else () for d in own], [near.get(d, ()) for d in own])]],
                    ["shard", "place", "spans", "items", "near"])

    wanted = index.select("shard", "starts", "n_words", "terms", "own_counts", "positions").join(lists, "shard")
    kind = "array<struct<item:string>>"
    found = map_batches(wanted, run, f"shard string, place int, spans array<struct<a:bigint,b:bigint>>, items {kind}, near {kind}")
    return found.groupBy("shard", "place").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items", "near")])


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def covered(spans):
    """Words inside an array of half-open spans (a, b), each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda x, s: F.struct(F.greatest(x["end"], s["b"]).alias("end"), (x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(x["end"], s["a"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda x: x["n"])


def match_index(index: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 2, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_items, n_near_items, contaminated) per indexed row; see ``contamination``."""
    windows = materialize(benchmark_windows(benchmark, size, item_id, item_text), "positions-windows")
    found = materialize(search_index(index, windows, size, slop), "positions-found")
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("place", "d")).select("shard", "place", F.col("d.ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    items = F.coalesce(F.array_sort(F.filter(F.transform("items", lambda x: x["item"]), lambda x: x.isNotNull())), F.array().cast("array<string>"))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    return rows.join(found, ["shard", "place"], "left").select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"), count("items").alias("n_items"), count("near").alias("n_near_items"), (n_hit > 0).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_items, n_near_items, contaminated) for every row of ``docs``.

    A window is ``size`` consecutive words of an item (an item of fewer words, but not none, is one window). A word
    of a document is hit if it lies inside any occurrence of a window; items are those with occurring windows, and
    n_near_items counts items with a window whose terms all stand within ``slop`` words (at most 16) of their places.

    Both tables stay distributed: windows are joined to the shards of the index that hold their rarest term.

    Defined cases: null and empty texts have no words and no hits; an item without words matches nothing; repeated
    rows of documents come out once each, repeated items count once; a null item_id counts in n_items but is not
    listed; a null doc_id keeps its row; other columns are ignored; an empty benchmark leaves every row clean.
    """
    if not 0 <= slop <= 16:
        raise ValueError("slop must lie between 0 and 16")
    return match_index(materialize(build_index(docs, doc_id, text), "positions"), benchmark, size, slop, item_id, item_text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` (text, ...) without any word inside an occurrence of a benchmark window; all columns stay.

    Defined cases: a row goes or stays by its own text, whatever its id, null or repeated; null and empty texts stay;
    repeated rows stay or go together; an empty table stays empty.
    """
    key = free_name(docs, "text_key")
    marked = docs.withColumn(key, F.md5("text"))
    bad = contamination(marked, benchmark, size, slop=0, doc_id=key).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return marked.join(bad, key, "left_anti").select(*docs.columns)


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
