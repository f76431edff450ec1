"""Near-duplicates by SimHash and generalised pigeonhole search in Hamming space."""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, free_name, map_batches, materialize, texts

BITS, SEED = 64, 42
#: Fingerprints that are looked at to choose partitions and thresholds; they decide the speed, never the result.
PLAN_SAMPLE = 2000

#: Runs of up to 255 hashes that are counted at once; a run takes 16 KB.
STEP = 256

#: SPREAD[b] holds the bits of byte b as eight counters of one byte each.
SPREAD = np.zeros(256, dtype="<u8")
for _b in range(8):
    SPREAD |= np.where(np.arange(256) >> _b & 1, np.uint64(1 << (8 * _b)), np.uint64(0))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every word shingle of the whole text; fewer words: the whole sequence; none: nothing."""
    data = b" ".join(text.encode("utf-8", "replace").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) < words:
        return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    first = [0, *(gaps + 1).tolist()]
    last = [*gaps.tolist(), len(data)]
    found = map(xxhash.xxh64_intdigest, map(data.__getitem__, map(slice, first, last[words - 1:])), repeat(SEED))
    return np.fromiter(found, np.uint64, len(last) - words + 1)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``sizes`` hashes: the 64-bit words of the bits set in over half of a group."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    cuts = np.concatenate([np.arange(b, b + s, 255) for b, s in zip(begin.tolist(), sizes[full].tolist(), strict=True)])
    parts = np.empty((len(cuts), BITS), dtype=np.uint8)
    for at in range(0, len(cuts), STEP):
        own = cuts[at:at + STEP]
        end = cuts[at + STEP] if at + STEP < len(cuts) else len(hashes)
        spread = SPREAD[hashes[own[0]:end].view(np.uint8).reshape(-1, 8)]
        parts[at:at + STEP] = np.add.reduceat(spread, own - own[0], axis=0).view(np.uint8).reshape(-1, BITS)
    counts = np.add.reduceat(parts, np.searchsorted(cuts, begin), axis=0, dtype=np.int64)
    set_ = counts * 2 > sizes[full][:, None]
    out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, fp: long) per row."""

    def run(batches):
        for piece, rows in texts(batches, most=2 << 20):
            each = [shingle_hashes(t, words) for t in rows]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.concatenate(each)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(majority_bits(flat, sizes).view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def as_bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` equal partitions so that correlated bits stand together."""
    p = bits.T @ bits / max(len(bits), 1)
    one = np.diag(p)
    sd = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    corr = np.abs((p - np.outer(one, one)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (corr[b, own].sum(), -b)))
            free.remove(own[-1])
        groups.append(sorted(own))
    return groups


def thresholds(sample: np.ndarray, n: int, groups: list[list[int]], most: int) -> tuple[float, list[int]]:
    """Thresholds that add up to ``most - parts + 1`` at the least estimated cost, by dynamic programming.

    A pair within ``most`` bits differs by at most its threshold in some partition; -1 leaves a partition out.
    """
    bits = as_bits(sample).astype(np.float32)
    m, n = max(len(bits), 2), max(n, 1000)
    cost = []
    for g in groups:
        x = bits[:, g]
        differ = x.sum(1)[:, None] + x.sum(1)[None, :] - 2 * (x @ x.T)
        own = [0.0]
        for t in range(most + 1):
            near = (float((differ <= t + 0.5).sum()) - m) / (m * (m - 1))
            random = sum(comb(len(g), i) for i in range(t + 1)) / 2.0 ** len(g)
            own.append(3.0 * n * (1 + sum(comb(len(g), i) for i in range(t + 1))) + 0.2 * n * n * max(near, random))
        cost.append(own)
    total = most - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for at, (c, chosen) in best.items():
            for t in range(-1, most + 1):
                if (key := at + t) not in step or c + own[t + 1] < step[key][0]:
                    step[key] = (c + own[t + 1], [*chosen, t])
        best = step
    return best[total]


def plan(fps: DataFrame, most: int) -> list[tuple[list[int], int]]:
    """The partitions of the bits with their thresholds, from a sample of fingerprints and the number of all."""
    n = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).select("fp").collect()], dtype=np.int64)
    bits, found = as_bits(sample).astype(float), []
    for parts in range(1, most + 2):
        groups = group_bits(bits, parts)
        found.append((*thresholds(sample, n, groups, most), groups))
    _, chosen, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(bits) -> int:
    return signed(sum(1 << b for b in bits))


def near_pairs(groups: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(fp, low, c) of distinct fingerprints ``groups`` (fp, low, n), and (a, b, ca, cb) of those near across centres.

    By generalised pigeonhole search within ``most`` bits: c is the centre, itself if there is none. First each fingerprint that is near the most copied one of a bucket of equal bits takes it as its centre, which
    leaves linear work for a bucket of near copies; the probe join then looks only for links between fingerprints of
    different centres.
    """
    parts = plan(groups, most)
    differ = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    masks = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(mask_of(g)).cast("long").alias("mask"), F.array(*[F.lit(mask_of(c)).cast("long") for k in range(t + 1) for c in combinations(g, k)]).alias("flips")) for i, (g, t) in enumerate(parts)])
    key = F.col("fp").bitwiseAND(F.col("p.mask"))
    rows = groups.select("fp", "n", F.explode(masks).alias("p")).select("fp", "n", F.col("p.part").alias("part"), key.alias("key"))
    top = rows.groupBy("part", "key").agg(F.max(F.struct("n", "fp"))["fp"].alias("top"), F.count("*").alias("size")).where("size > 1")
    centres = rows.join(top, ["part", "key"]).where((F.col("fp") != F.col("top")) & (differ("fp", "top") <= most)).groupBy("fp").agg(F.min("top").alias("top"))
    known = materialize(groups.join(centres, "fp", "left").select("fp", "low", F.least("fp", "top").alias("c")), "simhash-centres")
    data = known.select(F.col("fp").alias("b"), F.col("c").alias("cb"), F.explode(masks).alias("p")).select("b", "cb", F.col("p.part").alias("part"), F.col("b").bitwiseAND(F.col("p.mask")).alias("key"))
    probes = known.select(F.col("fp").alias("a"), F.col("c").alias("ca"), F.explode(masks).alias("p")).select("a", "ca", F.col("p.part").alias("part"), F.explode("p.flips").alias("flip"), F.col("a").bitwiseAND(F.col("p.mask")).alias("key"))
    probes = probes.select("a", "ca", "part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    return known, probes.join(data, ["part", "key"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (differ("a", "b") <= most))


def near_components(groups: DataFrame, most: int) -> DataFrame:
    """(fp, component_id) over distinct fingerprints ``groups`` (fp, low, n), linked within ``most`` bits over centres."""
    known, across = near_pairs(groups, most)
    comps = connected_components(across.select(F.col("ca").alias("src"), F.col("cb").alias("dst")), "simhash-components")
    lows = known.groupBy("c").agg(F.min("low").alias("low")).join(comps, F.col("c") == F.col("node"), "left").select("c", "low", F.coalesce("component", "c").alias("component"))
    named = lows.groupBy("component").agg(F.min("low").alias("component_id")).join(lows.select("c", "component"), "component")
    return known.select("fp", "c").join(named.select("c", "component_id"), "c").select("fp", "component_id")


def simhash_components(docs: DataFrame, words: int = 5, max_bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate components: (doc_id, fingerprint, component_id) for every row of ``docs``.

    Words are runs of anything but ASCII white space after lower-casing A-Z; shingles of ``words`` words, repeats
    included, are hashed with XXH64 (seed 42); a bit is set if it is in over half the hashes. Rows link when their
    fingerprints differ in at most ``max_bits`` bits; component_id is the smallest doc_id reachable.

    Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle
    hash as one sequence; repeated rows come out once for each row; a null doc_id keeps its row and takes part in
    links, but names no component (null if all ids of a component are null); other columns are ignored; an empty
    table gives an empty result.
    """
    fps = materialize(fingerprints(docs, words, doc_id, text), "simhash-fp")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-groups")
    return fps.join(near_components(groups, max_bits), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of the long signature that similarity search works on, and its bits.
WORDS, LONG_BITS = 4, 256
#: Bits of the first word that may differ for the pigeonhole search; what is similar beyond them the minima find.
NEAR_BITS = 4
#: Bits that may differ at a Jaccard similarity of s: the share acos(2s / (1 + s)) / pi of all, and so many standard
#: deviations. Sets of fewer than SMALL shingles are too uneven for that and go to the exact check in any case.
ROOM, SMALL = 5, 64
#: Keys of KEY_ROWS minima each: a pair of similarity s shares one with a probability of 1 - (1 - s^KEY_ROWS)^KEYS.
KEYS, KEY_ROWS = 24, 5
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, (KEYS, KEY_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: From this similarity to its hub on a set is described by what it has beyond the hub's.
BESIDE = 0.4
SLIP = 1e-9


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, name, size, s0 to s3, keys) per row, from the set of its distinct shingle hashes.

    ``name`` is a 128-bit digest of the set, s0 to s3 are fingerprints under four mixings of the hashes, ``keys`` hash
    minima under KEYS x KEY_ROWS multipliers (none for an empty set).
    """

    def run(batches):
        for piece, rows in texts(batches, most=1 << 20):
            each = [np.unique(shingle_hashes(t, words)) for t in rows]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.concatenate(each)
            name = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in each], pa.binary())
            long = [pa.array(majority_bits(mixed(flat + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)), sizes).view(np.int64)) for k in range(WORDS)]
            full = np.flatnonzero(sizes)
            begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            keys = np.zeros((len(full), KEYS), np.uint64)
            for k in range(KEYS if len(full) else 0):
                keys[:, k] = k
                for factor in FACTORS[k]:
                    keys[:, k] = mixed(keys[:, k] + np.minimum.reduceat(flat * factor, begin))
            ends = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), piece.column("text_key"), name, pa.array(sizes), *long,
                pa.ListArray.from_arrays(ends((sizes > 0) * KEYS), pa.array(keys.ravel().view(np.int64)))],
                ["doc_id", "text_key", "name", "size", *[f"s{k}" for k in range(WORDS)], "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_key"), "text")
    return map_batches(rows, run, "doc_id long, text_key string, name binary, size long, " + ", ".join(f"s{k} long" for k in range(WORDS)) + ", keys array<long>")


def may_link(a: str, b: str, similarity: float):
    """Whether two structs (size, s0 to s3) can be of this similarity by their sizes and, if not small, signatures."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = int(LONG_BITS * share + ROOM * np.sqrt(LONG_BITS * share * (1 - share)))
    differ = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(1, WORDS)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    low, high = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return (low >= similarity * high - SLIP) & ((low < SMALL) | (differ <= most))


def compared(pairs: DataFrame, groups: DataFrame, docs: DataFrame, words: int, least: float, name: str) -> DataFrame:
    """(a, b, sim, gone, new) of the pairs (a, b) of sets whose Jaccard similarity, by whole texts, is ``least`` or more.

    ``gone`` counts shingles of b that a lacks, ``new`` lists those of a that b lacks. The text of a set is that of
    its row (doc_id, text_key) in ``groups``.
    """
    pairs = materialize(pairs, name)
    used = groups.select("node", "doc_id", "text_key").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_key"), "text")
    own = rows.join(used, (rows["doc_id"] == used["doc_id"]) & rows["text_key"].eqNullSafe(used["text_key"])).groupBy("node").agg(F.any_value("text").alias("text"))
    own = materialize(own, name + "-texts")

    def run(batches):
        for batch in batches:
            found, last = [], {}
            for k, (a, b, x, y) in enumerate(zip(*(batch.column(c) for c in ("a", "b", "x", "y")), strict=True)):
                last = {n: last[n] if n in last else np.unique(shingle_hashes(t.as_py() or "", words)) for n, t in ((a.as_py(), x), (b.as_py(), y))}
                one, two = last[a.as_py()], last[b.as_py()]
                common = len(np.intersect1d(one, two, assume_unique=True))
                sim = common / max(1, len(one) + len(two) - common)
                if sim >= least - SLIP:
                    found.append((k, sim, len(two) - common, np.setdiff1d(one, two, assume_unique=True).view(np.int64)))
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("a").take(at), batch.column("b").take(at), pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.list_(pa.int64()))], ["a", "b", "sim", "gone", "new"])

    return map_batches(pairs.join(own.toDF("b", "y"), "b").join(own.toDF("a", "x"), "a").select("a", "b", "x", "y"), run, "a long, b long, sim double, gone long, new array<long>")


def near_sets(groups: DataFrame, most: int) -> DataFrame:
    """(a, b): sets (node, n, x) whose fingerprints s0 are within ``most`` bits, each linked to its centre at least.

    Sets of one fingerprint are linked to the first of them.
    """
    own = groups.where("x.size > 0").select("node", "n", F.col("x.s0").alias("fp"))
    fps = materialize(own.groupBy("fp").agg(F.min("node").alias("low"), F.sum("n").alias("n")), "simhash-set-fps")
    known, across = near_pairs(fps, most)
    first = fps.select("fp", "low")
    same = own.join(first, "fp").select(F.col("node").alias("a"), F.col("low").alias("b"))
    centre = known.where("fp <> c").select(F.col("low").alias("a"), "c").join(first.toDF("c", "b"), "c").select("a", "b")
    ends = across.select("a", "b").distinct().toDF("p", "q").join(first.toDF("p", "a"), "p").join(first.toDF("q", "b"), "q").select("a", "b")
    return same.where("a <> b").union(centre).union(ends)


def hubs_of(rows: DataFrame) -> DataFrame:
    """(node, hub): for each node of ``rows`` (node, n, key) the most central one within two steps over shared keys.

    Central is what has the most company in its keys, then the most copies; two rounds of maxima over keys spread it.
    """
    company = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(rows.join(company, "key"), "simhash-shared-keys")
    central = shared.groupBy("node").agg(F.struct(F.sum("size").alias("size"), F.max("n").alias("n"), F.col("node").alias("hub")).alias("h"))
    for _ in range(2):
        of_key = shared.join(central, "node").groupBy("key").agg(F.max("h").alias("h"))
        central = materialize(shared.select("node", "key").join(of_key, "key").groupBy("node").agg(F.max("h").alias("h")), "simhash-hubs")
    return central.select("node", F.col("h.hub").alias("hub"))


def open_pairs(state: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes in different components that can still be of this similarity.

    ``state`` has (node, c, hub, sim, over, less, new, x) for every node: its component, its hub with the similarity
    to it (null if under BESIDE), what it exceeds the link bound to the hub by, how many shingles more it lacks than
    it adds, those it adds, and its signature. Pairs of the same hub link only if they are about as far from it, and
    if one of them does not link to the hub itself, only if they add a common shingle or the other one is the smaller
    by what the first exceeds the bound; so the many texts around one hub are joined on what they add, not pairwise.
    """
    fields = ["node", "c", "hub", "sim", "over", "less"]
    left, right = (F.struct(*fields, "x.*").alias(k) for k in ("p", "q"))
    apart = (F.col("p.node") < F.col("q.node")) & (F.col("p.c") != F.col("q.c")) & may_link("p", "q", similarity)
    same = F.col("p.hub").eqNullSafe(F.col("q.hub")) & F.col("p.hub").isNotNull()
    level = F.abs(F.col("p.sim") - F.col("q.sim")) <= 1 - similarity + SLIP
    smaller = lambda a, b: similarity * F.col(f"{b}.less") + 1e-6 >= F.col(f"{a}.over")
    held = rows.join(state, "node")
    mixed_keys = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    held = materialize(rows.join(mixed_keys, "key", "left_semi").join(state.drop("new"), "node"), "simhash-open-keys")
    by_key = held.select("key", left).join(held.select("key", right), "key").where(apart & (~same | level & smaller("p", "q") & smaller("q", "p")))
    loose = state.where(F.col("sim").isNotNull()).groupBy("hub").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("hub")
    added = state.where(F.col("sim").isNotNull()).join(loose, "hub", "left_semi").withColumn("element", F.explode("new")).drop("new")
    common = added.groupBy("hub", "element").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select(F.col("hub").alias("h"), "element")
    added = materialize(added.withColumn("h", F.col("hub")).join(common, ["h", "element"], "left_semi"), "simhash-open-elements")
    by_element = added.select("h", "element", left).join(added.select("h", "element", right), ["h", "element"]).where(apart & level)
    return by_key.select("p.node", "q.node").union(by_element.select("p.node", "q.node")).toDF("a", "b").distinct()


def similar_rows(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Signature rows with their set's node, and (node, component_id) of every set; docs have no null doc_id."""
    sigs = materialize(signatures(docs, words).withColumn("row", F.monotonically_increasing_id()), "simhash-sig")
    own = F.struct("size", *[f"s{k}" for k in range(WORDS)]).alias("x")
    first = F.min(F.struct("doc_id", "text_key"))
    rest = ["size", *[f"s{k}" for k in range(WORDS)], "keys"]
    groups = sigs.groupBy("name").agg(F.min("row").alias("node"), first.alias("first"), F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in rest])
    groups = materialize(groups.select("name", "node", "first.*", "n", own, "keys"), "simhash-sets")
    rows = groups.where("x.size > 0").select("node", "n", F.explode("keys").alias("key"))
    hubs = hubs_of(rows)
    to_hub = hubs.where("node <> hub").toDF("a", "b")
    met = compared(near_sets(groups, NEAR_BITS).union(to_hub).distinct(), groups, docs, words, BESIDE, "simhash-first-pairs")
    met = materialize(met, "simhash-met")
    beside = met.join(to_hub, ["a", "b"], "left_semi")
    stars = connected_components(met.where(F.col("sim") >= similarity - SLIP).select(F.col("a").alias("src"), F.col("b").alias("dst")), "simhash-stars")
    size = F.col("x.size")
    hub_size = size - F.size("new") + F.col("gone")
    over = F.col("gone") + similarity * F.size("new") - (1 - similarity) * hub_size
    state = groups.select("node", "x").join(beside.withColumnRenamed("a", "node"), "node", "left").join(stars, "node", "left").join(hubs, "node", "left")
    is_hub = F.col("hub") == F.col("node")
    state = state.select(
        "node", "x", F.coalesce("component", "node").alias("c"), F.when(is_hub | F.col("sim").isNotNull(), F.col("hub")).alias("hub"), F.when(is_hub, 1.0).otherwise(F.col("sim")).alias("sim"),
        F.when(is_hub, -(1 - similarity) * size).otherwise(over).alias("over"), F.when(is_hub, 0).otherwise(F.col("gone") - F.size("new")).alias("less"), F.coalesce("new", F.array().cast("array<long>")).alias("new"))
    state = materialize(state, "simhash-state")
    pairs = open_pairs(state, rows.select("node", "key"), similarity)
    found = compared(pairs, groups, docs, words, similarity, "simhash-cross-pairs").select("a", "b")
    of = state.select("node", "c")
    ends = found.join(of.toDF("a", "src"), "a").join(of.toDF("b", "dst"), "b").select("src", "dst")
    comps = connected_components(ends, "simhash-similar").withColumnRenamed("node", "c")
    named = of.join(comps, "c", "left").select("node", F.coalesce("component", "c").alias("component"))
    lows = named.join(groups.select("node", "doc_id", "text_key"), "node").groupBy("component").agg(first.alias("low"))
    named = materialize(named.join(lows, "component").select("node", "low"), "simhash-named")
    return sigs.select("doc_id", "text_key", "name").join(groups.select("name", "node"), "name").drop("name"), named


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): components of documents whose sets of word shingles have this Jaccard similarity or more.

    Sets whose SimHash fingerprints are within NEAR_BITS bits are found by generalised pigeonhole search. For similar sets
    beyond these bits, sets that share a key of minima meet the most central of them, their hub, which is linear work for
    a group of near copies; what can still link across the components so far is proposed by ``open_pairs``. All similarities are
    exact, on whole texts. Only pairs that share none of KEYS keys (1 in 14,000 at 0.8) or differ by ROOM standard
    deviations of the signature can be missed.

    Defined cases: documents of equal sets (empty ones too) are of similarity 1; rows with a null doc_id are left out;
    different texts under one doc_id are different documents.
    """
    rows, named = similar_rows(docs.where("doc_id IS NOT NULL"), words, similarity)
    return rows.join(named, "node").select("doc_id", F.col("low.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The first row of each component of ``docs`` (doc_id, text, ...) by doc_id, then text digest; all columns stay.

    Components hold exact copies and documents of the given Jaccard similarity of word shingles or more.

    Defined cases: equal rows of a kept document collapse to one; different texts under one doc_id are different
    documents; rows without a doc_id stay; null and empty texts are copies of each other; an empty table stays empty.
    """
    rows, named = similar_rows(docs.where("doc_id IS NOT NULL"), words, similarity)
    kept = named.select("low.*").distinct()
    key, place = free_name(docs, "text_key"), free_name(docs, "place")
    marked = docs.withColumn(key, F.coalesce(F.md5("text"), F.lit("")))
    kept = kept.select("doc_id", F.coalesce("text_key", F.lit("")).alias(key))
    once = Window.partitionBy("doc_id", key).orderBy(key)
    first = marked.join(kept, ["doc_id", key], "left_semi").withColumn(place, F.row_number().over(once)).where(F.col(place) == 1)
    return first.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
