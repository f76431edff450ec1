"""Secret scan: fixed patterns, and strings that a primed compressor finds incompressible in sensitive context."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

#: The patterns of known kinds with the fewest characters that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: Words that make their surroundings sensitive, and what may be a secret near them.
SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|secret|token|api[_-]?key|private[_-]?key|credential|bearer|authorization", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEAST, REACH, CONTEXT = 16, 64, 256
#: Marginal compressed bytes for each character from which a candidate counts as incompressible.
NOVEL = 0.55

#: Identifiers and code phrases that the compressor knows beforehand.
DICTIONARY = (
    "public static final private protected class interface return import package void int string boolean null true false self this "
    "def lambda function const let var require module exports async await try except finally raise throw catch new delete print "
    "config settings environment variable default example placeholder changeme your_password_here your-api-key-here xxxxxxxxxxxxxxxx "
    "username password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret authorization bearer "
    "http://www. https://api. .com/ .org/ .net/ .json .html localhost 127.0.0.1 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ the and of to in is that for with as on was by at from this are or an be not have has")


class Novelty:
    """Marginal compressed size of a string given its surroundings, under a primed zstandard dictionary."""

    def __init__(self, dictionary: str = DICTIONARY):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def rate(self, before: str, found: str, after: str) -> float:
        around = before.encode("utf-8", "replace") + after.encode("utf-8", "replace")
        return (len(self.press(around + found.encode())) - len(self.press(around))) / len(found)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    found = [(*m.span(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> set[tuple[int, int]]:
    """(start, end) of runs of 16 or more characters that end within REACH before a sensitive word or begin within
    REACH after it; of a run that holds such words, what stands before, between and behind them."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return set()
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    starts, ends, out = [s for s, _ in runs], [e for _, e in runs], set()
    held: dict[tuple[int, int], int] = {}  # where the last word of a run ends
    for a, b in words:
        for s, e in runs[bisect_left(ends, a - REACH):bisect_right(starts, b + REACH)]:
            if e <= a or s >= b:
                out.add((s, e))
            else:
                out.add((held.get((s, e), s), a))
                held[s, e] = b
    out.update((b, e) for (_, e), b in held.items())
    return {(s, e) for s, e in out if e - s >= LEAST}


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Incompressible candidates near a sensitive word that no base span covers; the longest of nested ones."""
    out: list[tuple[int, int, str]] = []
    last = [0, *accumulate((e for _, e, _ in base), max)]
    begins = [s for s, *_ in base]
    for start, end in sorted(candidates(text), key=lambda c: (c[0], -c[1])):
        if last[bisect_left(begins, end)] > start or out and end <= out[-1][1]:
            continue
        if novelty.rate(text[max(0, start - CONTEXT):start], text[start:end], text[end:end + CONTEXT]) >= NOVEL:
            out.append((start, end, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for every row, over its whole text.

    Defined cases: null and empty texts have no spans (the digest of the empty string); overlapping spans of
    different kinds are all given; repeated rows come out each; other columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches):
        novelty = Novelty()
        for piece, rows in texts(batches):
            base = [base_spans(t) for t in rows]
            novel = [novel_spans(t, b, novelty) for t, b in zip(rows, base, strict=True)]
            count = lambda kind: pa.array([sum(s[2] == kind for s in b) for b in base], pa.int64())  # noqa: E731, B023
            spans = [joined(sorted(b + n, key=lambda s: (s[0], KINDS.index(s[2])))) for b, n in zip(base, novel, strict=True)]
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array([len(n) for n in novel], pa.int64()),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array(spans)],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mask``; null texts stay null, all rows and columns stay."""

    def run(batches):
        novelty = Novelty()
        for piece, rows in texts(batches):
            nulls = piece.column("text").is_null().to_pylist()
            out = []
            for t, gone in zip(rows, nulls, strict=True):
                base = base_spans(t)
                parts, at = [], 0
                for start, end, _ in sorted(base + novel_spans(t, base, novelty)):
                    if end > at:
                        parts += [t[at:start], mask] if start >= at else []
                        at = end
                out.append(None if gone else "".join([*parts, t[at:]]))
            k = piece.schema.get_field_index("text")
            yield piece.set_column(k, piece.schema.field(k), pa.array(out, piece.schema.field(k).type))

    return map_batches(docs, run, docs.schema)
