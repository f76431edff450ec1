"""WARC archives as a Python data source: writing with revisit records, reading with pushed-down predicates."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import materialize, new_path

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Columns that predicates are pushed down for, and the header each is read from.
HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
DATE = "2000-01-01T00:00:00Z"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record_bytes(row: dict) -> bytes:
    """One WARC record: its header block, then an HTTP response, whose body a revisit leaves out."""
    payload = row["payload"] or b""
    full = row["warc_type"] != "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"] + (payload if full else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['warc_date'] or DATE}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["target_uri"], safe="!#$%&'()*+,/:;=?@[]~"))
    if not full:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}", "", ""]
    return "\r\n".join(lines).encode() + http + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and plain length, so that readers can skip it."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Writes files of bounded size per task into a folder of the job; the commit moves them out, an abort drops it."""

    def __init__(self, options: dict):
        self.path, self.level, self.job = options["path"], int(options.get("level", 1)), uuid.uuid4().hex
        self.most = int(options.get("maxFileBytes", 128 << 20))

    def write(self, iterator):
        store, root = filesystem(self.path)
        store.create_dir(f"{root}/_{self.job}", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{root}/_{self.job}/{files[-1]}", compression=None), 0
                    member = gzip_member(record_bytes(row), self.level)
                    out.write(member)
                    if (size := size + len(member)) >= self.most:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        store, root = filesystem(self.path)
        for m in messages:
            for name in m.files if m else []:
                store.move(f"{root}/_{self.job}/{name}", f"{root}/{name}")
        self.drop(store, root)

    def abort(self, messages):
        self.drop(*filesystem(self.path))

    def drop(self, store, root) -> None:
        """The folder of the job goes, with what tasks left there that died or ran twice."""
        if store.get_file_info(f"{root}/_{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_{self.job}")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))


class WarcReader(DataSourceReader):
    """Plans whole files to partitions of bounded size; reads headers first and payloads of wanted records only."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "true") == "true"
        self.split = int(options.get("partitionBytes", 32 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                own = {f.value}
            elif name in HEADERS and isinstance(f, In):
                own = set(f.value)
            elif name in ("record_id", "warc_type") and isinstance(f, IsNotNull):
                continue
            else:
                yield f
                continue
            self.wanted[name] = self.wanted[name] & own if name in self.wanted else own

    def partitions(self):
        store, root = filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and "/_" not in f.path[len(root):] and f.base_name.endswith((".warc", ".warc.gz"))), key=lambda f: f.path)
        groups, own, size = [], [], 0
        for f in found:
            if own and size + f.size > self.split:
                groups.append(Files(own))
                own, size = [], 0
            own.append(f.path)
            size += f.size
        return groups + [Files(own)] * bool(own) or [Files([])]

    def read(self, partition):
        store, _ = filesystem(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        rows, size = [], 0
        for path in partition.value:
            with store.open_input_file(path) as f:
                for row in records(f, self.wanted, self.payloads, self.verify):
                    rows.append(row)
                    if (size := size + len(row["payload"] or b"") + 300) >= 8 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Member:
    """One record's bytes, decompressed no further than asked for."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at
        f.seek(at)
        head = f.read(24)
        self.zipped = head[:2] == b"\x1f\x8b"
        self.end = at + struct.unpack("<I", head[16:20])[0] if head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl" else None
        f.seek(at)
        self.raw, self.press = bytearray(), zlib.decompressobj(31) if self.zipped else None

    def more(self, least: int) -> bool:
        """Read until ``least`` plain bytes are there; False at the end."""
        while len(self.raw) < least:
            data = (self.press.unconsumed_tail if self.zipped else b"") or self.f.read(65_536)
            if not data or self.zipped and self.press.eof:
                return False
            self.raw += self.press.decompress(data, max(4096, least - len(self.raw))) if self.zipped else data
        return True

    def find(self, mark: bytes, begin: int, end: int | None = None) -> int:
        """The place of ``mark`` from ``begin`` on, reading on as needed; -1 if it does not come before ``end``."""
        while (at := self.raw.find(mark, begin, end)) < 0:
            begin = max(begin, len(self.raw) - len(mark) + 1)
            if end is not None and len(self.raw) >= end or not self.more(len(self.raw) + 1):
                return -1
        return at


def records(f, wanted: dict[str, set], payloads: bool, verify: bool):
    """Rows of one archive; records whose headers miss a predicate are skipped without decoding their payload."""
    at, total = 0, f.size()
    while at < total:
        m = Member(f, at)
        cut = m.find(b"\r\n\r\n", 0)
        head = bytes(m.raw[:max(cut, 0)])
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        length, begin = int(headers["content-length"]), len(head) + 4
        row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
        keep = all(row[c] in own for c, own in wanted.items())
        if keep:
            full = row["warc_type"] != "revisit"
            if full and (payloads or verify):
                m.more(begin + length)
            http = row["warc_type"] in ("response", "revisit") and "application/http" in headers.get("content-type", "")
            cut = m.find(b"\r\n\r\n", begin, begin + length) if http else -1
            inner = bytes(m.raw[begin:cut]) if cut >= 0 else b""
            skip = cut + 4 - begin if cut >= 0 else 0
            size = next((int(x[15:]) for x in inner.split(b"\r\n") if x.lower().startswith(b"content-length:")), length - skip)
            body = bytes(memoryview(m.raw)[begin + skip:begin + length]) if full and (payloads or verify) else None
            if body is not None:
                size = len(body)
                if verify and row["payload_digest"] and bare_digest(body) != row["payload_digest"]:
                    raise ValueError(f"payload digest of {row['record_id']} does not match")
            yield row | {"payload_bytes": size, "payload": body if payloads else None}
        at = next_record(m, at, begin + length + 4)


def next_record(m: Member, at: int, plain: int) -> int:
    if m.end is not None:
        return m.end
    if not m.zipped:
        return at + plain
    while not m.press.eof:  # no length in the header: decode to the member's end
        data = m.press.unconsumed_tail or m.f.read(65_536)
        if not data:
            break
        m.press.decompress(data, 1 << 20)
    return m.f.tell() - len(m.press.unused_data)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; options: payload, verify, partitionBytes. Also ``df.write.format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_of(digest):
    """Base-32 form of a column of 40 hexadecimal digits: 5 digits give 4 letters."""
    parts = [F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    letters = F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "")
    return F.concat(*[F.get(letters, F.shiftright(p, 15 - 5 * k).bitwiseAND(F.lit(31))) for p in parts for k in range(4)])


def warc_records(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows to write: of equal payloads of at least ``least`` bytes the largest page_id responds, others revisit it.

    Digests that repeat are found over digests and ids alone and written down; payloads are then joined to them, which
    moves no payload as long as Spark finds that table small enough to broadcast.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 AND top IS NOT NULL").select("digest", "top")
    repeated = materialize(repeated, "warc-repeated")
    again = (F.octet_length("payload") >= least) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return rows.join(repeated, "digest", "left").select(
        name("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), "target_uri", F.lit(DATE).alias("warc_date"),
        F.when(again, name("top")).alias("refers_to"), base32_of(F.col("digest")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` to WARC files and read them back as a DataFrame of the data source.

    Defined cases: null html is the empty payload (all empty payloads are equal); a null url has no target header;
    rows without page_id are named urn:page:none; repeated rows of the largest page_id all respond; other columns
    are ignored; an empty table gives empty archives and an empty result.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or new_path(spark, "warc")
    warc_records(pages, least).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path)


def archived_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives."""
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    back = archive(pages, None, least)
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
