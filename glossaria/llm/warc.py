"""WARC files as a PySpark Python data source.

``spark.read.format("warc").load(path)`` gives a row per record. The reader
plans partitions over files, takes predicates on the record type and on
header columns from Spark, parses a record's headers first, and seeks past
the block of a record that they rule out (or of every record, with option
``payload=false``) without reading or inflating it. Files are plain or ``.gz``.
Members written here hold one record and its compressed length (``sl`` field),
so that a reader gets past them; those of other writers are inflated to their
end. ``df.write.format("warc")`` writes a file per task; on commit the names of the tasks that counted are listed in a manifest, and a
reader of a folder with manifests reads only listed files, so repeated
attempts of a task never show twice.

Defined results: null payload is empty; null in a header column leaves the
header out (payload_length and payload_digest are then those of the payload);
CR and LF in a header value become blanks; records with broken headers end
their file's reading with an error; an empty folder gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from glossaria.llm.storage import open_fs, scratch_path

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To"}
#: Records are handed on in batches of so many bytes of payload.
BATCH_BYTES = 4 << 20
#: A partition holds files of so many bytes together, one file at least.
PARTITION_BYTES = 64 << 20
#: What a reader takes from a file at once; blocks longer than this are seeked past unread.
BUFFER_BYTES = 64 << 10
MIN_REVISIT = 1000


def to_base32(hex_digest: str | None) -> str | None:
    return None if hex_digest is None else "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def from_base32(value: str | None) -> str | None:
    """Lower-case hex of a ``sha1:`` header in base 32 or hex; others as they are."""
    if value is None or not value.lower().startswith("sha1:"):
        return value
    raw = value[5:]
    return base64.b32decode(raw.upper()).hex() if len(raw) == 32 else raw.lower()


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {' '.join(v.splitlines())}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def read_headers(f) -> dict[str, str] | None:
    """The header fields (lower-case names) of the record that starts here; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    found: dict[str, str] = {"": line.decode().strip()}
    last = ""
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def row_of(h: dict[str, str]) -> dict:
    row = {c: h.get(name.lower()) for c, name in HEADERS.items()}
    row["payload_digest"] = from_base32(h.get("warc-payload-digest"))
    length = h.get("x-payload-length")
    row["payload_length"] = int(length) if length else None
    return row


def payload_of(h: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head, if it has one."""
    if "application/http" in h.get("content-type", "") and (at := block.find(b"\r\n\r\n")) >= 0:
        return block[at + 4 :]
    return block


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        known = {*HEADERS, "payload_digest"}
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column in known and isinstance(f, EqualTo):
                self.tests.append(("eq", column, f.value))
            elif column in known and isinstance(f, In):
                self.tests.append(("in", column, tuple(f.value)))
            elif column in known and isinstance(f, StringStartsWith):
                self.tests.append(("starts", column, f.value))
            elif column in known and isinstance(f, IsNotNull):
                self.tests.append(("some", column, None))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            x = row[column]
            if x is None or kind == "eq" and x != value or kind == "in" and x not in value or kind == "starts" and not x.startswith(value):
                return False
        return True

    def partitions(self):
        fs, base = open_fs(self.path)
        listed = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        files = {i.path: i.size for i in listed if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))}
        names = None
        for i in listed:
            if i.base_name.startswith("manifest-"):
                with fs.open_input_stream(i.path) as f:
                    names = (names or set()) | set(f.read().decode().split())
        bins, size = [[]], 0
        for p, n in sorted(files.items()):
            if names is None or p.rsplit("/", 1)[1] in names:
                if bins[-1] and size + n > PARTITION_BYTES:
                    bins.append([])
                    size = 0
                bins[-1].append(p)
                size += n
        return [Files(tuple(b)) for b in bins]

    def read(self, partition: Files):
        columns = [*HEADERS, "payload_digest", "payload_length"]
        order = ["record_type", "record_id", "target_uri", "date", "payload_digest", "payload_length", "refers_to", "payload"]
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        fs, _ = open_fs(self.path)
        held: list[dict] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], kinds.get(c, pa.string())) for c in order], names=order)

        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                whole = io.BufferedReader(Raw(raw), BUFFER_BYTES)
                for f in members(whole) if path.endswith(".gz") else (whole,):
                    while (h := read_headers(f)) is not None:
                        n = int(h.get("content-length", 0))
                        row = row_of(h)
                        if not (wanted := self.wanted(row)) or not self.payload:
                            alone = skip(f, n)
                        else:
                            alone = False
                            row["payload"] = payload_of(h, f.read(n))
                            if row["payload_length"] is None:
                                row["payload_length"] = len(row["payload"])
                        if wanted:
                            held.append({c: row.get(c) for c in [*columns, "payload"]})
                            size += len(row.get("payload") or b"") + 300
                        if size >= BATCH_BYTES:
                            yield batch()
                            held, size = [], 0
                        if alone:
                            break
        if held:
            yield batch()


class Raw(io.RawIOBase):
    """An Arrow input file as a raw file."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=io.SEEK_SET):
        return self.file.seek(offset, whence)

    def tell(self):
        return self.file.tell()

    def readinto(self, b):
        got = self.file.read(len(b))
        b[: len(got)] = got
        return len(got)


class Member(io.RawIOBase):
    """One gzip member of ``f``, which stands at its start, as a raw file.

    ``next`` is the offset after it: known at once from an ``sl`` field, which
    writers give to members of one record, else at the member's end.
    """

    def __init__(self, f):
        self.f, self.inflate, self.held = f, zlib.decompressobj(31), b""
        at = f.tell()
        head = f.read(12)
        extra = f.read(int.from_bytes(head[10:12], "little")) if len(head) == 12 and head[3] & 4 else b""
        f.seek(at)
        self.next = None
        while len(extra) >= 4:
            n = int.from_bytes(extra[2:4], "little")
            if extra[:2] == b"sl" and n == 8:
                self.next = at + int.from_bytes(extra[4:8], "little")
            extra = extra[4 + n :]
        self.alone = self.next is not None

    def readable(self):
        return True

    def readinto(self, b):
        while not self.inflate.eof:
            chunk = self.inflate.unconsumed_tail or self.f.read(4096)
            if not chunk:
                raise EOFError("a gzip member breaks off")
            got = self.inflate.decompress(chunk, len(b))
            if self.inflate.eof and not self.alone:
                self.next = self.f.tell() - len(self.inflate.unused_data)
            if got:
                b[: len(got)] = got
                return len(got)
        return 0


def members(f):
    """The gzip members of ``f`` as buffered files, each to be read to its end unless it is known to be one record."""
    at = 0
    while f.seek(at) == at and f.peek(1):
        raw = Member(f)
        member = io.BufferedReader(raw, 4096)
        yield member
        while raw.next is None and member.read(1 << 20):
            pass
        at = raw.next


def skip(f: io.BufferedReader, n: int) -> bool:
    """Pass over a block of n bytes; whether ``f`` holds no further record."""
    if isinstance(f.raw, Member):
        if f.raw.alone:
            return True
        while n > 0 and (got := len(f.read(min(n, 1 << 20)))):
            n -= got
    else:
        f.seek(n, io.SEEK_CUR)
    return False


def gzip_member(record: bytes) -> bytes:
    """``record`` as a gzip member that says its compressed length, where 32 bits hold it."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    if 32 + len(body) >= 1 << 32 or len(record) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 32 + len(body), len(record)) + body + tail


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compressed: bool):
        self.path, self.compressed = path, compressed

    def write(self, iterator):
        fs, base = open_fs(self.path)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed
        pack = gzip_member if self.compressed else bytes
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(pack(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            for batch in iterator:
                for r in batch.to_pylist():
                    payload = r.get("payload") or b""
                    revisit = r["record_type"] == "revisit"
                    digest = r.get("payload_digest") or hashlib.sha1(payload).hexdigest()
                    length = r.get("payload_length")
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    headers = [(name_, r.get(c)) for c, name_ in HEADERS.items()]
                    headers += [("WARC-Payload-Digest", to_base32(digest)), ("X-Payload-Length", str(len(payload) if length is None else length)), ("Content-Type", "application/http; msgtype=response")]
                    if revisit:
                        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                    f.write(pack(record_bytes(headers, head + (b"" if revisit else payload))))
        return Written(name)

    def commit(self, messages):
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}") as f:
            f.write("\n".join(m.name for m in messages if m is not None).encode())

    def abort(self, messages):
        fs, base = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{base}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("compression", "none").lower() == "gzip")


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark push predicates into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame) -> DataFrame:
    """Records for ``pages`` (page_id, url, html).

    Of equal payloads of ``MIN_REVISIT`` bytes or more the largest page_id is
    the response and the others revisit it; a null page_id is never referred to.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.length("payload").cast("long"))
    groups = rows.filter(F.col("payload_length") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = groups.filter("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first")
    # smaller payloads join nothing, so each has a key of its own
    key = F.when(F.col("payload_length") >= MIN_REVISIT, F.col("payload_digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id"), F.pmod(F.xxhash64("target_uri"), F.lit(1 << 20))).cast("string")))
    rows = rows.withColumn("_key", key).join(groups, F.col("_key") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        "payload_digest",
        "payload_length",
        F.when(again, F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _page(column: str):
    text = F.regexp_extract(F.col(column), r"^<urn:page:(-?\d+)>$", 1)
    return F.when(text != "", text.cast("long"))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as compressed WARC files and read page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and size are those of the payload read back, a
    revisit's those of its headers.
    """
    register(spark)
    path = scratch_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").option("compression", "gzip").save(path)
    back = spark.read.format("warc").load(path).filter(F.col("record_type").isin("response", "revisit"))
    full = F.col("record_type") == "response"
    return back.select(
        _page("record_id").alias("page_id"),
        F.when(full, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
        "target_uri",
    )


ORACLE = f"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS top FROM p WHERE n >= {MIN_REVISIT} GROUP BY digest HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to, url AS target_uri
FROM p LEFT JOIN g ON p.digest = g.digest
"""
