"""WARC archives as a Python data source: ``spark.read.format("warc")``, ``df.write.format("warc")``.

Files are gzip with one member per record; each member's header carries the record's lengths
(the "sl" extra field of the format's gzip annex), so a reader can step over a record after
its headers. A reader plans whole files into partitions by size, takes predicates on the record
type and the other header fields, inflates and parses only the headers of a record first, and
inflates the rest only of records that pass and only if a column needs it.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
                                    LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortscope.llm.common import join_hot, prepare, stored

SCHEMA = ("record_type string, record_id string, date string, target_uri string, refers_to string, "
          "refers_to_uri string, payload_digest string, content_type string, content_length long, "
          "fields map<string,string>, http_length long, payload binary")
VERSION = b"WARC/1.1"
# Fixed: header field of each column.
NAMED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date",
         "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "refers_to_uri": "WARC-Refers-To-Target-URI",
         "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
BRACKETED = {"record_id", "refers_to"}
HTTP = "application/http; msgtype=response"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed: the profile's name
HEAD_BYTES = 4096  # inflated first; longer headers take more
CHUNK = 1 << 20  # bytes read at a time
BATCH_BYTES = 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    if re.match(r"file:/+", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if urlparse(path).scheme else (pafs.LocalFileSystem(), path)


# --- one record ------------------------------------------------------------------------------


def clean(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def uri(value: str) -> str:
    """A URI without blanks, brackets, control or non-ASCII characters (percent-encoded as UTF-8)."""
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~|-._^`{}")


def record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION.decode()] + [f"{k}: {v}" for k, v in head] + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member of one record with both lengths in its header, where 32 bits hold them."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size, tail = 20 + 4 + len(body), struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size += len(tail)
    if max(size, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00" + b"\x00" * 5 + b"\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04" + b"\x00" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def http_block(payload: bytes | None, mime: str, length: int | None = None) -> bytes:
    """An HTTP response; without a payload its headers alone, which tell ``length``."""
    n = len(payload) if payload is not None else length or 0
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {n}\r\n\r\n"
    return head.encode() + (payload or b"")


def parse_head(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined, of repeated names the first counts."""
    found: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            if last in found:
                last = None
            else:
                found[last] = value.strip()
    return found


def columns_of(head: dict[str, str]) -> dict:
    """Header columns of a record."""
    row = {c: head.get(n.lower()) for c, n in NAMED.items()}
    for c in BRACKETED:
        if row[c]:
            row[c] = row[c].strip("<>")
    row["content_length"] = int(row["content_length"] or 0)
    return row


# --- reading files ---------------------------------------------------------------------------


class _Source:
    """Sequential bytes of a file, read in chunks; ``skip`` seeks past what is not held."""

    def __init__(self, file):
        self.file, self.held, self.at, self.read = file, b"", 0, 0

    def need(self, n: int) -> bool:
        """Hold at least ``n`` bytes from here; False at the end of the file."""
        while len(self.held) - self.at < n:
            more = self.file.read(max(CHUNK, n - (len(self.held) - self.at)))
            if not more:
                return False
            self.read += len(more)
            self.held, self.at = self.held[self.at:] + more, 0
        return True

    def skip(self, n: int) -> None:
        here = len(self.held) - self.at
        if n <= here:
            self.at += n
        else:
            self.file.seek(self.file.tell() + n - here)
            self.held, self.at = b"", 0

    def view(self, n: int) -> bytes:
        return self.held[self.at:self.at + n]


class _Plain:
    """A record that is not compressed."""

    def __init__(self, source: _Source):
        self.source = source

    def head(self) -> bytes | None:
        n, s = HEAD_BYTES, self.source
        while s.need(4) and s.view(2) == b"\r\n":
            s.skip(2)
        while True:
            more = s.need(n)
            seen = s.view(n)
            end = seen.find(b"\r\n\r\n")
            if end >= 0:
                s.skip(end + 4)
                return seen[:end]
            if not more:
                if seen.strip():
                    raise ValueError("a record's header does not end")
                return None
            n *= 4

    def body(self, length: int) -> bytes:
        if not self.source.need(length):
            raise ValueError("a record's block is cut off")
        return self.source.view(length)

    def close(self, length: int) -> None:
        self.source.skip(length)


class _Member:
    """A record in a gzip member of its own."""

    def __init__(self, source: _Source):
        self.source, self.out, self.fed, self.made = source, bytearray(), 0, 0
        s = source
        if not s.need(10):
            raise ValueError("a gzip member is cut off")
        flags, self.size, n = s.view(4)[3], None, 10
        if flags & 4:
            s.need(12)
            extra = struct.unpack("<H", s.view(12)[10:12])[0]
            s.need(12 + extra)
            field = s.view(12 + extra)[12:]
            n = 12 + extra
            while len(field) >= 4:
                size = struct.unpack("<H", field[2:4])[0]
                if field[:2] == b"sl" and size == 8:
                    self.size = struct.unpack("<I", field[4:8])[0]
                field = field[4 + size:]
        for flag in (8, 16):
            if flags & flag:
                while s.need(n + 1) and s.view(n + 1)[n]:
                    n += 1
                n += 1
        n += 2 if flags & 2 else 0
        s.need(n)
        s.skip(n)
        self.begun = n
        self.zip = zlib.decompressobj(-15)

    def _inflate(self, n: int) -> None:
        """Have ``n`` inflated bytes, or all there are."""
        while len(self.out) < n and not self.zip.eof:
            data = self.zip.unconsumed_tail
            if not data:
                self.source.need(1)
                take = len(self.source.held) - self.source.at
                if self.size:
                    take = min(take, self.size - 8 - self.begun - self.fed)
                if take <= 0:
                    raise ValueError("a gzip member is cut off")
                data = self.source.view(take)
                self.source.skip(take)
                self.fed += take
            more = self.zip.decompress(data, n - len(self.out))
            self.made += len(more)
            self.out += more

    def head(self) -> bytes:
        n = HEAD_BYTES
        while True:
            self._inflate(n)
            end = self.out.find(b"\r\n\r\n")
            if end >= 0:
                raw = bytes(self.out[:end])
                del self.out[:end + 4]
                self.head_bytes = end + 4
                return raw
            if self.zip.eof:
                raise ValueError("a record's header does not end")
            n *= 4

    def body(self, length: int) -> bytes:
        self._inflate(length)
        if len(self.out) < length:
            raise ValueError("a record's block is cut off")
        return bytes(self.out[:length])

    def close(self, length: int) -> None:
        s = self.source
        if self.size:
            s.skip(self.size - self.begun - self.fed)
            return
        while not self.zip.eof:
            self.out.clear()
            self._inflate(CHUNK)
        if self.made > self.head_bytes + length + 4:
            raise ValueError("several records in one gzip member")
        s.at -= len(self.zip.unused_data)
        s.need(8)
        s.skip(8)


def read_records(file, wanted, needs_block):
    """``(header columns, header fields, block or None)`` of the records of an open file.

    ``wanted``: a test on the header columns; other records are stepped over with only their
    headers inflated and parsed. ``needs_block``: whether blocks are asked for at all.
    """
    source = _Source(file)
    while source.need(1):
        packed = source.need(2) and source.view(2) == b"\x1f\x8b"
        one = _Member(source) if packed else _Plain(source)
        raw = one.head()
        if raw is None:
            return
        if not raw.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = parse_head(raw)
        row = columns_of(head)
        n = row["content_length"]
        if wanted(row):
            block = one.body(n) if needs_block else None
            yield row, head, block
        one.close(n)


_TESTS = {
    EqualTo: lambda v, w: v is not None and v == w,
    EqualNullSafe: lambda v, w: v == w,
    GreaterThan: lambda v, w: v is not None and v > w,
    GreaterThanOrEqual: lambda v, w: v is not None and v >= w,
    LessThan: lambda v, w: v is not None and v < w,
    LessThanOrEqual: lambda v, w: v is not None and v <= w,
    In: lambda v, w: v is not None and v in w,
    StringStartsWith: lambda v, w: v is not None and v.startswith(w),
    StringEndsWith: lambda v, w: v is not None and v.endswith(w),
    StringContains: lambda v, w: v is not None and w in v,
}


def as_test(f):
    """(column, test of its value) of a predicate on a header column; None for others."""
    if isinstance(f, Not):
        inner = as_test(f.child)
        if inner is None or isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe)):
            return inner and (inner[0], lambda v: not inner[1](v))
        return inner[0], lambda v: v is not None and not inner[1](v)
    path = getattr(f, "attribute", ())
    if len(path) != 1 or path[0] not in NAMED:
        return None
    if isinstance(f, (IsNull, IsNotNull)):
        null = isinstance(f, IsNull)
        return path[0], lambda v: (v is None) == null
    test = _TESTS.get(type(f))
    return test and (path[0], lambda v: test(v, f.value))


@dataclass
class Files(InputPartition):
    files: list


class WarcReader(DataSourceReader):
    """Options: ``path`` (a file or folder), ``splitBytes`` (files of a partition; 32 MB)."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.split = int(options.get("splitBytes", 32 << 20))
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            if as_test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        """Files, largest first, each to a partition of its own or with others up to the size."""
        parts, last, held = [], None, 0
        for name, size in sorted(listed(self.path), key=lambda x: (-x[1], x[0])):
            if last is None or held + size > self.split:
                last, held = [], 0
                parts.append(Files(last))
            last.append(name)
            held += size
        return parts or [Files([])]

    def read(self, partition):
        tests = [as_test(f) for f in self.filters]
        wanted = lambda row: all(test(row[c]) for c, test in tests)
        asked = [f.name for f in self.schema.fields]
        kinds = to_arrow_schema(self.schema)
        block_asked = bool({"http_length", "payload"} & {*asked})
        known = {n.lower() for n in NAMED.values()}
        made: dict[str, list] = {c: [] for c in asked}
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in kinds], schema=kinds)

        for name in partition.files:
            store, path = filesystem(name)
            with store.open_input_file(path) as file:
                for row, head, block in read_records(file, wanted, block_asked):
                    if "fields" in made:
                        row["fields"] = [(k, v) for k, v in head.items() if k not in known]
                    if block is not None:
                        row["http_length"], row["payload"] = None, block
                        if (row["content_type"] or "").startswith("application/http"):
                            top, _, rest = block.partition(b"\r\n\r\n")
                            told = parse_head(top).get("content-length", "")
                            row["http_length"] = int(told) if told.isdigit() else None
                            row["payload"] = None if row["record_type"] == "revisit" else rest
                        size += len(block)
                    for c in asked:
                        made[c].append(row.get(c))
                    size += 200
                    if size >= BATCH_BYTES:
                        yield batch()
                        made, size = {c: [] for c in asked}, 0
        if made[asked[0]] if asked else False:
            yield batch()


def listed(path: str) -> list[tuple[str, int]]:
    """Files and sizes: those that the manifests of finished writes name, or else all WARC files."""
    store, at = filesystem(path)
    info = store.get_file_info(at)
    back = path if path.endswith("/") else path + "/"
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = store.get_file_info(pafs.FileSelector(at, recursive=True))
    manifests = [i.path for i in infos if i.base_name.startswith("_manifest-")]
    if manifests:
        found = []
        for m in manifests:
            with store.open_input_file(m) as f:
                found += [(back + n, s) for n, s in json.loads(f.read())]
        return found
    return [(back + posixpath.relpath(i.path, at), i.size) for i in infos
            if i.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", i.base_name)]


# --- writing ---------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Options: ``path``, ``fileBytes`` (a file is closed beyond it; 64 MB), ``level`` (of gzip).

    A task writes files under names of its own; the commit names the files of the tasks that
    counted in a manifest, so files of lost or repeated tasks are never read.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.bytes, self.level = int(options.get("fileBytes", 64 << 20)), int(options.get("level", 6))

    def write(self, iterator):
        store, at = filesystem(self.path)
        store.create_dir(at, recursive=True)
        done, out, name, size = [], None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    size = out.write(member(self.info(name, row.get("date")), self.level))
                size += out.write(member(self.record(row), self.level))
                if size >= self.bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        return Written(done)

    @staticmethod
    def info(name: str, date: str | None) -> bytes:
        text = b"software: Spark data source\r\nformat: WARC File Format 1.1\r\n"
        return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                       ("WARC-Date", date or EPOCH), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], text)

    @staticmethod
    def record(row: dict) -> bytes:
        head = []
        for c, name in NAMED.items():
            value = row.get(c)
            if c == "content_length" or value is None:
                continue
            value = uri(value) if c.endswith("uri") else clean(value)
            head.append((name, f"<{value}>" if c in BRACKETED else value))
        fields = row.get("fields") or []
        head += [(clean(k), clean(v)) for k, v in (fields.items() if isinstance(fields, dict) else fields) if v is not None]
        if (row.get("content_type") or "").startswith("application/http"):
            block = http_block(row.get("payload"), "text/html; charset=utf-8", row.get("http_length"))
        else:
            block = row.get("payload") or b""
        return record(head, block)

    def commit(self, messages):
        store, at = filesystem(self.path)
        store.create_dir(at, recursive=True)
        old = [i for i in store.get_file_info(pafs.FileSelector(at)) if i.base_name.startswith("_manifest-")]
        gone = [f for f in listed(self.path)] if self.overwrite and old else []
        with store.open_output_stream(f"{at}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        for path in [i.path for i in old] * self.overwrite + [filesystem(n)[1] for n, _ in gone]:
            store.delete_file(path)

    def abort(self, messages):
        store, at = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                store.delete_file(f"{at}/{name}")


class WarcSource(DataSource):
    """``format("warc")``: records of WARC files, plain or gzip, one row each.

    Columns: see ``SCHEMA``. ``fields`` holds the header fields without a column of their own,
    by lower-case name. ``payload`` is the block, of an HTTP response the body after its headers;
    a revisit has none (null). ``http_length`` is the length that the HTTP headers tell. A reader
    given a smaller schema reads no more than it needs.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session, with predicate pushdown."""
    prepare(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcSource)


# --- pages -----------------------------------------------------------------------------------

EPOCH = "1970-01-01T00:00:00Z"
REVISIT_BYTES = 100  # shorter payloads are always stored
PAGE, FIRST = "X-Page-Id", "X-Refers-To-Page-Id"


def page_records(pages: DataFrame, min_bytes: int = REVISIT_BYTES, date: str = EPOCH,
                 id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """WARC records of ``pages``: copies of a payload of ``min_bytes`` or more revisit the
    record with the smallest id.

    Null html is an empty payload. A null id never wins against an id; copies that have none
    are all responses. Rows that repeat the smallest id with its payload are all responses, and
    rows equal in id, url and html share a record id. Other columns are not read. Digests that
    occur once stay out of the table that the rows join; hot ones are broadcast.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    record_id = lambda page, url: F.regexp_replace(
        F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), "digest")),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")
    copies = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.min(F.struct("page_id", "url")).alias("any"),
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"),
        F.count(F.lit(1)).alias("copies"))
    copies = stored(copies.filter("copies > 1").select("digest", "first", "copies"), "warc-copies")
    rows = join_hot(rows, copies, "digest", "copies", pages.count())
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    first_id, first_url = F.col("first.page_id"), F.col("first.url")
    text = lambda c: c.cast("string")
    extra = F.map_filter(F.create_map(
        F.lit(PAGE), text(F.col("page_id")), F.lit(FIRST), F.when(revisit, text(first_id)),
        F.lit("WARC-Profile"), F.when(revisit, F.lit(SAME_PAYLOAD))), lambda k, v: v.isNotNull())
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("page_id"), F.col("url")).alias("record_id"), F.lit(date).alias("date"),
        F.col("url").alias("target_uri"), F.when(revisit, record_id(first_id, first_url)).alias("refers_to"),
        F.when(revisit, first_url).alias("refers_to_uri"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.lit(HTTP).alias("content_type"), F.lit(None).cast("long").alias("content_length"), extra.alias("fields"),
        F.col("bytes").alias("http_length"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, **options) -> None:
    """Write ``pages`` as WARC files below ``path``."""
    register(pages.sparkSession)
    writer = page_records(pages).write.format("warc").mode("append").options(**{"level": "1", **options})
    writer.save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the archives.

    Length and digest of a response come from the payload itself. A revisit is read by its
    headers: the digest it names, and the length in the HTTP headers it kept.
    """
    register(spark)
    number = lambda name: F.col("fields")[name.lower()].cast("long")
    read = lambda kind, columns: spark.read.format("warc").schema(columns).load(path).filter(
        F.col("record_type") == kind)
    full = read("response", "record_type string, fields map<string,string>, payload binary").select(
        number(PAGE).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read("revisit", "record_type string, payload_digest string, fields map<string,string>, http_length long").select(
        number(PAGE).alias("page_id"), F.col("http_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type",
        number(FIRST).alias("refers_to"))
    return full.unionByName(again)


ORACLE_SQL = r"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
