"""WARC as a Python data source, and the writing of pages with revisit records for equal payloads.

Written: gzip members, one per record, each with the extra field ``SL`` (lengths of the member and of its content), so that a reader
knows where the next record begins without decompressing this one. Files are closed at ``max_file_bytes`` and named by a random part, and
a commit lists them in ``_MANIFEST.json``: what failed or repeated tasks wrote is never read.

Read: the driver lists the files and packs them into partitions of ``partition_bytes``; a file is not split. Of each record the headers
are parsed first; predicates on record type and headers that Spark pushes down are tested on these; the payload of a record that fails
them, or of any if the option ``payload`` is false, is neither decompressed (where the member tells its length) nor decoded. Plain
``.warc`` files and gzip files of other writers are read too. Option ``verify``: a response's payload must match its digest.

Columns: record_id, type, date, target_uri, payload_digest (bare base32 SHA-1), refers_to, content_type, headers (map of all fields),
payload (entity body of a response, null for other records), payload_length (of the body; for a revisit what its HTTP headers tell).

Defined results: a null payload is empty; a null target is left out; CR and LF within a header become spaces; repeated records stay; a file
that ends within a record is an error; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from parley.llm.common import Workspace, attach

SCHEMA = "record_id string, type string, date string, target_uri string, payload_digest string, refers_to string, content_type string, headers map<string,string>, payload binary, payload_length long"
FIELDS = {"record_id": "warc-record-id", "type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
HEAD = 4096


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, that of the session where it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field SL has its own length and that of the record."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    lengths = (whole, len(record)) if max(whole, len(record)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HccHII", 12, b"S", b"L", 8, *lengths) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(head: dict[str, str | None], payload: bytes, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [f"{k}: {' '.join(v.splitlines())}" for k, v in head.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[list] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_id, type, date, target_uri, payload_sha1 in hexadecimal digits, refers_to, payload)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.most = int(options.get("level", 6)), int(options.get("max_file_bytes", 128 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        out, done, size, name = None, [], 0, ""
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "type", "date", "target_uri", "payload_sha1", "refers_to", "payload")]
            for row in range(batch.num_rows):
                rid, kind, date, uri, digest, refers, payload = (c[row].as_py() for c in columns)
                head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"}
                if kind == "revisit":
                    head |= {"WARC-Refers-To": refers, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                size += out.write(data := member(record(head, payload or b"", kind == "revisit"), self.level)) or len(data)
                if size >= self.most:
                    out.close()
                    done.append([name, size])
                    out = None
        if out is not None:
            out.close()
            done.append([name, size])
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        old = [] if self.overwrite else manifest(fs, root) or []
        with fs.open_output_stream(f"{root}/_MANIFEST.json", compression=None) as out:
            out.write(json.dumps(sorted([*old, *files])).encode())
        if self.overwrite:
            known = {name for name, _ in files}
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if info.base_name.endswith(".warc.gz") and info.base_name not in known:
                    fs.delete_file(info.path)

    def abort(self, messages: list) -> None:
        fs, root = store(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


def manifest(fs: pafs.FileSystem, root: str) -> list | None:
    if fs.get_file_info(f"{root}/_MANIFEST.json").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/_MANIFEST.json", compression=None) as f:
        return json.loads(f.read())


@dataclass
class Files(InputPartition):
    names: list[str] = field(default_factory=list)


def headers_of(data: bytes) -> tuple[dict[str, str], int]:
    """Fields by lower-case name, and where the block begins; -1 if ``data`` ends before that."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    found: dict[str, str] = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return found, end + 4


class Gzip:
    """Members of a gzip file. ``head`` decompresses the beginning of one, ``rest`` the remainder, ``skip`` goes to the next."""

    def __init__(self, f):
        self.f, self.at = f, 0

    def head(self) -> bytes | None:
        self.f.seek(self.at)
        start = self.f.read(12)
        if not start:
            return None
        if len(start) < 12:
            raise ValueError(f"the file ends within a member at {self.at}")
        self.length = 0
        if start[3] == 4:
            extra = self.f.read(struct.unpack("<H", start[10:12])[0])
            if len(extra) == 12 and extra[:2] == b"SL":
                self.length = struct.unpack("<II", extra[4:])[0]
        self.inflate = zlib.decompressobj(31)
        self.f.seek(self.at)
        self.data = self.f.read(self.length) if self.length else b""
        if len(self.data) < self.length:
            raise ValueError(f"the file ends within the member at {self.at}")
        self.known = b""
        return self.more(HEAD)

    def more(self, n: int) -> bytes:
        """At least ``n`` bytes from the member's beginning, unless it ends before."""
        while len(self.known) < n and not self.inflate.eof:
            if not self.data and not self.length:
                self.data = self.f.read(1 << 16)
            if not self.data:
                break
            out = self.inflate.decompress(self.data, n - len(self.known))
            self.known += out
            self.data = self.inflate.unconsumed_tail
            if not out and not self.data and self.length:
                break
        return self.known

    def skip(self) -> None:
        if self.length:
            self.at += self.length
            return
        while not self.inflate.eof:
            self.data = self.data or self.f.read(1 << 16)
            if not self.data:
                raise ValueError(f"the file ends within the member at {self.at}")
            self.inflate.decompress(self.data, 1 << 20)
            self.data = self.inflate.unconsumed_tail
        self.at = self.f.tell() - len(self.inflate.unused_data)


class Plain:
    """The same for a file that is not compressed; a record's length comes from its headers."""

    def __init__(self, f):
        self.f, self.at = f, 0

    def head(self) -> bytes | None:
        self.known = b""
        return self.more(HEAD) or None

    def more(self, n: int) -> bytes:
        self.f.seek(self.at + len(self.known))
        self.known += self.f.read(max(0, n - len(self.known)))
        return self.known

    def skip(self) -> None:
        fields, begin = headers_of(self.known)
        end = self.at + begin + int(fields.get("content-length", 0))
        if end > self.f.size():
            raise ValueError(f"the file ends within the record at {self.at}")
        self.at = end + 4


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload, self.verify = options.get("payload", "true") == "true", options.get("verify", "false") == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = FIELDS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif column and isinstance(f, (IsNotNull, IsNull)):
                self.tests.append((column, "some" if isinstance(f, IsNotNull) else "none", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = store(self.path)
        files = manifest(fs, root)
        if files is None:
            infos = fs.get_file_info(pafs.FileSelector(root)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
            root = root if len(infos) != 1 or infos[0].path != root else root.rpartition("/")[0]
            files = [[i.base_name, i.size] for i in infos if i.base_name.endswith((".warc", ".warc.gz"))]
        out: list[InputPartition] = []
        size = self.partition_bytes + 1
        for name, n in sorted(files):
            if size + n > self.partition_bytes:
                out.append(Files([]))
                size = 0
            out[-1].names.append(f"{root}/{name}")
            size += n
        return out

    def wanted(self, fields: dict[str, str]) -> bool:
        for name, test, values in self.tests:
            value = digest_of(fields.get(name)) if name == "warc-payload-digest" else fields.get(name)
            if test == "in" and value not in values or test == "starts" and not (value or "").startswith(values) or test == "some" and value is None or test == "none" and value is not None:
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = store(self.path)
        for name in partition.names if partition else ():
            with fs.open_input_file(name) as f:
                source = Gzip(f) if name.endswith(".gz") else Plain(f)
                while (data := source.head()) is not None:
                    fields, begin = headers_of(data)
                    while begin < 0 and len(more := source.more(len(data) * 2)) > len(data):
                        data = more
                        fields, begin = headers_of(data)
                    if begin < 0:
                        if not data.strip():
                            break
                        raise ValueError(f"no WARC headers at {source.at} of {name}")
                    if self.wanted(fields):
                        yield self.row(fields, source, begin)
                    source.skip()

    def row(self, fields: dict[str, str], source: Gzip | Plain, begin: int) -> tuple:
        size, body, length = int(fields.get("content-length", 0)), None, None
        kind, digest = fields.get("warc-type"), digest_of(fields.get("warc-payload-digest"))
        if "application/http" in fields.get("content-type", ""):
            n = HEAD
            http, start = headers_of(source.more(min(begin + size, begin + n))[begin : begin + size])
            while start < 0 and n < size:
                n *= 4
                http, start = headers_of(source.more(min(begin + size, begin + n))[begin : begin + size])
            if "content-length" in http:
                length = int(http["content-length"])
            if kind == "response" and start >= 0:
                length = size - start
                if self.payload:
                    body = source.more(begin + size)[begin + start : begin + size]
        elif self.payload:
            body = source.more(begin + size)[begin : begin + size]
        if self.verify and kind == "response" and body is not None and digest and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
        own = {c: fields.get(h) for c, h in FIELDS.items()} | {"payload_digest": digest}
        return (*own.values(), fields, body, length)


def digest_of(value: str | None) -> str | None:
    return value.removeprefix("sha1:") if value else None


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: The record id of a page without an id.
NO_ID = "<urn:uuid:ffffffff-ffff-8fff-bfff-ffffffffffff>"


def record_id(page_id: Column) -> Column:
    """A version 8 UUID that holds the 64 bits of the id."""
    h = F.lpad(F.hex(page_id), 16, "0")
    return F.coalesce(F.lower(F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-0000-8000-8000-0000"), F.substring(h, 9, 8), F.lit(">"))), F.lit(NO_ID))


def page_id(record: Column) -> Column:
    return F.when(record != NO_ID, F.conv(F.concat(F.substring(record, 11, 8), F.substring(record, 39, 8)), 16, -10).cast("long"))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """A record per page. Of equal payloads of ``min_bytes`` or more that of the smallest id is the response, others revisit it;
    repeated rows of that id are responses too, and a page without an id is a response."""
    spark = pages.sparkSession
    register(spark)
    space = Workspace(spark, "warc-pages")
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    keys = space.table(rows.filter(F.octet_length("payload") >= min_bytes).select("id", "sha1"), "digests")
    groups = keys.groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = space.table(groups, "groups")
    again = attach(keys, groups, ["sha1"], keys.count()).filter("id <> first").distinct()
    joined = rows.alias("r").join(again.alias("g"), (F.col("r.id") == F.col("g.id")) & (F.col("r.sha1") == F.col("g.sha1")), "left")
    first = F.col("g.first")
    out = joined.select(record_id(F.col("r.id")).alias("record_id"), F.when(first.isNull(), "response").otherwise("revisit").alias("type"), F.lit(date).alias("date"), F.col("r.target_uri"), F.col("r.sha1").alias("payload_sha1"), F.when(first.isNotNull(), record_id(first)).alias("refers_to"), F.col("r.payload"))
    out.write.format("warc").mode("overwrite").save(qualified(spark, path))


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), verify=str(verify).lower()).load(qualified(spark, path))
