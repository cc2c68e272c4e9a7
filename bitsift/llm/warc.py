"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition for each run of files of about ``split_bytes`` (a
large uncompressed file is cut into byte ranges; a range owns the records that
start in it).  Filters on record_type, page_id and the other header columns are
pushed down.  A record's headers are parsed first; where they fail a filter, or
the payload isn't asked for (option ``payload`` = "false"; "verify" reads it
only to check length and digest), its block is skipped by Content-Length without being read or decoded.  In
per-record gzip files the block is inflated and dropped, as it can't be seeked.

Writing takes columns page_id, url, html, record_type, refers_to and
payload_digest.  Each task writes one file to ``_temporary`` below the path; the
commit moves the files of the tasks that succeeded, so lost executors and
repeated tasks leave no second copy.

Records: a response's block is an HTTP head and the payload; a revisit's block
is empty, and its headers name the record it refers to.  ``WARC-Payload-Length``
carries the length of the full payload in both.

Cases: a null html is an empty payload; a null url gives no target header; a
null page_id gives a record without the page header (page_id null again); rows
that repeat a page_id are records of their own; an empty table gives no files and
reads as no rows; other columns of the input aren't written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from bitsift.llm.common import fresh_path, join_sized, materialise

READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Headers that columns come from.
HEADER_OF = {"page_id": "warc-page-id", "record_type": "warc-type", "url": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to-page", "payload_bytes": "warc-payload-length"}


def filesystem(path: str):
    """(pyarrow file system, path there); a bare path is local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None, record_type: str, refers_to: int | None, payload_digest: str | None, date: str) -> bytes:
    payload = (html or "").encode()
    block = HEAD + payload if record_type == "response" else b""
    headers = [("WARC-Type", record_type), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._ ")))
    headers.append(("WARC-Payload-Digest", "sha1:" + (payload_digest or digest(payload))))
    headers.append(("WARC-Payload-Length", str(len(payload))))
    if refers_to is not None:
        headers += [("WARC-Refers-To-Page", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Range(InputPartition):
    files: list  # of (path, first byte, end)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(schema, self.options)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.split_bytes = int(options.get("split_bytes", 32 << 20))
        self.payload = options.get("payload", "true").lower()
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo):
                self._allow(column, {f.value})
            elif column in HEADER_OF and isinstance(f, In):
                self._allow(column, set(f.value))
            elif not (column in ("record_type", "payload_digest", "payload_bytes") and isinstance(f, IsNotNull)):
                yield f

    def _allow(self, column: str, values: set) -> None:
        self.equal[column] = self.equal[column] & values if column in self.equal else values

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = filesystem(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out, held, size = [], [], 0
        for info in sorted(infos, key=lambda i: i.path):
            if info.type != fs.FileType.File or not re.search(r"\.warc(\.gz)?$", info.path) or "_temporary" in info.path:
                continue
            if info.path.endswith(".warc") and info.size > 2 * self.split_bytes:
                out += [Range([(info.path, a, min(a + self.split_bytes, info.size))]) for a in range(0, info.size, self.split_bytes)]
                continue
            if held and size + info.size > self.split_bytes:
                out.append(Range(held))
                held, size = [], 0
            held.append((info.path, 0, info.size))
            size += info.size
        if held:
            out.append(Range(held))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = filesystem(self.path)
        wanted = [f.name for f in self.schema.fields]
        for path, first, end in partition.files if partition else []:
            with system.open_input_file(path) as raw:
                for headers, block in gzip_records(raw) if path.endswith(".gz") else plain_records(raw, first, end):
                    row = {c: headers.get(h) for c, h in HEADER_OF.items()}
                    for c in ("page_id", "refers_to", "payload_bytes"):
                        row[c] = int(row[c]) if row[c] is not None else None
                    if row["payload_digest"]:
                        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
                    if any(row[c] not in allowed for c, allowed in self.equal.items()):
                        continue
                    row["payload"] = None
                    if self.payload != "false" and row["record_type"] == "response":
                        payload = block().partition(b"\r\n\r\n")[2]
                        if self.payload == "true":
                            row["payload"] = payload
                        if (len(payload), digest(payload)) != (row["payload_bytes"], row["payload_digest"]):
                            raise ValueError(f"{path}: the payload of page {row['page_id']} isn't what its header says")
                    yield tuple(row[c] for c in wanted)


def parse_headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for line in raw.decode(errors="replace").split("\r\n")[1:] if ":" in line for k, _, v in (line.partition(":"),)}


def plain_records(raw, first: int, end: int, buffer: int = 1 << 20) -> Iterator[tuple[dict, object]]:
    """Headers of the records that start in a byte range, and a function that reads the block; unread blocks are skipped."""
    at = first
    if first:  # the first record that starts in the range
        at = _next_start(raw, first, end, buffer)
    window, base = b"", 0
    size = raw.size()
    while at is not None and at < end:
        if not (base <= at and window.find(b"\r\n\r\n", at - base) >= 0):
            length = 8192
            while True:
                raw.seek(at)
                window, base = raw.read(length), at
                if window.find(b"\r\n\r\n") >= 0 or at + length >= size:
                    break
                length *= 4
        stop = window.find(b"\r\n\r\n", at - base)
        if stop < 0 or not window.startswith(b"WARC/", at - base):
            return
        headers = parse_headers(window[at - base : stop])
        n, begin = int(headers.get("content-length", 0)), base + stop + 4

        def block(begin=begin, n=n) -> bytes:
            raw.seek(begin)
            return raw.read(n)

        yield headers, block
        at = begin + n + 4


def _next_start(raw, first: int, end: int, buffer: int) -> int | None:
    """Record starts follow the blank lines that end a block; payloads that imitate one are told apart by a full header."""
    at, mark = first - 4, b"\r\n\r\nWARC/1."
    while at < end:
        raw.seek(max(0, at))
        data = raw.read(buffer + 4096)
        i = data.find(mark)
        while i >= 0 and i < buffer:
            stop = data.find(b"\r\n\r\n", i + 4)
            head = parse_headers(data[i + 4 : stop]) if stop >= 0 else {}
            if "warc-type" in head and "warc-record-id" in head and "content-length" in head:
                start = max(0, at) + i + 4
                return start if start < end else None
            i = data.find(mark, i + 1)
        if len(data) < buffer:
            return None
        at = max(0, at) + buffer
    return None


def gzip_records(raw) -> Iterator[tuple[dict, object]]:
    """Records of a file of gzip members, one member each."""
    rest = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        if not rest and not (rest := raw.read(1 << 16)):
            return
        while not inflate.eof:
            if not rest and not (rest := raw.read(1 << 16)):
                return
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        data = b"".join(parts)
        head, _, body = data.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        yield headers, lambda body=body, headers=headers: body[: int(headers.get("content-length", 0))]


class WarcWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options):
        self.path, self.compress = options["path"], options.get("compress", "false").lower() == "true"
        self.columns = [f.name for f in schema.fields]
        self.job = uuid.uuid4().hex
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator) -> Written:
        system, root = filesystem(self.path)
        out, name = None, None
        for row in iterator:
            if out is None:
                context = TaskContext.get()
                name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job[:8]}.warc" + ".gz" * self.compress
                system.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
                out = system.open_output_stream(f"{root}/_temporary/{self.job}/{name}", compression=None, buffer_size=1 << 20)
            raw = record(*(row[c] for c in ("page_id", "url", "html", "record_type", "refers_to", "payload_digest")), self.date)
            if self.compress:
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = deflate.compress(raw) + deflate.flush()
            out.write(raw)
        if out is not None:
            out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.path:
                system.move(f"{root}/_temporary/{self.job}/{m.path}", f"{root}/{m.path}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, record_type, refers_to, payload_digest: of equal payloads of at least ``least_bytes`` the largest id is the response.

    Digests are reduced by task before the shuffle.  Rows that repeat an id are one page if their payloads are equal: the first
    stays a response and the others too, as a record doesn't refer to itself.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    # base-32 of SHA-1 isn't among Spark's functions; equality is the same on hexadecimal digits
    keyed = own.withColumn("sha", F.sha1(F.coalesce("html", F.lit(""))))
    sizes = keyed.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("c"))
    repeated = materialise(sizes.where("c > 1").select("sha", "first"), "revisits")
    joined = join_sized(keyed, repeated, ["sha"], "left", 96)
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "html", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"), F.lit(None).cast("string").alias("payload_digest"),
    )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(records: DataFrame, path: str, compress: bool = False) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("compress", str(compress).lower()).save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def archive(pages: DataFrame, compress: bool = False) -> DataFrame:
    """Writes the pages to archives in the shared folder, and reads them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(with_revisits(pages), path, compress)
    return read(spark, path, payload="verify")
