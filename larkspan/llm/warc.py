"""WARC archives as a PySpark Python data source.

Writing makes one gzip member per record (or plain records) in files that roll
at a size; a task's files count only once the driver has listed them in the
manifest, so lost or repeated tasks leave no records. Reading plans whole files
into partitions, parses each record's headers first, and inflates but neither
keeps nor decodes the block of a record that the pushed filters on
``record_type`` and other header columns reject. Archives without a manifest are
listed by their endings.

Options: ``path``; ``compress`` (true), ``file_bytes`` and ``date`` for writing;
``split_bytes`` and ``payload`` (true; false leaves payloads null) for reading.

Cases: a null payload is empty. A null header column is not written and reads
back null. Header values are written and read as they stand, ``%`` included; one
that holds line breaks or has white space at its ends is percent-encoded and
named in a header of its own, so that it reads back exactly. Tables without rows
write archives without records. Repeated rows are records of their own; of pages
with equal payload and equal page_id all that carry the smallest id are
responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from larkspan.llm.scratch import Scratch

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
# Header names are the format's own.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
VERSION = b"WARC/1.1\r\n"
# Names the headers whose values are percent-encoded; other archives have no such header.
ESCAPED = "X-Escaped-Headers"
PRINTABLE = "".join(map(chr, range(33, 127))).replace("%", "")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES, CHUNK = 256 << 20, 32 << 20, 8 << 20, 1 << 16


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or a local path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: str) -> bytes:
    return f"{name}: {value}".encode("utf-8", "surrogatepass") + b"\r\n"


def _escaped(value: str) -> str | None:
    """The value percent-encoded if a header line can't hold it (line breaks, white space at its ends), else null."""
    held = value == value.strip() and not any(c in value for c in "\r\n")
    return None if held else quote(value, safe=PRINTABLE, errors="surrogatepass")


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Lower-case names with values as they stand; those that ``ESCAPED`` lists are decoded."""
    out = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}
    for name in out.get(ESCAPED.lower(), "").lower().split():
        if name in out:
            out[name] = unquote(out[name])
    return out


def record(row: dict, date: str) -> bytes:
    """One record; a response or revisit carries an HTTP header that states the payload's length."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    kind = row["record_type"] or "resource"
    http = kind in ("response", "revisit")
    block = b""
    if http:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if kind != "revisit":
        block += payload
    escaped: list[str] = []
    lines = [VERSION, _line("WARC-Type", kind), _line("WARC-Date", date)]
    for column, name in HEADERS.items():
        value = row[column]
        if column == "record_id" and value is None:
            value = uuid.uuid4().urn
        if column != "record_type" and value is not None:
            if (safe := _escaped(value)) is not None:
                value, escaped = safe, [*escaped, name]
            text = f"<{value}>" if column in ("record_id", "refers_to") else f"sha1:{value}" if column == "payload_digest" else value
            lines.append(_line(name, text))
    if escaped:
        lines.append(_line(ESCAPED, " ".join(escaped)))
    if kind == "revisit":
        lines.append(_line("WARC-Profile", REVISIT_PROFILE))
    lines.append(_line("Content-Type", "application/http; msgtype=response" if http else "application/octet-stream"))
    lines.append(b"Content-Length: %d\r\n\r\n" % len(block))
    return b"".join([*lines, block, b"\r\n\r\n"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.compress = options.get("compress", "true").lower() == "true"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        files: list[tuple[str, int, int]] = []
        out, size, count = None, 0, 0

        def close() -> None:
            nonlocal out, size, count
            if out is not None:
                out.close()
                files.append((name, size, count))
            out, size, count = None, 0, 0

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{stem}-{len(files):04d}.warc" + ".gz" * self.compress
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = record(row, self.date)
                if self.compress:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                out.write(data)
                size += len(data)
                count += 1
                if size >= self.file_bytes:
                    close()
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        files = [list(f) for m in messages if m for f in m.files]
        if not self.overwrite and system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as old:
                files = json.loads(old.read())["files"] + files
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        for message in messages:
            for name, _, _ in message.files if message else []:
                system.delete_file(f"{root}/{name}")


class Source:
    """Bytes of an archive, record by record: gzip members, or plain records that can be skipped over."""

    def __init__(self, file, compressed: bool):
        self.file, self.compressed = file, compressed
        self.raw = b""

    def _more(self) -> bool:
        data = self.file.read(CHUNK)
        self.raw += data
        return bool(data)

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(headers, block) of the records that ``wanted(headers)`` takes; the others' blocks are passed over."""
        while True:
            inflate = zlib.decompressobj(31) if self.compressed else None
            text = b""
            # Headers first.
            while (end := text.find(b"\r\n\r\n")) < 0:
                if not self.raw and not self._more():
                    if text.strip():
                        raise ValueError("a record ends inside its headers")
                    return
                if inflate:
                    text += inflate.decompress(self.raw, CHUNK)
                    self.raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                    if inflate.eof and b"\r\n\r\n" not in text:
                        if text.strip():
                            raise ValueError("a gzip member holds no whole record")
                        inflate, text = zlib.decompressobj(31), b""
                else:
                    text, self.raw = (text + self.raw).lstrip(b"\r\n") if not text else text + self.raw, b""
            lines = text[:end].split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            headers = _headers(lines[1:])
            length = int(headers.get("content-length", "0"))
            take = wanted(headers)
            have = text[end + 4 :]
            if inflate:
                parts, kept = [have], len(have)
                while not inflate.eof:
                    if not self.raw and not self._more():
                        raise ValueError("a gzip member is cut off")
                    data = inflate.decompress(self.raw, 1 << 20)
                    self.raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                    if take and kept < length:
                        parts.append(data)
                    kept += len(data)
                if kept < length:
                    raise ValueError("a record is cut off")
                if take:
                    yield headers, b"".join(parts)[:length]
                continue
            if len(have) >= length:
                block, self.raw = have[:length], have[length:]
            elif take:
                rest = self.file.read(length - len(have))
                block = have + rest
                if len(block) < length:
                    raise ValueError("a record is cut off")
            else:
                self.file.seek(self.file.tell() + length - len(have))
                block = b""
            if take:
                yield headers, block


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality, lists and not-null tests on header columns; hands back the rest."""
        for test in filters:
            column = test.attribute[0] if len(getattr(test, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(test, (EqualTo, In, IsNotNull)):
                self.tests.append((column, None if isinstance(test, IsNotNull) else (test.value,) if isinstance(test, EqualTo) else tuple(test.value)))
            else:
                yield test

    def partitions(self) -> list[Files]:
        system, root = open_path(self.path)
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as file:
                found = [(f"{root}/{name}", size) for name, size, _ in json.loads(file.read())["files"]]
        elif system.get_file_info(root).type == fs.FileType.File:
            found = [(root, 0)]
        else:
            found = [(i.path, i.size) for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.path.endswith((".warc", ".warc.gz"))]
        parts: list[Files] = []
        room = 0
        for name, size in sorted(found):
            if not parts or size > room:
                parts.append(Files([]))
                room = self.split_bytes
            parts[-1].names.append(name)
            room -= size
        return parts or [Files([])]

    def _columns(self, headers: dict[str, str]) -> dict[str, str | None]:
        out = {c: headers.get(name.lower()) for c, name in HEADERS.items()}
        for c in ("record_id", "refers_to", "target_uri"):
            if out[c] is not None and out[c].startswith("<") and out[c].endswith(">"):
                out[c] = out[c][1:-1]
        if (out["payload_digest"] or "").startswith("sha1:"):
            out["payload_digest"] = out["payload_digest"][5:]
        return out

    def _wanted(self, headers: dict[str, str]) -> bool:
        row = self._columns(headers)
        return all(row[c] is not None if values is None else row[c] is not None and row[c] in values for c, values in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_path(self.path)
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for name in partition.names:
            with system.open_input_file(name) as file:
                for headers, block in Source(file, name.endswith(".gz")).records(self._wanted):
                    row = self._columns(headers)
                    length, payload = len(block), block
                    if headers.get("content-type", "").startswith("application/http"):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        length = len(payload)
                        if row["record_type"] == "revisit":
                            stated = [x.partition(b":")[2] for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            length, payload = (int(stated[0]) if stated else None), None
                    row["payload_length"], row["payload"] = length, payload if self.payload else None
                    rows.append(row)
                    held += len(block)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


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


def page_records(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Records of pages: of equal payloads, that of the smallest page_id is the response.

    Only digests with several pages are joined back, stored first so that their
    size is known. Pages without an id come last; where no page of a payload has
    an id, all are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    several = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    several = scratch.store(several, "digests")
    joined = rows.join(several, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        base32(F.col("digest")).alias("payload_digest"),
        F.when(revisit, name("first")).alias("refers_to"),
        F.length("payload").cast("long").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(hex_digest):
    """Upper-case base32 of a 40-digit hex string: four characters for each five digits."""
    parts = []
    for i in range(8):
        number = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = scratch.path("archive")
    page_records(pages, scratch).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    # A response's facts come from the payload read; a revisit has none of its own.
    return back.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
