"""WARC archives as a Spark data source, and archiving of pages with revisit records.

``spark.dataSource.register(WarcSource)`` gives the format ``warc``. The writer makes one gzip member per record, rolls
files at a size, and its commit writes a manifest that names the files of successful tasks only, so files of lost or
repeated attempts are never read. The length of each member stands in its gzip header (extra field ``sl``), so a reader
inflates the WARC headers of a record first and jumps over the payload of records that no predicate wants; archives of
other makers, without that field, are inflated through but not decoded.

The reader plans one partition per file and takes over equality and IN predicates on record type and header columns.
Option ``payload=false`` returns no payloads and reads headers only.

Pages: null payloads are empty; rows with the same page id are archived one by one; a null id is archived with an empty
id and comes back null, as a revisit if another page has its payload. Repeated rows of one id and payload are all
responses, or all revisits. Extra columns are not archived. An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, WriterCommitMessage)

from ragspark.llm.common import stored
from ragspark.session import ensure_checkpoint_dir

#: Fixed values of the file format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_COLUMNS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
                  "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "page_key": "WARC-Page-Key",
                  "full_length": "WARC-Payload-Length"}
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in HEADER_COLUMNS] + [T.StructField("payload", T.BinaryType())])
MANIFEST = "manifest.json"
FILE_BYTES = 64 << 20
HEAD_BYTES = 1024
READ_BYTES = 1 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: Column) -> Column:
    """A record id that follows from the page's key."""
    digits = F.md5(F.concat(F.lit("page:"), key))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def gzip_member(content: bytes) -> bytes:
    """One gzip member whose extra field ``sl`` holds its own length and the content's length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + whole.to_bytes(4, "little") + (len(content) & 0xFFFFFFFF).to_bytes(4, "little")
    return (b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + len(extra).to_bytes(2, "little") + extra + body
            + zlib.crc32(content).to_bytes(4, "little") + (len(content) & 0xFFFFFFFF).to_bytes(4, "little"))


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record where one should start")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class WarcFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    records: int


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], schema, int(self.options.get("filebytes", FILE_BYTES)))


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of the source's schema as records; a payload of null gives a record without an HTTP body."""

    def __init__(self, path: str, schema: T.StructType, file_bytes: int):
        self.path, self.names, self.file_bytes = path, schema.names, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        # the name of a repeated or speculative attempt differs, so attempts never share a file
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        files, out, size, count = [], None, 0, 0
        for batch in iterator:
            columns = [batch.column(self.names.index(n)) for n in SCHEMA.names]
            for row in range(batch.num_rows):
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"{stem}-{len(files)}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                member = gzip_member(self._record(dict(zip(SCHEMA.names, (c[row].as_py() for c in columns)))))
                out.write(member)
                size += len(member)
                count += 1
        if out is not None:
            out.close()
        return Written(files, count)

    @staticmethod
    def _record(row: dict) -> bytes:
        payload = row.pop("payload")
        headers = {HEADER_COLUMNS[k]: v for k, v in row.items() if v is not None}
        headers |= {"WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response"}
        if row["record_type"] == "revisit":
            headers["WARC-Profile"] = PROFILE
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return warc_record(headers, http + (payload or b""))

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        listed = {"files": [f for m in messages if m for f in m.files], "records": sum(m.records for m in messages if m)}
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        for name in (f for m in messages if m for f in m.files):
            system.delete_file(f"{folder}/{name}")


class WarcReader(DataSourceReader):
    """One partition per file; header predicates decide before a payload is inflated or decoded."""

    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADER_COLUMNS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values
            # Spark tests the rows that are left again: a scan does not show its pushed predicates in the plan, and
            # two scans that differ in them alone would otherwise count as one and be reused for each other
            yield f

    def partitions(self) -> list[WarcFile]:
        system, folder = _open(self.path)
        manifest = f"{folder}/{MANIFEST}"
        if system.get_file_info(manifest).type == pafs.FileType.File:
            names = json.loads(system.open_input_stream(manifest).read())["files"]
        else:
            found = system.get_file_info(pafs.FileSelector(folder))
            names = sorted(i.base_name for i in found if i.base_name.endswith((".warc", ".warc.gz")))
        return [WarcFile(f"{self.path}/{n}") for n in names] or [WarcFile("")]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, path = _open(partition.path)
        rows, held = [], 0
        with system.open_input_file(path) as file:
            walk = gzip_records if path.endswith(".gz") else plain_records
            for headers, body in walk(file):
                values = [headers.get(h.lower()) for h in HEADER_COLUMNS.values()]
                if any(v not in self.wanted[n] for n, v in zip(HEADER_COLUMNS, values) if n in self.wanted):
                    continue
                payload = None
                if self.payload:
                    block = body()
                    http = headers.get("content-type", "").startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                rows.append((*values, payload))
                held += len(payload or b"")
                if len(rows) >= 1000 or held >= 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.string()] * len(HEADER_COLUMNS) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SCHEMA.names)


def _split_head(data: bytes) -> int:
    return data.find(b"\r\n\r\n")


def gzip_records(file) -> Iterator[tuple[dict[str, str], object]]:
    """Headers of each member's record, and a function that inflates its block when asked."""
    at, size = 0, file.size()
    while at < size:
        file.seek(at)
        start = file.read(24)
        length = int.from_bytes(start[16:20], "little") if len(start) == 24 and start[3] & 4 and start[12:14] == b"sl" else 0
        if length:
            raw = start + file.read(length - 24)
            inflater = zlib.decompressobj(31)
            head = inflater.decompress(raw, HEAD_BYTES)
            while _split_head(head) < 0 and inflater.unconsumed_tail:
                head += inflater.decompress(inflater.unconsumed_tail, HEAD_BYTES)
            cut = _split_head(head)
            headers = parsed_headers(head[:cut])

            def body(inflater=inflater, head=head, cut=cut, n=int(headers["content-length"])) -> bytes:
                return (head + inflater.decompress(inflater.unconsumed_tail))[cut + 4:cut + 4 + n]

            yield headers, body
            at += length
            continue
        inflater, parts = zlib.decompressobj(31), []
        file.seek(at)
        used = 0
        while not inflater.eof:
            raw = file.read(READ_BYTES)
            if not raw:
                break
            parts.append(inflater.decompress(raw))
            used += len(raw)
        content = b"".join(parts)
        cut = _split_head(content)
        headers = parsed_headers(content[:cut])
        yield headers, lambda c=content, k=cut, n=int(headers["content-length"]): c[k + 4:k + 4 + n]
        at += used - len(inflater.unused_data)


def plain_records(file) -> Iterator[tuple[dict[str, str], object]]:
    """The same for an archive without compression; blocks are jumped over."""
    at, size = 0, file.size()
    while at < size:
        file.seek(at)
        head = b""
        while _split_head(head) < 0:
            more = file.read(HEAD_BYTES)
            if not more:
                break
            head += more
        cut = _split_head(head)
        if cut < 0:
            if head.strip():
                raise ValueError("a WARC record breaks off in its headers")
            return
        headers = parsed_headers(head[:cut])
        begin, n = at + cut + 4, int(headers["content-length"])

        def body(begin=begin, n=n) -> bytes:
            file.seek(begin)
            return file.read(n)

        yield headers, body
        at = begin + n + 4


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html",
                  url_col: str = "url", least_bytes: int = 0) -> None:
    """Write every page as a record below ``folder``.

    Of pages with equal payloads of at least ``least_bytes`` the largest id is the response; the others become revisit
    records that carry its record id and digest but no payload.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    digested = stored(with_digest(pages.select(id_col, payload_col), id_col, payload_col))
    # partial counts leave one row per digest and task before the shuffle; only repeated payloads go on
    repeated = (digested.where(F.col("n_bytes") >= least_bytes).groupBy("digest")
                .agg(F.max(id_col).alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"))
    revisits = (digested.where(F.col("n_bytes") >= least_bytes).join(repeated, "digest")
                .where(F.col(id_col).isNull() | (F.col(id_col) < F.col("response")))
                .select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("page_key"), "digest",
                        F.col("response").cast("string").alias("response")).distinct())
    rows = with_digest(pages.select(id_col, payload_col, F.col(url_col).alias("target_uri")), id_col, payload_col, True)
    rows = rows.withColumn("page_key", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    marked = rows.join(revisits, ["page_key", "digest"], "left")
    again = F.col("response").isNotNull()
    uris = F.regexp_replace("target_uri", r"[\r\n]", "")
    records = marked.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("page_key")).alias("record_id"), uris.alias("target_uri"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(again, record_id(F.col("response"))).alias("refers_to"), "page_key",
        F.col("n_bytes").cast("string").alias("full_length"),
        F.when(~again, F.col("payload")).alias("payload"))
    records.write.format("warc").mode("append").save(folder)


def with_digest(rows: DataFrame, id_col: str, payload_col: str, keep: bool = False) -> DataFrame:
    """Length and base32 SHA-1 of the payload's UTF-8 bytes; with ``keep`` also the bytes themselves and the URL."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(1).cast(pa.binary()).fill_null(b"")
            raw = payloads.to_pylist()
            arrays = [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(sha1_base32, raw), pa.string())]
            names = [id_col, "n_bytes", "digest"]
            if keep:
                arrays += [payloads, batch.column(2)]
                names += ["payload", "target_uri"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(digested, f"`{id_col}` {kind}, n_bytes long, digest string"
                           + (", payload binary, target_uri string" if keep else ""))


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def page_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archived page: id, length and digest of the full payload, record type and the page it refers to.

    Of responses both are computed from the payload as read; of revisits they stand in the record's headers.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(sha1_base32, raw), pa.string()),
                 batch.column(2)], ["page_key", "payload_bytes", "payload_digest", "record_id"])

    records = read_archive(spark, folder)
    page_id = F.expr("try_cast(page_key as bigint)").alias("page_id")
    responses = records.where("record_type = 'response'").select("page_key", "payload", "record_id").mapInArrow(
        measured, "page_key string, payload_bytes long, payload_digest string, record_id string")
    revisits = read_archive(spark, folder, payload=False).where("record_type = 'revisit'").select(
        page_id, F.col("full_length").cast("long").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.col("refers_to"))
    # only responses that a revisit names take part in the join
    named = responses_named(read_archive(spark, folder, payload=False), revisits)
    linked = revisits.join(named, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
        F.col("response_id").alias("refers_to"))
    return responses.select(
        page_id, "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to")).unionByName(linked)


def responses_named(headers: DataFrame, revisits: DataFrame) -> DataFrame:
    """Record id and page id of the responses that revisits name, one row per record id."""
    wanted = revisits.select("refers_to").distinct()
    found = headers.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.expr("try_cast(page_key as bigint)").alias("response_id"))
    return found.join(wanted, "refers_to", "left_semi").distinct()
