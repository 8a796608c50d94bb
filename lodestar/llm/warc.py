"""WARC archives: writing deduplicated captures, reading them back, and assembling transactions.

A capture is three records: a request, a response (or a revisit of an earlier response) and metadata. Request and
metadata carry ``WARC-Concurrent-To`` with the record id of the response. ``assemble`` joins the three through these
identifiers and emits one nested row per capture.

Records are gzip members of their own, so an archive can be cut at any record. Each task writes archives of bounded
size through the file system that the shared folder's URI names, under a name of its own; the manifest of finished
archives is a table, so what a lost executor left half-written is never read.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import looked_up, shared_dir, utf8, written

#: Payloads shorter than this are stored again and again: a revisit record would not be smaller.
MIN_REVISIT_BYTES = 100
#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
MANIFEST = "path string, records long, bytes long"
CAPTURE_PARTS = (
    "record_id string, record_type string, concurrent_to string, target_uri string, page_id long, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def with_roles(pages: DataFrame) -> DataFrame:
    """Adds ``payload``, its SHA-256, ``refers_to`` and ``refers_to_uri``.

    The digests are grouped first (partial aggregation leaves a row per digest and task), and only digests that occur
    on several rows are joined back. Payloads too short to be revisited stay out of the join, and pages of a digest that
    very many share, an error page perhaps, are dealt over all tasks (``shared.looked_up``).
    """
    payload = utf8(F.col("html"))
    long = F.length("payload") >= MIN_REVISIT_BYTES
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    rows = rows.withColumn("_key", F.when(long, F.col("payload_digest")))
    heads = (
        pages.select("page_id", "url", payload.alias("payload"))
        .where(long)
        .groupBy(F.sha2("payload", 256).alias("_key"))
        .agg(F.min("page_id").alias("head"), F.min_by("url", "page_id").alias("refers_to_uri"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND head IS NOT NULL")
        .select("_key", "head", "refers_to_uri")
    )
    joined = looked_up(rows, heads, "_key", "page_id", "url", total=pages.count(), nulls=True)
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("head"))).drop("head", "_key")


def record_id(kind: str, page_id: int | None, url: str, digest: str, serial: str) -> str:
    name = hashlib.md5(f"{kind}\0{page_id}\0{url}\0{digest}\0{serial}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{uuid.UUID(name)}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31, 9 if len(block) > 4096 else 5)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def header_value(text: str | None) -> str:
    """A header holds no line ends; they are percent-encoded, as in a URI."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def capture_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, serial: str, refers_to_uri: str | None = None) -> Iterator[bytes]:
    """The three records of one capture. ``serial`` keeps apart rows that repeat another row exactly."""
    uri = header_value(url)
    ids = {kind: record_id(kind, page_id, uri, digest, serial) for kind in ("response", "request", "metadata")}
    date = ("WARC-Date", "2000-01-01T00:00:00Z")
    page = ("X-Page-Id", "" if page_id is None else str(page_id))
    main = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", ids["response"]), date, ("WARC-Target-URI", uri), page, ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        yield member([*main, ("Content-Type", "application/http; msgtype=response")], http + payload)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield member([*main, ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", header_value(refers_to_uri)), ("WARC-Refers-To-Date", date[1]), ("X-Refers-To-Page-Id", str(refers_to)), ("Content-Type", "application/http; msgtype=response")], http)
    tail = [date, ("WARC-Target-URI", uri), page, ("WARC-Concurrent-To", ids["response"])]
    yield member([("WARC-Type", "request"), ("WARC-Record-ID", ids["request"]), *tail, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
    yield member([("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *tail, ("Content-Type", "application/warc-fields")], b"payload-bytes: %d\r\n" % len(payload))


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Writes ``captures`` (page_id, url, payload, payload_digest, refers_to, refers_to_uri) below ``folder``; returns the manifest.

    A task keeps at most one archive open and streams members into it. Tasks that are run again write other files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done, run, row = None, [], uuid.uuid4().hex, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "refers_to_uri")]
            for values in zip(*columns, strict=True):
                page_id, url, payload, digest, refers_to, uri = (v.as_py() for v in values)
                if out is None:
                    path = f"{root}/{run}-{len(done)}.warc.gz"
                    out, size, records = store.open_output_stream(path, compression=None), 0, 0
                for data in capture_records(page_id, url, payload, digest, refers_to, f"{run}{row}", uri):
                    out.write(data)
                    size, records = size + len(data), records + 1
                row += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    source = captures.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "payload", "payload_digest", F.col("refers_to").cast("long"), F.col("refers_to_uri").cast("string"))
    return written(source.mapInArrow(write, MANIFEST), "warc-manifest")


def members(stream: io.IOBase) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time; memory holds one record and one read."""
    pending = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending and not (pending := stream.read(READ_BYTES)):
                if parts:
                    raise ValueError("archive ends inside a record")
                return
            parts.append(unpack.decompress(pending))
            pending = unpack.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], memoryview]:
    """Header fields by lower-case name, and the block. A value is all that follows the blank after the colon."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, memoryview(record)[end + 4 : end + 4 + int(fields["content-length"])]


def read_records(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives. ``payloads=False`` measures and digests payloads but does not return them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    for record in members(stream):
                        head, block = parse(record)
                        number = head.get("x-page-id") or None
                        refers = head.get("x-refers-to-page-id") or None
                        size = digest = payload = None
                        if head["warc-type"] == "response":
                            body = block[end.end() :] if (end := re.search(rb"\r\n\r\n", block)) else block
                            size, digest, payload = len(body), hashlib.sha256(body).hexdigest(), bytes(body) if payloads else None
                            # Other writers may give no digest or one of another kind.
                            if head.get("warc-payload-digest", "").startswith("sha256:") and head["warc-payload-digest"] != f"sha256:{digest}":
                                raise ValueError("payload differs from its digest")
                            held += len(body) if payloads else 0
                        elif head["warc-type"] == "metadata":
                            stated = re.search(rb"payload-bytes: (\d+)", block)
                            size = int(bytes(stated[1])) if stated else None
                        elif head["warc-type"] == "revisit":
                            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-concurrent-to"), head.get("warc-target-uri"), number and int(number), refers and int(refers), size, digest, payload))
                        if len(rows) >= 8192 or held > 32 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # One archive is one unit of work.
    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("path").repartition(n).mapInArrow(read, CAPTURE_PARTS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and metadata concurrent to it.

    Record ids are unique, so groups have three rows and grouping them is even whatever the pages hold. A request or
    metadata record whose response is missing makes no capture.
    """
    part = F.struct("record_id", "record_type", "target_uri", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload")

    def of(*kinds: str):
        return F.first(F.when(F.col("record_type").isin(*kinds), part), ignorenulls=True)

    return (
        records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .groupBy("capture_id")
        .agg(of("response", "revisit").alias("response"), of("request").alias("request"), of("metadata").alias("metadata"))
        .where("response IS NOT NULL")
    )


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes the pages as archives in the shared folder, reads these back and assembles the captures."""
    folder = shared_dir(pages.sparkSession, "warc")
    manifest = write_archives(with_roles(pages), folder)
    return assemble(read_records(manifest, folder, payloads))


def page_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Null html is an empty payload; a null url is an empty target; a page without page_id never is what others refer
    to. Rows that repeat the smallest page_id of a payload are all responses. Other columns are ignored.
    """
    captures = round_trip(pages)
    return captures.select(
        F.col("response.page_id").alias("page_id"),
        # A revisit holds no payload: its size is what the concurrent metadata record says.
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
    )
