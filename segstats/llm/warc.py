"""Web archives: write records, index them first, read selected records by sorted and coalesced byte ranges.

Every task writes one archive of gzip members, one per record, into the given folder and returns the index rows: archive, offset,
length, page id, URL, payload digest and size, record type. The index is a table; archives of lost attempts are in no index
row and so are never read. A payload of at least ``least_bytes`` that several records share is stored once, with the
largest page id; the others become revisits that point to it.

Reading takes any selection of the index, groups it by archive and stretch of ``BLOCK`` bytes, sorts by offset and reads
neighbouring records with one request. Blocks bound a task however many records one archive or host has.

Defined cases: a null html is an empty payload; records without a page id are stored, rank lowest as response and are named by
an empty id; rows that repeat the largest page id of their payload are all responses; an empty table gives no archive.
The folder must be one that ``pyarrow.fs`` opens on every executor (file, hdfs, s3, gs URIs).
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.session import materialize, scratch_path

LEAST_BYTES = 1000
#: Records start a new read block at every multiple of this offset; ranges closer than GAP are read together.
BLOCK = 1 << 25
GAP = 1 << 14
#: One request is at most this long, unless a single record is longer.
REQUEST = 1 << 23
LEVEL = 1
INDEX = (
    "archive string, offset bigint, length bigint, page_id {kind}, url string, digest string, payload_bytes bigint, "
    "record_type string, refers_to {kind}"
)
ENDING = b"\r\n\r\n"


def header_safe(value: str) -> str:
    """A header value on one line; control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; a revisit has the headers of its payload and not the payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        + body
    )
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_safe(url)}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode() + ENDING + block + ENDING


def parse(raw: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(ENDING)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(ENDING)
    size = next(int(x.split(": ")[1]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return {"headers": headers, "payload": payload, "payload_bytes": size}


def name_in(header: str | None) -> str | None:
    return header[len("<urn:page:"):-1] if header is not None else None


def hex_digest(header: str) -> str:
    return base64.b32decode(header.removeprefix("sha1:")).hex()


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages (page_id, url, payload)`` with digest and ``refers_to``, the response that a record revisits.

    Only shared digests are joined back; whether they are broadcast or the pages shuffled follows from their size.
    """
    digested = pages.withColumn("digest", F.sha1("payload"))
    shared = (
        digested.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    shared = materialize(shared.select(F.col("digest").alias("shared"), "first"), "shared")
    joined = digested.join(
        shared, (F.col("digest") == F.col("shared")) & (F.octet_length("payload") >= least_bytes), "left"
    )
    points = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(points, F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """Write one record per row below ``folder``; the result is the index, already stored there."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = with_originals(
        pages.select(
            F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
            F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("payload"),
        ),
        least_bytes,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, out, at = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = store.open_output_stream(name, compression=None)
            offsets, lengths, sizes = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page, url, payload, digest, refers_to in zip(*columns):
                refers = None if refers_to is None else str(refers_to)
                packed = _gzip(record("" if page is None else str(page), url, payload, digest, refers))
                out.write(packed)
                offsets.append(at)
                lengths.append(len(packed))
                sizes.append(len(payload))
                at += len(packed)
            types = ["response" if r is None else "revisit" for r in columns[4]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * batch.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                    batch.column("page_id"), batch.column("url"), batch.column("digest"), pa.array(sizes, pa.int64()),
                    pa.array(types), batch.column("refers_to"),
                ],
                names=["archive", "offset", "length", "page_id", "url", "digest", "payload_bytes", "record_type", "refers_to"],
            )
        if out is not None:
            out.close()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return materialize(rows.mapInArrow(run, INDEX.format(kind=kind)), "warc-index")


def read_ranges(store: fs.FileSystem, rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """Record bytes for sorted ``(archive, offset, length)``, neighbours in one request."""
    at, source, opened = 0, None, None
    while at < len(rows):
        name, start, length = rows[at]
        end, last = start + length, at + 1
        while last < len(rows) and rows[last][0] == name and rows[last][1] <= end + GAP and rows[last][1] + rows[last][2] - start <= REQUEST:
            end = max(end, rows[last][1] + rows[last][2])
            last += 1
        if name != opened:
            if source is not None:
                source.close()
            source, opened = store.open_input_file(name), name
        data = memoryview(source.read_at(end - start, start))
        for _, offset, size in rows[at:last]:
            yield zlib.decompress(data[offset - start:offset - start + size], 31)
        at = last
    if source is not None:
        source.close()


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """``(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload])`` of the index rows given, from the archives.

    Digests of responses are checked against the payload that was read.
    """
    kind = index.schema["page_id"].dataType
    named = f"page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string{', payload binary' if with_payload else ''}"
    block = F.floor(F.col("offset") / BLOCK)
    total = index.agg(F.sum("length")).first()[0] or 0
    # as many tasks as there are blocks of archive bytes: by the size of the index alone Spark would make far fewer
    tasks = max(1, -(-total // BLOCK))
    placed = index.select("archive", "offset", "length").repartition(tasks, "archive", block).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            places = list(zip(*[c.to_pylist() for c in batch.columns]))
            for some in _slices(places):
                rows = []
                for raw in read_ranges(store, some):
                    r = parse(raw)
                    h, digest = r["headers"], hex_digest(r["headers"]["WARC-Payload-Digest"])
                    if h["WARC-Type"] == "response" and sha1(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not have its digest")
                    row = (
                        name_in(h["WARC-Record-ID"]) or None, h.get("WARC-Target-URI"), h["WARC-Type"], r["payload_bytes"],
                        digest, name_in(h.get("WARC-Refers-To")),
                    )
                    rows.append(row + (r["payload"],) if with_payload else row)
                types = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()] * with_payload
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload,
                )

    found = placed.mapInArrow(run, named)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def _slices(places: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of about one request each."""
    some, size = [], 0
    for p in places:
        some.append(p)
        size += p[2]
        if size >= REQUEST:
            yield some
            some, size = [], 0
    if some:
        yield some


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, as a URI."""
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
