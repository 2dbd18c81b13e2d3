"""WARC archives: written with an index, read back by coalesced byte ranges.

Every task of ``write_archives`` writes archive files of its own under unique names, one gzip member per
record, and returns an index row per record: file, offset, length, URL and digest. The index is committed by
Spark as a table, so a task that ran twice leaves a file that no index row names. Readers select index rows
first; ``read_records`` sorts the ranges of each stretch of a file, joins neighbours into one read of bounded
length and parses only what was asked for. Files are reached by URI through Arrow's file systems, which
executors share; nothing is written to a local folder unless the shared folder is one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REVISIT_BYTES = 100
ROLL_BYTES = 1 << 30  # an archive is closed at this size
STRETCH_BYTES = 4 << 20  # index rows of one such stretch of a file are read by one task, and a task has one or two
GAP_BYTES = 64 << 10  # ranges closer than this become one read
READ_BYTES = 8 << 20  # and reads end at this length, unless one record is longer
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-01T00:00:00Z"

INDEX_SCHEMA = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary, intact boolean"
)


def file_system(uri: str):
    """Arrow's file system and path of a URI; ``file:/x`` and plain paths are accepted."""
    from pyarrow import fs

    if re.match(r"file:/(?!//)", uri):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
        block = http
    else:
        block = http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record, as RECORD_SCHEMA names them."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "page_id": number("Page-Id"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": number("Payload-Length") if revisit else len(payload),
        "payload_digest": stated if revisit else hashlib.sha256(payload).hexdigest(),
        "refers_to": number("Refers-To-Page-Id"),
        "payload": None if revisit else payload,
        "intact": revisit or (hashlib.sha256(payload).hexdigest() == stated and len(payload) == number("Payload-Length")),
    }


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` below ``folder`` and return the written index.

    A null html is an empty payload; a null URL leaves its header out; control characters of a URL are
    percent-encoded. Of rows with equal payloads of REVISIT_BYTES or more, those with the smallest page_id are
    responses (all of them, should a page_id repeat) and the others revisit them; a null page_id is never the
    smallest. Other columns are not stored. An empty table gives an empty index and no archive.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest")
    )
    slim = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = (
        slim.join(first, "digest")
        .where("refers_to is not null and (page_id is null or page_id <> refers_to)")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )
    same = (F.col("p.page_id").eqNullSafe(F.col("r.page_id"))) & (F.col("p.digest") == F.col("r.digest"))
    decided = rows.alias("p").join(revisits.alias("r"), same, "left").select("p.*", "r.refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if out is None:
                    name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None, buffer_size=1 << 20)
                revisit = row["refers_to"] is not None
                payload = row["html"].encode()
                packed = _gzip(_record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], revisit))
                out.write(packed)
                kind = "revisit" if revisit else "response"
                index.append((name, at, len(packed), row["page_id"], row["url"], row["digest"], kind))
                at += len(packed)
                if at >= roll_bytes:
                    out.close()
                    out = None
            if index:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*index), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])],
                    names=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"],
                )
        if out is not None:
            out.close()

    decided.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records that the rows of ``index`` name, fetched by sorted, coalesced byte ranges.

    ``folder`` says which store the file names belong to. ``payload`` is null for revisits, and for all if not
    asked for; ``intact`` says that length and digest of a payload agree with the header.
    """
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    # a number that is stated is kept: by itself Spark would deal tasks by the bytes of the index, not of the archives
    wanted = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
    readers = max(1, -(-wanted // STRETCH_BYTES))
    sorted_ranges = (
        index.select("file", "offset", "length", stretch.alias("stretch"))
        .repartition(readers, "file", "stretch")
        .sortWithinPartitions("file", "offset")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())]
        )
        run: list[tuple[int, int]] = []
        name, opened = None, None

        def fetch():
            start, end = run[0][0], run[-1][0] + run[-1][1]
            opened.seek(start)
            view = opened.read(end - start)
            found = []
            for offset, length in run:
                fields = parse_record(zlib.decompress(view[offset - start : offset - start + length], 31))
                if not with_payload:
                    fields["payload"] = None
                found.append(fields)
            return pa.RecordBatch.from_pylist(found, schema=schema)

        for batch in batches:
            for file, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                breaks = run and (
                    file != name
                    or offset > run[-1][0] + run[-1][1] + GAP_BYTES
                    or offset + length - run[0][0] > READ_BYTES
                )
                if breaks:
                    yield fetch()
                    run = []
                if file != name:
                    if opened is not None:
                        opened.close()
                    name, opened = file, store.open_input_file(file)
                run.append((offset, length))
        if run:
            yield fetch()
        if opened is not None:
            opened.close()

    return sorted_ranges.mapInArrow(read, RECORD_SCHEMA)
