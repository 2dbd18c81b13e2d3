"""FASTQ as a Spark data source (S4) and sink.

The source splits plain files by bytes and reads a gzip file in one partition. It only cuts lines into
records, a block at a time into Arrow batches; names, mates and everything else are column expressions.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW_SCHEMA = "file string, pos bigint, header string, sequence string, plus string, quality string"
_ARROW_SCHEMA = pa.schema(
    [("file", pa.string()), ("pos", pa.int64())]
    + [(c, pa.string()) for c in ("header", "sequence", "plus", "quality")]
)
BLOCK_BYTES = 8 << 20


class FastqSplit(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _expand(path: str) -> list[tuple[str, int]]:
    """Files below a path with their sizes."""
    fs, inner = _filesystem(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
        return sorted(
            (prefix + f.path, f.size) for f in found
            if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))
        )
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return [(path, info.size)]


def _next_record(handle, start: int) -> int:
    """Offset of the first record at or after ``start``: a line with ``@`` whose second next line has ``+``.

    A quality line may begin with ``@``, but then the second next line is a sequence.
    """
    handle.seek(start - 1)
    offset = start - 1 + len(handle.readline())
    lines, offsets = [], []
    while True:
        while len(lines) < 3:
            line = handle.readline()
            if not line:
                return offset
            lines.append(line)
            offsets.append(offset)
            offset += len(line)
        if lines[0].startswith(b"@") and lines[2].startswith(b"+"):
            return offsets[0]
        lines.pop(0)
        offsets.pop(0)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(";") if p]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", 128 << 20)))
        if not self.paths:
            raise ValueError("the fastq source needs a path")

    def partitions(self) -> list[FastqSplit]:
        splits = []
        for root in self.paths:
            for path, size in _expand(root):
                if path.endswith(".gz") or size <= self.split_bytes:
                    splits.append(FastqSplit(path, 0, None))
                else:
                    bounds = list(range(0, size, self.split_bytes)) + [size]
                    splits += [FastqSplit(path, a, b) for a, b in zip(bounds, bounds[1:])]
        return splits

    def read(self, split: FastqSplit) -> Iterator[pa.RecordBatch]:
        fs, inner = _filesystem(split.path)
        with fs.open_input_file(inner) as raw:
            handle = gzip.GzipFile(fileobj=raw) if split.path.endswith(".gz") else io.BufferedReader(raw, BLOCK_BYTES)
            start, end = split.start, split.end
            if end is not None:
                start = _next_record(handle, split.start) if split.start else 0
                end = _next_record(handle, split.end) if split.end < fs.get_file_info(inner).size else split.end
            if split.end is not None:
                handle.seek(start)
            yield from _batches(split.path, handle, start, end)


def _batches(path: str, handle, start: int, end: int | None) -> Iterator[pa.RecordBatch]:
    """Blocks of whole records. ``pos`` is the byte offset of the record in the (unpacked) file."""
    rest, offset = b"", start
    while True:
        want = BLOCK_BYTES if end is None else min(BLOCK_BYTES, end - offset - len(rest))
        block = handle.read(want) if want > 0 else b""
        data = rest + block
        last = not block
        lines = data.split(b"\n")
        if last:
            if lines and lines[-1] == b"":
                lines.pop()
            whole = len(lines)
        else:
            whole = (len(lines) - 1) // 4 * 4
        if whole:
            yield _record_batch(path, lines[:whole], offset)
        used = sum(map(len, lines[:whole])) + whole
        rest = data[used:]
        offset += used
        if last:
            return


def _record_batch(path: str, lines: list[bytes], offset: int) -> pa.RecordBatch:
    lines = lines + [None] * (-len(lines) % 4)
    text = [None if line is None else line.rstrip(b"\r").decode("utf-8", "replace") for line in lines]
    positions, at = [], offset
    for i in range(0, len(lines), 4):
        positions.append(at)
        at += sum(len(line) + 1 for line in lines[i:i + 4] if line is not None)
    columns = [pa.array([path] * len(positions)), pa.array(positions, pa.int64())]
    columns += [pa.array(text[j::4], pa.string()) for j in range(4)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCHEMA)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


def parse_headers(raw: DataFrame) -> DataFrame:
    """Read id without ``@`` and mate suffix, mate from ``/1`` or ``/2``, the rest as comment."""
    name = F.regexp_extract(F.coalesce("header", F.lit("")), r"^@(\S*)", 1)
    return raw.select(
        "file", "pos", "header",
        F.regexp_replace(name, r"/[12]$", "").alias("read_id"),
        F.nullif(F.regexp_extract(name, r"/([12])$", 1), F.lit("")).cast("int").alias("mate"),
        F.regexp_extract(F.coalesce("header", F.lit("")), r"^\S*\s+(.*)$", 1).alias("comment"),
        "sequence", "plus", "quality",
    )


def read_fastq(spark: SparkSession, paths: str | list[str], split_bytes: int = 128 << 20) -> DataFrame:
    """S4. Plain or gzip FASTQ files or folders of them."""
    spark.dataSource.register(FastqSource)
    listed = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.format("fastq").option("path", ";".join(listed)).option("splitBytes", split_bytes).load()
    return parse_headers(raw)


def gene_of(comment="comment"):
    """The gene symbol a read header carries as ``GENE:<symbol>``."""
    return F.nullif(F.regexp_extract(comment, r"GENE:(\S+)", 1), F.lit(""))


def write_fastq(reads: DataFrame, path: str, name: str = "read_name", compression: str = "gzip") -> None:
    """S14. One four-line record per row, gzip part files; no shuffle."""
    header = F.concat(
        F.lit("@"), F.col(name),
        F.when(F.col("mate").isNotNull(), F.concat(F.lit("/"), F.col("mate").cast("string"))).otherwise(""),
        F.when(F.length("comment") > 0, F.concat(F.lit(" "), F.col("comment"))).otherwise(""),
    )
    reads.select(
        F.concat_ws("\n", header, "sequence", F.lit("+"), "quality").alias("value")
    ).write.text(path, compression=compression)
