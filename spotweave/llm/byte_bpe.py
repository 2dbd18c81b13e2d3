"""Byte-level BPE over the corpus: each distinct word is encoded once, wherever it occurs.

Texts are cut into pre-tokens in blocks of some megabytes. A block explodes into its distinct words, each with
a number (slot), and the sequence of slots by position. Words meet in a shuffle by word hash, one packed row
per block and hash bucket, so that a frequent word costs one entry per block however often it occurs. Each
bucket encodes its distinct words once and sends the ids back to the blocks, where they are put at their
positions. Decoding joins the ids of a document with the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 12 << 20  # a block holds whole texts and ends after so many characters
CACHED_WORDS = 1_000_000  # encoded words a bucket keeps at hand; beyond it starts anew
DECODE_TOKENS = 1 << 19  # tokens decoded at a time, and of the texts that are put together or decoded at a time, about
DOCS_AT_ONCE = 256  # texts of a block put together at a time
WIDE = 0x250  # below this code point a faster, equal pattern serves

# Fixed by the tokenizer: its word pattern and its white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

RANKS_FILE = "byte_bpe_50k.tiktoken"


@lru_cache(1)
def _patterns():
    import unicodedata

    of = lambda kind: "".join(chr(c) for c in range(128, WIDE) if unicodedata.category(chr(c))[0] == kind)
    letters, digits, space = "A-Za-z" + of("L"), "0-9" + of("N"), "\t-\r \x85\xa0"
    narrow = re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"
    )
    return re.compile(f"[^\x00-{chr(WIDE - 1)}]").search, narrow.findall, regex.compile(PATTERN).findall


def pre_tokens(text: str) -> list[str]:
    """The words that are encoded separately; joined they are the text."""
    wide, narrow_words, wide_words = _patterns()
    return (wide_words if wide(text) else narrow_words)(text)


def read_ranks(path: str) -> bytes:
    """A rank file's bytes; the driver reads it and sends it along, a megabyte or so."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(2)
def token_bytes(ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: all bytes in a row, and each token's start and length."""
    table = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in ranks.splitlines() if line))
    lengths = np.zeros(table[-1][0] + 1, np.int64)
    lengths[[r for r, _ in table]] = [len(t) for _, t in table]
    return np.frombuffer(b"".join(t for _, t in table), np.uint8), np.cumsum(lengths) - lengths, lengths


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers by byte plane, compressed: [count, planes, bytes] of each array."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u4")
        planes = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        parts.append(np.array([len(a), planes], "<u4").tobytes() + a.view(np.uint8).reshape(-1, 4)[:, :planes].T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(packed: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    while at < len(data):
        n, planes = np.frombuffer(data, "<u4", 2, at)
        wide = np.zeros((int(n), 4), np.uint8)
        wide[:, :planes] = np.frombuffer(data, np.uint8, int(n) * int(planes), at + 8).reshape(int(planes), int(n)).T
        out.append(wide.view("<u4").reshape(-1))
        at += 8 + int(n) * int(planes)
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + length) one after another."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total, dtype=np.int64)


PARTS_SCHEMA = "block string, kind string, key string, payload binary, words binary, ids array<long>"
_PARTS = pa.schema(
    [("block", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("payload", pa.binary()),
     ("words", pa.binary()), ("ids", pa.list_(pa.int64()))]
)


def _explode(buckets: int, block_chars: int):
    def rows(block: str, ids: list, texts: list[str]) -> pa.RecordBatch:
        slots = defaultdict(count().__next__)
        seqs = [np.fromiter(map(slots.__getitem__, w), np.uint32, len(w)) for w in map(pre_tokens, texts)]
        seq = np.concatenate(seqs) if seqs else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(seq, minlength=len(slots)), kind="stable")  # frequent words get small slots
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = [w.encode() for w in slots]
        # parts of a recomputed block that differs from the lost one must not meet its other parts
        print_of = xxhash.xxh3_64(seq.tobytes())
        print_of.update(b"\0".join(words))
        block = f"{block}-{print_of.hexdigest()}"
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        out = [(block, "sequence", block, _pack(rank[seq], np.array([len(s) for s in seqs])), None, ids)]
        by_bucket = order[np.argsort(bucket[order], kind="stable")]
        for part in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
            if len(part):
                own = [words[i] for i in part]
                payload = _pack(np.diff(rank[part], prepend=0), np.array([len(w) for w in own]))
                packed = zstandard.ZstdCompressor(level=3).compress(b"".join(own))
                out.append((block, "words", f"bucket {bucket[part[0]]}", payload, packed, None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS)], schema=_PARTS)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= block_chars:
                    yield rows(f"{task}-{number}", ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if texts:
            yield rows(f"{task}-{number}", ids, texts)

    return explode


def _encode_words(ranks):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = encoding(ranks.value)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == "words":
                    steps, lengths = _unpack(row["payload"])
                    blob = zstandard.ZstdDecompressor().decompress(row["words"])
                    if len(known) > CACHED_WORDS:
                        known.clear()
                    found, at = [], 0
                    for n in lengths.tolist():
                        word = blob[at : at + n]
                        at += n
                        ids = known.get(word)
                        if ids is None:
                            ids = known[word] = single(word)
                        found.append(ids)
                    flat = np.array([i for ids in found for i in ids], np.int64)
                    row |= {"kind": "ids", "payload": _pack(steps, np.array([len(x) for x in found]), flat), "words": None}
                out.append(tuple(row.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS)], schema=_PARTS)

    return encode


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in batch.to_pylist()]
    sequence = [r for r in rows if r["kind"] == "sequence"]
    if len(sequence) != 1:
        raise ValueError(f"block {rows[0]['block']} has {len(sequence)} sequences")
    parts = [_unpack(r["payload"]) for r in rows if r["kind"] == "ids"]
    seq, per_doc = _unpack(sequence[0]["payload"])
    slots = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    sizes = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    flat = np.concatenate([p[2] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
    if len(np.unique(slots)) != (int(seq.max()) + 1 if len(seq) else 0):
        raise ValueError(f"block {rows[0]['block']} misses words")
    starts, lengths = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
    starts[slots], lengths[slots] = np.cumsum(sizes) - sizes, sizes
    ids, ends = pa.array(sequence[0]["ids"], pa.int64()), np.cumsum(per_doc, dtype=np.int64)
    first, at = 0, 0
    while first < len(per_doc):  # texts of about so many words at a time, at least one
        last = max(first + 1, min(first + DOCS_AT_ONCE, int(np.searchsorted(ends, at + DECODE_TOKENS, "right"))))
        last = min(last, len(per_doc))
        here = seq[at : int(ends[last - 1])]
        size = lengths[here]
        total = np.concatenate([[0], np.cumsum(size)])
        offsets = np.concatenate([[0], total[ends[first:last] - at]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, flat[_spread(starts[here], size)])
        yield pa.RecordBatch.from_arrays([ids[first:last], lists], names=["doc_id", "ids"])
        first, at = last, int(ends[last - 1])


def encode(
    docs: DataFrame, ranks: bytes, text: str = "text", doc_id: str = "doc_id", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``, as the tiktoken library encodes its text without special tokens.

    A null text is an empty one and gives no ids. Rows that repeat, or repeat a doc_id (null too), each give a
    row. Other columns are not carried. An empty table gives an empty table. A block's texts are in memory of
    one task; a text longer than a block is a block of its own.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ranks)
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _explode(buckets, block_chars), PARTS_SCHEMA
    )
    encoded = parts.repartition("key").mapInArrow(_encode_words(sent), PARTS_SCHEMA)
    return encoded.groupBy("block").applyInArrow(_reassemble, "doc_id long, ids array<int>")


def _by_tokens(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about DECODE_TOKENS tokens, as their lists in the column ``place`` count them."""
    size = np.nan_to_num(pa.compute.list_value_length(batch.column(place)).to_numpy(zero_copy_only=False)).astype(np.int64)
    slices = (np.cumsum(size) - size) // DECODE_TOKENS
    firsts = np.flatnonzero(np.diff(slices, prepend=-1))
    for a, b in zip(firsts, np.append(firsts[1:], len(size))):
        yield batch.slice(a, b - a)


def decode(encoded: DataFrame, ranks: bytes, ids: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and ``bytes``, the bytes of its ids. A null list gives empty bytes; an id that
    the vocabulary lacks is an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    place = encoded.columns.index(ids)

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, starts, lengths = token_bytes(sent.value)
        for batch in (part for whole in batches for part in _by_tokens(whole, place)):
            lists = batch.column(place)
            offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))])
            tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(lengths) or not lengths[tokens].all()):
                raise ValueError("an id that is not in the vocabulary")
            size = lengths[tokens]
            pieces = [
                blob[_spread(starts[tokens[a : a + DECODE_TOKENS]], size[a : a + DECODE_TOKENS])]
                for a in range(0, len(tokens), DECODE_TOKENS)
            ]
            data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
            ends = np.concatenate([[0], np.cumsum(size)])[offsets].astype(np.int64)
            texts = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.binary())], names=[*batch.schema.names, "bytes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", bytes binary"
    return encoded.mapInArrow(join_bytes, schema)
