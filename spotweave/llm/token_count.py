"""Token counts of whole texts; huge ones in overlapping chunks, spliced where both encodings must agree.

A text up to ``chunk_chars`` is encoded as it is. A longer one is cut into chunks that overlap, which are
dealt out and encoded apart, and each chunk reports the places in its overlaps where a token ends in its own
encoding. A place is proven stable if no word pattern reaches across it: before a single space between two visible
characters, between a letter and a digit, and before a sign that follows a letter or digit (in any script, so texts
without spaces have such places too), unless a special token holds both neighbours. Every encoding of the
text then has a token start there. Two
chunks are spliced at their first common stable place. A text with a splice that fails (no such place in an
overlap) is cut again with an overlap 16 times as long, until it holds or the text is one chunk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotweave.llm.byte_bpe import PATTERN, WIDE
from spotweave.llm.common import n_bytes
from spotweave.session import materialize

CHUNK_CHARS = 32 << 10
OVERLAP_CHARS = 256
WIDER = 16
VOCABULARY_FILE = "byte_bpe_50k.json"
_STABLE = regex.compile(r"(?<=\S) (?=\S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}\p{C}\p{Z}])")
_RARE = re.compile(f"[^\x00-{chr(WIDE - 1)}]")


def read_vocabulary(path: str) -> str:
    """A vocabulary file's text; the driver reads it and sends it along, a megabyte or two."""
    with open(path, encoding="utf8") as f:
        return f.read()


@lru_cache(2)
def _library(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_str(vocabulary)


@lru_cache(2)
def _ranked(vocabulary: str):
    """The same encoder by ranks, several times faster, where the vocabulary is ordered by merge; else None.

    Gives the encoding and the byte length of every token.
    """
    stated = json.loads(vocabulary)
    model, before = stated["model"], stated["pre_tokenizer"]
    plain = [t for t in stated["added_tokens"] if not (t["special"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"])]
    if model["type"] != "BPE" or stated["normalizer"] or plain or not before or before["type"] != "ByteLevel":
        return None
    if before["add_prefix_space"] or not before["use_regex"] or any(" " in t["content"] for t in stated["added_tokens"]):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes the vocabulary shows as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in stated["added_tokens"]}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    by_rank = [model["vocab"][m] for m in merges]
    if by_rank != sorted(by_rank):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        lengths[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), lengths


def token_ends(text: str, vocabulary: str) -> np.ndarray:
    """Where the tokens of a text end, in UTF-8 bytes, as the tokenizers library gives them."""
    ranked = _ranked(vocabulary)
    if ranked and not _RARE.search(text):
        try:
            return np.cumsum(ranked[1][ranked[0].encode(text, allowed_special="all")])
        except ValueError:  # its pattern engine gives up on a very long run of white space
            pass
    # a character's tokens share its offsets, so the ends in bytes come from the tokens themselves
    tokens = _library(vocabulary).encode(text, add_special_tokens=False)
    special = {t.content for t in _library(vocabulary).get_added_tokens_decoder().values()}
    return np.cumsum([len(t.encode()) if t in special else len(t) for t in tokens.tokens] or [0])[: len(tokens.ids)]


def n_tokens(text: str, vocabulary: str) -> int:
    return len(token_ends(text, vocabulary))


@lru_cache(2)
def _inside_special(vocabulary: str) -> frozenset[str]:
    """All two neighbours within special tokens: a chunk may end inside such a token."""
    added = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
    return frozenset(t[i : i + 2] for t in added for i in range(len(t) - 1))


def _stable_places(text: str, first: int, last: int, ends: np.ndarray, joined: frozenset[str]) -> tuple[list[int], list[int]]:
    """Stable places of a chunk from character ``first`` to ``last``, and the tokens before each."""
    places, before = [], []
    at, seen = len(text[:first].encode()), first
    for m in _STABLE.finditer(text, first, last):
        place = m.start()
        if text[place - 1 : place + 1] in joined:
            continue
        at, seen = at + len(text[seen:place].encode()), place
        i = int(np.searchsorted(ends, at))
        if i < len(ends) and ends[i] == at:
            places.append(place)
            before.append(i + 1)
    return places, before


_CUT_SCHEMA = "doc_id long, key string, chunk long, chunks long, start long, left_end long, right_start long, text string"
_SPLICE_SCHEMA = (
    "doc_id long, key string, chunk long, chunks long, n_tokens long, left array<long>, left_before array<long>, "
    "right array<long>, right_before array<long>"
)


def _cut(chunk_chars: int, overlap: int):
    stride = max(chunk_chars, overlap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text in zip(*[batch.column(i) for i in range(3)]):
                doc_id, key, text = doc_id.as_py(), key.as_py(), text.as_py()
                chunks = 1 if overlap >= len(text) else max(1, -(-len(text) // stride))
                for i in range(chunks):
                    start = i * stride
                    end = len(text) if i == chunks - 1 else min(len(text), start + stride + overlap)
                    # the overlap with the chunk before lies at the start, that with the next begins there
                    left_end = min(end, start + overlap) if i else start
                    right_start = start + stride if i < chunks - 1 else end
                    row = (doc_id, key, i, chunks, start, left_end - start, right_start - start, text[start:end])
                    yield pa.RecordBatch.from_pylist([dict(zip(_CUT, row))], schema=pa.schema(_CUT.items()))

    return cut


_CUT = {
    "doc_id": pa.int64(), "key": pa.string(), "chunk": pa.int64(), "chunks": pa.int64(), "start": pa.int64(),
    "left_end": pa.int64(), "right_start": pa.int64(), "text": pa.string(),
}
_SPLICE = {"doc_id": pa.int64(), "key": pa.string(), "chunk": pa.int64(), "chunks": pa.int64(), "n_tokens": pa.int64()} | {
    name: pa.list_(pa.int64()) for name in ("left", "left_before", "right", "right_before")
}


def _encode_chunks(vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, start = row["text"], row["start"]
                ends = token_ends(text, vocabulary.value)
                joined = _inside_special(vocabulary.value)
                left, left_before = _stable_places(text, 0, row["left_end"], ends, joined) if row["left_end"] else ([], [])
                right, right_before = _stable_places(text, row["right_start"], len(text), ends, joined)
                out.append(
                    {k: row[k] for k in ("doc_id", "key", "chunk", "chunks")}
                    | {"n_tokens": len(ends), "left": [start + p for p in left], "left_before": left_before}
                    | {"right": [start + p for p in right], "right_before": right_before}
                )
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(_SPLICE.items()))

    return encode


def _spliced(chunks: DataFrame) -> DataFrame:
    """(doc_id, key, n_tokens or null where a splice failed, copies) from encoded chunks."""
    ids = ["doc_id", "key"]
    chunks = chunks.groupBy(*ids, "chunk", "chunks").agg(
        F.count("*").alias("copies"),
        *[F.first(c).alias(c) for c in ("n_tokens", "left", "left_before", "right", "right_before")],
    )  # rows that repeat give equal chunks
    after = chunks.select(
        F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), (F.col("chunk") - 1).alias("before_chunk"),
        F.col("left").alias("next_left"), F.col("left_before").alias("next_before"),
    )
    paired = chunks.join(
        after,
        F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("key") == F.col("next_key")) & (F.col("chunk") == F.col("before_chunk")),
        "left",
    )
    place = F.array_min(F.array_intersect("right", "next_left"))
    at = lambda places, values: F.element_at(values, F.array_position(places, place).cast("int"))
    last = F.col("chunk") == F.col("chunks") - 1
    part = F.when(last, F.col("n_tokens")).when(
        place.isNotNull(), at(F.col("right"), F.col("right_before")) - at(F.col("next_left"), F.col("next_before"))
    )
    return paired.groupBy(*ids).agg(
        F.when(F.count(part) == F.count("*"), F.sum(part)).alias("n_tokens"), F.max("copies").alias("copies")
    )


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    doc_id: str = "doc_id",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``.

    A null text is an empty one: no bytes, no tokens. Rows that repeat, or repeat a doc_id (null too), each give
    a row. Other columns are not carried. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    long_text = F.length(F.coalesce("text", F.lit(""))) > chunk_chars

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [n_tokens(t.as_py() or "", sent.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = rows.where(~long_text).withColumn("n_bytes", n_bytes(F.col("text"))).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    huge = rows.where(long_text).withColumn("key", F.md5("text")).select("doc_id", "key", "text")
    sizes = huge.select("doc_id", "key", n_bytes(F.col("text")).alias("n_bytes")).groupBy("doc_id", "key").agg(F.max("n_bytes").alias("n_bytes"))
    left = huge
    while True:
        cut = left.mapInArrow(_cut(chunk_chars, overlap), _CUT_SCHEMA).repartition("key", "chunk")
        encoded = materialize(cut.mapInArrow(_encode_chunks(sent), _SPLICE_SCHEMA), "token-chunks")  # read twice
        spliced = materialize(_spliced(encoded), "token-splices")
        same = F.col("s.doc_id").eqNullSafe(F.col("z.doc_id")) & (F.col("s.key") == F.col("z.key"))
        done = spliced.where("n_tokens is not null").alias("s").join(sizes.alias("z"), same)
        done = done.select("s.doc_id", "z.n_bytes", "s.n_tokens", F.explode(F.sequence(F.lit(1), F.col("s.copies").cast("int"))).alias("copy"))
        out = out.unionByName(done.drop("copy"))
        failed = spliced.where("n_tokens is null")
        if failed.limit(1).count() == 0:
            return out
        again = failed.select(F.col("doc_id").alias("failed_id"), F.col("key").alias("failed_key"))
        same = F.col("doc_id").eqNullSafe(F.col("failed_id")) & (F.col("key") == F.col("failed_key"))
        left, overlap = huge.join(again, same, "left_semi"), overlap * WIDER
