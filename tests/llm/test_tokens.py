import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotweave.llm import byte_bpe, token_count
from spotweave.llm.queries import bpe_digests

DOCS = "doc_id long, text string, ids string, n_bytes string"
ALPHABET = [
    chr(c)
    for a, b in ((0, 0x300), (0x370, 0x600), (0x2000, 0x2100), (0x3000, 0x3100), (0x1F600, 0x1F640), (0x4E00, 0x4E40))
    for c in range(a, b)
]


def texts():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(ALPHABET + [" "] * 300, k=rng.randint(0, 250)))) for i in range(120)]
    rows += [(None, None), (5, ""), (5, ""), (7, " " * 5000 + "a"), (8, "'s't'RE  \n\n x"), (None, "a b"), (None, "a b")]
    rows += [(900, "ab<|endoftext|> cd<|endoftext|>" * 40), (901, "x" * 3000), (901, "x" * 3000), (903, "the end " * 500)]
    return [(*r, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_bpe.RANKS_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark, library):
    rows = texts()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())))
    got = [tuple(r) for r in bpe_digests(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_small_blocks_and_round_trip(spark, library):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS_FILE))
    docs = spark.createDataFrame(texts(), DOCS)
    out = byte_bpe.decode(byte_bpe.encode(docs, ranks, block_chars=500), ranks).collect()
    got = sorted(((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in out), key=repr)
    assert got == sorted(((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in texts()), key=repr)
    bad = spark.createDataFrame([([50256],)], "ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(bad, ranks).collect()
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), ranks).first().bytes == b""


@pytest.mark.parametrize("chunk, overlap", [(100, 20), (1 << 15, 256)])
def test_counts_equal_the_library(spark, chunk, overlap):
    path = public_tokenizers.path(token_count.VOCABULARY_FILE)
    vocabulary, plain = token_count.read_vocabulary(path), Tokenizer.from_file(path)
    rows = texts() + [(904, ("word " * 10 + "y" * 700) * 5, "", "")]
    want = [(i, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    got = token_count.count_tokens(spark.createDataFrame(rows, DOCS), vocabulary, chunk_chars=chunk, overlap=overlap).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_places_in_every_script():
    path = public_tokenizers.path(token_count.VOCABULARY_FILE)
    vocabulary, plain = token_count.read_vocabulary(path), Tokenizer.from_file(path)
    joined = token_count._inside_special(vocabulary)
    samples = ["привет мир, 2024год.", "γειά σου κόσμε 7ημέρες", "你好，世界123年。再见", "مرحبا بالعالم ١٢٣كلمة", "ab1c2 don't 3'd x<|endoftext|>y"]
    for sample in samples:
        text = sample * 40
        whole = token_count.token_ends(text, vocabulary)
        places, before = token_count._stable_places(text, 0, len(text), whole, joined)
        assert len(places) >= 40
        for place, tokens in list(zip(places, before))[:60]:  # both sides encoded by themselves give the same tokens
            left, right = (len(plain.encode(t, add_special_tokens=False).ids) for t in (text[:place], text[place:]))
            assert left == tokens and left + right == len(whole)


@pytest.mark.parametrize("sample", ["привет мир, как дела? ", "你好世界，这是一个很长的句子。", "τα πάντα ῥεῖ 12η ", "<|endoftext|>中文12", "غدا٣ يوم "])
def test_long_texts_of_other_scripts_are_spliced_at_once(spark, monkeypatch, sample):
    path = public_tokenizers.path(token_count.VOCABULARY_FILE)
    vocabulary, plain = token_count.read_vocabulary(path), Tokenizer.from_file(path)
    text = sample * (40_000 // len(sample))
    monkeypatch.setattr(token_count, "WIDER", 10**9)  # a splice that failed would leave one chunk
    cuts = []
    cut = token_count._cut
    monkeypatch.setattr(token_count, "_cut", lambda *a: cuts.append(a) or cut(*a))
    got = token_count.count_tokens(spark.createDataFrame([(1, text, "", "")], DOCS), vocabulary).first()
    assert got.n_tokens == len(plain.encode(text, add_special_tokens=False).ids) and len(cuts) == 1


def test_counts_of_nothing(spark):
    vocabulary = token_count.read_vocabulary(public_tokenizers.path(token_count.VOCABULARY_FILE))
    assert token_count.count_tokens(spark.createDataFrame([], DOCS), vocabulary).count() == 0
    assert token_count._ranked(vocabulary) is not None
    assert token_count.count_tokens(spark.createDataFrame([(1, "a", "", "")], DOCS).where(F.lit(True)), vocabulary).first().n_tokens == 1


def test_tokens_are_put_together_and_decoded_a_slice_at_a_time(monkeypatch):
    monkeypatch.setattr(byte_bpe, "DECODE_TOKENS", 10)
    lists = [[1, 2, 3]] * 7 + [list(range(25)), None, []]
    batch = byte_bpe.pa.RecordBatch.from_arrays([byte_bpe.pa.array(range(10)), byte_bpe.pa.array(lists)], names=["doc_id", "ids"])
    slices = list(byte_bpe._by_tokens(batch, 1))
    assert [r for s in slices for r in s.to_pylist()] == batch.to_pylist()
    assert all(sum(len(x or []) for x in s.column(1).to_pylist()[:-1]) <= 10 for s in slices) and len(slices) > 2
    packed = byte_bpe._pack(byte_bpe.np.tile([0, 1], 20), byte_bpe.np.array([3, 0, 30, 7]))
    ids = byte_bpe._pack(byte_bpe.np.array([0, 1]), byte_bpe.np.array([1, 2]), byte_bpe.np.array([5, 6, 7]))
    rows = [("x", "sequence", "x", packed, None, [1, 2, 3, None]), ("x", "ids", "bucket 0", ids, None, None)]
    parts = [byte_bpe.pa.RecordBatch.from_pylist([dict(zip(byte_bpe._PARTS.names, r))], schema=byte_bpe._PARTS) for r in rows]
    out = [r for b in byte_bpe._reassemble(iter(parts)) for r in b.to_pylist()]
    flat = [t for w in [0, 1] * 20 for t in ([5], [6, 7])[w]]
    assert [r["doc_id"] for r in out] == [1, 2, 3, None] and [t for r in out for t in r["ids"]] == flat
    assert len(list(byte_bpe._reassemble(iter(parts)))) > 1
