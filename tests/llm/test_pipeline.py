"""The pipeline's rows against plain Python over the same rows, stage by stage."""

import base64
import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from spotweave.llm import language, toxicity
from spotweave.llm.byte_bpe import RANKS_FILE
from tests.llm.test_mixing_and_sharding import plain_targets
from tests.llm.test_similarity import plain_near_duplicates

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain_mix(rows):
    """Each row as often as systematic sampling takes it: (doc_id, text, source) in, the same out."""
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    md5 = lambda *parts: hashlib.md5(":".join(parts).encode()).hexdigest()
    name = lambda s: "1" if s is None else "0" + s
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    targets, out = plain_targets(sizes), []
    for source in sizes:
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (size(r[1]), md5("mix", "~" if r[0] is None else str(r[0]))))
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        start = int(md5("mix", "offset", name(source))[:8], 16) / 4294967296
        for i, row in enumerate(own):
            out += [row] * (math.floor(rate * (i + 1) + start) - math.floor(rate * i + start))
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(90001, None, None, None, None), (90002, "", "en", "src1", 0), (90003, "123 456", "en", "src1", 7)], docs.schema
    )
    twice = docs.where("doc_id % 50 = 1")
    docs = docs.unionByName(odd).unionByName(twice).withColumn("_score", F.lit("clash")).withColumn("row", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]

    model = toxicity.fit_from_labels(docs, labels)
    automaton = toxicity._matcher(model)
    score = lambda text: toxicity._logistic(model.curve, *toxicity.features(text or "", automaton))
    rows = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]

    clean = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    field = language.fit(clean.where(~language.held_out()))

    def sure(text):
        words = language._WORD.findall((text or "").lower())
        if not words:
            return 0.0
        # the mean of the words' own certainty, whatever languages they are told to be
        return float(language.posteriors(field.emissions(words), np.array([len(words)]), field.transitions, field.start)[1][0])

    rows = [r for r in rows if sure(r[1]) >= corpus_pipeline.LEAST_SURE]
    assert not {90001, 90002, 90003} & {r[0] for r in rows} and len(rows) > 150

    keep = {i for i, _, _, kept in plain_near_duplicates([r[:2] for r in rows]) if kept}
    rows = list(dict.fromkeys(r for r in rows if r[0] in keep))
    rows = plain_mix([r[:3] for r in rows])

    with open(public_tokenizers.path(RANKS_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest(text.encode())))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
