"""The language stage keeps clean texts that switch between languages."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spotweave.llm import language

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_clean_text_in_three_languages_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    longest = docs.where(F.length("text") < language.SAMPLE_CHARS).groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text"))
    by_lang = {r["lang"]: language._WORD.findall(r["text"]) for r in longest.orderBy(F.desc(F.length("text")), "lang").collect() if r["lang"]}
    parts = list(by_lang.values())[:3]
    assert len(parts) == 3 and min(map(len, parts)) >= 20
    mixed = [" ".join(w for p, n in zip(parts, shares) for w in (p * 5)[:n]) for shares in ((45, 35, 20), (36, 32, 32))]
    planted = spark.createDataFrame([(95001 + i, t, None, "src1", 0) for i, t in enumerate(mixed)], "doc_id long, text string, lang string, source string, n int")
    planted = planted.select(*[F.col(c).cast(docs.schema[c].dataType) if c in planted.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(planted), SF).where("doc_id >= 95001").collect()}
    assert kept == {95001, 95002}
