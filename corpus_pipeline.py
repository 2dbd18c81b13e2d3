"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read by the next.

A stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.

1. toxicity: fits the lexicon on the labelled documents that reach it and drops those it scores as toxic.
2. language: fits the field on the documents' languages and drops texts it can't tell: without a letter, or
   whose words' own likeliest languages have a mean probability below LEAST_SURE. A text that switches between
   languages stays if its words can be told.
3. near_dedup: keeps one document of every component of near duplicates.
4. mixing: repeats and leaves out documents so that sources meet their target weights.
5. byte_bpe: encodes and decodes every text; ids and bytes come out as digests.

Null texts: not toxic, dropped by the language stage as undetermined. Rows that repeat in all of doc_id and
text are near duplicates of each other, and one stays. Extra columns pass through all stages but the last.
An empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import language as lang
from spotweave.llm import toxicity as tox
from spotweave.llm.common import table
from spotweave.llm.mixing import mixed_rows
from spotweave.llm.near_dup import near_duplicates
from spotweave.llm.queries import bpe_digests
from spotweave.session import materialize

LEAST_SURE = 0.5


def _whole_rows(docs: DataFrame) -> DataFrame:
    """(text, row): the row as a struct, so that columns a stage adds can't clash with its own."""
    return docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not call toxic."""
    model = tox.fit_from_labels(docs, table(spark, sf_dir, "labels"))
    return tox.score(_whole_rows(docs), model, carried=["row"]).where(F.col("_score") < tox.THRESHOLD).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    model = lang.fit(docs.where(~lang.held_out()))
    told = lang.identify(_whole_rows(docs), model, carried=["row"], sure=True)
    return told.where((F.col("_lang") != lang.UNDETERMINED) & (F.col("_sure") >= LEAST_SURE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    found = near_duplicates(docs)
    kept = found.where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    staying = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"])).drop(kept["_kept_id"])
    return staying.dropDuplicates(["doc_id", "text"])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's ids and of the bytes they decode to."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: A lexicon, a field and a tokenizer are beyond SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
