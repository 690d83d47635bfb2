"""A text corpus from raw documents: five stages, each written as Parquet and reread by the next.

Toxic documents go, one document of each group of near duplicates stays, benchmark passages are cut
out, secrets are replaced, and what is left is encoded.

Defined results, in every stage: a null or empty text is kept as it is, has no toxicity, no duplicates,
no benchmark words, no secrets and no tokens; a null doc_id keeps its row, of equal texts a row with an
id is preferred; repeated rows are judged alike, and of equal or linked texts one row stays, that of the
least doc_id, the first stored of ties; texts are read whole; columns of any other name pass through the
first four stages, and ``n_chars`` follows the text where there is such a column; an empty table gives an
empty table, empty labels no toxic document and an empty benchmark no cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, fmindex, jaccard, secrets, toxicity
from tidemark.session import stage


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the texts as they now are, if they have that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), "n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The lexicon is learned from the labelled
    rows among ``docs``."""
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (least doc_id) of each group linked by a 5-gram Jaccard of 0.8 or more."""
    return jaccard.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word runs that cover windows of benchmark items."""
    return _counted(fmindex.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    return _counted(secrets.redacted(docs, secrets.load()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with the digests that the round trip is checked by."""
    return bpe.encoded(docs, bpe.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the lexicon nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{i}")
    return docs
