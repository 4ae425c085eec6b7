"""Corpus pipeline: toxic documents go, exact and near copies go, secrets are masked, the rest is packed into sequences.

Defined results: null and empty texts score as the share of label 1 and so stay, unless most labels are 1; they are one text for
exact deduplication and the row of the largest identifier stays; it has no shingles and no secrets and is packed as its closing
token alone. Rows without identifier sort below all others. Very long texts are handled whole. Of repeated rows and of ties
one row stays. Empty tables give empty tables. Columns of documents beyond text and doc_id are carried to packing, whatever their
names; secrets need source and lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm.common import documents, labels, materialize
from bazaarflow.llm.exact_dedup import drop_exact_duplicates
from bazaarflow.llm.jaccard_join import drop_near_duplicates
from bazaarflow.llm.packing import pack
from bazaarflow.llm.queries import tokenizer_path
from bazaarflow.llm.secret_scan import redact
from bazaarflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without toxic ones; the classifier learns from the labelled rows of the documents table."""
    return drop_toxic(docs, labels(spark, sf_dir), source=documents(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the row of the largest identifier of each text."""
    return drop_exact_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near copies, the one of the smallest identifier."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked in their texts; no row goes."""
    return redact(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scan),
    ("packing", packing),
]

#: SQL has neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table; every stage is written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
