"""The corpus pipeline: each stage takes the documents that its predecessor kept.

Every stage is (spark, docs, sf_dir) -> DataFrame and is written as Parquet and read again as the
next one's documents.  All but the last return the columns of ``documents``.

Nulls in any column pass through; null and empty texts are kept by every stage (they have nothing to judge) and
taken into the mix with size 0; very long texts are read whole; rows that repeat are judged alike, and one of
equal rows stays after the near-duplicate stage; an empty table stays empty; extra columns pass through all but
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import unigram
from tidewatch.llm.common import materialize, small_batches
from tidewatch.llm.line_dedup import LineDedup
from tidewatch.llm.mixing import Mixture
from tidewatch.llm.ngram_join import JaccardJoin
from tidewatch.llm.quality_model import QualityModel
from tidewatch.llm.queries import PIECES


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    small_batches(spark)
    return QualityModel(docs).keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or nearly repeat an earlier one."""
    small_batches(spark)
    return LineDedup(docs).apply(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one that names it; of equal rows one.

    Rows go, not ids: texts that share a doc_id are judged each for itself.
    """
    return JaccardJoin(size=5, num=75, den=100).keep(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken."""
    return Mixture(docs, weights=(3.0, 1.0, 2.0), share=1.5, ceiling=2.0).take(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document of the mix, with the round trip through decoding."""
    small_batches(spark)
    vocabulary = unigram.Vocabulary.load(PIECES)
    return unigram.digests(docs, vocabulary)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Expectation-maximisation and the trained scorer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
