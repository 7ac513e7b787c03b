"""From raw documents to packed sequences, stage by stage.

Every stage takes what its predecessor kept and all but the last return the
columns of documents, whatever further columns there are. Defined cases that hold
for all stages: an empty table stays empty; null ids are ids like others and
repeated rows are rows like others unless a stage says otherwise; null and empty
texts have no words, lines or tokens of their own; texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontam, linededup, neardup, packing, quality
from granary.llm.common import discard, materialize, scratch, shared_dir
from granary.llm.queries import table, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled ones among docs.

    Null texts score as empty ones, equal texts alike, so repeated rows go or
    stay together. Without labels of both kinds every score is the share of good
    ones (0.5 without any) and all rows stay or go by it.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; texts and n_chars follow.

    A null id is the smallest; rows of one id are one document and keep each
    other's lines. A null text becomes an empty one. No row goes.
    """
    return linededup.apply(docs, linededup.keep_bitmaps(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first by id, of each group of near copies (five-word Jaccard of 0.8 or more).

    Null ids come last; among rows of one id the smallest hash of the row comes
    first, and of equal rows any one stays. All texts without words are one group.
    Candidates are documents whose SimHash fingerprints lie within 4 bits, and those
    that share a MinHash band, as most pairs at 0.8 lie farther apart than that; both
    are verified on their full sets.
    """
    return neardup.first_of_each(docs, simhash=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Texts without words hold none; repeated rows go or stay together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens: a row a piece. A text without tokens is its closing id alone."""
    placements, _ = packing.pack(docs, tokenizer_path())
    return placements


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Trained models, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage wrote on its way is deleted once its result is."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
