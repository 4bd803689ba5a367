"""Training-corpus pipeline over ``documents``: five stages, each written as
Parquet and read again as the next one's input. Each stage works on all rows
its predecessor kept; all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from intentlane.llm.common import free_name, is_rest, materialise, table
from intentlane.llm.decontaminate import remove_leaks
from intentlane.llm.langid_crf import UNKNOWN, predict_language, train_langid
from intentlane.llm.mixing import mix_sources
from intentlane.llm.simhash import one_per_component
from intentlane.llm.toxicity import THRESHOLD, learn_toxicity, toxicity_score
from intentlane.session import ship_package

#: documents below this language score are in no language that can be told
MIN_LANGUAGE_SCORE = 0.35


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity classifier flags (operator 8)."""
    ship_package(spark)
    lexicon = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(F.col("text"), lexicon) < F.lit(THRESHOLD))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language (operator 1)."""
    ship_package(spark)
    model = train_langid(docs, ~is_rest(F.col("doc_id"), 4, 2))
    mark = free_name(docs, "_language")
    marked = docs.withColumn(mark, predict_language(F.col("text"), model))
    return (marked.where((F.col(f"{mark}.lang_pred") != UNKNOWN) & (F.col(f"{mark}.score") >= F.lit(MIN_LANGUAGE_SCORE)))
            .drop(mark))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near-duplicates (operator 2)."""
    ship_package(spark)
    return one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (operator 10)."""
    ship_package(spark)
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each kept document are read, so that sources meet
    their targets (operator 5)."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Trained classifiers, SimHash fingerprints and tiling have no SQL form; a test holds the rows of one planted set against what was planted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
