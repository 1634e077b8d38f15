"""From raw documents to packed sequences: five stages, each by one operator of `tidemark.llm`.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last
returns the columns of `documents`.  Each result is written as Parquet and read
again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._store import stored
from tidemark.llm.line_frequency import SITE_RATIO, drop_boilerplate
from tidemark.llm.mixture_packing import pack_mixture
from tidemark.llm.quality_divergence import quality_rules
from tidemark.llm.setsketch import deduplicate
from tidemark.llm.spaced_seeds import decontaminate

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules(docs, keep=("text", "lang", "source", "n_chars")).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their source go; all documents stay, and copies of one text count as one page."""
    out = drop_boilerplate(docs, max_ratio=SITE_RATIO, distinct=True, keep=("lang", "source", "n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.coalesce(F.length("kept_text"), F.col("n_chars")).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: similarity 0.8 or more on five-word shingles."""
    return deduplicate(docs, percent=80, keep=("text", "lang", "source", "n_chars")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of `benchmark` go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, keep=("text", "lang", "source", "n_chars")).filter("NOT contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left in sequences of at most 1024 tokens, as pieces."""
    return pack_mixture(docs, with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No stage but line dedup can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
