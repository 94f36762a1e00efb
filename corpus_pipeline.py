"""The corpus pipeline: quality rules, near duplicates, decontamination, secret scan, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's ``docs``. All stages but the last return the
columns of ``docs``; columns the stages do not know pass through. An empty table
gives empty stages. ``labels`` and ``benchmark`` are read from ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortal.core.settle import settle
from cohortal.llm import adapt_join, automata, fm_index, mixing, risk_rules
from cohortal.llm.queries import read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of texts that were cut; it stays as it was where there is no text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the risk-controlled rules keep; a null or empty text fails the base rule and goes."""
    return risk_rules.keep_good(docs, read(spark, sf_dir, "labels"), settle)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id; rows without words are no duplicates."""
    return adapt_join.keep_first(docs, settle)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans they share with the benchmark; rows that lose all their words go."""
    found = fm_index.find_benchmark(docs, read(spark, sf_dir, "benchmark"))
    return _recounted(fm_index.remove_spans(found, drop_emptied=True))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of every secret; no row goes."""
    return _recounted(automata.redact(automata.find_secrets(docs, settle)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: how many of its words the mix takes, with its source's size and target."""
    return mixing.mix_sources(docs, settle).taken().drop("row")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mix", mix),
]

#: No SQL can express the learned cut-offs and automata; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written down before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
