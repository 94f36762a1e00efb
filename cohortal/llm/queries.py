"""The registered queries of this folder, each over its whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortal.core.settle import scratch_dir, settle
from cohortal.llm import adapt_join, automata, best_position, dac, fm_index, gam, hmm, kernels, mixing, risk_rules, squares, url_templates, wrappers


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.filter_urls(pages, settle).drop("url")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), settle)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(read(spark, sf_dir, "documents"), settle)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(read(spark, sf_dir, "pages"), settle)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"), settle).taken().drop("row")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_index.digest(fm_index.find_benchmark(docs, read(spark, sf_dir, "benchmark")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_join.document_classes(read(spark, sf_dir, "documents"), settle)


def op8_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), settle)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return automata.digest(automata.find_secrets(docs, settle))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.identify_languages(read(spark, sf_dir, "documents"), settle)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), settle)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch_dir(spark)}/tokens/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    dac.write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return dac.with_starts(dac.read_documents(spark, folder), settle)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return squares.digest(squares.find_runs(squares.plant_period(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_quality_rules,
        op3_lm_score,
        op4_main_text,
        op5_mix_sources,
        op6_decontaminate,
        op7_ngram_join,
        op8_quality_score,
        op9_secret_scan,
        op10_language,
        op11_lexical_search,
        op12_token_files,
        op13_periodic_runs,
    )
}
