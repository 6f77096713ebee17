"""The subpackage's queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, html_template, line_dedup, ngram_join, oracle_sql, quality, secret_scan, sharding, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lambda spark, d: line_dedup.repeated_lines(_table(spark, d, "documents")),
        "op2_sharding": lambda spark, d: sharding.sharded(_table(spark, d, "documents")),
        "op3_secret_scan": lambda spark, d: secret_scan.found(_table(spark, d, "documents")),
        "op4_quality": lambda spark, d: quality.kept(docs := _table(spark, d, "documents"), quality.fit(docs, _table(spark, d, "labels"))),
        "op5_decontamination": lambda spark, d: decontam.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
        "op6_toxicity": lambda spark, d: toxicity.passages(docs := _table(spark, d, "documents"), toxicity.fit(docs, _table(spark, d, "labels"))),
        "op7_bpe": lambda spark, d: bpe.encode(_table(spark, d, "documents")),
        "op8_url_filter": lambda spark, d: url_filter.filtered(_table(spark, d, "pages")),
        "op9_html_template": lambda spark, d: html_template.extracted(_table(spark, d, "pages")),
        "op10_ngram_join": lambda spark, d: ngram_join.near_duplicates(_table(spark, d, "documents")),
    }


def oracles() -> dict[str, str]:
    return {"op1_line_dedup": oracle_sql.line_sql(), "op5_decontamination": decontam.leak_sql(), "op8_url_filter": url_filter.url_sql(), "op10_ngram_join": oracle_sql.ngram_sql()}
