"""The queries of the training-data operators over text, by the problem's number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolloom.llm import leakage, pairs, repetition, syntax, tokenize
from symbolloom.session import table


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pairs(table(spark, sf, "blobs"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pairs(spark, sf).select("blob_id", "func_name").distinct()


def p6_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.repairs(table(spark, sf, "blobs")).where("edits > 0")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_repairs(spark, sf).select("blob_id").distinct()


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.rates(table(spark, sf, "blobs"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.token_ids(table(spark, sf, "documents"))


def p9_templates(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_templates(spark, sf).where("verbatim = 1").select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf, "documents"))


def p10_share(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.statistics(table(spark, sf, "documents")).select("doc_id", "n_words", "n_repeated", F.round("share", 6).alias("share"))


def p10_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.outliers(table(spark, sf, "documents")).where("rejected").select("doc_id", "language", "origin", "share", "d2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p5_found, p5_pairs, p6_found, p6_repairs, p6_rates, p8_ids, p9_found, p9_templates, p10_found, p10_share, p10_outliers)
    return {f.__name__: f for f in own}
