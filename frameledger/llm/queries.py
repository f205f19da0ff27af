"""Queries of the text operators, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameledger.llm import encoding, mixing, pairs, tokenize, truncation
from frameledger.session import table


FIELDS = ["raw_output", "structurer_raw_response"]


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(truncation.value_table(table(spark, d, "structured_predictions"), "record_id", "model_name", FIELDS, "written_at"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).where("cut").select("record_id", "field")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_evidence(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.one_defect(p5_labels(spark, d))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return pairs.label_pairs(table(spark, d, "structured_predictions"), table(spark, d, "prepared_samples"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_blocks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.in_order(p8_mix(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"), restore=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_rates": p3_rates, "p5_found": p5_found, "p5_labels": p5_labels, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_blocks": p8_blocks, "p8_shares": p8_shares, "p9_found": p9_found, "p9_restored": p9_restored}
SQL: dict[str, str] = {}
