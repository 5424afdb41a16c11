"""Queries of problems 6 to 8. SQL cannot express most of them: they are tested against brute force and other libraries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import encoding, packing, quality
from tidemark.session import fill_cores, stage_table


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return fill_cores(_table(spark, folder, "documents"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode(_documents(spark, folder))


def p7_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, folder), _table(spark, folder, "pack_spec"))


def p7_balance(spark: SparkSession, folder: str) -> DataFrame:
    specs = _table(spark, folder, "pack_spec")
    return packing.balance(stage_table(p7_packs(spark, folder), "packs"), specs)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(_documents(spark, folder), _table(spark, folder, "common_words"))


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_documents(spark, folder), _table(spark, folder, "common_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_ids": p6_ids,
    "p7_packs": p7_packs,
    "p7_balance": p7_balance,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
}
SQL: dict[str, str] = {
    # what every good packing has in common, whichever it is
    "p7_balance": """SELECT spec_id, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0 AS overfull, 0 AS needless, true AS tight
FROM pack_spec WHERE capacity > 0 AND EXISTS (SELECT 1 FROM documents WHERE text <> '')""",
}
