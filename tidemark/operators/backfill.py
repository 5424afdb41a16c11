"""Windowed, budgeted import of an account's records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.records import BOOK, LIST, LIST_ITEM, REVIEW

PRIORITY = (REVIEW, BOOK, LIST_ITEM, LIST)


def priority(collection: Column, order: Sequence[str] = PRIORITY) -> Column:
    """Place of a collection in the order of import; unlisted ones come last."""
    place = F.array_position(F.array(*map(F.lit, order)), collection)
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1))


def within_budget(rows: DataFrame, limit: int, order: Sequence[str] = PRIORITY) -> DataFrame:
    """Per account, the first ``limit`` rows by collection priority and then newest first; the budget is the feature."""
    by = Window.partitionBy("did").orderBy(priority(F.col("collection"), order), F.col("rkey").desc(), "at_uri")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)


def replay_order(rows: DataFrame, at: Column, archive_only: Column) -> DataFrame:
    """Place of each row in an account's replay: archived kinds first, then by time of writing, unknown times first."""
    known = F.coalesce(F.unix_micros(at), F.lit(0))
    by = Window.partitionBy("did").orderBy((~archive_only).cast("int"), known, "at_uri")
    return rows.withColumn("turn", F.row_number().over(by))


def page_of(place: Column, size: int = 100) -> Column:
    """Page number, from 1, of a row's place when pages are read in order."""
    return F.ceil(place / size)
