"""Event sources: JSON lines as batch, stream and Python data source; records of a repository as events.

``COMMIT_EVENT`` is the shape of one line; the record stays JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

COMMIT = "struct<rev string, operation string, collection string, rkey string, record string, cid string>"
COMMIT_EVENT = f"struct<did string, time_us bigint, kind string, commit {COMMIT}, identity struct<did string, handle string>>"


def parse_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Events of the text column ``value``; blank lines are skipped, malformed ones raise if ``strict``, else give null kinds."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    kept = lines.where(F.trim("value") != "")
    return kept.withColumn("event", F.from_json("value", COMMIT_EVENT, mode)).select(*(c for c in lines.columns if c != "value"), "event.*")


PLACE = ("file", "block")  # where a line was read: the file, and the first byte of the split


def in_order(rows: DataFrame, first: int = 0) -> DataFrame:
    """``rows`` with ``seq`` in place of PLACE: numbers without gaps in order of file name and place in the file.

    Lines of a split are read one after the other, so a split's numbers begin at
    the count of lines before it; only one row for each split is added up.
    """
    numbered = rows.withColumn("_line", F.monotonically_increasing_id())
    splits = numbered.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_lines"), F.min("_line").alias("_from"))
    # in two steps, files and the splits of each, so that no task sums up more than the files or one file's splits
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file").agg(F.sum("_lines").alias("_sum"))
    files = files.select("file", F.coalesce(F.sum("_sum").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"))
    starts = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(inside), F.lit(0))).join(files, "file")
    starts = starts.select(*PLACE, (F.col("_before") + F.col("_skip") - F.col("_from") + first).alias("_shift"))
    return numbered.join(starts, list(PLACE)).withColumn("seq", F.col("_line") + F.col("_shift")).drop(*PLACE, "_line", "_shift")


def _lines(reader, path: str) -> DataFrame:
    lines = reader.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of JSON-lines files with ``seq``, the order of arrival: by file name, then by line (blank lines count)."""
    events = parse_lines(in_order(_lines(spark.read, path)), strict)
    return events.withColumn("batch_no", F.lit(0).cast("bigint")).withColumn("received_at", F.lit(None).cast("timestamp_ntz"))


def stream_events(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """The same as a stream of files that arrive in a folder.

    A stream cannot number its rows: they carry PLACE, and ``arrived`` numbers
    them batch by batch.
    """
    lines = _lines(spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch), folder)
    return parse_lines(lines, strict=False).withColumn("received_at", F.current_timestamp().cast("timestamp_ntz"))


BATCH_ROWS = 1 << 40  # numbers kept for each micro-batch


def arrived(batch: DataFrame, number: int) -> DataFrame:
    """A micro-batch of ``stream_events`` with ``seq`` and ``batch_no``; the same again if the batch is run again."""
    return in_order(batch, number * BATCH_ROWS).withColumn("batch_no", F.lit(number).cast("bigint"))


def from_repository(records: DataFrame) -> DataFrame:
    """Events for records read back from a repository (uri, cid, value as JSON): creates without revision and time."""
    part = lambda i: F.get(F.split("uri", "/"), F.lit(i))
    none = F.lit(None)
    commit = F.struct(
        none.cast("string").alias("rev"), F.lit("create").alias("operation"), part(3).alias("collection"), part(4).alias("rkey"), F.col("value").alias("record"), F.col("cid")
    )
    return records.select(part(2).alias("did"), none.cast("bigint").alias("time_us"), F.lit("commit").alias("kind"), commit.alias("commit"))


def wanted(collections: Sequence[str]) -> Column:
    """The filter that sources take over: commits of some collections."""
    return (F.col("kind") == "commit") & F.col("commit.collection").isin(*collections)


# --- Python data source ---------------------------------------------------------


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class CommitLogReader(DataSourceReader):
    """One partition per file; filters on the collection are evaluated before rows are made."""

    def __init__(self, paths: list[str]):
        self.paths, self.collections = paths, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("collection",):
                self.collections = {f.value}
            elif isinstance(f, In) and f.attribute == ("collection",):
                self.collections = set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in self.paths]

    def read(self, partition: FilePartition):
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                if not line.strip():
                    continue
                event = json.loads(line)
                commit = event.get("commit") or {}
                if event.get("kind") != "commit" or (self.collections is not None and commit.get("collection") not in self.collections):
                    continue
                record = commit.get("record")
                yield (
                    event.get("did"), event.get("time_us"), commit.get("rev"), commit.get("operation"), commit.get("collection"),
                    commit.get("rkey"), record if record is None or isinstance(record, str) else json.dumps(record, ensure_ascii=False), commit.get("cid"),
                )


class CommitLog(DataSource):
    """``spark.read.format("commitlog").load(folder)``: commits of JSON-lines files, flat.

    Option ``path``: a file or a folder that all executors can read. ``register``
    makes it known to a session and has filters pushed down to it.
    """

    @classmethod
    def name(cls) -> str:
        return "commitlog"

    def schema(self) -> StructType | str:
        return "did string, time_us bigint, rev string, operation string, collection string, rkey string, record string, cid string"

    def reader(self, schema: StructType) -> DataSourceReader:
        import glob
        import os

        path = self.options["path"]
        paths = sorted(p for kind in ("*.jsonl", "*.txt") for p in glob.glob(os.path.join(path, kind))) if os.path.isdir(path) else [path]
        return CommitLogReader(paths)


def register(spark: SparkSession) -> None:
    """Makes ``commitlog`` known to a session; its filters need the setting that lets Python sources take them over."""
    spark.dataSource.register(CommitLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
