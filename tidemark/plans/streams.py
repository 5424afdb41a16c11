"""Queries through the sources and the streaming sinks, and their SQL: the same rows must come out as from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.operators import changefeed
from tidemark.operators.redelivery import SeenStore
from tidemark.plans.problems import _COMMITS, _LIVE, commit_rows, table
from tidemark.session import fresh_path, stage_table
from tidemark.sources import events as E
from tidemark.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def as_lines(spark, folder):
    """The stream written as JSON lines; returns the folder."""
    rows = table(spark, folder, "jetstream_sample")
    path = fresh_path(spark, "lines")
    rows.select(F.to_json(F.struct("did", "time_us", "kind", "commit", "identity")).alias("value")).write.text(path)
    return path


def streamed(spark, folder):
    """The stream's table as a stream of files, eight to a micro-batch."""
    path = f"{folder}/jetstream_sample.parquet"
    # a pattern, as the table may be one file and a stream takes folders only
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[t]")


@query("SELECT kind, commit.collection AS collection, commit.operation AS operation, count(*) AS n, count(commit.record) AS records, sum(length(commit.record)) AS chars, max(time_us) AS high FROM jetstream_sample GROUP BY ALL")
def events_replayed(spark, folder):
    """Written as JSON lines and read again."""
    rows = E.read_events(spark, as_lines(spark, folder))
    return rows.groupBy("kind", F.col("commit.collection").alias("collection"), F.col("commit.operation").alias("operation")).agg(
        F.count(F.lit(1)).alias("n"), F.count("commit.record").alias("records"), F.sum(F.length("commit.record")).alias("chars"), F.max("time_us").alias("high")
    )


@query("SELECT commit.rkey AS rkey, commit.rev AS rev, did, md5(commit.record) AS record FROM jetstream_sample WHERE kind = 'commit' AND commit.collection = 'social.popfeed.feed.list'")
def commitlog_scan(spark, folder):
    """One collection out of the Python data source, which takes the filter over."""
    E.register(spark)
    path = as_lines(spark, folder).removeprefix("file://")
    rows = spark.read.format("commitlog").option("path", path).load().where(F.col("collection") == R.LIST)
    return rows.select("rkey", "rev", "did", F.md5("record").alias("record"))


@query(f"WITH {_LIVE} SELECT collection, count(*) AS n, count(cid) AS with_cid, sum(length(record)) AS chars FROM live GROUP BY collection")
def repository_events(spark, folder):
    """Live records read back from their repositories, as creates without revision."""
    state = changefeed.record_state(commit_rows(spark, folder), F.struct("cid", "record"))
    records = changefeed.live(state, changefeed.RECORD).select(changefeed.at_uri().alias("uri"), "payload.cid", F.col("payload.record").alias("value"))
    rows = E.from_repository(records).select("commit.*").where(F.col("rev").isNull() & (F.col("operation") == "create"))
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.count("cid").alias("with_cid"), F.sum(F.length("record")).alias("chars"))


@query(f"WITH {_LIVE} SELECT at_uri, cid FROM live")
def stream_state(spark, folder):
    """The live records after the stream has run through a kept table."""
    kept = changefeed.ChangeTable(spark, fresh_path(spark, "kept"), changefeed.RECORD, buckets=8)
    ingest.keep_state(streamed(spark, folder), kept, F.struct("cid"), fresh_path(spark, "state-progress")).awaitTermination()
    return kept.live().select(changefeed.at_uri().alias("at_uri"), F.col("payload.cid").alias("cid"))


@query(f"WITH {_COMMITS} SELECT count(DISTINCT (did, rev, collection, rkey)) AS messages FROM commits WHERE rev IS NOT NULL")
def stream_messages(spark, folder):
    """Messages with a revision that the stream lets through: each once."""
    sink = fresh_path(spark, "unique")
    ingest.drop_redundant(streamed(spark, folder), SeenStore(spark), sink, fresh_path(spark, "seen-progress")).awaitTermination()
    return spark.read.parquet(sink).where(F.col("rev").isNotNull()).agg(F.count(F.lit(1)).alias("messages"))


@query(f"WITH {_COMMITS} SELECT date_trunc('hour', received_at) AS start, collection, operation, count(*) AS n FROM commits WHERE received_at IS NOT NULL GROUP BY ALL")
def stream_windows(spark, folder):
    """Commits by hour out of a streaming aggregation that keeps every window until the end."""
    rows = changefeed.commits(streamed(spark, folder)).where(F.col("received_at").isNotNull()).withColumn("at", F.col("received_at").cast("timestamp"))
    sink = fresh_path(spark, "windows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/{number}")

    counts = ingest.counts_by_window(rows, "at", late="3650 days").drop("accounts")
    run = counts.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", fresh_path(spark, "window-progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    # the last update of each window counts, and counts only grow
    found = spark.read.option("recursiveFileLookup", "true").parquet(sink).groupBy("start", "collection", "operation").agg(F.max("n").alias("n"))
    return stage_table(found.select(F.col("start").cast("timestamp_ntz").alias("start"), "collection", "operation", "n"), "windows")
