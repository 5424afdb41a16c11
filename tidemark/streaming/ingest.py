"""Structured Streaming over the commit stream: the batch operators inside foreachBatch.

Both sinks are safe when a micro-batch is run again: folding changes twice is
the same as once, and the seen store knows which batches it has committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import archive, pairing, works
from tidemark.operators.changefeed import RECORD, ChangeTable, commit_rank, commits, versioned
from tidemark.operators.redelivery import SeenStore
from tidemark.functions import records
from tidemark.session import stage_table
from tidemark.sources.events import PLACE, arrived, read_events


def commit_rows(batch: DataFrame, number: int) -> DataFrame:
    """The commits of a micro-batch, be it of commits already or of events as they arrive."""
    if "kind" not in batch.columns:
        return batch
    return commits(arrived(batch, number) if PLACE[0] in batch.columns else batch)


def keep_state(stream: DataFrame, table: ChangeTable, payload: Column, checkpoint: str) -> StreamingQuery:
    """Keeps ``table`` at the latest version of every record; runs until the stream's present end."""

    def apply(batch: DataFrame, number: int) -> None:
        table.apply(versioned(commit_rows(batch, number), RECORD, commit_rank(), F.col("operation") == "delete", payload))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_redundant(stream: DataFrame, store: SeenStore, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes rows that are no redelivery to ``sink``, one folder per micro-batch."""

    def apply(batch: DataFrame, number: int) -> None:
        # written once, so that numbers of arrival are the same for the store and the sink
        rows = stage_table(commit_rows(batch, number), "batch")
        rows.join(store.accept(rows, number), "seq", "left_anti").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(commits: DataFrame, at: str = "received_at", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Commits by window, collection and operation; events later than ``late`` are left out once their window is closed."""
    return (
        commits.withWatermark(at, late)
        .groupBy(F.window(at, window).alias("window"), "collection", "operation")
        .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("did").alias("accounts"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "collection", "operation", "n", "accounts")
    )


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Every activity that the events in JSON-lines files cause, as if they arrived now: files to notes in one run."""
    rows = archive.wanted(commits(read_events(spark, path)))
    rows = stage_table(rows.where(F.col("collection").isin(records.REVIEW, records.LIST_ITEM)), "replayed")
    found = records.with_work(records.fields(rows))
    return pairing.activities(found, works.mint(found.where(F.col("operation") != "delete")))
