"""Applying a stream of inserts, updates and deletes (problem 1).

The fold is commutative, associative and idempotent: per key the maximum of
``struct(rank, deleted, payload)``. So arrival order, repeats and the cut into
batches do not matter, partial maxima are taken before the shuffle (a key that
holds a third of all rows sends one row per map task), and rows of an earlier
state enter the same maximum. Deletes stay as tombstones, so a change that
arrives after the delete but ranks before it cannot revive the key.

Defined results for odd input: a row whose key has a null part names no record
and is left out; an empty string is an ordinary key; equal ranks are decided by
the later columns of the struct, so repeated rows give one row; an empty input
gives an empty state; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import hadoop_fs, stage_table

VERSION = "version"


def versioned(changes: DataFrame, key: Sequence[str], rank: Column, deleted: Column, payload: Column) -> DataFrame:
    """Rows (key..., version) ready to be folded; keys with a null part are left out."""
    whole = F.lit(True)
    for part in key:
        whole = whole & F.col(part).isNotNull()
    return changes.where(whole).select(
        *key, F.struct(rank.alias("rank"), deleted.alias("deleted"), payload.alias("payload")).alias(VERSION)
    )


def fold(changes: DataFrame, key: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """The winning version of each key over ``changes`` and the earlier state ``base``."""
    rows = changes if base is None else base.unionByName(changes)
    return rows.groupBy(*key).agg(F.max(VERSION).alias(VERSION))


def live(state: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are not deleted, with their payload."""
    return state.where(~F.col(f"{VERSION}.deleted")).select(*key, F.col(f"{VERSION}.payload").alias("payload"))


# --- the commit stream -------------------------------------------------------

RECORD = ("did", "collection", "rkey")


def commits(stream: DataFrame) -> DataFrame:
    """Rows of kind commit with the commit's fields at the top; a null operation means create."""
    return stream.where(F.col("kind") == "commit").select(
        "seq",
        "batch_no",
        "received_at",
        "time_us",
        "did",
        F.col("commit.rev").alias("rev"),
        F.coalesce(F.col("commit.operation"), F.lit("create")).alias("operation"),
        F.col("commit.collection").alias("collection"),
        F.col("commit.rkey").alias("rkey"),
        F.col("commit.record").alias("record"),
        F.col("commit.cid").alias("cid"),
    )


def commit_rank() -> Column:
    """Rows with a revision outrank rows without; then revision as text, then arrival."""
    return F.struct(
        F.col("rev").isNotNull().alias("has_rev"),
        F.coalesce(F.col("rev"), F.lit("")).alias("rev"),
        F.coalesce(F.col("seq"), F.lit(-1)).alias("seq"),
    )


def at_uri() -> Column:
    return F.concat(F.lit("at://"), F.col("did"), F.lit("/"), F.col("collection"), F.lit("/"), F.col("rkey"))


def record_state(rows: DataFrame, payload: Column, base: DataFrame | None = None) -> DataFrame:
    """State of every record named in ``rows`` (a result of ``commits``), tombstones included."""
    changes = versioned(rows, RECORD, commit_rank(), F.col("operation") == "delete", payload)
    return fold(changes, RECORD, base)


def live_records(rows: DataFrame) -> DataFrame:
    """(at_uri, cid) of each live record."""
    state = record_state(rows, F.struct("cid"))
    return live(state, RECORD).select(at_uri().alias("at_uri"), F.col("payload.cid").alias("cid"))


class ChangeTable:
    """A table kept on disk for change feeds that come in batches.

    Keys are hashed into ``buckets``; a version holds the buckets that its batch
    has touched, and the state is the last version of each bucket, so a batch
    reads and writes no more than its buckets. A version counts once its commit
    file exists: a failed or repeated batch leaves a readable table, and the
    result depends on the set of changes alone. The number of buckets belongs to
    the table; choose it so that one bucket is a task's work.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), tuple(key), buckets

    def _listed(self, folder: str) -> list[str]:
        fs, at = hadoop_fs(self.spark, f"{self.path}/{folder}")
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        return max(map(int, self._listed("commits")), default=0)

    def _versions(self) -> dict[str, list[int]]:
        """Committed versions of each bucket, by its folder's name, in order."""
        now, found = self.version(), {}
        for v in sorted(v for v in map(int, self._listed("state")) if v <= now):
            for name in self._listed(f"state/{v}"):
                if name.startswith("bucket="):
                    found.setdefault(name, []).append(v)
        return found

    def _read(self, names: Iterable[str]) -> DataFrame | None:
        versions = self._versions()
        paths = [f"{self.path}/state/{versions[n][-1]}/{n}" for n in names if n in versions]
        return self.spark.read.parquet(*paths) if paths else None

    def state(self) -> DataFrame | None:
        return self._read(self._versions())

    def apply(self, changes: DataFrame) -> int:
        """Fold a batch (a result of ``versioned``) in; returns the new version."""
        now = self.version()
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).alias("bucket")
        batch = stage_table(changes.select(*changes.columns, bucket), "changes")
        touched = [f"bucket={r['bucket']}" for r in batch.select("bucket").distinct().collect()]  # at most as many as buckets
        fs, left = hadoop_fs(self.spark, f"{self.path}/state/{now + 1}")
        fs.delete(left, True)  # what a failed batch may have left
        if touched:
            after = fold(batch.drop("bucket"), self.key, self._read(touched)).select("*", bucket)
            # partitions of even size, of few buckets each
            after.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/{now + 1}")
        if not fs.createNewFile(hadoop_fs(self.spark, f"{self.path}/commits/{now + 1}")[1]):
            raise RuntimeError(f"version {now + 1} of {self.path} was committed by another writer")
        for name, versions in self._versions().items():
            # readers of the version before may still be running
            for v in [v for v in versions if v <= now][:-1]:
                fs.delete(hadoop_fs(self.spark, f"{self.path}/state/{v}/{name}")[1], True)
        return now + 1

    def live(self) -> DataFrame:
        state = self.state()
        if state is None:
            raise LookupError(f"{self.path} holds no state yet")
        return live(state, self.key)
