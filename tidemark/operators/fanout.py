"""Delivery: who gets an activity, the log of attempts, retries, relays, follows and likes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timefn import retry_delay


def recipient(shared: Column, own: Column) -> Column:
    """The shared inbox where there is one."""
    return F.coalesce(F.nullif(shared, F.lit("")), own)


def distinct_inboxes(follows: DataFrame, order: str = "seq") -> DataFrame:
    """(did, inbox, first): each inbox of an author's followers once, in order of first occurrence."""
    return follows.groupBy("did", recipient(F.col("shared_inbox"), F.col("inbox")).alias("inbox")).agg(F.min(order).alias("first"))


def relay_targets(relays: DataFrame, max_relays: int = 1000) -> list[str]:
    """Inboxes of the relays in order; they are configuration and read with a checked bound."""
    targets = [r["inbox"] for r in relays.select("inbox").distinct().limit(max_relays + 1).collect()]
    if len(targets) > max_relays:
        raise ValueError(f"more than {max_relays} relays")
    return sorted(targets)


def to_relays(activities: DataFrame, relays: DataFrame, max_relays: int = 1000) -> DataFrame:
    """``activities`` with each relay's ``inbox``: an array in the row, so no row is paired with another table's."""
    targets = relay_targets(relays, max_relays)
    return activities.select(*activities.columns, F.explode(F.array(*map(F.lit, targets)) if targets else F.expr("cast(array() as array<string>)")).alias("inbox"))


def to_followers(activities: DataFrame, inboxes: DataFrame) -> DataFrame:
    """``activities`` with each ``inbox`` of the followers of their author (``did``)."""
    return activities.join(inboxes.select("did", "inbox"), "did")


def plan(activities: DataFrame, relays: DataFrame, inboxes: DataFrame, max_relays: int = 1000) -> DataFrame:
    """(activity, did, path, inbox): relay targets and then follower targets, an inbox in both twice."""
    rows, order = activities.select("activity", "did"), ("activity", "did", "path", "inbox")
    relayed = to_relays(rows, relays, max_relays).withColumn("path", F.lit("relay"))
    return relayed.select(*order).unionByName(to_followers(rows, inboxes).withColumn("path", F.lit("direct")).select(*order))


def counts(activities: DataFrame, keys: DataFrame, relays: DataFrame, inboxes: DataFrame) -> DataFrame:
    """(activity, did, relays, direct): how many deliveries of each kind; none for authors without a key (did)."""
    n = len(relay_targets(relays))
    direct = inboxes.groupBy("did").agg(F.count(F.lit(1)).alias("n"))
    rows = activities.join(keys.select("did", F.lit(True).alias("_key")).distinct(), "did", "left").join(direct, "did", "left")
    if_known = lambda c: F.when(F.col("_key"), c).otherwise(F.lit(0)).cast("bigint")
    return rows.select("activity", "did", if_known(F.lit(n)).alias("relays"), if_known(F.coalesce("n", F.lit(0))).alias("direct"))


def delivery_log(attempts: DataFrame) -> DataFrame:
    """Latest attempt of each (record, inbox); the kind of activity stays that of the first."""
    newest, oldest = F.struct(F.col("created_at"), F.col("id")), F.struct(F.col("created_at"), F.col("id"))
    return attempts.groupBy("record_uri", "target_inbox").agg(
        F.min_by("activity_type", oldest).alias("activity_type"),
        F.max_by(F.struct("status", "attempts", "response_code", "last_attempt"), newest).alias("latest"),
        F.count(F.lit(1)).alias("entries"),
    ).select("record_uri", "target_inbox", "activity_type", "latest.*", "entries")


def retry_schedule(failed: DataFrame, schedule: Sequence[int] = (2, 4, 8, 16)) -> DataFrame:
    """One row per attempt that may still be made for a failed delivery, with its delay in seconds."""
    attempt = F.explode(F.sequence(F.lit(1), F.lit(len(schedule)))).alias("attempt")
    rows = failed.select("id", F.coalesce("attempts", F.lit(0)).alias("made"), attempt).where(F.col("attempt") > F.col("made"))
    return rows.withColumn("delay", retry_delay(F.col("attempt"), schedule)).drop("made")


def reconcile(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """(inbox, action, new_state): what brings the stored relay subscriptions to the configuration.

    Missing, pending, rejected and unsubscribed ones are followed (again), those
    no longer configured are undone while they are pending or accepted.
    """
    c, s = configured.select("inbox", F.lit(True).alias("is_configured")), stored.select("inbox", "state")
    both = c.join(s, "inbox", "full_outer")
    follow = F.col("is_configured") & (F.col("state").isNull() | F.col("state").isin("pending", "rejected", "unsubscribed"))
    undo = F.col("is_configured").isNull() & F.col("state").isin("pending", "accepted")
    action = F.when(follow, "follow").when(undo, "undo").otherwise("keep")
    after = F.when(action == "follow", "pending").when(action == "undo", "unsubscribed").otherwise(F.col("state"))
    return both.select("inbox", action.alias("action"), after.alias("new_state"))


def follow_state(events: DataFrame) -> DataFrame:
    """Follows after a stream of follow and undo events (local_did, follower, inbox, shared_inbox, undo, seq)."""
    last = events.groupBy("local_did", "follower").agg(F.max(F.struct("seq", "undo", "inbox", "shared_inbox")).alias("last"))
    return last.where(~F.col("last.undo")).select("local_did", "follower", "last.inbox", "last.shared_inbox")


def likes(events: DataFrame) -> DataFrame:
    """Likes by activity id: the first arrival counts, the same actor and object under another id is another like."""
    return events.groupBy("activity_id").agg(F.min(F.struct("seq", "actor", "object")).alias("x")).select("activity_id", "x.actor", "x.object")


def undo_likes(kept: DataFrame, undone: DataFrame) -> DataFrame:
    """Likes that are left: an undo counts if activity and actor are those of the like."""
    return kept.join(undone.select("activity_id", "actor").distinct(), ["activity_id", "actor"], "left_anti")
