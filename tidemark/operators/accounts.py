"""Accounts over time: opting out and in, and what their profiles say.

Which control event stands when an event arrives is an as-of join. Arrivals are
cut into buckets: one row for each account and bucket with events carries what
stood at its start and the changes inside it, so that only these rows are ever
put in order by account, and an account that holds a third of all rows, or
changes its mind all the time, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPT_OUT, OPT_IN = "opt_out", "opt_in"
SPAN = 1 << 16  # arrivals of one bucket


def standing(events: DataFrame, controls: DataFrame) -> DataFrame:
    """(did, bucket, control, turns) for each account with controls and bucket of its events.

    ``control`` is the last one before the bucket, ``turns`` (seq, control) are
    those inside it, without repeats of the one before.
    """
    bucket = F.floor(F.col("seq") / SPAN).alias("bucket")
    order = Window.partitionBy("did", "bucket").orderBy("seq", "control")
    # of several control events with one number the last as they sort decides
    inside = controls.select("did", "seq", "control", bucket).withColumn("_before", F.lag("control").over(order))
    inside = inside.where(F.col("_before").isNull() | (F.col("_before") != F.col("control")))
    inside = inside.groupBy("did", "bucket").agg(F.array_sort(F.collect_list(F.struct("seq", "control"))).alias("turns"))
    met = events.select("did", bucket).distinct().join(controls.select("did").distinct(), "did", "left_semi")
    rows = met.join(inside, ["did", "bucket"], "full_outer")
    before = Window.partitionBy("did").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.try_element_at("turns", F.lit(-1))["control"], ignorenulls=True).over(before)
    return rows.select("did", "bucket", last.alias("control"), "turns")


def accepted(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Events of accounts that had not opted out when they arrived."""
    known = standing(events, controls).select("did", F.col("bucket").alias("_bucket"), F.col("control").alias("_control"), F.col("turns").alias("_turns"))
    joined = events.withColumn("_bucket", F.floor(F.col("seq") / SPAN)).join(known, ["did", "_bucket"], "left")
    here = F.try_element_at(F.filter("_turns", lambda t: t["seq"] < F.col("seq")), F.lit(-1))["control"]
    return joined.where(F.coalesce(here, F.col("_control"), F.lit(OPT_IN)) != OPT_OUT).select(*events.columns)


def purged(archive: DataFrame, controls: DataFrame) -> DataFrame:
    """Archive rows after the purges: ``deleted`` also where the account opted out after the last change.

    ``purged`` tells those; opting in again does not revive them.
    """
    last = controls.where(F.col("control") == OPT_OUT).groupBy("did").agg(F.max("seq").alias("_out"))
    joined = archive.join(last, "did", "left")
    gone = ~F.col("deleted") & F.coalesce(F.col("_out") > F.col("updated_seq"), F.lit(False))
    return joined.withColumn("purged", gone).withColumn("deleted", F.col("deleted") | gone).drop("_out")


def profile_state(rows: DataFrame, name: Column, avatar: Column) -> DataFrame:
    """(did, name, avatar): the last name and the last avatar that are not empty, by arrival."""
    at = lambda c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.col("seq"))
    return rows.groupBy("did").agg(
        F.max_by(F.nullif(name, F.lit("")), at(name)).alias("name"), F.max_by(F.nullif(avatar, F.lit("")), at(avatar)).alias("avatar")
    )


def merged_identifiers(rows: DataFrame, minted: DataFrame) -> DataFrame:
    """(work_key, ids): the identifiers of all records of a work, later ones overriding earlier ones."""
    each = rows.select("seq", F.explode_outer("ids").alias("k", "v")).join(minted, "seq").where(F.col("k").isNotNull())
    last = each.groupBy(F.col("minted_key").alias("work_key"), "k").agg(F.max_by("v", "seq").alias("v"))
    return last.groupBy("work_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("ids"))


def servers(did_dim: DataFrame) -> DataFrame:
    """(did, pds): the server that holds each account's records; of several the first as text, none where it is not told."""
    rows = did_dim.select("did", F.explode("service").alias("s")).where(F.endswith("s.id", F.lit("#atproto_pds")))
    return rows.groupBy("did").agg(F.min("s.serviceendpoint").alias("pds"))


def follow_answer(actor_ok: Column, resolved: Column, handle: Column, known: Column, opted_out: Column, own_inbox: Column) -> Column:
    """struct(status, response) to a follow: accepted at the author's own inbox or by name, rejected where it may not be."""
    say = lambda code, text=None: F.struct(F.lit(code).alias("status"), F.lit(text).cast("string").alias("response"))
    return (
        F.when(~actor_ok, say(400))
        .when(~resolved, say(202))
        .when(own_inbox & ~known, say(404))
        .when(own_inbox, say(202, "Accept"))
        .when(handle.isNull() | ~known | opted_out, say(202, "Reject"))
        .otherwise(say(202, "Accept"))
    )


def undo_kind(object_type: Column, object_id: Column) -> Column:
    """What an undo takes back: a follow, a like (also where only its id is given), or nothing known."""
    return F.when(object_type == "Follow", "follow").when((object_type == "Like") | (object_type.isNull() & object_id.isNotNull()), "like").otherwise("ignored")
