"""The archive: every record's latest state by arrival, and the queries over it.

Here the last arrival wins, as in the live service (revisions are the business
of ``changefeed``). A delete keeps the record's last content as a tombstone, a
later create or update revives it, a delete of a record never seen leaves no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.functions import text as T
from tidemark.operators.changefeed import RECORD, at_uri

SERVICE_DID = "did:tidemark:relay"


def wanted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("collection").isin(*R.WANTED))


def opted_out(did_dim: DataFrame) -> DataFrame:
    """Accounts without a service: in the test tables these stand for those that opted out."""
    return did_dim.where(F.coalesce(F.size("service"), F.lit(0)) <= 0).select("did").distinct()


def without_opted_out(rows: DataFrame, out: DataFrame) -> DataFrame:
    return rows.join(out, "did", "left_anti")


def route(rows: DataFrame) -> Column:
    """Which way an event goes; the first match wins. Needs ``fields`` and ``with_work``."""
    kind = F.coalesce(F.col("work_type") == "tv_episode", F.lit(False))
    named = F.col("work_key").isNotNull()
    contributes = contributes_expr()
    return (
        F.when(F.col("collection") == R.PROFILE, "profile")
        .when(F.col("collection") == R.LIST, "archive")
        .when(F.col("operation") == "delete", "delete")
        .when(kind, "episode")
        .when((F.col("collection") == R.LIST_ITEM) & ~(named & contributes), "membership")
        .when(named & F.col("collection").isin(R.REVIEW, R.LIST_ITEM) & contributes, "paired")
        .otherwise("standalone")
    )


def contributes_expr() -> Column:
    """Whether a record takes part in its author's note on the work: reviews do, list items with a shelf do."""
    shelf = R.shelf_of_item(F.col("doc.listType"), F.col("doc.creativeWorkType"))
    return (F.col("collection") == R.REVIEW) | ((F.col("collection") == R.LIST_ITEM) & shelf.isNotNull())


def state(rows: DataFrame, payload: Sequence[str] = ("cid", "record")) -> DataFrame:
    """(did, collection, rkey, at_uri, payload..., op, created_seq, updated_seq, created_at, updated_at, deleted).

    ``payload`` names the columns kept of the last content: nothing else of a row
    is read or shuffled. One aggregation of maxima and minima of structs: partial
    results go through the shuffle, so a record changed very often costs one row
    per map task.
    """
    upsert = F.col("operation") != "delete"
    grouped = rows.groupBy(*RECORD).agg(
        F.max(F.when(upsert, F.struct("seq", "received_at", *payload))).alias("last_up"),
        F.min(F.when(upsert, F.struct("seq", "received_at"))).alias("first_up"),
        F.max(F.struct("seq", "received_at", "operation")).alias("last"),
    )
    return grouped.where(F.col("last_up").isNotNull()).select(
        *RECORD,
        at_uri().alias("at_uri"),
        *(F.col(f"last_up.{c}").alias(c) for c in payload),
        F.col("last.operation").alias("op"),
        F.col("first_up.seq").alias("created_seq"),
        F.col("last.seq").alias("updated_seq"),
        F.col("first_up.received_at").alias("created_at"),
        F.col("last.received_at").alias("updated_at"),
        (F.col("last.operation") == "delete").alias("deleted"),
    )


def actors(rows: DataFrame, did_dim: DataFrame) -> DataFrame:
    """(did, handle, first_seen, last_seen): every account with a wanted event other than a profile's."""
    seen = rows.where(F.col("collection") != R.PROFILE).groupBy("did").agg(
        F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen")
    )
    handles = did_dim.groupBy("did").agg(
        F.min(F.get(F.filter("also_known_as", lambda a: a.startswith("at://")), F.lit(0))).alias("alias")
    )
    joined = seen.join(handles, "did", "left")
    handle = F.coalesce(F.nullif(F.regexp_replace("alias", "^at://", ""), F.lit("")), T.fallback_handle(F.col("did")))
    return joined.select("did", handle.alias("handle"), "first_seen", "last_seen")


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only, as LIKE compares in SQLite."""
    return F.translate(text, _CAPITALS, _SMALL)


def search(archive: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Rows whose collection, key or content contains the text (``%`` and ``_`` are wild), newest first."""
    like = f"%{pattern.translate(str.maketrans(_CAPITALS, _SMALL))}%"
    hit = F.lit(False)
    for name in ("collection", "rkey", "record"):
        hit = hit | F.coalesce(ascii_lower(F.col(name)).like(like), F.lit(False))
    rows = archive.where(hit) if pattern else archive
    return rows.orderBy(F.col("updated_at").desc(), "at_uri").limit(limit)


def with_handle(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the author's handle, the did where it is not known."""
    return rows.join(known.select("did", F.col("handle").alias("_h")), "did", "left").withColumn("handle", F.coalesce("_h", "did")).drop("_h")


def with_list_label(items: DataFrame, lists: DataFrame, list_uri: Column) -> DataFrame:
    """Adds ``label``, what the list of an item is called; null where the list (at_uri, label) is unknown."""
    known = lists.select(F.col("at_uri").alias("list_at"), "label")
    return items.join(known, list_uri == F.col("list_at"), "left").drop("list_at")


def newest_of_author(archive: DataFrame, limit: int = 200) -> DataFrame:
    """The newest active records of each author, at most ``limit`` of them (the account view)."""
    order = Window.partitionBy("did").orderBy(F.col("updated_at").desc(), "at_uri")
    return archive.where(~F.col("deleted")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def post_state(row_found: Column, published: Column, deleted: Column) -> Column:
    """What a post's address shows: nothing, a tombstone or the note."""
    return F.when(~row_found | ~F.coalesce(published | deleted, F.lit(False)), F.lit("absent")).when(deleted & published, F.lit("tombstone")).when(
        ~published, F.lit("absent")
    ).otherwise(F.lit("note"))


def actor_lookup(idents: DataFrame, authors: DataFrame) -> DataFrame:
    """(ident, did, shown) of each ``ident``, a handle or did of ``authors`` (did, handle, opted_out).

    ``shown`` is found, gone (opted out) or none; of accounts that share a handle
    the smallest did counts.
    """
    by_did = authors.select(F.col("did").alias("ident"), "did", "opted_out")
    least = authors.groupBy("handle").agg(F.min(F.struct("did", "opted_out")).alias("a"))
    by_handle = least.where(~F.startswith("handle", F.lit("did:"))).select(F.col("handle").alias("ident"), "a.did", "a.opted_out")
    shown = F.when(F.col("did").isNull(), "none").when(F.col("opted_out"), "gone").otherwise("found")
    return idents.join(by_did.unionByName(by_handle), "ident", "left").select("ident", "did", shown.alias("shown"))


def with_forms(archive: DataFrame, activities: DataFrame) -> DataFrame:
    """``archive`` with ``form`` and ``form_seq``, kind and arrival of the last activity that each record carries.

    Only these two columns are replaced where a record is written again; the
    others keep what the record's own events say.
    """
    last = activities.groupBy(F.col("anchor").alias("at_uri")).agg(F.max(F.struct("seq", "step", "kind")).alias("f"))
    return archive.join(last, "at_uri", "left").withColumn("form", F.col("f.kind")).withColumn("form_seq", F.col("f.seq")).drop("f")
