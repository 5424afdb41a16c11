"""Queries of what happens to whole accounts, of stored forms and of addresses, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import records as R
from tidemark.functions import text as T
from tidemark.operators import accounts as U
from tidemark.operators import archive as A
from tidemark.operators import backfill as B
from tidemark.operators import pairing as P
from tidemark.operators import works as W
from tidemark.plans.problems import table
from tidemark.plans.reference import _BUDGET, _C, _CONTROLS, _H, _P, _PAIRS, BASE, MARKER, actors, controls, events, imported, log, paired, posts, slim
from tidemark.plans.scalars import _ALL_WORKS, _FOLD, works_of
from tidemark.session import stage_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


# --- opting out -----------------------------------------------------------------

_PURGED = f"""
left_posts AS (SELECT p.*, coalesce(handle, p.did) AS handle FROM posts p LEFT JOIN actors a ON a.did = p.did WHERE NOT deleted
  AND EXISTS (SELECT 1 FROM controls c WHERE c.did = p.did AND c.seq > p.updated_seq AND c.control = 'opt_out'))"""


def left_posts(spark, folder):
    """Active records of accounts that opted out after the last change, with the author's handle."""
    rows = U.purged(posts(spark, folder), controls(spark, folder)).where("purged")
    return A.with_handle(rows, actors(spark, folder))


@query(
    f"""WITH {_P}, {_H}, {_CONTROLS}, {_PURGED} SELECT at_uri, '{BASE}/users/' || handle || '/posts/' || rkey || '#delete' AS activity_id, 'Delete' AS type, '{BASE}/users/' || handle AS actor,
'{BASE}/users/' || handle || '/posts/' || rkey AS object FROM left_posts WHERE is_published"""
)
def optout_deletes(spark, folder):
    """The Delete of each published record of an account that opted out; what was only archived is not answered."""
    rows = left_posts(spark, folder).where("is_published")
    note_id, actor = D.post_url(F.col("handle"), F.col("rkey"), BASE), D.actor_url(F.col("handle"), BASE)
    none = F.lit(None).cast("string")
    made = D.activity(F.lit("delete"), none, note_id, actor, none, none)
    return rows.select("at_uri", made["id"].alias("activity_id"), made["type"].alias("type"), made["actor"].alias("actor"), made["tombstone"]["id"].alias("object"))


@query(f"WITH {_P}, {_H}, {_CONTROLS}, {_PURGED} SELECT did, count(*) AS tombstoned, count(*) FILTER (is_published) AS retracted FROM left_posts GROUP BY did")
def optout_counts(spark, folder):
    rows = left_posts(spark, folder)
    return rows.groupBy("did").agg(F.count(F.lit(1)).alias("tombstoned"), F.count_if("is_published").alias("retracted"))


# --- importing, profiles, stored forms ----------------------------------------------


@query(
    f"""WITH {_BUDGET}, {_H},
turned AS (SELECT did, at_uri, row_number() OVER (PARTITION BY did ORDER BY (collection <> 'social.popfeed.feed.list')::INT, written, at_uri) AS turn FROM budget),
profiles AS (SELECT DISTINCT did FROM archive WHERE collection = 'social.popfeed.actor.profile' AND NOT deleted)
SELECT t.did, handle, count(*) AS imported, arg_min(at_uri, turn) AS first_uri, t.did IN (SELECT did FROM profiles) AS refreshed FROM turned t JOIN actors a ON a.did = t.did GROUP BY t.did, handle"""
)
def backfill_run(spark, folder):
    """One import of each account: those that opted out or have nothing in the window are left out; then the profile is refreshed."""
    written = imported(spark, folder)
    rows = B.replay_order(written, F.col("written"), F.col("collection") == R.LIST)
    done = rows.groupBy("did").agg(F.count(F.lit(1)).alias("imported"), F.min_by("at_uri", "turn").alias("first_uri"))
    live = slim(spark, folder).where((F.col("collection") == R.PROFILE) & ~F.col("deleted"))
    profiles = live.select("did", F.lit(True).alias("_profile")).distinct()
    known = actors(spark, folder).select("did", "handle")
    return done.join(known, "did").join(profiles, "did", "left").select("did", "handle", "imported", "first_uri", F.coalesce("_profile", F.lit(False)).alias("refreshed"))


@query(
    f"""WITH {_C}, {_H} SELECT e.seq, '{BASE}/users/' || handle || '#updates/' || time_us AS activity_id, 'Update' AS type, '{BASE}/users/' || handle AS actor, '{BASE}/users/' || handle || '/followers' AS cc
FROM events_in e JOIN actors a ON a.did = e.did WHERE collection = 'social.popfeed.actor.profile' AND operation <> 'delete' AND time_us IS NOT NULL"""
)
def profile_updates(spark, folder):
    """The Update that an edited profile sends to the account's followers; accounts without other records have none."""
    rows = events(spark, folder).where((F.col("collection") == R.PROFILE) & (F.col("operation") != "delete") & F.col("time_us").isNotNull())
    rows = rows.join(actors(spark, folder).select("did", "handle"), "did")
    made = D.person_update(F.col("handle"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("time_us"), BASE)
    return rows.select("seq", made["id"].alias("activity_id"), made["type"].alias("type"), made["actor"].alias("actor"), F.get(made["cc"], F.lit(0)).alias("cc"))


@query(
    f"""WITH RECURSIVE {_PAIRS}, {_FOLD}, forms AS (SELECT anchor, arg_max(kind, (seq, step)) AS form, max(seq) AS form_seq FROM st WHERE k LIKE '#%' GROUP BY anchor)
SELECT at_uri, cid, deleted, coalesce(form, 'none') AS form, form_seq FROM archive LEFT JOIN forms ON anchor = at_uri WHERE collection IN ('social.popfeed.feed.review', 'social.popfeed.feed.listItem')"""
)
def record_forms(spark, folder):
    """The archive of reviews and list items with the last activity that each carries."""
    kept = events(spark, folder).where(F.col("collection").isin(R.REVIEW, R.LIST_ITEM))
    rows = R.with_work(R.fields(kept))
    made = P.activities(rows, W.mint(rows.where(F.col("operation") != "delete")))
    return A.with_forms(A.state(kept, ("cid",)), made).select("at_uri", "cid", "deleted", F.coalesce("form", F.lit("none")).alias("form"), "form_seq")


@query(f"WITH {_ALL_WORKS} SELECT seq, work_type, work_key, to_json(list_transform(all_ids, lambda e: e.v))::VARCHAR AS ids FROM works")
def work_keys(spark, folder):
    """What each record is about: type, key, and the identifiers that name the work."""
    ids = F.coalesce(F.transform("aliases", lambda a: a["id"]), F.array().cast("array<string>"))
    return works_of(spark, folder).select("seq", "work_type", "work_key", F.to_json(ids).alias("ids"))


@query(
    f"""WITH {_P}, {_H} SELECT did, count(*) AS total, least(count(*), 100) AS shown FROM posts JOIN actors USING (did) WHERE is_published AND NOT deleted GROUP BY did"""
)
def outbox_totals(spark, folder):
    """Length of each outbox, and of its first page of a hundred."""
    rows = posts(spark, folder).where(F.col("is_published") & ~F.col("deleted")).join(actors(spark, folder).select("did"), "did")
    total = F.count(F.lit(1))
    return rows.groupBy("did").agg(total.alias("total"), F.least(total, F.lit(100)).alias("shown"))


@query(f"WITH {_P} SELECT DISTINCT did FROM (SELECT did FROM archive ORDER BY updated_at DESC, at_uri LIMIT 100)")
def page_accounts(spark, folder):
    """The accounts on the first page of the archive."""
    return slim(spark, folder).orderBy(F.col("updated_at").desc(), "at_uri").limit(100).select("did").distinct()


# --- addresses --------------------------------------------------------------------------

_ADDRESS = f"""given AS (SELECT id, record_uri, target_inbox, split_part(record_uri, '/', -1) AS name,
  CASE id % 5 WHEN 0 THEN 'acct:' || split_part(record_uri, '/', -1) || '@bridge.example' WHEN 1 THEN 'acct:@' || split_part(record_uri, '/', -1) WHEN 2 THEN 'acct:x@' || split_part(target_inbox, '/', 3)
    WHEN 3 THEN '{BASE}/users/' || split_part(record_uri, '/', -1) || '/' ELSE record_uri END AS resource FROM delivery_log)"""


@query(
    f"""WITH {_ADDRESS} SELECT id, CASE id % 5 WHEN 0 THEN name WHEN 1 THEN name WHEN 3 THEN name WHEN 4 THEN CASE WHEN resource LIKE 'http%' THEN nullif(name, '') END END AS account,
  CASE WHEN id % 5 = 3 THEN name END AS local, '/' || ltrim(CASE WHEN id % 2 = 0 THEN '//' ELSE '\\' END || target_inbox, '/\\') AS redirect,
  split_part(target_inbox, '/', 3) || '|' || name AS words, url_encode(record_uri) AS encoded, url_decode(url_encode(record_uri)) = record_uri AS round_trip,
  '<a href="' || regexp_replace(target_inbox, '^([^:/]+://[^/]*)', '\\1/{MARKER}') || '">' || activity_type || '</a>' AS link, CAST(created_at AS DATE)::VARCHAR AS day, strftime(created_at, '%H:%M:%S') AS clock
FROM given JOIN (SELECT id AS i, activity_type, created_at FROM delivery_log) ON i = id"""
)
def address_functions(spark, folder):
    """Names out of resources and addresses, redirects, word lists, encoding, links and shown times."""
    rows, k = log(spark, folder), F.col("id") % 5
    name, host = T.last_segment(F.col("record_uri"), "/"), F.get(F.split("target_inbox", "/"), F.lit(2))
    resource = (
        F.when(k == 0, F.concat(F.lit("acct:"), name, F.lit("@bridge.example"))).when(k == 1, F.concat(F.lit("acct:@"), name)).when(k == 2, F.concat(F.lit("acct:x@"), host))
        .when(k == 3, F.concat(F.lit(f"{BASE}/users/"), name, F.lit("/"))).otherwise(F.col("record_uri"))
    )
    path = F.concat(F.when(F.col("id") % 2 == 0, "//").otherwise("\\"), "target_inbox")
    return rows.select(
        "id",
        T.account_name(resource, "bridge.example").alias("account"),
        T.local_handle(resource, BASE).alias("local"),
        T.redirect_target(path).alias("redirect"),
        F.array_join(T.words_of_list(F.concat(host, F.lit(", "), name, F.lit("  "), host)), "|").alias("words"),
        # blanks are %20 here, and + where forms are meant
        F.replace(F.url_encode("record_uri"), F.lit("+"), F.lit("%20")).alias("encoded"),
        (F.url_decode(F.url_encode("record_uri")) == F.col("record_uri")).alias("round_trip"),
        T.title_html(F.col("activity_type"), F.col("target_inbox"), MARKER).alias("link"),
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        F.date_format("created_at", "HH:mm:ss").alias("clock"),
    )


# --- what is fetched and kept for a while -------------------------------------------------


@query(
    f"""WITH {_P}, wanted_lists AS (SELECT DISTINCT json_extract_string(record, '$.listUri') AS list_uri FROM archive WHERE collection = 'social.popfeed.feed.listItem' AND NOT deleted),
hosts AS (SELECT did, min(s.serviceendpoint) AS pds FROM (SELECT did, unnest(service) AS s FROM did_dim) WHERE s.id LIKE '%#atproto_pds' GROUP BY did)
SELECT list_uri, pds, CASE WHEN pds IS NULL THEN 'failed' ELSE 'fetch' END AS outcome FROM wanted_lists LEFT JOIN hosts ON did = split_part(list_uri, '/', 3)
WHERE regexp_full_match(list_uri, 'at://[^/]+/social\\.popfeed\\.feed\\.list/[^/]*') AND list_uri NOT IN (SELECT at_uri FROM archive)"""
)
def lists_to_fetch(spark, folder):
    """Lists that live items name but the archive lacks: each once, from its author's server; without one it counts as failed."""
    doc = F.from_json("record", "struct<listUri string>")
    rows = stage_table(A.state(events(spark, folder).withColumn("list_uri", doc["listUri"]), ("list_uri",)).select("at_uri", "collection", "deleted", "list_uri"), "named")
    named = rows.where((F.col("collection") == R.LIST_ITEM) & ~F.col("deleted") & T.is_list_uri(F.col("list_uri"))).select("list_uri").distinct()
    missing = named.join(rows.select(F.col("at_uri").alias("list_uri")), "list_uri", "left_anti")
    hosts = U.servers(table(spark, folder, "did_dim")).withColumnRenamed("did", "_did")
    found = missing.join(hosts, F.get(F.split("list_uri", "/"), F.lit(2)) == F.col("_did"), "left")
    return found.select("list_uri", "pds", F.when(F.col("pds").isNull(), "failed").otherwise("fetch").alias("outcome"))


@query(f"WITH {_C} SELECT seq, did, collection, rkey FROM events_in ORDER BY seq LIMIT 500")
def first_processed(spark, folder):
    """A stream that stops after so many processed events; events that are skipped do not count."""
    return events(spark, folder).select("seq", "did", "collection", "rkey").orderBy("seq").limit(500)


@query(
    f"WITH {_C} SELECT did, min(seq) AS started, count(*) - 1 AS refused FROM jetstream_sample WHERE kind = 'identity' AND did NOT IN (SELECT did FROM outs) GROUP BY did"
)
def import_requests(spark, folder):
    """Identity events as requests to import: one runs for each account, none for accounts that opted out."""
    rows = table(spark, folder, "jetstream_sample").where(F.col("kind") == "identity").select("did", "seq")
    rows = A.without_opted_out(rows, A.opted_out(table(spark, folder, "did_dim")))
    return rows.groupBy("did").agg(F.min("seq").alias("started"), (F.count(F.lit(1)) - 1).alias("refused"))


@query(
    f"""WITH RECURSIVE {_PAIRS} SELECT at_uri, work, title, poster_url AS poster FROM paired LEFT JOIN work_catalog ON work_key = work"""
)
def record_catalog(spark, folder):
    """Each paired record with the catalog's entry of the work it joined."""
    catalog = table(spark, folder, "work_catalog").select(F.col("work_key").alias("work"), "title", F.col("poster_url").alias("poster"))
    return paired(spark, folder).select("at_uri", "work").join(catalog, "work", "left").select("at_uri", "work", "title", "poster")


@query(
    """WITH signed AS (SELECT did, max(received_at) AS since FROM jetstream_sample WHERE kind = 'identity' GROUP BY did), turns AS (SELECT did, received_at FROM jetstream_sample WHERE kind = 'commit')
SELECT s.did, since + INTERVAL 30 MINUTE AS expires, count(t.did) AS used FROM signed s LEFT JOIN turns t ON t.did = s.did AND t.received_at >= since AND t.received_at <= since + INTERVAL 30 MINUTE GROUP BY ALL"""
)
def sessions_used(spark, folder):
    """Identity events as sign-ins that last half an hour: the last of each account, and how many events fall into it."""
    rows = table(spark, folder, "jetstream_sample")
    signed = rows.where(F.col("kind") == "identity").groupBy("did").agg(F.max("received_at").alias("at"))
    signed = signed.withColumn("expires", F.col("at") + F.expr("INTERVAL 30 MINUTES"))
    turns = rows.where(F.col("kind") == "commit").select("did", "received_at")
    # counted before the join: one row for each account and moment
    turns = turns.groupBy("did", "received_at").agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("received_at") >= F.col("at")) & (F.col("received_at") <= F.col("expires"))
    joined = signed.join(turns, "did", "left")
    return joined.groupBy("did", "expires").agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("used"))
