"""Queries of the service's own operators over the test tables, and their SQL.

Lenses, the same on both sides: accounts without a service opted out; the
inboxes named relay... in the delivery log are relays, the others followers'
inboxes of the author whose record was delivered; a live review, or live list
item with a shelf, counts as published.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.functions import text as T
from tidemark.functions import timefn as M
from tidemark.operators import accounts as U
from tidemark.operators import archive as A
from tidemark.operators import backfill as B
from tidemark.operators import fanout as O
from tidemark.operators import works as W
from tidemark.plans.problems import commit_rows, table
from tidemark.session import stage_table

CONFIGURED_RELAYS = ("https://relay0.example/inbox", "https://relay2.example/inbox", "https://relay7.example/inbox")
NOW = "2022-01-21 00:00:00"
WINDOW_DAYS = 7
BUDGET = 50
BASE = "https://bridge.example"
MARKER = "~neodb~"  # fixed value: what peers look for in links to works

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- lenses -------------------------------------------------------------------


def events(spark, folder):
    """Wanted events of accounts that have not opted out."""
    return A.without_opted_out(A.wanted(commit_rows(spark, folder)), A.opted_out(table(spark, folder, "did_dim")))


def archive(spark, folder, *payload):
    """The archive with the columns of the last content that are needed, by default cid and record."""
    return A.state(events(spark, folder), payload or ("cid", "record"))


def slim(spark, folder):
    """The archive without contents."""
    return A.state(events(spark, folder), ())


def with_shelf(rows):
    """Adds the shelf of list items, read off the record before anything is shuffled."""
    doc = F.from_json("record", "struct<listType string, creativeWorkType string>")
    return rows.withColumn("_doc", doc).withColumn("shelf", F.when(F.col("collection") == R.LIST_ITEM, R.shelf_of_item(F.col("_doc.listType"), F.col("_doc.creativeWorkType")))).drop("_doc")


def posts(spark, folder, *payload):
    """The archive with shelf and is_published in place of the records, and other columns of the last content."""
    rows = A.state(with_shelf(events(spark, folder)), ("shelf", *payload))
    return rows.withColumn("is_published", F.col("collection").isin(R.REVIEW, R.BOOK) | F.col("shelf").isNotNull())


def actors(spark, folder):
    return A.actors(events(spark, folder), table(spark, folder, "did_dim"))


def published(rows):
    """Adds doc, value, shelf and is_published to archive rows."""
    rows = R.fields(rows)
    shelf = R.shelf_of_item(F.col("doc.listType"), F.col("doc.creativeWorkType"))
    rows = rows.withColumn("shelf", F.when(F.col("collection") == R.LIST_ITEM, shelf))
    out = (F.col("collection") == R.REVIEW) | (F.col("collection") == R.BOOK) | F.col("shelf").isNotNull()
    return rows.withColumn("is_published", out)


def log(spark, folder):
    return table(spark, folder, "delivery_log")


def relays_stored(spark, folder):
    rows = log(spark, folder).where(F.col("target_inbox").like("https://relay%"))
    state = F.max_by("status", F.struct("created_at", "id"))
    name = F.when(state == "sent", "accepted").when(state == "failed", "rejected").otherwise("pending")
    return rows.groupBy(F.col("target_inbox").alias("inbox")).agg(name.alias("state"))


def follows(spark, folder):
    """(did, follower, inbox, shared_inbox, seq): who receives an author's records."""
    rows = log(spark, folder).where(F.col("record_uri").like("at://did:%") & ~F.col("target_inbox").like("https://relay%"))
    host = F.regexp_extract("target_inbox", "^https://([^/]+)/", 1)
    return rows.select(
        F.regexp_extract("record_uri", "^at://([^/]+)/", 1).alias("did"),
        F.concat(F.lit("https://"), host, F.lit("/users/u"), (F.col("id") % 7).cast("string")).alias("follower"),
        F.concat(F.lit("https://"), host, F.lit("/users/u"), (F.col("id") % 7).cast("string"), F.lit("/inbox")).alias("inbox"),
        F.when(F.col("id") % 3 > 0, F.col("target_inbox")).alias("shared_inbox"),
        F.col("id").alias("seq"),
        (F.col("status") == "failed").alias("undo"),
    )


_C = """
commits AS (
  SELECT seq, batch_no, received_at, time_us, did, commit.rev AS rev, coalesce(commit.operation, 'create') AS operation,
         commit.collection AS collection, commit.rkey AS rkey, commit.record AS record, commit.cid AS cid
  FROM jetstream_sample WHERE kind = 'commit'
),
outs AS (SELECT DISTINCT did FROM did_dim WHERE coalesce(len(service), 0) = 0),
wanted AS (SELECT * FROM commits WHERE collection IN ('social.popfeed.feed.list', 'social.popfeed.feed.listItem',
           'social.popfeed.feed.review', 'social.popfeed.actor.profile', 'buzz.bookhive.book')),
events_in AS (SELECT * FROM wanted WHERE did NOT IN (SELECT did FROM outs))"""
_A = (
    _C
    + """,
archive AS (
  SELECT did, collection, rkey, 'at://' || did || '/' || collection || '/' || rkey AS at_uri,
         arg_max(cid, seq) FILTER (operation <> 'delete') AS cid, arg_max(record, seq) FILTER (operation <> 'delete') AS record,
         arg_max(operation, seq) AS op, min(seq) FILTER (operation <> 'delete') AS created_seq, max(seq) AS updated_seq,
         arg_min(received_at, seq) FILTER (operation <> 'delete') AS created_at, arg_max(received_at, seq) AS updated_at,
         arg_max(operation, seq) = 'delete' AS deleted
  FROM events_in GROUP BY did, collection, rkey HAVING count(*) FILTER (operation <> 'delete') > 0
)"""
)
_WORDS = ", ".join(f"'{k}': '{v}'" for k, v in R.SHELF_OF_WORD.items())


def _shelf_sql(text: str) -> str:
    """Shelf of a list type in SQL."""
    words = f"regexp_split_to_array({text}, '[_\\-\\s]+')"
    return (
        f"coalesce(m[{text}], (SELECT CASE WHEN m[w] = 'complete' AND coalesce(before = 'to', false) THEN 'wishlist' ELSE m[w] END FROM "
        f"(SELECT i, {words}[i] AS w, CASE WHEN i > 1 THEN {words}[i - 1] END AS before FROM range(1, len({words}) + 1) r(i)) "
        f"WHERE m[w] IS NOT NULL ORDER BY i LIMIT 1))"
    )


_P = (
    _A
    + f""",
types AS (SELECT DISTINCT lower(coalesce(json_extract_string(record, '$.listType'), '')) AS lt FROM commits WHERE record IS NOT NULL),
verbs AS (SELECT MAP {{{_WORDS}}} AS m),
shelves AS (SELECT lt, {_shelf_sql('lt')} AS base FROM types, verbs),
full_archive AS (
  SELECT a.*, CASE WHEN collection = 'social.popfeed.feed.listItem' THEN
           CASE WHEN base IS NOT NULL AND json_extract_string(record, '$.creativeWorkType') = 'tv_episode' THEN 'progress' ELSE base END END AS shelf
  FROM archive a LEFT JOIN shelves ON lt = lower(coalesce(json_extract_string(record, '$.listType'), ''))
),
posts AS (SELECT *, collection IN ('social.popfeed.feed.review', 'buzz.bookhive.book') OR shelf IS NOT NULL AS is_published FROM full_archive)"""
)
_H = """
seen AS (SELECT did, min(received_at) AS first_seen, max(received_at) AS last_seen FROM events_in
         WHERE collection <> 'social.popfeed.actor.profile' GROUP BY did),
names AS (SELECT did, min(list_filter(also_known_as, lambda a: starts_with(a, 'at://'))[1]) AS alias FROM did_dim GROUP BY did),
actors AS (SELECT s.did, coalesce(nullif(substr(alias, 6), ''), split_part(s.did, ':', -1) || '.did') AS handle, first_seen, last_seen
           FROM seen s LEFT JOIN names n ON n.did = s.did)"""
_RELAYS = """
relays AS (SELECT target_inbox AS inbox, CASE arg_max(status, (created_at, id)) WHEN 'sent' THEN 'accepted' WHEN 'failed' THEN 'rejected' ELSE 'pending' END AS state
           FROM delivery_log WHERE target_inbox LIKE 'https://relay%' GROUP BY 1)"""
_CONFIGURED = "configured AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in CONFIGURED_RELAYS) + "]) AS inbox)"
_FOLLOWS = """
follows AS (
  SELECT split_part(record_uri, '/', 3) AS did, 'https://' || split_part(target_inbox, '/', 3) || '/users/u' || (id % 7) AS follower,
         'https://' || split_part(target_inbox, '/', 3) || '/users/u' || (id % 7) || '/inbox' AS inbox,
         CASE WHEN id % 3 > 0 THEN target_inbox END AS shared_inbox, id AS seq, status = 'failed' AS undo
  FROM delivery_log WHERE record_uri LIKE 'at://did:%' AND target_inbox NOT LIKE 'https://relay%')"""
_INBOXES = "inboxes AS (SELECT did, coalesce(nullif(shared_inbox, ''), inbox) AS inbox, min(seq) AS first FROM follows GROUP BY ALL)"


# --- ingest -------------------------------------------------------------------


@query(f"WITH {_C} SELECT collection, operation, count(*) AS n FROM events_in GROUP BY ALL")
def ingest_counter(spark, folder):
    return events(spark, folder).groupBy("collection", "operation").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_C} SELECT collection, count(*) AS skipped FROM wanted WHERE did IN (SELECT did FROM outs) GROUP BY ALL")
def optout_skipped(spark, folder):
    rows = A.wanted(commit_rows(spark, folder))
    return rows.join(A.opted_out(table(spark, folder, "did_dim")), "did", "left_semi").groupBy("collection").agg(F.count(F.lit(1)).alias("skipped"))


@query(
    "SELECT kind, count(*) AS n, max(time_us) AS high_time, count(*) FILTER (time_us IS NULL) AS untimed FROM jetstream_sample GROUP BY kind"
)
def stream_kinds(spark, folder):
    rows = table(spark, folder, "jetstream_sample")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("time_us").alias("high_time"), F.count_if(F.col("time_us").isNull()).alias("untimed"))


@query(f"WITH {_A} SELECT at_uri, cid, op, created_seq, updated_seq, deleted FROM archive")
def latest_state(spark, folder):
    return archive(spark, folder, "cid").select("at_uri", "cid", "op", "created_seq", "updated_seq", "deleted")


@query(f"WITH {_C}, {_H} SELECT did, handle, first_seen, last_seen FROM actors")
def seen_bounds(spark, folder):
    return actors(spark, folder)


@query(
    f"""WITH {_P},
docs AS (SELECT *, json_extract_string(record, '$."$type"') AS t, json_extract_string(record, '$.creativeWorkType') AS cw, json_extract_string(record, '$.hiveId') AS hive,
  nullif(json_extract_string(record, '$.identifiers.tmdbTvSeriesId'), '') AS series, nullif(json_extract_string(record, '$.identifiers.seasonNumber'), '') AS season FROM events_in),
identified AS (SELECT DISTINCT seq FROM docs, json_each(record, '$.identifiers') e WHERE json_type(record, '$.identifiers') = 'OBJECT' AND e.type <> 'NULL'
  AND json_extract_string(e.value, '$') <> '' AND e.key NOT IN ('episodeNumber', 'seasonNumber', 'tmdbTvSeriesId')),
kinds AS (SELECT d.*, i.seq IS NOT NULL AS has_id, coalesce(t = 'buzz.bookhive.book', hive IS NOT NULL) AS is_book, base,
  coalesce(NOT coalesce(t = 'buzz.bookhive.book', hive IS NOT NULL) AND cw = 'tv_episode' AND t LIKE '%feed.listItem' AND series IS NOT NULL AND season IS NOT NULL, false) AS is_season
  FROM docs d LEFT JOIN identified i USING (seq) LEFT JOIN shelves ON lt = lower(coalesce(json_extract_string(record, '$.listType'), ''))),
works AS (SELECT *, CASE WHEN is_book THEN 'book' WHEN is_season THEN 'tv_season' ELSE coalesce(nullif(cw, ''), 'unknown') END AS kind,
  is_season OR has_id OR (is_book AND coalesce(hive <> '', false)) OR (coalesce(cw = 'tv_season', false) AND series IS NOT NULL AND season IS NOT NULL) AS named,
  collection = 'social.popfeed.feed.review' OR (collection = 'social.popfeed.feed.listItem' AND base IS NOT NULL) AS contributes FROM kinds)
SELECT CASE WHEN collection = 'social.popfeed.actor.profile' THEN 'profile' WHEN collection = 'social.popfeed.feed.list' THEN 'archive' WHEN operation = 'delete' THEN 'delete'
  WHEN kind = 'tv_episode' THEN 'episode' WHEN collection = 'social.popfeed.feed.listItem' AND NOT (named AND contributes) THEN 'membership'
  WHEN named AND contributes THEN 'paired' ELSE 'standalone' END AS route, operation, count(*) AS n FROM works GROUP BY ALL"""
)
def route_mix(spark, folder):
    rows = R.with_work(R.fields(events(spark, folder)))
    return rows.groupBy(A.route(rows).alias("route"), "operation").agg(F.count(F.lit(1)).alias("n"))


# --- reading ------------------------------------------------------------------


@query(
    f"""WITH {_P}, {_H}, {_RELAYS}, {_FOLLOWS}
SELECT (SELECT count(*) FROM actors WHERE did <> '{A.SERVICE_DID}') AS bridged_actors, count(*) AS records_total,
  count(*) FILTER (NOT deleted) AS records_active, count(*) FILTER (is_published AND NOT deleted) AS posts_published,
  (SELECT count(*) FROM relays WHERE state = 'accepted') AS relays_accepted, {len(CONFIGURED_RELAYS)} AS relays_configured,
  (SELECT count(*) FROM work_catalog) AS works, (SELECT count(*) FROM delivery_log) AS deliveries,
  (SELECT count(*) FROM (SELECT did FROM follows GROUP BY did, follower HAVING NOT arg_max(undo, seq))) AS follows,
  (SELECT count(DISTINCT cid) FROM commits WHERE collection = 'app.bsky.feed.like' AND operation <> 'delete') + (SELECT count(*) > 0 FROM commits WHERE collection = 'app.bsky.feed.like' AND operation <> 'delete' AND cid IS NULL)::INT AS likes FROM posts"""
)
def stats_totals(spark, folder):
    one = posts(spark, folder).agg(
        F.count(F.lit(1)).alias("records_total"),
        F.count_if(~F.col("deleted")).alias("records_active"),
        F.count_if(F.col("is_published") & ~F.col("deleted")).alias("posts_published"),
    )
    seen = events(spark, folder).where((F.col("collection") != R.PROFILE) & (F.col("did") != A.SERVICE_DID))
    people = seen.agg(F.count_distinct("did").alias("bridged_actors"))
    accepted = relays_stored(spark, folder).agg(F.count_if(F.col("state") == "accepted").alias("relays_accepted"))
    works = table(spark, folder, "work_catalog").agg(F.count(F.lit(1)).alias("works"))
    sent = log(spark, folder).agg(F.count(F.lit(1)).alias("deliveries"))
    following = followers(spark, folder).agg(F.count(F.lit(1)).alias("follows"))
    liked = O.likes(like_events(spark, folder)).agg(F.count(F.lit(1)).alias("likes"))
    # each side is one row, joined on a constant key
    out = one.withColumn("k", F.lit(1))
    for other in (people, accepted, works, sent, following, liked):
        out = out.join(other.withColumn("k", F.lit(1)), "k")
    return out.drop("k").withColumn("relays_configured", F.lit(len(CONFIGURED_RELAYS)))


@query(f"WITH {_A} SELECT collection, count(*) AS n, count(*) FILTER (deleted) AS tombstones FROM archive GROUP BY collection")
def records_by_collection(spark, folder):
    return slim(spark, folder).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.count_if("deleted").alias("tombstones"))


@query("SELECT status, count(*) AS n FROM delivery_log GROUP BY status")
def deliveries_by_status(spark, folder):
    return log(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P} SELECT did, count(*) FILTER (NOT deleted) AS active, count(*) FILTER (is_published AND NOT deleted) AS published, count(*) FILTER (is_published AND deleted) AS retracted FROM posts GROUP BY did")
def author_counts(spark, folder):
    return posts(spark, folder).groupBy("did").agg(
        F.count_if(~F.col("deleted")).alias("active"),
        F.count_if(F.col("is_published") & ~F.col("deleted")).alias("published"),
        F.count_if(F.col("is_published") & F.col("deleted")).alias("retracted"),
    )


@query(
    f"""WITH {_A}, {_H}
SELECT at_uri, coalesce(handle, a.did) AS handle, split_part(collection, '.', -1) AS short_name, updated_at FROM archive a LEFT JOIN actors USING (did)
WHERE lower(collection) LIKE '%kitchen%' OR lower(rkey) LIKE '%kitchen%' OR lower(record) LIKE '%kitchen%'
ORDER BY updated_at DESC, at_uri LIMIT 100"""
)
def archive_search(spark, folder):
    hits = A.search(archive(spark, folder), "kitchen")
    return A.with_handle(hits, actors(spark, folder)).select("at_uri", "handle", T.last_segment(F.col("collection"), ".").alias("short_name"), "updated_at")


@query(
    f"""WITH {_A} SELECT did, at_uri, place FROM (SELECT did, at_uri, row_number() OVER (PARTITION BY did ORDER BY updated_at DESC, at_uri) AS place
FROM archive WHERE NOT deleted) WHERE place <= 200"""
)
def account_recent(spark, folder):
    return A.newest_of_author(slim(spark, folder)).select("did", "at_uri", F.col("place").cast("bigint").alias("place"))


@query(
    f"""WITH {_P}, {_H} SELECT handle, rkey, '{BASE}/users/' || handle || '/posts/' || rkey AS url, created_at
FROM posts JOIN actors USING (did) WHERE is_published AND NOT deleted"""
)
def outbox(spark, folder):
    rows = posts(spark, folder).where(F.col("is_published") & ~F.col("deleted")).join(actors(spark, folder), "did")
    # written first, as a range sort reads its input twice
    rows = stage_table(rows.select("did", "handle", "rkey", "at_uri", "created_at"), "outbox")
    url = F.concat(F.lit(f"{BASE}/users/"), "handle", F.lit("/posts/"), "rkey")
    # a range sort over all outboxes: an author with very many posts is cut like any other range
    return rows.orderBy("did", F.col("created_at").desc(), "at_uri").select("handle", "rkey", url.alias("url"), "created_at")


@query(
    f"""WITH {_P} SELECT did, rkey, arg_min(CASE WHEN NOT is_published THEN 'absent' WHEN deleted THEN 'tombstone' ELSE 'note' END, at_uri) AS shown
FROM posts GROUP BY did, rkey"""
)
def post_lookup_state(spark, folder):
    rows = posts(spark, folder)
    shown = A.post_state(F.lit(True), F.col("is_published"), F.col("deleted"))
    return rows.groupBy("did", "rkey").agg(F.min_by(shown, "at_uri").alias("shown"))


@query(
    f"""WITH {_A} SELECT i.at_uri, nullif(trim(coalesce(nullif(json_extract_string(l.record, '$.name'), ''), json_extract_string(l.record, '$.description'))), '') AS label
FROM archive i LEFT JOIN archive l ON l.at_uri = json_extract_string(i.record, '$.listUri') AND l.collection = 'social.popfeed.feed.list'
WHERE i.collection = 'social.popfeed.feed.listItem'"""
)
def list_label_join(spark, folder):
    doc = F.from_json("record", "struct<listUri string, name string, description string>")
    kept = events(spark, folder).where(F.col("collection").isin(R.LIST, R.LIST_ITEM)).withColumn("doc", doc)
    named = kept.withColumn("list_uri", F.when(F.col("collection") == R.LIST_ITEM, F.col("doc.listUri")))
    named = named.withColumn("label", F.when(F.col("collection") == R.LIST, R.list_label(F.col("doc.name"), F.col("doc.description"))))
    rows = stage_table(A.state(named, ("list_uri", "label")).select("at_uri", "collection", "list_uri", "label"), "listed")
    items = rows.where(F.col("collection") == R.LIST_ITEM).drop("label")
    return A.with_list_label(items, rows.where(F.col("collection") == R.LIST), F.col("list_uri")).select("at_uri", "label")


@query(
    f"""WITH {_P}, {_H}, {_RELAYS} SELECT (SELECT count(*) FROM actors) AS users_total, count(*) FILTER (NOT deleted) AS local_posts,
(SELECT count(*) FROM relays WHERE state = 'accepted') AS relays, (SELECT count(*) FROM work_catalog) AS works FROM posts"""
)
def node_info(spark, folder):
    # the columns that are not asked for cost nothing: their sides of the join are pruned to one row each
    names = {"users_total": "bridged_actors", "local_posts": "records_active", "relays": "relays_accepted", "works": "works"}
    return stats_totals(spark, folder).select(*(F.col(c).alias(n) for n, c in names.items()))


@query(f"WITH {_A} SELECT date_trunc('day', updated_at) AS day, collection, count(*) AS n FROM archive WHERE NOT deleted GROUP BY ALL")
def activity_by_day(spark, folder):
    return slim(spark, folder).where(~F.col("deleted")).groupBy(F.date_trunc("day", "updated_at").cast("timestamp_ntz").alias("day"), "collection").agg(F.count(F.lit(1)).alias("n"))


# --- pairs --------------------------------------------------------------------

_PREFERRED = ", ".join(f"'{n}'" for n in R.PREFERRED_IDS)


def works_sql(source: str) -> str:
    """``works``: the rows of a table of events with the work each is about, its identifiers and the names of these."""
    return f"""
parsed AS (SELECT seq, did, collection, rkey, operation, record, json_extract_string(record, '$."$type"') AS t, json_extract_string(record, '$.hiveId') AS hive, json_extract_string(record, '$.creativeWorkType') AS cw,
  json_extract_string(record, '$.title') AS title, json_extract_string(record, '$.posterUrl') AS poster_url FROM {source}),
entries AS (SELECT seq, list({{'k': e.key, 'v': json_extract_string(e.value, '$')}} ORDER BY e.id) AS raw FROM parsed, json_each(record, '$.identifiers') e
  WHERE json_type(record, '$.identifiers') = 'OBJECT' AND e.type <> 'NULL' AND json_extract_string(e.value, '$') <> '' GROUP BY seq),
typed AS (SELECT p.*, coalesce(raw, []) AS raw, coalesce(t = 'buzz.bookhive.book', hive IS NOT NULL) AS is_book FROM parsed p LEFT JOIN entries USING (seq)),
named AS (SELECT *, list_filter(raw, lambda e: e.k = 'tmdbTvSeriesId')[1].v AS series, list_filter(raw, lambda e: e.k = 'seasonNumber')[1].v AS season FROM typed),
kinds AS (SELECT *, coalesce(NOT is_book AND cw = 'tv_episode' AND t LIKE '%feed.listItem' AND series IS NOT NULL AND season IS NOT NULL, false) AS of_season FROM named),
shaped AS (SELECT *, CASE WHEN is_book THEN 'book' WHEN of_season THEN 'tv_season' ELSE coalesce(nullif(cw, ''), 'unknown') END AS work_type,
  CASE WHEN is_book AND hive <> '' AND len(list_filter(raw, lambda e: e.k = 'hiveId')) = 0 THEN list_append(raw, {{'k': 'hiveId', 'v': hive}})
       WHEN of_season THEN list_filter(raw, lambda e: e.k IN ('tmdbTvSeriesId', 'seasonNumber')) ELSE raw END AS ids FROM kinds),
picks AS (SELECT *, list_filter(ids, lambda e: e.k NOT IN ('episodeNumber', 'seasonNumber', 'tmdbTvSeriesId')) AS own,
  CASE WHEN work_type = 'tv_season' AND series IS NOT NULL AND season IS NOT NULL THEN [{{'k': 'tmdbId', 'v': series || '-season-' || season}}] ELSE [] END AS compound FROM shaped),
keyed AS (SELECT *, coalesce(list_filter(list_transform([{_PREFERRED}],
    lambda n: list_filter(ids, lambda e: e.k = n)[1]), lambda x: x IS NOT NULL)[1], own[1], compound[1]) AS pick, list_concat(own, list_filter(compound, lambda c: NOT list_contains(own, c))) AS all_ids FROM picks),
works AS (SELECT *, work_type || ':' || pick.k || '-' || pick.v AS work_key, list_transform(all_ids, lambda e: to_json([work_type, e.k, e.v])::VARCHAR) AS aliases FROM keyed)"""


# the ordered fold over all first occurrences, one a turn; # and the turn name the key that an occurrence joined
MINT_SQL = """
firsts AS (SELECT work_key, aliases, min(seq) AS seq FROM works WHERE work_key IS NOT NULL GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (ORDER BY seq) AS turn FROM firsts),
owner(alias, key, turn) USING KEY (alias) AS (
  SELECT '' AS alias, '' AS key, 0::BIGINT AS turn
  UNION
  SELECT n.alias, n.key, n.turn FROM (
    WITH now AS (SELECT t.* FROM turns t JOIN (SELECT turn FROM recurring.owner WHERE alias = '') c ON t.turn = c.turn + 1),
    held AS (SELECT a.alias, a.place, o.key FROM (SELECT unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS place FROM now) a LEFT JOIN recurring.owner o ON o.alias = a.alias),
    joined AS (SELECT coalesce((SELECT arg_min(key, place) FROM held WHERE key IS NOT NULL), work_key) AS key, turn FROM now)
    SELECT alias, joined.key, joined.turn FROM held, joined WHERE held.key IS NULL
    UNION ALL SELECT '', '', turn FROM joined
    UNION ALL SELECT '#' || turn, key, turn FROM joined) n
),
minted AS (SELECT w.seq, o.key AS minted_key FROM works w JOIN turns t ON t.work_key = w.work_key AND t.aliases = w.aliases JOIN owner o ON o.alias = '#' || t.turn)"""
_PAIRS = (
    _P
    + f""",
kept AS (SELECT * FROM events_in WHERE operation <> 'delete' AND collection IN ('social.popfeed.feed.review', 'social.popfeed.feed.listItem')),
{works_sql("kept")},
{MINT_SQL},
paired AS (SELECT p.*, m.minted_key AS work FROM posts p JOIN minted m ON m.seq = p.updated_seq
           WHERE NOT deleted AND collection IN ('social.popfeed.feed.review', 'social.popfeed.feed.listItem'))"""
)


def paired(spark, folder):
    """All active reviews and list items that name a work, with the key of the work they joined."""
    kept = events(spark, folder).where(F.col("collection").isin(R.REVIEW, R.LIST_ITEM))
    minted = W.mint(R.with_work(R.fields(kept.where(F.col("operation") != "delete"))))
    live = A.state(with_shelf(kept), ("shelf",)).where(~F.col("deleted"))
    live = live.withColumn("is_published", (F.col("collection") == R.REVIEW) | F.col("shelf").isNotNull())
    # the last event of an active record is the one that its content is from
    return live.join(minted.select(F.col("seq").alias("updated_seq"), F.col("minted_key").alias("work")), "updated_seq")


@query(
    f"""WITH RECURSIVE {_PAIRS} SELECT did, work, arg_max(at_uri, (created_at, created_seq)) FILTER (collection LIKE '%review') AS review,
arg_max(at_uri, (created_at, created_seq)) FILTER (shelf IS NOT NULL) AS item, arg_max(shelf, (created_at, created_seq)) FILTER (shelf IS NOT NULL) AS shelf
FROM paired GROUP BY did, work"""
)
def pair_latest(spark, folder):
    """Newest review and newest list item with a shelf of each author and work."""
    at = F.struct("created_at", "created_seq", "at_uri", "shelf")
    newest = lambda condition: F.max(F.when(condition, at))
    found = paired(spark, folder).groupBy("did", "work").agg(
        newest(F.col("collection") == R.REVIEW).alias("review"), newest(F.col("shelf").isNotNull()).alias("item")
    )
    return found.select("did", "work", F.col("review.at_uri").alias("review"), F.col("item.at_uri").alias("item"), F.col("item.shelf").alias("shelf"))


@query(
    f"""WITH RECURSIVE {_PAIRS} SELECT did, work, arg_max(at_uri, (created_at, created_seq)) AS anchor, count(*) AS holders
FROM paired WHERE is_published GROUP BY did, work"""
)
def pair_holder(spark, folder):
    """The newest published record of each author and work, and how many there are."""
    rows = paired(spark, folder).where("is_published")
    return rows.groupBy("did", "work").agg(F.max_by("at_uri", F.struct("created_at", "created_seq")).alias("anchor"), F.count(F.lit(1)).alias("holders"))


@query(
    f"""WITH RECURSIVE {_PAIRS} SELECT at_uri FROM paired p WHERE is_published AND EXISTS (SELECT 1 FROM paired q WHERE q.did = p.did AND q.work = p.work
AND q.is_published AND q.at_uri <> p.at_uri)"""
)
def other_holder(spark, folder):
    """Published records beside which the author has another one of the same work."""
    rows = stage_table(paired(spark, folder).where("is_published").select("did", "work", "at_uri"), "holders")
    count = rows.groupBy("did", "work").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    return rows.join(count, ["did", "work"], "left_semi").select("at_uri")


# --- delivery -----------------------------------------------------------------


@query(f"WITH {_FOLLOWS}, {_INBOXES} SELECT did, inbox, first FROM inboxes")
def inbox_dedup(spark, folder):
    return O.distinct_inboxes(follows(spark, folder))


@query(
    f"""WITH {_C}, {_RELAYS}, {_CONFIGURED}, {_FOLLOWS}, {_INBOXES},
acts AS (SELECT DISTINCT 'at://' || did || '/' || collection || '/' || rkey AS activity, did FROM events_in WHERE collection = 'social.popfeed.feed.review' AND operation <> 'delete')
SELECT activity, 'relay' AS path, inbox FROM acts, relays WHERE state = 'accepted' AND inbox IN (SELECT inbox FROM configured)
UNION ALL SELECT activity, 'direct', inbox FROM acts JOIN inboxes USING (did)"""
)
def fanout_plan(spark, folder):
    rows = events(spark, folder).where((F.col("collection") == R.REVIEW) & (F.col("operation") != "delete"))
    acts = rows.select(A.at_uri().alias("activity"), "did").distinct()
    targets = relays_stored(spark, folder).where((F.col("state") == "accepted") & F.col("inbox").isin(*CONFIGURED_RELAYS))
    return O.plan(acts, targets, O.distinct_inboxes(follows(spark, folder))).drop("did")


@query(
    """SELECT record_uri, target_inbox, arg_min(activity_type, (created_at, id)) AS activity_type, arg_max(status, (created_at, id)) AS status,
arg_max(attempts, (created_at, id)) AS attempts, count(*) AS entries FROM delivery_log GROUP BY record_uri, target_inbox"""
)
def delivery_latest(spark, folder):
    return O.delivery_log(log(spark, folder)).select("record_uri", "target_inbox", "activity_type", "status", "attempts", "entries")


@query(
    """SELECT id, attempt, CASE WHEN attempt < 4 THEN [2, 4, 8, 16][attempt] END AS delay
FROM (SELECT id, coalesce(attempts, 0) AS made, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS attempt FROM delivery_log WHERE status <> 'sent') WHERE attempt > made"""
)
def retry_schedule(spark, folder):
    return O.retry_schedule(log(spark, folder).where(F.col("status") != "sent"))


@query(
    f"""WITH {_RELAYS}, {_CONFIGURED} SELECT inbox, action, CASE action WHEN 'follow' THEN 'pending' WHEN 'undo' THEN 'unsubscribed' ELSE state END AS new_state FROM (
SELECT coalesce(c.inbox, r.inbox) AS inbox, state, CASE WHEN c.inbox IS NOT NULL AND (state IS NULL OR state IN ('pending', 'rejected', 'unsubscribed')) THEN 'follow'
WHEN c.inbox IS NULL AND state IN ('pending', 'accepted') THEN 'undo' ELSE 'keep' END AS action FROM configured c FULL JOIN relays r ON r.inbox = c.inbox)"""
)
def relay_reconcile(spark, folder):
    return O.reconcile(spark.createDataFrame([(x,) for x in CONFIGURED_RELAYS], "inbox string"), relays_stored(spark, folder))


@query(f"WITH {_RELAYS}, {_CONFIGURED} SELECT inbox FROM relays WHERE state = 'accepted' INTERSECT SELECT inbox FROM configured")
def relay_intersection(spark, folder):
    stored = relays_stored(spark, folder).where(F.col("state") == "accepted").select("inbox")
    return stored.intersect(spark.createDataFrame([(x,) for x in CONFIGURED_RELAYS], "inbox string"))


def followers(spark, folder):
    return O.follow_state(follows(spark, folder).withColumnRenamed("did", "local_did"))


@query(
    f"""WITH {_FOLLOWS} SELECT did AS local_did, follower, arg_max(inbox, seq) AS inbox FROM follows GROUP BY did, follower HAVING NOT arg_max(undo, seq)"""
)
def follow_state(spark, folder):
    return followers(spark, folder).select("local_did", "follower", "inbox")


_LIKES = (
    _C
    + """,
liked AS (SELECT cid AS activity_id, did AS actor, json_extract_string(record, '$.subject.uri') AS object, seq FROM commits
          WHERE collection = 'app.bsky.feed.like' AND operation <> 'delete'),
kept AS (SELECT activity_id, arg_min(actor, (seq, actor)) AS actor, arg_min(object, (seq, actor)) AS object FROM liked GROUP BY activity_id)"""
)


def like_events(spark, folder):
    rows = commit_rows(spark, folder).where((F.col("collection") == "app.bsky.feed.like") & (F.col("operation") != "delete"))
    return rows.select(F.col("cid").alias("activity_id"), F.col("did").alias("actor"), F.get_json_object("record", "$.subject.uri").alias("object"), "seq")


@query(f"WITH {_LIKES} SELECT object, count(*) AS likes, count(DISTINCT actor) AS people FROM kept GROUP BY object")
def like_totals(spark, folder):
    return O.likes(like_events(spark, folder)).groupBy("object").agg(F.count(F.lit(1)).alias("likes"), F.count_distinct("actor").alias("people"))


@query(
    f"""WITH {_LIKES}, gone AS (SELECT DISTINCT c.cid AS activity_id, c.did AS actor FROM commits c JOIN commits d ON d.did = c.did AND d.rkey = c.rkey AND d.collection = c.collection
AND d.operation = 'delete' WHERE c.collection = 'app.bsky.feed.like' AND c.operation <> 'delete')
SELECT activity_id, actor FROM kept k WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.activity_id = k.activity_id AND g.actor = k.actor)"""
)
def undo_likes(spark, folder):
    rows = commit_rows(spark, folder).where(F.col("collection") == "app.bsky.feed.like")
    deletes = rows.where(F.col("operation") == "delete").select("did", "rkey").distinct()
    gone = rows.where(F.col("operation") != "delete").join(deletes, ["did", "rkey"]).select(F.col("cid").alias("activity_id"), F.col("did").alias("actor"))
    return O.undo_likes(O.likes(like_events(spark, folder)), gone).select("activity_id", "actor")


# --- backfill -----------------------------------------------------------------

_TID = "(SELECT sum((instr('234567abcdefghijklmnopqrstuvwxyz', rkey[i]) - 1)::HUGEINT * (1::HUGEINT << (5 * (13 - i)))) FROM range(1, 14) r(i))"


@query(
    f"""WITH {_A} SELECT at_uri, CASE WHEN regexp_full_match(rkey, '[234567abcdefghij][234567abcdefghijklmnopqrstuvwxyz]{{12}}')
THEN CAST({_TID} // 1024 AS BIGINT) END AS micros FROM archive"""
)
def tid_micros(spark, folder):
    return slim(spark, folder).select("at_uri", M.tid_micros(F.col("rkey")).alias("micros"))


_AGES = (
    _A
    + f""",
aged AS (SELECT *, CASE WHEN regexp_full_match(rkey, '[234567abcdefghij][234567abcdefghijklmnopqrstuvwxyz]{{12}}') THEN make_timestamp(CAST({_TID} // 1024 AS BIGINT))
  ELSE try_cast(coalesce(nullif(json_extract_string(record, '$.createdAt'), ''), json_extract_string(record, '$.addedAt')) AS TIMESTAMP) END AS written FROM archive)"""
)


def aged(spark, folder):
    doc = F.from_json("record", "struct<createdAt string, addedAt string>")
    rows = A.state(events(spark, folder).withColumn("stated", doc), ("stated",))
    return rows.withColumn("written", M.record_time(F.col("rkey"), F.col("stated.createdAt"), F.col("stated.addedAt")))


@query(
    f"""WITH {_AGES} SELECT collection, count(*) FILTER (written >= TIMESTAMP '{NOW}' - INTERVAL {WINDOW_DAYS} DAY) AS kept,
count(*) FILTER (written < TIMESTAMP '{NOW}' - INTERVAL {WINDOW_DAYS} DAY) AS old, count(*) FILTER (written IS NULL) AS unknown_age FROM aged GROUP BY collection"""
)
def age_window(spark, folder):
    rows, now = aged(spark, folder), F.to_timestamp(F.lit(NOW))
    recent = M.in_window(F.col("written"), now, WINDOW_DAYS)
    return rows.groupBy("collection").agg(
        F.count_if(recent).alias("kept"), F.count_if(~recent & F.col("written").isNotNull()).alias("old"), F.count_if(F.col("written").isNull()).alias("unknown_age")
    )


_PRIORITY_SQL = "CASE collection WHEN 'social.popfeed.feed.review' THEN 1 WHEN 'buzz.bookhive.book' THEN 2 WHEN 'social.popfeed.feed.listItem' THEN 3 WHEN 'social.popfeed.feed.list' THEN 4 ELSE 5 END"
_BUDGET = (
    _AGES
    + f""",
budget AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY did ORDER BY {_PRIORITY_SQL}, rkey DESC, at_uri) AS place FROM aged
  WHERE NOT deleted AND collection <> 'social.popfeed.actor.profile' AND written >= TIMESTAMP '{NOW}' - INTERVAL {WINDOW_DAYS} DAY) WHERE place <= {BUDGET})"""
)


def imported(spark, folder):
    rows = aged(spark, folder).where(~F.col("deleted") & (F.col("collection") != R.PROFILE) & M.in_window(F.col("written"), F.to_timestamp(F.lit(NOW)), WINDOW_DAYS))
    return B.within_budget(rows, BUDGET)


@query(f"WITH {_BUDGET} SELECT did, at_uri, place, CAST(ceil(place / 100) AS BIGINT) AS page FROM budget")
def backfill_budget(spark, folder):
    return imported(spark, folder).select("did", "at_uri", F.col("place").cast("bigint").alias("place"), B.page_of(F.col("place")).alias("page"))


@query(
    f"""WITH {_BUDGET} SELECT did, at_uri, row_number() OVER (PARTITION BY did ORDER BY (collection <> 'social.popfeed.feed.list')::INT, written, at_uri) AS turn FROM budget"""
)
def replay_order(spark, folder):
    rows = B.replay_order(imported(spark, folder), F.col("written"), F.col("collection") == R.LIST)
    return rows.select("did", "at_uri", F.col("turn").cast("bigint").alias("turn"))


# --- accounts -----------------------------------------------------------------

_CONTROLS = """controls AS (SELECT did, seq, CASE WHEN seq % 3 = 0 THEN 'opt_in' ELSE 'opt_out' END AS control FROM jetstream_sample WHERE kind = 'identity')"""


def controls(spark, folder):
    """Identity events as control events: every third one opts in, the others opt out."""
    rows = table(spark, folder, "jetstream_sample").where(F.col("kind") == "identity")
    return rows.select("did", "seq", F.when(F.col("seq") % 3 == 0, U.OPT_IN).otherwise(U.OPT_OUT).alias("control"))


@query(
    f"""WITH {_C}, {_CONTROLS} SELECT collection, count(*) AS n FROM wanted w
WHERE coalesce((SELECT arg_max(control, c.seq) FROM controls c WHERE c.did = w.did AND c.seq < w.seq), 'opt_in') <> 'opt_out' GROUP BY collection"""
)
def accepted_events(spark, folder):
    return U.accepted(A.wanted(commit_rows(spark, folder)), controls(spark, folder)).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_A}, {_CONTROLS} SELECT at_uri FROM archive a WHERE NOT deleted
AND EXISTS (SELECT 1 FROM controls c WHERE c.did = a.did AND c.seq > a.updated_seq AND c.control = 'opt_out')"""
)
def optout_purge(spark, folder):
    return U.purged(slim(spark, folder), controls(spark, folder)).where("purged").select("at_uri")


@query(
    f"""WITH {_C}, p AS (SELECT did, seq, nullif(coalesce(nullif(json_extract_string(record, '$.displayName'), ''), json_extract_string(record, '$.name')), '') AS name,
  coalesce(nullif(json_extract_string(record, '$.avatar.ref."$link"'), ''), nullif(json_extract_string(record, '$.avatar.cid'), '')) AS avatar
  FROM events_in WHERE collection = 'social.popfeed.actor.profile' AND operation <> 'delete')
SELECT did, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(avatar, seq) FILTER (avatar IS NOT NULL) AS avatar FROM p GROUP BY did"""
)
def profile_state(spark, folder):
    rows = R.fields(events(spark, folder).where((F.col("collection") == R.PROFILE) & (F.col("operation") != "delete")))
    name = F.coalesce(F.nullif(F.col("doc.displayName"), F.lit("")), F.col("doc.name"))
    return U.profile_state(rows, name, R.avatar_cid(F.col("doc.avatar")))


@query(
    f"""WITH {_A} SELECT collection, op, deleted, count(*) AS n, sum(length(rkey)) AS key_chars FROM archive GROUP BY CUBE (collection, op, deleted)"""
)
def archive_cube(spark, folder):
    return slim(spark, folder).cube("collection", "op", "deleted").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("rkey")).alias("key_chars"))


@query(
    "SELECT target_inbox, status, count(*) AS n, round(avg(attempts), 4) AS mean_attempts, min(created_at) AS first, max(last_attempt) AS last, count(DISTINCT record_uri) AS records FROM delivery_log GROUP BY ALL"
)
def delivery_summary(spark, folder):
    return log(spark, folder).groupBy("target_inbox", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("attempts"), 4).alias("mean_attempts"),
        F.min("created_at").alias("first"),
        F.max("last_attempt").alias("last"),
        F.count_distinct("record_uri").alias("records"),
    )


@query(
    f"""WITH RECURSIVE {_C}, source AS (SELECT * FROM events_in WHERE operation <> 'delete' AND collection IN ('social.popfeed.feed.review', 'social.popfeed.feed.listItem', 'buzz.bookhive.book')),
{works_sql("source")},
{MINT_SQL},
each AS (SELECT minted_key, e.k AS k, arg_max(e.v, seq) AS v FROM (SELECT seq, unnest(ids) AS e FROM works) JOIN minted USING (seq) GROUP BY ALL)
SELECT minted_key AS work_key, '{{' || string_agg(to_json(k) || ':' || to_json(v), ',' ORDER BY k) || '}}' AS ids FROM each GROUP BY 1"""
)
def work_identifiers(spark, folder):
    """Merged identifiers of each work; rests on the ordered fold."""
    rows = R.with_work(R.fields(events(spark, folder).where((F.col("operation") != "delete") & F.col("collection").isin(R.REVIEW, R.LIST_ITEM, R.BOOK))))
    return U.merged_identifiers(rows, W.mint(rows)).select("work_key", F.to_json("ids").alias("ids"))
