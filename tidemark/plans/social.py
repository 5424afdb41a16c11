"""Queries of inbound activities, relays and fan-out, and their SQL.

Lens, the same on both sides: the delivery log read as a log of what arrived.
Each row is an activity of a kind drawn from its id, about the author and the
record it names; authors are all accounts with wanted records, those without a
service opted out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.functions import text as T
from tidemark.operators import archive as A
from tidemark.operators import fanout as O
from tidemark.operators import inbound as I
from tidemark.plans.problems import commit_rows, table
from tidemark.plans.reference import _C, _CONFIGURED, _FOLLOWS, _INBOXES, _P, _RELAYS, BASE, CONFIGURED_RELAYS, events, follows, log, posts, relays_stored

SERVICE = f"{BASE}/actor"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def authors(spark, folder):
    """(did, handle, opted_out) of every account with wanted records."""
    dim = table(spark, folder, "did_dim")
    known = A.actors(A.wanted(commit_rows(spark, folder)), dim).select("did", "handle")
    out = A.opted_out(dim).withColumn("opted_out", F.lit(True))
    return known.join(out, "did", "left").withColumn("opted_out", F.coalesce("opted_out", F.lit(False)))


def inbound(spark, folder):
    """The delivery log as activities that arrived."""
    k, turn = F.col("id") % 7, F.floor(F.col("id") / 7)
    did = F.get(F.split("record_uri", "/"), F.lit(2))
    rows = log(spark, folder).select("id", did.alias("did"), T.last_segment(F.col("record_uri"), "/").alias("rkey"))
    rows = rows.join(authors(spark, folder).select("did", F.col("handle").alias("_h")), "did", "left").withColumn("handle", F.coalesce("_h", F.lit("nobody.example")))
    number = lambda c: c.cast("string")
    user = F.concat(F.lit(f"{BASE}/users/"), "handle")
    post = F.concat(F.lit(f"{BASE}/users/"), F.when(F.col("id") % 4 == 0, F.col("did")).otherwise(F.col("handle")), F.lit("/posts/"), "rkey")
    undo = F.col("id") % 3
    is_undo = k == 3
    like = F.concat(F.lit("like-"), number(F.col("id") - 1))
    return rows.select(
        F.col("id").alias("seq"),
        F.when(k.isin(0, 5), "Follow").when(k == 1, "Accept").when(k == 2, "Like").when(is_undo, "Undo").when(k == 4, "Reject").otherwise("Announce").alias("type"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("https://peer"), number(turn % 5), F.lit(".example/users/u"), number(turn % 3))).alias("actor"),
        F.when(F.col("id") % 2 == 0, F.col("handle")).when(F.col("id") % 5 == 0, "nobody.example").alias("inbox_user"),
        F.when(is_undo & (undo == 0), "Follow").when(is_undo & (undo == 1), "Like").alias("object_type"),
        F.when(is_undo, like).when(k == 2, post).otherwise(user).alias("object_id"),
        (~is_undo | (undo == 2)).alias("object_is_text"),
        F.when(is_undo & (undo == 0), user).alias("inner_object"),
        (F.col("id") % 13 > 0).alias("reachable"),
    )


_IN = (
    _P
    + f""",
seen AS (SELECT DISTINCT did FROM wanted WHERE collection <> 'social.popfeed.actor.profile'),
names AS (SELECT did, min(list_filter(also_known_as, lambda a: starts_with(a, 'at://'))[1]) AS alias FROM did_dim GROUP BY did),
authors AS (SELECT s.did, coalesce(nullif(substr(alias, 6), ''), split_part(s.did, ':', -1) || '.did') AS handle, s.did IN (SELECT did FROM outs) AS opted_out
            FROM seen s LEFT JOIN names n ON n.did = s.did),
handles AS (SELECT handle, min(did) AS did, arg_min(opted_out, did) AS opted_out FROM authors GROUP BY handle),
arrived AS (SELECT id, id % 7 AS k, id // 7 AS turn, id % 3 AS undo, split_part(record_uri, '/', 3) AS did, split_part(record_uri, '/', -1) AS rkey, coalesce(a.handle, 'nobody.example') AS handle
            FROM delivery_log l LEFT JOIN authors a ON a.did = split_part(record_uri, '/', 3)),
inbound AS (SELECT id AS seq, CASE WHEN k IN (0, 5) THEN 'Follow' WHEN k = 1 THEN 'Accept' WHEN k = 2 THEN 'Like' WHEN k = 3 THEN 'Undo' WHEN k = 4 THEN 'Reject' ELSE 'Announce' END AS type,
  CASE WHEN id % 11 > 0 THEN 'https://peer' || (turn % 5) || '.example/users/u' || (turn % 3) END AS actor,
  CASE WHEN id % 2 = 0 THEN handle WHEN id % 5 = 0 THEN 'nobody.example' END AS inbox_user, CASE WHEN k = 3 AND undo = 0 THEN 'Follow' WHEN k = 3 AND undo = 1 THEN 'Like' END AS object_type,
  CASE WHEN k = 3 THEN 'like-' || (id - 1) WHEN k = 2 THEN '{BASE}/users/' || CASE WHEN id % 4 = 0 THEN did ELSE handle END || '/posts/' || rkey ELSE '{BASE}/users/' || handle END AS object_id,
  k <> 3 OR undo = 2 AS object_is_text, CASE WHEN k = 3 AND undo = 0 THEN '{BASE}/users/' || handle END AS inner_object, id % 13 > 0 AS reachable FROM arrived),
looked_up AS (SELECT i.*, own.did AS own, meant.did AS meant, coalesce(meant.opted_out, false) AS meant_out FROM inbound i LEFT JOIN handles own ON own.handle = inbox_user
  LEFT JOIN handles meant ON meant.handle = split_part(substr(coalesce(inner_object, object_id), length('{BASE}/users/') + 1), '/', 1)
    AND starts_with(coalesce(inner_object, object_id), '{BASE}/users/')),
answers AS (SELECT seq, actor, object_id,
  CASE WHEN type IN ('Accept', 'Reject') THEN 'answer' WHEN type = 'Announce' THEN 'ignored' WHEN type = 'Follow' THEN 'follow' WHEN type = 'Like' THEN 'like'
    WHEN object_type = 'Follow' OR (own IS NOT NULL AND object_is_text) THEN 'undo_follow' WHEN object_type = 'Like' OR object_is_text THEN 'undo_like' ELSE 'ignored' END AS route,
  CASE WHEN type IN ('Follow', 'Undo', 'Like') AND actor IS NULL THEN 400 WHEN type = 'Follow' AND reachable AND inbox_user IS NOT NULL AND own IS NULL THEN 404 ELSE 202 END AS status,
  CASE WHEN type = 'Follow' AND actor IS NOT NULL AND reachable THEN CASE WHEN inbox_user IS NOT NULL THEN CASE WHEN own IS NOT NULL THEN 'Accept' END
    WHEN meant IS NOT NULL AND NOT meant_out THEN 'Accept' ELSE 'Reject' END END AS response,
  CASE WHEN type = 'Follow' THEN CASE WHEN actor IS NOT NULL AND reachable THEN CASE WHEN inbox_user IS NOT NULL THEN own WHEN NOT meant_out THEN meant END END
    WHEN type = 'Undo' AND (object_type = 'Follow' OR (own IS NOT NULL AND object_is_text)) THEN CASE WHEN inbox_user IS NOT NULL THEN own WHEN NOT object_is_text THEN meant END END AS local_did FROM looked_up),
addressed AS (SELECT 'like-' || seq AS activity_id, actor, seq, object_id, split_part(substr(object_id, length('{BASE}/users/') + 1), '/posts/', 1) AS ident,
  split_part(object_id, '/posts/', 2) AS rkey FROM answers WHERE route = 'like' AND status = 202),
live_posts AS (SELECT did, rkey, min(at_uri) AS at_uri FROM posts WHERE is_published AND NOT deleted GROUP BY ALL),
liked AS (SELECT activity_id, actor, seq, p.at_uri, '{BASE}/users/' || a.handle || '/posts/' || l.rkey AS canonical FROM addressed l LEFT JOIN handles h ON h.handle = l.ident
  JOIN live_posts p ON p.did = CASE WHEN l.ident LIKE 'did:%' THEN l.ident ELSE h.did END AND p.rkey = l.rkey JOIN authors a ON a.did = p.did)"""
)


def answered(spark, folder):
    return I.answers(inbound(spark, folder), authors(spark, folder), BASE)


@query(f"WITH {_IN} SELECT seq, route, status, response, local_did FROM answers")
def inbound_answers(spark, folder):
    return answered(spark, folder).select("seq", "route", "status", "response", "local_did")


@query(
    f"""WITH {_IN} SELECT local_did AS did, actor AS follower FROM answers WHERE actor IS NOT NULL AND local_did IS NOT NULL AND (response = 'Accept' OR route = 'undo_follow')
GROUP BY ALL HAVING arg_max(route, seq) = 'follow'"""
)
def inbound_follows(spark, folder):
    return I.follows_after(answered(spark, folder))


def likes_of_posts(spark, folder):
    """Likes of live posts: (activity_id, actor, seq, at_uri, canonical)."""
    likes = answered(spark, folder).where((F.col("route") == "like") & (F.col("status") == 202))
    likes = likes.select(F.concat(F.lit("like-"), F.col("seq").cast("string")).alias("activity_id"), "actor", "seq", F.col("like_id").alias("object_id"))
    live = posts(spark, folder).where(F.col("is_published") & ~F.col("deleted")).select("did", "rkey", "at_uri")
    return I.live_posts(likes, "object_id", authors(spark, folder), live, BASE).select("activity_id", "actor", "seq", "at_uri", "canonical")


@query(f"WITH {_IN} SELECT activity_id, actor, at_uri, canonical FROM liked")
def like_canonical(spark, folder):
    return likes_of_posts(spark, folder).select("activity_id", "actor", "at_uri", "canonical")


@query(
    f"""WITH {_IN} SELECT canonical, count(*) AS likes, count(DISTINCT actor) AS people FROM liked l
WHERE NOT EXISTS (SELECT 1 FROM answers u WHERE u.route = 'undo_like' AND u.status = 202 AND u.object_id = l.activity_id AND u.actor = l.actor AND u.seq > l.seq) GROUP BY canonical"""
)
def like_totals_live(spark, folder):
    """Likes that stand, by live post."""
    undone = answered(spark, folder).where((F.col("route") == "undo_like") & (F.col("status") == 202))
    undone = undone.select(F.col("like_id").alias("activity_id"), F.col("actor"), F.col("seq").alias("undone"))
    undone = undone.groupBy("activity_id", "actor").agg(F.max("undone").alias("undone"))
    rows = likes_of_posts(spark, folder).join(undone, ["activity_id", "actor"], "left").where(F.col("undone").isNull() | (F.col("undone") < F.col("seq")))
    return rows.groupBy("canonical").agg(F.count(F.lit(1)).alias("likes"), F.count_distinct("actor").alias("people"))


_EVENTS = """controls AS (SELECT target_inbox AS inbox, id AS seq, CASE WHEN id % 5 = 4 THEN 'remove' ELSE 'follow' END AS kind, CASE WHEN id % 5 <> 4 THEN 'f' || id END AS follow_id
  FROM delivery_log WHERE target_inbox LIKE 'https://relay%' AND id % 5 NOT IN (1, 2)),
replies AS (SELECT 'f' || (id - id % 5 - 5 * (id % 2)) AS follow_id, id AS seq, id % 5 = 1 AS accepted FROM delivery_log WHERE id % 5 IN (1, 2)),
last AS (SELECT inbox, max(seq) AS since, arg_max(kind, seq) AS kind, CASE WHEN arg_max(kind, seq) = 'follow' THEN 'f' || max(seq) END AS follow_id FROM controls GROUP BY inbox)"""


def relay_events(spark, folder):
    """Follows, removals and answers: ids ending in 4 or 9 remove, in 1, 2, 6 or 7 answer, all others follow."""
    rows, kind = log(spark, folder), F.col("id") % 5
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    controls = rows.where(F.col("target_inbox").like("https://relay%") & ~kind.isin(1, 2)).select(
        F.col("target_inbox").alias("inbox"), F.col("id").alias("seq"), F.when(kind == 4, "remove").otherwise("follow").alias("kind"), F.when(kind != 4, name(F.col("id"))).alias("follow_id")
    )
    replies = rows.where(kind.isin(1, 2)).select(name(F.col("id") - kind - 5 * (F.col("id") % 2)).alias("follow_id"), F.col("id").alias("seq"), (kind == 1).alias("accepted"))
    return controls, replies


@query(
    f"""WITH {_EVENTS} SELECT inbox, CASE WHEN kind = 'remove' THEN 'unsubscribed' ELSE coalesce((SELECT CASE WHEN arg_max(accepted, r.seq) THEN 'accepted' ELSE 'rejected' END
  FROM replies r WHERE r.follow_id = l.follow_id AND r.seq > l.since HAVING count(*) > 0), 'pending') END AS state, follow_id FROM last l"""
)
def relay_fold(spark, folder):
    return I.relay_states(*relay_events(spark, folder))


_DOC = f'\'{{"@context":"{I.CONTEXT}","id":"\' || x.follow_id || \'","type":"Follow","actor":"{SERVICE}","object":"{I.PUBLIC}"}}\''


@query(
    f"""WITH {_EVENTS}, x AS (SELECT inbox, follow_id FROM last WHERE follow_id IS NOT NULL)
SELECT inbox, {_DOC} AS follow, '{{"@context":"{I.CONTEXT}","id":"' || x.follow_id || '#undo","type":"Undo","actor":"{SERVICE}","object":' || {_DOC} || '}}' AS undo FROM x"""
)
def relay_documents(spark, folder):
    rows = relay_fold(spark, folder).where(F.col("follow_id").isNotNull())
    follow, undo = I.follow_document(F.col("follow_id"), SERVICE), I.undo_document(F.col("follow_id"), SERVICE)
    return rows.select("inbox", F.to_json(follow).alias("follow"), F.to_json(undo).alias("undo"))


def accepted_relays(spark, folder):
    return relays_stored(spark, folder).where((F.col("state") == "accepted") & F.col("inbox").isin(*CONFIGURED_RELAYS))


@query(
    f"""WITH {_C}, {_RELAYS}, {_CONFIGURED}, {_FOLLOWS}, {_INBOXES},
acts AS (SELECT DISTINCT 'at://' || did || '/' || collection || '/' || rkey AS activity, did FROM wanted WHERE collection = 'social.popfeed.feed.review' AND operation <> 'delete'),
keys AS (SELECT DISTINCT did FROM did_dim WHERE len(service) > 0), direct AS (SELECT did, count(*) AS n FROM inboxes GROUP BY did)
SELECT activity, CASE WHEN k.did IS NULL THEN 0 ELSE (SELECT count(*) FROM relays WHERE state = 'accepted' AND inbox IN (SELECT inbox FROM configured)) END AS relays,
  CASE WHEN k.did IS NULL THEN 0 ELSE coalesce(n, 0) END AS direct FROM acts a LEFT JOIN keys k ON k.did = a.did LEFT JOIN direct d ON d.did = a.did"""
)
def fanout_counts(spark, folder):
    """How many deliveries each activity causes; none where the author has no key (here: no service)."""
    rows = A.wanted(commit_rows(spark, folder)).where((F.col("collection") == R.REVIEW) & (F.col("operation") != "delete"))
    acts = rows.select(A.at_uri().alias("activity"), "did").distinct()
    keys = table(spark, folder, "did_dim").where(F.size("service") > 0).select("did").distinct().withColumn("_key", F.lit(True))
    return O.counts(acts, keys, accepted_relays(spark, folder), O.distinct_inboxes(follows(spark, folder))).select("activity", "relays", "direct")


@query(
    f"""WITH {_C}, {_FOLLOWS}, {_INBOXES} SELECT 'at://' || e.did || '/' || collection || '/' || rkey || '#' || seq AS activity, inbox FROM
(SELECT * FROM events_in WHERE collection = 'social.popfeed.actor.profile' AND operation <> 'delete') e JOIN inboxes i ON i.did = e.did"""
)
def profile_fanout(spark, folder):
    """Updates of profiles go to the author's followers only."""
    rows = events(spark, folder).where((F.col("collection") == R.PROFILE) & (F.col("operation") != "delete"))
    acts = rows.select(F.concat(A.at_uri(), F.lit("#"), F.col("seq").cast("string")).alias("activity"), "did")
    return O.to_followers(acts, O.distinct_inboxes(follows(spark, folder))).select("activity", "inbox")


@query(
    f"""WITH {_IN}, {_RELAYS}, {_CONFIGURED} SELECT activity_id, inbox, '{{"@context":"{I.CONTEXT}","id":"{SERVICE}/activities/' || activity_id || '","type":"Announce","actor":"{SERVICE}","to":["{I.PUBLIC}"],"object":{{"id":"' || activity_id || '","type":"Like","actor":"' || actor || '","object":"' || canonical || '"}}}}' AS made
FROM liked, relays WHERE state = 'accepted' AND inbox IN (SELECT inbox FROM configured)"""
)
def announce_plan(spark, folder):
    """Likes of live posts, passed on to the relays inside an announcement of the service."""
    likes = likes_of_posts(spark, folder)
    like = F.struct(F.col("activity_id").alias("id"), F.lit("Like").alias("type"), "actor", F.col("canonical").alias("object"))
    made = I.announcement(F.concat(F.lit(f"{SERVICE}/activities/"), "activity_id"), like, SERVICE)
    rows = likes.select(F.col("activity_id").alias("activity"), F.lit(None).cast("string").alias("did"), F.to_json(made).alias("made"))
    return O.to_relays(rows, accepted_relays(spark, folder)).select(F.col("activity").alias("activity_id"), "inbox", "made")


@query(
    f"""WITH {_IN}, idents AS (SELECT DISTINCT CASE WHEN id % 4 = 0 THEN did ELSE handle END AS ident FROM arrived)
SELECT ident, coalesce(CASE WHEN ident LIKE 'did:%' THEN d.did ELSE h.did END, '') AS did,
  CASE WHEN coalesce(d.did, h.did) IS NULL THEN 'none' WHEN coalesce(d.opted_out, h.opted_out) THEN 'gone' ELSE 'found' END AS shown
FROM idents LEFT JOIN authors d ON d.did = ident LEFT JOIN handles h ON h.handle = ident AND ident NOT LIKE 'did:%'"""
)
def actor_lookup(spark, folder):
    """What an account's address shows: by handle or did, gone where the account opted out."""
    rows = log(spark, folder).select("id", F.get(F.split("record_uri", "/"), F.lit(2)).alias("did"))
    known = authors(spark, folder)
    rows = rows.join(known.select("did", F.col("handle").alias("_h")), "did", "left")
    idents = rows.select(F.when(F.col("id") % 4 == 0, F.col("did")).otherwise(F.coalesce("_h", F.lit("nobody.example"))).alias("ident")).distinct()
    return A.actor_lookup(idents, known).select("ident", F.coalesce("did", F.lit("")).alias("did"), "shown")
