from tests.stream import frame
from tidemark.operators import archive as A
from tidemark.operators import backfill as B
from tidemark.operators import fanout as O
from tidemark.operators.changefeed import commits

C = "social.popfeed.feed.list"


def test_archive_keeps_tombstones_and_revives(spark):
    rows = [
        (1, "a", None, "create", C, "k", "{1}", "x1"),
        (2, "a", None, "delete", C, "k", None, None),
        (3, "b", None, "create", C, "k", "{2}", "x2"),
        (4, "b", None, "delete", C, "k", None, None),
        (5, "b", None, "update", C, "k", "{3}", "x3"),
        (6, "c", None, "delete", C, "k", None, None),  # never seen
    ]
    got = {r.did: (r.cid, r.record, r.op, r.created_seq, r.updated_seq, r.deleted) for r in A.state(commits(frame(spark, rows))).collect()}
    assert got == {"a": ("x1", "{1}", "delete", 1, 2, True), "b": ("x3", "{3}", "update", 3, 5, False)}
    assert A.state(commits(frame(spark, []))).count() == 0


def test_search_folds_ascii_only(spark):
    rows = [(1, "a", None, "create", C, "K1", '{"t": "ÉCLAT"}', "x"), (2, "a", None, "create", C, "k2", None, "x")]
    archive = A.state(commits(frame(spark, rows)))
    keys = lambda p: [r.rkey for r in A.search(archive, p).collect()]
    assert keys("k1") == ["K1"] and keys("clat") == ["K1"] and keys("éclat") == [] and sorted(keys("")) == ["K1", "k2"]


def test_delivery(spark):
    follows = spark.createDataFrame([("a", "i1", "s", 1), ("a", "i2", "s", 2), ("a", "i3", None, 3), ("a", "i4", "", 4), ("b", "i1", "s", 5)], "did string, inbox string, shared_inbox string, seq bigint")
    inboxes = O.distinct_inboxes(follows)
    assert {(r.did, r.inbox, r.first) for r in inboxes.collect()} == {("a", "s", 1), ("a", "i3", 3), ("a", "i4", 4), ("b", "s", 5)}
    acts = spark.createDataFrame([("n1", "a"), ("n2", "z")], "activity string, did string")
    relays = spark.createDataFrame([("s",), ("r",)], "inbox string")
    assert sorted((r.activity, r.path, r.inbox) for r in O.plan(acts, relays, inboxes).collect()) == [
        ("n1", "direct", "i3"), ("n1", "direct", "i4"), ("n1", "direct", "s"), ("n1", "relay", "r"), ("n1", "relay", "s"), ("n2", "relay", "r"), ("n2", "relay", "s"),
    ]
    assert O.plan(acts, relays.limit(0), inboxes).count() == 3


def test_relays_follows_likes(spark):
    configured = spark.createDataFrame([("new",), ("pending",), ("accepted",)], "inbox string")
    stored = spark.createDataFrame([("pending", "pending"), ("accepted", "accepted"), ("old", "accepted"), ("rejected", "rejected")], "inbox string, state string")
    assert {(r.inbox, r.action, r.new_state) for r in O.reconcile(configured, stored).collect()} == {
        ("new", "follow", "pending"), ("pending", "follow", "pending"), ("accepted", "keep", "accepted"), ("old", "undo", "unsubscribed"), ("rejected", "keep", "rejected"),
    }
    events = spark.createDataFrame([("x", "f", 1, False, "i1"), ("x", "f", 2, False, "i2"), ("x", "g", 1, False, "i"), ("x", "g", 2, True, "i")], "local_did string, follower string, seq bigint, undo boolean, inbox string")
    got = O.follow_state(events.selectExpr("*", "cast(null as string) AS shared_inbox")).collect()
    assert [(r.follower, r.inbox) for r in got] == [("f", "i2")]
    likes = O.likes(spark.createDataFrame([("1", "a", "o", 1), ("1", "b", "o", 2), ("2", "a", "o", 3)], "activity_id string, actor string, object string, seq bigint"))
    undone = spark.createDataFrame([("1", "b"), ("2", "a")], "activity_id string, actor string")
    assert [(r.activity_id, r.actor) for r in O.undo_likes(likes, undone).collect()] == [("1", "a")]


def test_budget(spark):
    rows = spark.createDataFrame([("a", B.PRIORITY[0], "k1", "u1"), ("a", B.PRIORITY[0], "k2", "u2"), ("a", C, "k9", "u3"), ("a", "other", "k9", "u4")], "did string, collection string, rkey string, at_uri string")
    assert [r.at_uri for r in B.within_budget(rows, 3).orderBy("place").collect()] == ["u2", "u1", "u3"]
