"""Answers to what arrives at inboxes, relays, and likes of live posts on small cases."""

import json

from pyspark.sql import functions as F

from tidemark.operators import archive as A
from tidemark.operators import fanout as O
from tidemark.operators import inbound as I

BASE = "https://b"
ACTIVITY = "seq bigint, type string, actor string, inbox_user string, object_type string, object_id string, object_is_text boolean, inner_object string, reachable boolean, response string"
AUTHORS = [("did:a", "ann", False), ("did:o", "out", True), ("did:z", "ann", False)]


def authors(spark):
    return spark.createDataFrame(AUTHORS, "did string, handle string, opted_out boolean")


def user(name):
    return f"{BASE}/users/{name}"


def test_answers(spark):
    rows = [
        (1, "Follow", "p", "ann", None, "x", True, None, True, ""),
        (2, "Follow", "p", "nobody", None, "x", True, None, True, ""),
        (3, "Follow", "p", None, None, user("ann"), True, None, True, ""),
        (4, "Follow", "p", None, None, user("out"), True, None, True, ""),  # opted out, at the shared inbox
        (5, "Follow", "p", "out", None, "x", True, None, True, ""),  # its own inbox is still there
        (6, "Follow", None, "ann", None, "x", True, None, True, ""),
        (7, "Follow", "p", "ann", None, "x", True, None, False, ""),  # the sender cannot be reached
        (8, "Follow", "p", "relay", None, "as:Public", True, None, True, ""),
        (9, "Undo", "p", None, "Follow", "f", False, user("ann"), True, ""),
        (10, "Undo", "p", "ann", None, "f", True, None, True, ""),  # at a user's inbox text is a follow
        (11, "Undo", "p", None, None, "l", True, None, True, ""),  # elsewhere a like
        (12, "Undo", "p", None, "Like", "l", False, None, True, ""),
        (13, "Undo", "p", None, "Block", "l", False, None, True, ""),
        (14, "Like", "p", None, None, None, None, None, True, ""),
        (15, None, None, None, None, None, None, None, None, ""),
        (16, "Accept", None, None, None, "f", True, None, True, ""),
    ]
    got = {r.seq: (r.route, r.status, r.response, r.local_did) for r in I.answers(spark.createDataFrame(rows, ACTIVITY), authors(spark), BASE).collect()}
    assert got == {
        1: ("follow", 202, "Accept", "did:a"),
        2: ("follow", 404, None, None),
        3: ("follow", 202, "Accept", "did:a"),
        4: ("follow", 202, "Reject", None),
        5: ("follow", 202, "Accept", "did:o"),
        6: ("follow", 400, None, None),
        7: ("follow", 202, None, None),
        8: ("follow", 202, "Reject", None),
        9: ("undo_follow", 202, None, "did:a"),
        10: ("undo_follow", 202, None, "did:a"),
        11: ("undo_like", 202, None, None),
        12: ("undo_like", 202, None, None),
        13: ("ignored", 202, None, None),
        14: ("like", 400, None, None),
        15: ("ignored", 202, None, None),
        16: ("answer", 202, None, None),
    }
    answered = I.answers(spark.createDataFrame(rows, ACTIVITY), authors(spark), BASE)
    assert {tuple(r) for r in I.follows_after(answered).collect()} == {("did:o", "p")}
    assert I.answers(spark.createDataFrame([], ACTIVITY), authors(spark), BASE).count() == 0


def test_likes_of_live_posts(spark):
    likes = spark.createDataFrame([(i, o, "clash") for i, o in enumerate([f"{user('ann')}/posts/k", f"{user('did:a')}/posts/k", f"{user('ann')}/posts/gone", "https://other/1", None, f"{user('no')}/posts/k"])], "seq int, o string, did string")
    posts = spark.createDataFrame([("did:a", "k", "at://2"), ("did:a", "k", "at://1"), ("did:z", "k", "at://z")], "did string, rkey string, at_uri string")
    got = sorted((r.seq, r.did, r.at_uri, r.canonical) for r in I.live_posts(likes, "o", authors(spark), posts, BASE).collect())
    assert got == [(i, "clash", "at://1", f"{user('ann')}/posts/k") for i in (0, 1)]


def test_relays(spark):
    controls = [("r1", 1, "follow", "f1"), ("r1", 5, "follow", "f5"), ("r2", 2, "follow", "f2"), ("r2", 7, "remove", None), ("r3", 3, "follow", "f3"), ("r4", 4, "follow", "f4")]
    replies = [("f1", 6, True), ("f5", 8, False), ("f5", 9, True), ("f2", 8, True), ("f3", 2, True), ("f4", 6, False), (None, 9, True)]
    states = I.relay_states(spark.createDataFrame(controls, "inbox string, seq int, kind string, follow_id string"), spark.createDataFrame(replies, "follow_id string, seq int, accepted boolean"))
    # the answer to an earlier follow, one after a removal and one before the follow count for nothing
    assert {r.inbox: r.state for r in states.collect()} == {"r1": "accepted", "r2": "unsubscribed", "r3": "pending", "r4": "rejected"}


def test_fanout(spark):
    acts = spark.createDataFrame([("x", "did:a"), ("y", "did:n")], "activity string, did string")
    relays = spark.createDataFrame([("r",), ("r",), ("s",)], "inbox string")
    inboxes = spark.createDataFrame([("did:a", "i"), ("did:a", "r"), ("did:n", "j")], "did string, inbox string")
    keys = spark.createDataFrame([("did:a",), ("did:a",)], "did string")
    assert sorted(map(tuple, O.counts(acts, keys, relays, inboxes).collect())) == [("x", "did:a", 2, 2), ("y", "did:n", 0, 0)]
    assert sorted(map(tuple, O.plan(acts.where("activity = 'x'"), relays, inboxes).select("path", "inbox").collect())) == [("direct", "i"), ("direct", "r"), ("relay", "r"), ("relay", "s")]
    assert O.to_relays(acts, relays.limit(0)).count() == 0


def test_lookups(spark):
    idents = spark.createDataFrame([(x,) for x in ("ann", "did:z", "out", "did:o", "none", None)], "ident string")
    assert {r.ident: (r.did, r.shown) for r in A.actor_lookup(idents, authors(spark)).collect()} == {
        "ann": ("did:a", "found"), "did:z": ("did:z", "found"), "out": ("did:o", "gone"), "did:o": ("did:o", "gone"), "none": (None, "none"), None: (None, "none"),
    }


def test_documents(spark):
    row = spark.range(1).select(
        F.to_json(I.undo_document(F.lit("f"), "s")).alias("undo"),
        I.inboxes(F.lit('{"inbox": "i", "endpoints": {"sharedInbox": "s"}}')).alias("both"),
        I.inboxes(F.lit('{"inbox": "i"}')).alias("one"),
        I.object_id(F.lit('{"object": "o"}')).alias("text"),
        I.object_id(F.lit('{"object": {"id": "o", "type": "Follow"}}')).alias("inner"),
        I.object_id(F.lit("{}")).alias("none"),
    ).first()
    assert json.loads(row.undo)["object"] == {"@context": I.CONTEXT, "id": "f", "type": "Follow", "actor": "s", "object": I.PUBLIC}
    assert (tuple(row.both), tuple(row.one), row.text, row.inner, row.none) == (("i", "s"), ("i", None), "o", "o", None)
