"""Activities that arrive at inboxes: who they are meant for, what they do, how they are answered.

Activities are rows (seq, type, actor, inbox_user, object_type, object_id,
object_is_text, inner_object, reachable): ``inbox_user`` is the account at whose
own inbox they arrived, null at the shared one; ``object_id`` is the object
itself if it is text, else its id; ``inner_object`` is the object of an embedded
follow; ``reachable`` says that the sender's inboxes are known. Authors are rows
(did, handle, opted_out).

Defined results for odd input: an activity without an actor is an error (400)
where one is needed; unknown types are acknowledged and ignored; of accounts that
share a handle the smallest did counts; of records that share a key the smallest
address; an answer that names no current follow changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.documents import PUBLIC

CONTEXT = "https://www.w3.org/ns/activitystreams"
SERVICE_USER = "relay"


def by_handle(authors: DataFrame) -> DataFrame:
    """(handle, did, opted_out), one row for each handle."""
    least = authors.groupBy("handle").agg(F.min(F.struct("did", "opted_out")).alias("a"))
    return least.select("handle", "a.did", "a.opted_out")


def answers(activities: DataFrame, authors: DataFrame, base: str) -> DataFrame:
    """(seq, actor, route, status, response, local_did, like_id) of each activity.

    ``route`` is follow, undo_follow, undo_like, like, answer (of a relay) or
    ignored; ``local_did`` the account followed or unfollowed; ``response`` what
    is sent back to a follow.
    """
    known = by_handle(authors)
    user = F.when(F.col("inbox_user") != SERVICE_USER, F.col("inbox_user"))
    named = F.when((F.col("type") == "Undo") & (F.col("object_type") == "Follow"), F.col("inner_object")).otherwise(F.col("object_id"))
    rows = activities.withColumn("_user", user).withColumn("_named", T.local_handle(named, base))
    at_inbox = known.select(F.col("handle").alias("_user"), F.col("did").alias("_own"))
    of_object = known.select(F.col("handle").alias("_named"), F.col("did").alias("_meant"), F.col("opted_out").alias("_out"))
    rows = rows.join(at_inbox, "_user", "left").join(of_object, "_named", "left")

    is_follow, is_undo, is_like = (F.col("type") == x for x in ("Follow", "Undo", "Like"))
    undoes_follow = (F.col("object_type") == "Follow") | (F.col("_own").isNotNull() & F.col("object_is_text"))
    undoes_like = (F.col("object_type") == "Like") | F.col("object_is_text")
    route = (
        F.when(F.col("type").isin("Accept", "Reject"), "answer")
        .when(~F.coalesce(is_follow | is_undo | is_like, F.lit(False)), "ignored")
        .when(is_follow, "follow")
        .when(is_like, "like")
        .when(F.coalesce(undoes_follow, F.lit(False)), "undo_follow")
        .when(F.coalesce(undoes_like, F.lit(False)), "undo_like")
        .otherwise("ignored")
    )
    follows = is_follow & F.col("actor").isNotNull() & F.col("reachable")
    shared = F.when(~F.coalesce("_out", F.lit(False)), F.col("_meant"))
    target = F.when(F.col("_user").isNotNull(), F.col("_own")).otherwise(shared)
    response = F.when(follows, F.when(target.isNotNull(), "Accept").when(F.col("_user").isNull(), "Reject"))
    needs_actor = is_follow | is_undo | is_like
    status = (
        F.when(needs_actor & F.col("actor").isNull(), 400)
        .when(is_like & F.col("object_id").isNull(), 400)
        .when(follows & F.col("_user").isNotNull() & F.col("_own").isNull(), 404)
        .otherwise(202)
    )
    meant = F.when(follows, target).when(route == "undo_follow", F.when(F.col("_user").isNotNull(), F.col("_own")).otherwise(F.when(~F.col("object_is_text"), F.col("_meant"))))
    return rows.select("seq", "actor", route.alias("route"), status.alias("status"), response.alias("response"), meant.alias("local_did"), F.when(route.isin("undo_like", "like"), F.col("object_id")).alias("like_id"))


def follows_after(answered: DataFrame) -> DataFrame:
    """(did, follower): the follows that stand after accepted follows and undos, in order of arrival."""
    counted = answered.where(F.col("actor").isNotNull() & F.col("local_did").isNotNull() & ((F.col("response") == "Accept") | (F.col("route") == "undo_follow")))
    last = counted.groupBy(F.col("local_did").alias("did"), F.col("actor").alias("follower")).agg(F.max_by("route", "seq").alias("route"))
    return last.where(F.col("route") == "follow").select("did", "follower")


def live_posts(likes: DataFrame, object_id: str, authors: DataFrame, posts: DataFrame, base: str) -> DataFrame:
    """``likes`` of posts that are live here, with ``canonical``, the post's own address.

    A post is addressed by its author's handle or did and its key; ``posts`` are
    rows (did, rkey, at_uri) of published live records.
    """
    rows = likes.withColumn("_part", T.post_parts(F.col(object_id), base))
    rows = rows.withColumn("_ident", F.col("_part.ident")).withColumn("_rkey", F.col("_part.rkey")).where(F.col("_ident").isNotNull())
    handles = by_handle(authors).select(F.col("handle").alias("_ident"), F.col("did").alias("_by_handle"))
    rows = rows.join(handles, "_ident", "left")
    did = F.when(F.startswith("_ident", F.lit("did:")), F.col("_ident")).otherwise(F.col("_by_handle"))
    rows = rows.withColumn("_did", did).drop("_by_handle", "_part", "_ident")
    own = posts.groupBy(F.col("did").alias("_did"), F.col("rkey").alias("_rkey")).agg(F.min("at_uri").alias("_at"))
    names = authors.groupBy(F.col("did").alias("_did")).agg(F.min("handle").alias("_handle"))
    url = F.concat(F.lit(f"{base}/users/"), "_handle", F.lit("/posts/"), "_rkey")
    return rows.join(own, ["_did", "_rkey"]).join(names, "_did").select(*likes.columns, F.col("_at").alias("at_uri"), url.alias("canonical"))


def relay_states(controls: DataFrame, replies: DataFrame) -> DataFrame:
    """(inbox, state, follow_id) of each relay after all events.

    ``controls`` (inbox, seq, kind, follow_id) are follows and removals, the last
    one decides; ``replies`` (follow_id, seq, accepted) count if they name the
    follow that stands, so a late answer to an earlier one, or after a removal, has no effect.
    """
    last = controls.groupBy("inbox").agg(F.max(F.struct("seq", "kind", "follow_id")).alias("c")).select("inbox", "c.*")
    standing = last.select("inbox", F.col("seq").alias("_since"), "kind", F.when(F.col("kind") == "follow", F.col("follow_id")).alias("follow_id"))
    answered = standing.join(replies, "follow_id").where(F.col("seq") > F.col("_since")).groupBy("inbox").agg(F.max_by("accepted", "seq").alias("accepted"))
    state = (
        F.when(F.col("kind") == "remove", "unsubscribed")
        .when(F.col("accepted").isNull(), "pending")
        .when(F.col("accepted"), "accepted")
        .otherwise("rejected")
    )
    return standing.join(answered, "inbox", "left").select("inbox", state.alias("state"), "follow_id")


def follow_document(follow_id: Column, service: str) -> Column:
    """The follow that is sent to a relay."""
    return F.struct(F.lit(CONTEXT).alias("@context"), follow_id.alias("id"), F.lit("Follow").alias("type"), F.lit(service).alias("actor"), F.lit(PUBLIC).alias("object"))


def undo_document(follow_id: Column, service: str) -> Column:
    """What takes that follow back."""
    own = F.concat(follow_id, F.lit("#undo"))
    return F.struct(
        F.lit(CONTEXT).alias("@context"), own.alias("id"), F.lit("Undo").alias("type"), F.lit(service).alias("actor"), follow_document(follow_id, service).alias("object")
    )


def announcement(own_id: Column, activity: Column, service: str) -> Column:
    """An activity of somebody else, passed on to relays."""
    return F.struct(
        F.lit(CONTEXT).alias("@context"), own_id.alias("id"), F.lit("Announce").alias("type"), F.lit(service).alias("actor"), F.array(F.lit(PUBLIC)).alias("to"), activity.alias("object")
    )


def inboxes(actor: Column) -> Column:
    """struct(inbox, shared) of an actor document as JSON."""
    return F.struct(F.get_json_object(actor, "$.inbox").alias("inbox"), F.get_json_object(actor, "$.endpoints.sharedInbox").alias("shared"))


def object_id(activity: Column) -> Column:
    """The object of an activity as JSON: itself if it is text, else its id."""
    whole = F.get_json_object(activity, "$.object")
    return F.when(F.startswith(whole, F.lit("{")), F.get_json_object(activity, "$.object.id")).otherwise(whole)
