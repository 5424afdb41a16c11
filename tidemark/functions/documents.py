"""Documents that other servers read, as nested column expressions.

Optional members are null fields: ``to_json`` leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.functions import text as T
from tidemark.functions.timefn import iso_micros

# Fixed values of the protocol.
PUBLIC = "https://www.w3.org/ns/activitystreams#Public"
BEST, WORST = 10, 1
BOOK_LEAD = {"wishlist": "Wants to read", "progress": "Reading", "complete": "Finished reading", "dropped": "Abandoned"}


def number_at(value: Column, path: str) -> Column:
    """The number at a path of a variant; null for any other JSON type, text and booleans included."""
    is_number = F.rlike(R.json_kind(value, path), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    return F.when(is_number, F.try_variant_get(value, path, "double"))


def actor_url(handle: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/users/"), handle)


def post_url(handle: Column, rkey: Column, base: str) -> Column:
    return F.concat(actor_url(handle, base), F.lit("/posts/"), rkey)


def catalog_url(work_key: Column, base: str) -> Column:
    kind, name = R.key_parts(work_key)
    return F.concat(F.lit(f"{base}/catalog/"), kind, F.lit("/"), name)


def catalog_item(work_key: Column, kind: Column, title: Column, poster: Column, ids: Column, base: str) -> Column:
    """The document of a work."""
    _, name = R.key_parts(work_key)
    shown = F.coalesce(F.nullif(title, F.lit("")), name)
    resources = F.transform(R.external_links(kind, ids), lambda u: F.struct(u.alias("url")))
    return F.struct(
        catalog_url(work_key, base).alias("id"),
        F.coalesce(R.lookup(R.ITEM_TYPE, kind), F.lit("Document")).alias("type"),
        shown.alias("name"),
        shown.alias("title"),
        shown.alias("display_title"),
        F.array(F.struct(F.lit("en").alias("lang"), shown.alias("text"))).alias("localized_title"),
        F.coalesce(R.lookup(R.CATEGORY, kind), F.lit("item")).alias("category"),
        resources.alias("external_resources"),
        poster.alias("cover_image_url"),
        ids["imdbId"].alias("imdb"),
        F.coalesce(ids["isbn13"], ids["isbn"], ids["isbn10"]).alias("isbn"),
    )


def published_at(created: Column, added: Column, created_kind: Column, time_us: Column, clock: Column) -> Column:
    """When a record says it was written: its text, else the stream's time, else the clock.

    ``createdAt`` that is a non-empty object hides ``addedAt``; an empty one does not.
    """
    stated = F.when(F.nullif(created, F.lit("")).isNotNull() & (created != "{}"), F.when(F.startswith(created_kind, F.lit("STRING")), created)).otherwise(F.nullif(added, F.lit("")))
    return F.coalesce(stated, iso_micros(time_us), clock)


def facet(kind: str, note_id: Column, actor: Column, work_url: Column, published: Column, updated: Column, **extra: Column) -> Column:
    """An entry of ``relatedWith`` about a work."""
    own = F.concat(note_id, F.lit(f"#{kind.lower()}"))
    blank = {"value": "double", "best": "int", "worst": "int", "content": "string", "status": "string"}
    return F.struct(
        own.alias("id"),
        F.lit(kind).alias("type"),
        work_url.alias("withRegardTo"),
        actor.alias("attributedTo"),
        own.alias("href"),
        published.alias("published"),
        F.coalesce(updated, published).alias("updated"),
        *(extra[n].cast(t).alias(n) if n in extra else F.lit(None).cast(t).alias(n) for n, t in blank.items()),
    )


def hashtag(name: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("Hashtag").alias("type"), none.alias("href"), F.concat(F.lit("#"), name).alias("name"), none.alias("image"))


def work_tag(kind: Column, url: Column, name: Column, poster: Column) -> Column:
    item = F.coalesce(R.lookup(R.ITEM_TYPE, kind), F.lit("Link"))
    return F.struct(item.alias("type"), url.alias("href"), name.alias("name"), F.nullif(poster, F.lit("")).alias("image"))


def note(base: str, clock: Column, marker: str) -> Column:
    """The note of a row with: did, handle, collection, rkey, doc, value, time_us, operation, label, shelf,
    text_html (rendered rich text), and the work columns of ``with_work`` (work_key null where there is none).
    """
    c, doc, value = F.col, F.col("doc"), F.col("value")
    actor, own = actor_url(c("handle"), base), post_url(c("handle"), c("rkey"), base)
    work_url = catalog_url(c("work_key"), base)
    is_book, is_review = c("collection") == R.BOOK, c("collection") == R.REVIEW
    named = c("work_key").isNotNull()
    title = F.coalesce(F.nullif(c("work_title"), F.lit("")), F.nullif(doc["title"], F.lit("")), F.when(is_book, F.lit("a book")).otherwise("a work"))
    shown = T.title_html(title, work_url, marker)
    rating = F.when(is_book, F.when(R.json_kind(value, "$.stars") == "BIGINT", F.try_variant_get(value, "$.stars", "double"))).when(is_review, number_at(value, "$.rating"))
    body = F.when(is_book, F.when(R.json_kind(value, "$.review") == "STRING", doc["review"])).when(is_review, doc["text"])
    body = F.nullif(body, F.lit(""))
    body_html = F.when(body.isNull(), F.lit("")).when(is_book, T.paragraphs_html(body)).otherwise(c("text_html"))
    shelf = F.when(is_book, R.shelf_of_book(doc["status"])).otherwise(c("shelf"))
    verb = (
        F.when(rating.isNotNull(), F.lit("Rated"))
        .when(is_review | body.isNotNull(), F.lit("Reviewed"))
        .when(is_book & shelf.isNotNull(), R.lookup(BOOK_LEAD, shelf))
        .otherwise(F.lit("Added"))
    )
    ending = F.when(rating.isNotNull(), F.concat(F.lit(" "), T.number_text(rating), F.lit(f"/{BEST}"))).otherwise(F.lit(""))
    to_list = F.coalesce(F.concat(F.lit(" to <strong>"), T.escape_html(c("label")), F.lit("</strong>")), F.lit(" to a list"))
    lead = F.concat(F.lit("<p>"), verb, F.lit(" "), shown, F.when(is_book | is_review, ending).otherwise(to_list), F.lit("</p>"))
    published = published_at(doc["createdAt"], doc["addedAt"], R.json_kind(value, "$.createdAt"), c("time_us"), clock)
    updated = F.when(c("operation") != "create", clock)
    spoilers = is_review & F.coalesce(F.try_variant_get(value, "$.containsSpoilers", "boolean"), F.lit(False))
    own_tags = F.when(is_review, F.transform(F.from_json(doc["tags"], "array<string>"), lambda t: hashtag(T.plain_json(t))))
    tags = F.concat(
        F.coalesce(own_tags, F.array().cast("array<struct<type:string,href:string,name:string,image:string>>")),
        F.array_compact(
            F.array(
                F.when(named, work_tag(c("work_type"), work_url, F.coalesce(F.nullif(c("work_title"), F.lit("")), R.key_parts(c("work_key"))[1]), c("poster"))),
                F.when(named, hashtag(F.coalesce(R.lookup(R.CATEGORY, c("work_type")), F.lit("item")))),
            )
        ),
    )
    about = lambda kind, **extra: facet(kind, own, actor, work_url, published, updated, **extra)
    related = F.array_compact(
        F.array(
            F.when(named & rating.isNotNull(), about("Rating", value=rating, best=F.lit(BEST), worst=F.lit(WORST))),
            F.when(named & body.isNotNull(), about("Comment", content=body_html)),
            F.when(named & shelf.isNotNull(), about("Status", status=shelf)),
        )
    )
    filled = lambda array: F.when(F.size(array) > 0, array)
    return F.struct(
        own.alias("id"),
        F.lit("Note").alias("type"),
        actor.alias("attributedTo"),
        published.alias("published"),
        F.array(F.lit(PUBLIC)).alias("to"),
        F.array(F.concat(actor, F.lit("/followers"))).alias("cc"),
        own.alias("url"),
        F.concat(lead, body_html).alias("content"),
        updated.alias("updated"),
        F.when(spoilers, F.lit(True)).alias("sensitive"),
        F.when(spoilers, F.concat(F.lit("Spoilers: "), title)).alias("summary"),
        filled(tags).alias("tag"),
        filled(related).alias("relatedWith"),
    )


def activity(kind: Column, note_column: Column, note_id: Column, actor: Column, published: Column, updated: Column) -> Column:
    """Create, Update or Delete around a note (``kind``: create, update, delete); a delete carries a tombstone."""
    stamp = F.unix_micros(F.try_to_timestamp(updated)).cast("string")
    own = F.when(kind == "update", F.concat(note_id, F.lit("#updates/"), stamp)).otherwise(F.concat(note_id, F.lit("#"), kind))
    tombstone = F.struct(note_id.alias("id"), F.lit("Tombstone").alias("type"), F.lit("Note").alias("formerType"))
    return F.struct(
        own.alias("id"),
        F.initcap(kind).alias("type"),
        actor.alias("actor"),
        published.alias("published"),
        F.array(F.lit(PUBLIC)).alias("to"),
        F.array(F.concat(actor, F.lit("/followers"))).alias("cc"),
        F.when(kind != "delete", note_column).alias("note"),
        F.when(kind == "delete", tombstone).alias("tombstone"),
    )


def person(handle: Column, name: Column, avatar: Column, base: str) -> Column:
    """The actor document of an account."""
    own = actor_url(handle, base)
    return F.struct(
        own.alias("id"),
        F.lit("Person").alias("type"),
        handle.alias("preferredUsername"),
        F.coalesce(F.nullif(name, F.lit("")), handle).alias("name"),
        F.concat(own, F.lit("/inbox")).alias("inbox"),
        F.concat(own, F.lit("/outbox")).alias("outbox"),
        F.concat(own, F.lit("/followers")).alias("followers"),
        F.when(avatar.isNotNull(), F.struct(F.lit("Image").alias("type"), avatar.alias("url"))).alias("icon"),
    )


def person_update(handle: Column, name: Column, avatar: Column, time_us: Column, base: str) -> Column:
    """The Update that tells an account's followers about its new profile."""
    own = actor_url(handle, base)
    return F.struct(
        F.concat(own, F.lit("#updates/"), time_us.cast("string")).alias("id"),
        F.lit("Update").alias("type"),
        own.alias("actor"),
        F.array(F.lit(PUBLIC)).alias("to"),
        F.array(F.concat(own, F.lit("/followers"))).alias("cc"),
        person(handle, name, avatar, base).alias("object"),
    )


def post_page(made: Column, handle: Column) -> Column:
    """What the page of a post shows: the first tag that leads to a work, the names of the others, cleaned content."""
    none = F.array().cast("array<struct<type:string,href:string,name:string,image:string>>")
    tags, content = F.coalesce(made["tag"], none), T.scrub_links(F.coalesce(made["content"], F.lit("")))
    is_hashtag = lambda t: F.coalesce(t["type"] == "Hashtag", F.lit(False))
    return F.struct(
        F.concat(F.lit("Post by @"), handle).alias("og_title"),
        content.alias("content"),
        T.description(content, F.coalesce(made["sensitive"], F.lit(False)), made["summary"]).alias("description"),
        F.transform(F.filter(tags, is_hashtag), lambda t: F.coalesce(t["name"], F.lit(""))).alias("hashtags"),
        F.get(F.filter(tags, lambda t: ~is_hashtag(t) & F.nullif(t["href"], F.lit("")).isNotNull()), F.lit(0)).alias("work"),
        made["id"].alias("url"),
    )


def shown_json(value: Column) -> Column:
    """JSON for the reader's eye, two blanks an indent."""
    return F.to_json(value, {"pretty": "true"})


def discovery(handle: Column, host: str, base: str) -> Column:
    """The discovery document of an account."""
    return F.struct(
        F.concat(F.lit("acct:"), handle, F.lit(f"@{host}")).alias("subject"),
        F.array(actor_url(handle, base)).alias("aliases"),
        F.array(F.struct(F.lit("self").alias("rel"), F.lit("application/activity+json").alias("type"), actor_url(handle, base).alias("href"))).alias("links"),
    )
