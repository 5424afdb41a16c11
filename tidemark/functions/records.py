"""What single records say: statuses, identifiers, titles, catalog links.

``fields`` parses a record's JSON once into typed columns; everything else is
an expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import head, last_segment

LIST = "social.popfeed.feed.list"
LIST_ITEM = "social.popfeed.feed.listItem"
REVIEW = "social.popfeed.feed.review"
PROFILE = "social.popfeed.actor.profile"
BOOK = "buzz.bookhive.book"
WANTED = (LIST, LIST_ITEM, REVIEW, PROFILE, BOOK)

# Words of list types and the shelf they stand for.
SHELF_OF_WORD = {
    "wishlist": "wishlist", "watchlist": "wishlist", "want": "wishlist", "backlog": "wishlist", "queued": "wishlist", "planned": "wishlist",
    "progress": "progress", "current": "progress", "watching": "progress", "playing": "progress", "reading": "progress", "listening": "progress",
    "complete": "complete", "completed": "complete", "finished": "complete", "done": "complete", "watched": "complete", "played": "complete", "read": "complete", "listened": "complete",
    "dropped": "dropped", "abandoned": "dropped", "shelved": "dropped", "dnf": "dropped",
}
# Statuses of books.
SHELF_OF_BOOK = {"wanttoread": "wishlist", "reading": "progress", "finished": "complete", "abandoned": "dropped"}
# Catalog category and item type of each kind of work.
CATEGORY = {"movie": "movie", "tv_show": "tv", "tv_season": "tv", "tv_episode": "tv", "video_game": "game", "book": "book", "music": "music", "album": "music", "ep": "music", "podcast": "podcast"}
ITEM_TYPE = {"movie": "Movie", "tv_show": "TVShow", "tv_season": "TVSeason", "video_game": "Game", "book": "Edition", "music": "Album", "album": "Album", "ep": "Album", "podcast": "Podcast"}
# Identifiers in order of preference, and those that only tell a position or a parent.
PREFERRED_IDS = ("imdbId", "tmdbId", "igdbId", "steamId", "isbn", "isbn13", "isbn10", "goodreadsId", "musicbrainzId", "mbId", "mbReleaseId", "hiveId")
POSITION_IDS = ("episodeNumber", "seasonNumber", "tmdbTvSeriesId")

DOCUMENT = (
    "struct<`$type` string, title string, text string, listType string, listUri string, createdAt string, addedAt string, "
    "identifiers string, creativeWorkType string, posterUrl string, name string, description string, hiveId string, "
    "status string, review string, displayName string, avatar string, tags string, facets string>"
)


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a constant map, null for other keys."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def fields(rows: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``doc`` (fields as text), ``value`` (the record as a variant) and their types where those matter."""
    return rows.withColumn("doc", F.from_json(F.coalesce(record, F.lit("{}")), DOCUMENT)).withColumn("value", F.try_parse_json(F.coalesce(record, F.lit("{}"))))


def json_kind(value: Column, path: str) -> Column:
    """Type of the JSON value at a path: STRING, BOOLEAN, BIGINT, DECIMAL..., ARRAY..., OBJECT..., null where absent."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def shelf_of_list(list_type: Column) -> Column:
    """Shelf that a list type stands for: a whole hit, else its first word with one; read after "to" is a wish."""
    words = F.split(list_type, r"[_\-\s]+")
    hits = F.filter(
        F.transform(
            words,
            lambda w, i: F.struct(
                lookup(SHELF_OF_WORD, w).alias("shelf"), F.coalesce((i > 0) & (F.get(words, i - 1) == "to"), F.lit(False)).alias("after_to")
            ),
        ),
        lambda x: x["shelf"].isNotNull(),
    )
    first = F.get(hits, F.lit(0))
    by_word = F.when((first["shelf"] == "complete") & first["after_to"], F.lit("wishlist")).otherwise(first["shelf"])
    return F.coalesce(lookup(SHELF_OF_WORD, list_type), by_word)


def shelf_of_item(list_type: Column, work_type: Column) -> Column:
    """Shelf of a list item; one episode is never more than progress on its season."""
    shelf = shelf_of_list(F.lower(F.coalesce(list_type, F.lit(""))))
    return F.when(shelf.isNotNull() & (work_type == "tv_episode"), F.lit("progress")).otherwise(shelf)


def shelf_of_book(status: Column) -> Column:
    return lookup(SHELF_OF_BOOK, F.lower(last_segment(status, "#")))


def list_label(name: Column, description: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(F.nullif(name, F.lit("")), description)), F.lit(""))


def avatar_cid(avatar: Column) -> Column:
    """Content id of an avatar in its old or its present form."""
    return F.coalesce(F.nullif(F.get_json_object(avatar, "$.ref.$link"), F.lit("")), F.nullif(F.get_json_object(avatar, "$.cid"), F.lit("")))


# --- identifiers and works ------------------------------------------------------


def identifier_map(identifiers: Column) -> Column:
    """Identifiers as map from text to text without null and empty values, in the order given."""
    parsed = F.from_json(identifiers, "map<string,string>")
    return F.map_filter(F.coalesce(parsed, F.expr("map()").cast("map<string,string>")), lambda _, v: v.isNotNull() & (v != ""))


def is_book(doc: Column) -> Column:
    return F.coalesce(doc["$type"] == BOOK, doc["hiveId"].isNotNull())


def picked_identifier(ids: Column, work_type: Column) -> Column:
    """struct(key, id): the preferred identifier, else the first identifying one, else a season's compound."""
    name = F.get(F.filter(F.array(*map(F.lit, PREFERRED_IDS)), lambda n: F.map_contains_key(ids, n)), F.lit(0))
    other = F.get(F.filter(F.map_keys(ids), lambda k: ~k.isin(*POSITION_IDS)), F.lit(0))
    key = F.coalesce(name, other)
    return F.coalesce(F.when(key.isNotNull(), F.struct(key.alias("key"), ids[key].alias("id"))), season_compound(ids, work_type))


def season_compound(ids: Column, work_type: Column) -> Column:
    """struct(key, id) of a season by its series and number; null for other works."""
    both = (work_type == "tv_season") & ids["tmdbTvSeriesId"].isNotNull() & ids["seasonNumber"].isNotNull()
    made = F.concat(ids["tmdbTvSeriesId"], F.lit("-season-"), ids["seasonNumber"])
    return F.when(both, F.struct(F.lit("tmdbId").alias("key"), made.alias("id")))


def normal_title(work_type: Column, title: Column, ids: Column) -> Column:
    """What the work is called where the title names one of its episodes."""
    shape = r"^(.+?)\s+-\s+S(\d+)E\d+\b"
    episodic = F.rlike(title, F.lit(shape))
    show, number = F.regexp_extract(title, shape, 1), F.regexp_extract(title, shape, 2)
    given = F.trim(F.coalesce(ids["seasonNumber"], F.lit("")))
    is_number = F.rlike(given, F.lit(r"^\d+$"))
    plain = lambda digits: F.regexp_replace(digits, r"^0+(?=\d)", "")
    season = (
        F.when(episodic, F.concat(show, F.lit(" - Season "), plain(F.when(is_number, given).otherwise(number))))
        .when(F.rlike(title, F.lit(r"(?i)\bSeason\s+\d+\b")), title)
        .when(is_number, F.concat(title, F.lit(" - Season "), plain(given)))
        .otherwise(title)
    )
    return (
        F.when(title.isNull() | (title == ""), title)
        .when(work_type == "tv_show", F.when(episodic, show).otherwise(title))
        .when(work_type == "tv_season", season)
        .otherwise(title)
    )


def external_links(work_type: Column, ids: Column) -> Column:
    """Addresses of a work on other sites, in fixed order."""

    def link(condition: Column, *parts) -> Column:
        return F.when(condition, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))

    has = lambda name: ids[name].isNotNull()
    return F.array_compact(
        F.array(
            link(F.startswith(ids["imdbId"], F.lit("tt")), "https://www.imdb.com/title/", ids["imdbId"]),
            link(has("tmdbId") & (work_type == "movie"), "https://www.themoviedb.org/movie/", ids["tmdbId"]),
            link(has("tmdbId") & (work_type == "tv_show"), "https://www.themoviedb.org/tv/", ids["tmdbId"]),
            link((work_type == "tv_season") & has("tmdbTvSeriesId") & has("seasonNumber"), "https://www.themoviedb.org/tv/", ids["tmdbTvSeriesId"], "/season/", ids["seasonNumber"]),
            link(has("slug") & (work_type == "video_game"), "https://www.igdb.com/games/", ids["slug"]),
            link(has("goodreadsId") & (work_type == "book"), "https://www.goodreads.com/book/show/", ids["goodreadsId"]),
            link(has("steamId"), "https://store.steampowered.com/app/", ids["steamId"]),
            link(has("mbId"), "https://musicbrainz.org/release-group/", ids["mbId"]),
            link(has("mbReleaseId"), "https://musicbrainz.org/release/", ids["mbReleaseId"]),
        )
    )


def with_work(rows: DataFrame) -> DataFrame:
    """Adds the work a record is about: work_type, ids (map), picked, work_key, work_title, poster, aliases.

    Books get their own shape; an episode on a list stands for its season if it
    can name it. ``work_key`` is null where no identifier names a work.
    """
    doc, raw, book = F.col("doc"), F.col("_raw"), F.col("_book")
    # step by step, so that no expression holds another one more than once
    rows = rows.withColumn("_book", is_book(doc)).withColumn("_raw", identifier_map(doc["identifiers"]))
    hive = (doc["hiveId"] != "") & ~F.map_contains_key(raw, F.lit("hiveId"))
    rows = rows.withColumn("_season", season_of_episode(doc, raw, book))
    ids = (
        F.when(book & F.coalesce(hive, F.lit(False)), F.map_concat(raw, F.create_map(F.lit("hiveId"), doc["hiveId"])))
        .when(F.col("_season"), F.map_filter(raw, lambda k, _: k.isin("tmdbTvSeriesId", "seasonNumber")))
        .otherwise(raw)
    )
    kind = F.when(book, "book").when(F.col("_season"), "tv_season").otherwise(F.coalesce(F.nullif(doc["creativeWorkType"], F.lit("")), F.lit("unknown")))
    rows = rows.withColumn("work_type", kind).withColumn("ids", ids)
    rows = rows.withColumn("_compound", season_compound(F.col("ids"), F.col("work_type")))
    identifying = F.filter(F.map_entries("ids"), lambda e: ~e["key"].isin(*POSITION_IDS))
    rows = rows.withColumn("_own", F.transform(identifying, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("id"))))
    rows = rows.withColumn("picked", picked_identifier(F.col("ids"), F.col("work_type")))
    aliases = F.array_distinct(F.array_compact(F.concat("_own", F.array("_compound"))))
    return (
        rows.withColumn("work_key", F.concat(F.col("work_type"), F.lit(":"), F.col("picked.key"), F.lit("-"), F.col("picked.id")))
        .withColumn("work_title", normal_title(F.col("work_type"), doc["title"], F.col("ids")))
        .withColumn("poster", F.when(~book, doc["posterUrl"]))
        .withColumn("aliases", F.when(F.col("picked").isNotNull(), aliases))
        .drop("_book", "_raw", "_season", "_compound", "_own")
    )


def season_of_episode(doc: Column, ids: Column, book: Column) -> Column:
    """Whether a record is an episode on a list that can name its season."""
    named = ids["tmdbTvSeriesId"].isNotNull() & ids["seasonNumber"].isNotNull()
    return F.coalesce(~book & (doc["creativeWorkType"] == "tv_episode") & F.endswith(doc["$type"], F.lit("feed.listItem")) & named, F.lit(False))


def key_parts(work_key: Column) -> tuple[Column, Column]:
    """(type, id) of a work key."""
    kind = head(work_key, ":")
    return kind, F.substr(work_key, F.length(kind) + 2)
