"""Queries of the scalar functions over documents, records and the catalog, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import records as R
from tidemark.functions import text as T
from tidemark.functions import timefn as M
from tidemark.operators import archive as A
from tidemark.operators import pairing as P
from tidemark.operators import works as W
from tidemark.plans.problems import commit_rows, table
from tidemark.plans.reference import _A, _C, _H, _P, _PAIRS, _WORDS, BASE, MARKER, MINT_SQL, NOW, works_sql, _shelf_sql, actors, archive, events, published
from tidemark.session import stage_table

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


def documents(spark, folder):
    return table(spark, folder, "documents")


def _escape_sql(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{plain}', '{entity}')"
    return text


@query(f"SELECT doc_id, md5({_escape_sql('text')}) AS escaped, length({_escape_sql('text')}) AS n FROM documents")
def text_escape(spark, folder):
    made = T.escape_html(F.col("text"))
    return documents(spark, folder).select("doc_id", F.md5(made).alias("escaped"), F.length(made).cast("bigint").alias("n"))


@query(
    f"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(
  regexp_split_to_array(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), '\\n{{2,}}'),
  lambda p: trim(regexp_replace(p, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) <> ''),
  lambda p: '<p>' || replace({_escape_sql('p')}, chr(10), '<br/>') || '</p>'), '')) AS made FROM documents"""
)
def text_paragraphs(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(T.paragraphs_html(F.col("text"))).alias("made"))


@query(
    """SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), 1, 200) AS snippet FROM documents"""
)
def html_snippet(spark, folder):
    return documents(spark, folder).select("doc_id", T.description(F.col("text")).alias("snippet"))


_LINKED = """linked AS (SELECT id, '<p>x</p><a href="' || CASE id % 4 WHEN 0 THEN record_uri WHEN 1 THEN target_inbox WHEN 2 THEN 'javascript:x()' ELSE replace(target_inbox, 'https', 'http') END
  || '">' || activity_type || '</a>' AS markup FROM delivery_log)"""


@query(
    f"""WITH {_LINKED} SELECT id, replace(regexp_replace(replace(replace(markup, ' href="https://', ' hReF="https://'), ' href="http://', ' hReF="http://'),
  ' href="[^"]*"', '', 'g'), ' hReF="', ' href="') AS clean FROM linked"""
)
def href_scrub(spark, folder):
    rows = table(spark, folder, "delivery_log")
    k = F.col("id") % 4
    link = F.when(k == 0, F.col("record_uri")).when(k == 1, F.col("target_inbox")).when(k == 2, F.lit("javascript:x()")).otherwise(F.replace("target_inbox", F.lit("https"), F.lit("http")))
    markup = F.concat(F.lit('<p>x</p><a href="'), link, F.lit('">'), F.col("activity_type"), F.lit("</a>"))
    return rows.select("id", T.scrub_links(markup).alias("clean"))


@query(
    f"""SELECT id, split_part(split_part(target_inbox, '://', 2), '/', 1) AS host, regexp_replace(target_inbox, '^([^:/]+://[^/]*)', '\\1/{MARKER}') AS marked,
  split_part(record_uri, '/', -1) AS last, CASE WHEN record_uri LIKE 'at://did:%' THEN split_part(split_part(record_uri, '/', 3), ':', -1) || '.did' END AS fallback,
  regexp_full_match(record_uri, 'at://[^/]+/social\\.popfeed\\.feed\\.list/[^/]*') AS is_list, (id % 3 = 0) AS local,
  CASE WHEN id % 3 = 0 THEN split_part(record_uri, '/', -1) END AS ident FROM delivery_log"""
)
def url_parts(spark, folder):
    rows = table(spark, folder, "delivery_log")
    made = F.when(F.col("id") % 3 == 0, F.concat(F.lit(f"{BASE}/users/"), T.last_segment(F.col("record_uri"), "/"), F.lit("/posts/1")))
    return rows.select(
        "id",
        F.regexp_extract("target_inbox", "^[^:/]+://([^/]*)", 1).alias("host"),
        T.marked_url(F.col("target_inbox"), MARKER).alias("marked"),
        T.last_segment(F.col("record_uri"), "/").alias("last"),
        F.when(F.col("record_uri").like("at://did:%"), T.fallback_handle(F.regexp_extract("record_uri", "^at://([^/]+)", 1))).alias("fallback"),
        T.is_list_uri(F.col("record_uri")).alias("is_list"),
        F.coalesce(T.post_parts(made, BASE)["rkey"] == "1", F.lit(False)).alias("local"),
        T.post_parts(made, BASE)["ident"].alias("ident"),
    )


_SPECIAL = "('localhost', 'local', 'internal', 'arpa', 'test', 'invalid', 'onion', 'home', 'corp', 'lan')"


@query(
    f"""WITH names AS (SELECT DISTINCT substr(unnest(also_known_as), 6) AS name FROM did_dim), dids AS (SELECT DISTINCT did FROM did_dim),
hosts AS (SELECT did, did LIKE 'did:web:%' AS web, split_part(url_decode(split_part(substr(did, 9), ':', 1)), ':', 1) AS host FROM dids)
SELECT name, length(name) <= 253 AND regexp_full_match(name, '([a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?')
  AND lower(split_part(name, '.', -1)) NOT IN {_SPECIAL} AS is_handle, false AS is_did FROM names WHERE name IS NOT NULL
UNION ALL SELECT did, false, regexp_full_match(did, 'did:[a-z]+:[A-Za-z0-9._:%-]{{1,512}}') AND (NOT web OR (host LIKE '%.%'
  AND NOT regexp_full_match(host, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.|$)){{4}}') AND lower(split_part(rtrim(host, '.'), '.', -1)) NOT IN {_SPECIAL})) FROM hosts"""
)
def account_ids(spark, folder):
    rows = table(spark, folder, "did_dim")
    names = rows.select(F.explode("also_known_as").alias("alias")).where(F.col("alias").isNotNull())
    names = names.select(F.substr("alias", F.lit(6)).alias("name")).distinct()
    dids = rows.select(F.col("did").alias("name")).distinct()
    return names.select("name", T.is_handle(F.col("name")).alias("is_handle"), F.lit(False).alias("is_did")).unionByName(
        dids.select("name", F.lit(False).alias("is_handle"), T.is_did(F.col("name")).alias("is_did"))
    )


@query(
    f"""WITH lists AS (SELECT DISTINCT unnest(known_values) AS list_type FROM lexicon_field WHERE field_name = 'listType'
  UNION SELECT v || tail FROM (SELECT unnest(known_values) AS v FROM lexicon_field WHERE field_name = 'listType'), (SELECT unnest(['-to-watch', ' to read', '_of_2024']) AS tail)),
verbs AS (SELECT MAP {{{_WORDS}}} AS m)
SELECT list_type, {_shelf_sql('list_type')} AS shelf FROM lists, verbs"""
)
def shelf_status_map(spark, folder):
    known = table(spark, folder, "lexicon_field").where("field_name = 'listType'").select(F.explode("known_values").alias("list_type"))
    tails = F.explode(F.array(*map(F.lit, ("", "-to-watch", " to read", "_of_2024"))))
    rows = known.select(tails.alias("tail"), "list_type").select(F.concat("list_type", "tail").alias("list_type")).distinct()
    return rows.select("list_type", R.shelf_of_list(F.col("list_type")).alias("shelf"))


@query(
    f"""WITH {_A} SELECT at_uri, CASE lower(split_part(json_extract_string(record, '$.status'), '#', -1)) WHEN 'wanttoread' THEN 'wishlist' WHEN 'reading' THEN 'progress'
  WHEN 'finished' THEN 'complete' WHEN 'abandoned' THEN 'dropped' END AS shelf FROM archive WHERE collection = 'buzz.bookhive.book'"""
)
def book_shelves(spark, folder):
    rows = R.fields(archive(spark, folder).where(F.col("collection") == R.BOOK))
    return rows.select("at_uri", R.shelf_of_book(F.col("doc.status")).alias("shelf"))


@query(
    """WITH t AS (SELECT work_key, creative_work_type AS k, title || CASE WHEN creative_work_type IN ('tv_show', 'tv_season') THEN ' - S0' || (length(title) % 9 + 1) || 'E' || length(title) || ' - x' ELSE '' END AS title FROM work_catalog)
SELECT work_key, CASE WHEN k = 'tv_show' AND regexp_matches(title, '^.+?\\s+-\\s+S\\d+E\\d+\\b') THEN regexp_extract(title, '^(.+?)\\s+-\\s+S(\\d+)E\\d+\\b', 1)
  WHEN k = 'tv_season' AND regexp_matches(title, '^.+?\\s+-\\s+S\\d+E\\d+\\b') THEN regexp_extract(title, '^(.+?)\\s+-\\s+S(\\d+)E\\d+\\b', 1) || ' - Season ' || CAST(CAST(regexp_extract(title, '^(.+?)\\s+-\\s+S(\\d+)E\\d+\\b', 2) AS INT) AS VARCHAR)
  ELSE title END AS title FROM t"""
)
def title_normalise(spark, folder):
    rows = table(spark, folder, "work_catalog")
    kind, n = F.col("creative_work_type"), F.length("title")
    tail = F.when(kind.isin("tv_show", "tv_season"), F.concat(F.lit(" - S0"), (n % 9 + 1).cast("string"), F.lit("E"), n.cast("string"), F.lit(" - x"))).otherwise("")
    empty = F.expr("map()").cast("map<string,string>")
    return rows.select("work_key", R.normal_title(kind, F.concat("title", tail), empty).alias("title"))


_ID = lambda name: f"nullif(json_extract_string(identifiers_json, '$.{name}'), '')"


@query(
    "SELECT work_key, CASE "
    + " ".join(f"WHEN {_ID(n)} IS NOT NULL THEN '{n}'" for n in R.PREFERRED_IDS)
    + " END AS id_key, coalesce("
    + ", ".join(_ID(n) for n in R.PREFERRED_IDS)
    + ") AS id FROM work_catalog"
)
def identifier_pick(spark, folder):
    rows = table(spark, folder, "work_catalog")
    picked = R.picked_identifier(R.identifier_map(F.col("identifiers_json")), F.col("creative_work_type"))
    return rows.select("work_key", picked["key"].alias("id_key"), picked["id"].alias("id"))


@query(
    f"""SELECT work_key, array_to_string(list_filter([
  CASE WHEN {_ID('imdbId')} LIKE 'tt%' THEN 'https://www.imdb.com/title/' || {_ID('imdbId')} END,
  CASE WHEN creative_work_type = 'movie' THEN 'https://www.themoviedb.org/movie/' || {_ID('tmdbId')} WHEN creative_work_type = 'tv_show' THEN 'https://www.themoviedb.org/tv/' || {_ID('tmdbId')} END,
  CASE WHEN creative_work_type = 'tv_season' THEN 'https://www.themoviedb.org/tv/' || {_ID('tmdbTvSeriesId')} || '/season/' || {_ID('seasonNumber')} END,
  CASE WHEN creative_work_type = 'video_game' THEN 'https://www.igdb.com/games/' || {_ID('slug')} END,
  CASE WHEN creative_work_type = 'book' THEN 'https://www.goodreads.com/book/show/' || {_ID('goodreadsId')} END,
  'https://store.steampowered.com/app/' || {_ID('steamId')}, 'https://musicbrainz.org/release-group/' || {_ID('mbId')},
  'https://musicbrainz.org/release/' || {_ID('mbReleaseId')}], lambda x: x IS NOT NULL), ' ') AS links FROM work_catalog"""
)
def external_links(spark, folder):
    rows = table(spark, folder, "work_catalog")
    links = R.external_links(F.col("creative_work_type"), R.identifier_map(F.col("identifiers_json")))
    return rows.select("work_key", F.array_join(links, " ").alias("links"))


def _case(values: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(
    f"""SELECT work_key, '{BASE}/catalog/' || split_part(work_key, ':', 1) || '/' || substr(work_key, length(split_part(work_key, ':', 1)) + 2) AS id,
  coalesce({_case(R.ITEM_TYPE, 'creative_work_type')}, 'Document') AS type, coalesce({_case(R.CATEGORY, 'creative_work_type')}, 'item') AS category, title, poster_url AS cover,
  coalesce({_ID('isbn13')}, {_ID('isbn')}, {_ID('isbn10')}) AS isbn FROM work_catalog ORDER BY first_seen DESC, work_key LIMIT 200"""
)
def work_catalog_newest(spark, folder):
    rows = table(spark, folder, "work_catalog")
    item = D.catalog_item(F.col("work_key"), F.col("creative_work_type"), F.col("title"), F.col("poster_url"), R.identifier_map(F.col("identifiers_json")), BASE)
    top = rows.orderBy(F.col("first_seen").desc(), "work_key").limit(200).select("work_key", item.alias("x"))
    return top.select("work_key", "x.id", "x.type", "x.category", F.col("x.title").alias("title"), F.col("x.cover_image_url").alias("cover"), "x.isbn")


@query(
    f"""WITH {_A} SELECT at_uri, coalesce(nullif(json_extract_string(record, '$.avatar.ref."$link"'), ''), nullif(json_extract_string(record, '$.avatar.cid'), '')) AS cid,
  coalesce(nullif(json_extract_string(record, '$.displayName'), ''), nullif(json_extract_string(record, '$.name'), '')) AS name FROM archive WHERE collection = 'social.popfeed.actor.profile'"""
)
def profile_cards(spark, folder):
    rows = R.fields(archive(spark, folder).where(F.col("collection") == R.PROFILE))
    name = F.coalesce(F.nullif(F.col("doc.displayName"), F.lit("")), F.nullif(F.col("doc.name"), F.lit("")))
    return rows.select("at_uri", R.avatar_cid(F.col("doc.avatar")).alias("cid"), name.alias("name"))


@query(
    f"""WITH {_A} SELECT at_uri, regexp_replace(CAST(CAST(json_extract_string(record, '$.rating') AS DOUBLE) AS VARCHAR), '\\.0$', '') AS rated FROM archive
  WHERE collection = 'social.popfeed.feed.review' AND json_type(record, '$.rating') IN ('DOUBLE', 'BIGINT', 'UBIGINT')"""
)
def ratings(spark, folder):
    rows = R.fields(archive(spark, folder).where(F.col("collection") == R.REVIEW))
    return rows.select("at_uri", T.number_text(D.number_at(F.col("value"), "$.rating")).alias("rated")).where(F.col("rated").isNotNull())


@query(
    "SELECT CAST(n AS INTEGER) AS attempt, CAST(least(pow(2, n), 60) AS INTEGER) AS seconds FROM range(0, 12) r(n)"
)
def reconnect_backoff(spark, folder):
    rows = spark.range(12).select(F.col("id").cast("int").alias("attempt"))
    return rows.select("attempt", M.reconnect_delay(F.col("attempt")).alias("seconds"))


# --- works --------------------------------------------------------------------


def works_of(spark, folder):
    rows = commit_rows(spark, folder).where((F.col("operation") != "delete") & F.col("collection").isin(R.REVIEW, R.LIST_ITEM, R.BOOK))
    return R.with_work(R.fields(rows))


_W = """
docs AS (
  SELECT seq, commit.collection AS collection, commit.record AS record,
    (json_extract_string(commit.record, '$."$type"') = 'buzz.bookhive.book' OR (json_extract_string(commit.record, '$."$type"') IS NULL AND json_extract_string(commit.record, '$.hiveId') IS NOT NULL)) AS is_book
  FROM jetstream_sample WHERE kind = 'commit' AND coalesce(commit.operation, 'create') <> 'delete'
    AND commit.collection IN ('social.popfeed.feed.review', 'social.popfeed.feed.listItem', 'buzz.bookhive.book')),
typed AS (SELECT *, CASE WHEN is_book THEN 'book' ELSE coalesce(nullif(json_extract_string(record, '$.creativeWorkType'), ''), 'unknown') END AS kind FROM docs),
ids AS (
  SELECT seq, kind, e.key AS k, json_extract_string(e.value, '$') AS v FROM typed, json_each(record, '$.identifiers') e
  WHERE json_type(record, '$.identifiers') = 'OBJECT' AND e.type <> 'NULL'
  UNION SELECT seq, kind, 'hiveId', json_extract_string(record, '$.hiveId') FROM typed WHERE is_book AND json_extract_string(record, '$.hiveId') <> ''
    AND json_extract_string(record, '$.identifiers.hiveId') IS NULL),
aliases AS (SELECT DISTINCT kind, k, v FROM ids WHERE v <> '' AND k NOT IN ('episodeNumber', 'seasonNumber', 'tmdbTvSeriesId'))"""


@query(f"WITH {_W} SELECT kind AS work_type, k AS id_key, v AS id FROM aliases")
def alias_register(spark, folder):
    # the outer form: the filter that explode implies would be pushed down with the whole derivation inside
    rows = works_of(spark, folder).select("work_type", F.explode_outer("aliases").alias("a"))
    found = rows.select("work_type", F.col("a.key").alias("id_key"), F.col("a.id").alias("id")).distinct()
    return found.where(F.col("id_key").isNotNull())


_ALL_WORKS = f"""source AS (SELECT seq, did, commit.collection AS collection, commit.rkey AS rkey, 'create' AS operation, commit.record AS record FROM jetstream_sample
  WHERE kind = 'commit' AND coalesce(commit.operation, 'create') <> 'delete' AND commit.collection IN ('social.popfeed.feed.review', 'social.popfeed.feed.listItem', 'buzz.bookhive.book')),
{works_sql("source")}"""


@query(f"WITH RECURSIVE {_ALL_WORKS}, {MINT_SQL} SELECT seq, minted_key FROM minted")
def work_mint(spark, folder):
    """Which work each record joins."""
    return W.mint(works_of(spark, folder))


@query(
    f"""WITH RECURSIVE {_ALL_WORKS},
groups AS (SELECT DISTINCT aliases FROM works WHERE len(aliases) > 0 AND pick IS NOT NULL),
links AS (SELECT DISTINCT x AS a, aliases[1] AS b FROM (SELECT aliases, unnest(aliases) AS x FROM groups) UNION SELECT aliases[1], x FROM (SELECT aliases, unnest(aliases) AS x FROM groups)),
label(node, component) USING KEY (node) AS (
  SELECT a AS node, a AS component FROM links
  UNION
  SELECT l.b, min(n.component) FROM label n JOIN links l ON l.a = n.node JOIN recurring.label r ON r.node = l.b GROUP BY l.b, r.component HAVING min(n.component) < r.component)
SELECT node, component FROM label"""
)
def work_components(spark, folder):
    named = works_of(spark, folder).select(F.transform("aliases", lambda a: F.to_json(F.array(F.col("work_type"), a["key"], a["id"]))).alias("nodes"))
    return W.components(stage_table(named.distinct(), "aliases").where("size(nodes) > 0"))


_EPISODE = r"'^(.+?)\s+-\s+S(\d+)E\d+\b'"


_TITLED = f"""
titled AS (SELECT seq, title, work_type, CASE WHEN NOT is_book THEN poster_url END AS poster, regexp_matches(title, {_EPISODE}) AS episodic, regexp_extract(title, {_EPISODE}, 1) AS series_title,
  regexp_extract(title, {_EPISODE}, 2) AS number, trim(coalesce(season, '')) AS given FROM works),
called AS (SELECT seq, poster, CASE WHEN title IS NULL OR title = '' THEN title WHEN work_type = 'tv_show' THEN CASE WHEN episodic THEN series_title ELSE title END
  WHEN work_type = 'tv_season' THEN CASE WHEN episodic THEN series_title || ' - Season ' || CAST(CAST(CASE WHEN regexp_full_match(given, '\\d+') THEN given ELSE number END AS HUGEINT) AS VARCHAR)
    WHEN regexp_matches(title, '(?i)\\bSeason\\s+\\d+\\b') THEN title WHEN regexp_full_match(given, '\\d+') THEN title || ' - Season ' || CAST(CAST(given AS HUGEINT) AS VARCHAR) ELSE title END
  ELSE title END AS title FROM titled)"""


@query(
    f"""WITH RECURSIVE {_ALL_WORKS}, {MINT_SQL},
{_TITLED}
SELECT minted_key AS work_key, arg_min(title, seq) FILTER (title <> '') AS title, arg_min(poster, seq) FILTER (poster <> '') AS poster, count(*) AS records, min(seq) AS first_seq
FROM called JOIN minted USING (seq) GROUP BY 1"""
)
def work_titles(spark, folder):
    rows = works_of(spark, folder)
    return W.catalog(rows, W.mint(rows))


def _rendered_sql(source: str) -> str:
    """``rendered`` (at_uri, text_html): rich text by byte ranges, one facet a turn, of a table (at_uri, record)."""
    part = lambda low, high: f"coalesce(decode(unhex(substr(hexed, (2 * ({low}) + 1)::BIGINT, (2 * greatest(({high}) - ({low}), 0))::BIGINT)), 'ignore'), '')"
    return f"""
rich AS (SELECT at_uri, hex(encode(coalesce(json_extract_string(record, '$.text'), ''))) AS hexed, CASE WHEN json_type(record, '$.facets') = 'ARRAY' THEN json_extract(record, '$.facets') END AS facets FROM {source}),
single AS (SELECT at_uri, i, json_extract(facets, '$[' || (i - 1) || ']') AS f FROM rich, unnest(range(1, CAST(json_array_length(facets) AS BIGINT) + 1)) r(i)),
spans AS (SELECT at_uri, i, try_cast(json_extract_string(f, '$.index.byteStart') AS BIGINT) AS low, try_cast(json_extract_string(f, '$.index.byteEnd') AS BIGINT) AS high,
  list_filter(list_transform(CASE WHEN json_type(f, '$.features') = 'ARRAY' THEN json_extract(f, '$.features[*]') ELSE [] END, lambda x: CASE WHEN json_extract_string(x, '$."$type"') LIKE '%#link' THEN nullif(json_extract_string(x, '$.uri'), '') END), lambda u: u IS NOT NULL)[1] AS uri
  FROM single WHERE json_type(f) = 'OBJECT'),
turns_of AS (SELECT *, row_number() OVER (PARTITION BY at_uri ORDER BY coalesce(low, 0), i) AS turn FROM spans),
walk(at_uri, turn, till, html) AS (
  SELECT at_uri, 0::BIGINT, 0::BIGINT, '' FROM rich
  UNION ALL
  SELECT w.at_uri, t.turn, CASE WHEN low IS NULL OR high IS NULL OR low < till THEN till ELSE high END, CASE WHEN low IS NULL OR high IS NULL OR low < till THEN html ELSE html || {_escape_sql(part("till", "low"))} ||
    CASE WHEN uri LIKE 'http://%' OR uri LIKE 'https://%' THEN '<a href="' || {_escape_sql("uri")} || '" rel="nofollow noopener">' || {_escape_sql(part("low", "high"))} || '</a>' ELSE {_escape_sql(part("low", "high"))} END END
  FROM walk w JOIN turns_of t ON t.at_uri = w.at_uri AND t.turn = w.turn + 1 JOIN rich r ON r.at_uri = w.at_uri),
rendered AS (SELECT r.at_uri, '<p>' || arg_max(html, turn) || {_escape_sql(part("arg_max(till, turn)", "length(hexed) // 2"))} || '</p>' AS text_html FROM walk w JOIN rich r ON r.at_uri = w.at_uri GROUP BY r.at_uri, hexed)"""


@query(f"WITH RECURSIVE {_A}, reviews AS (SELECT * FROM archive WHERE collection = 'social.popfeed.feed.review'), {_rendered_sql('reviews')} SELECT at_uri, text_html AS made FROM rendered")
def facet_render(spark, folder):
    """Rich text of reviews as HTML, by byte offsets."""
    rows = R.fields(archive(spark, folder).where(F.col("collection") == R.REVIEW))
    return rows.select("at_uri", T.render_facets(F.coalesce(F.col("doc.text"), F.lit("")), F.col("doc.facets")).alias("made"))


# --- pairs and documents ------------------------------------------------------


# The ordered fold, one turn of every author at once. Rows of st: records by address, ! the turn of an author, # what was emitted.
_FOLD = f"""
ev AS (SELECT e.did, e.seq, 'at://' || e.did || '/' || e.collection || '/' || e.rkey AS uri, e.collection = 'social.popfeed.feed.review' AS is_review, e.operation,
  m.minted_key AS work, CASE WHEN e.operation <> 'delete' AND e.collection = 'social.popfeed.feed.listItem' THEN
    CASE WHEN base IS NOT NULL AND json_extract_string(e.record, '$.creativeWorkType') = 'tv_episode' THEN 'progress' ELSE base END END AS shelf,
  row_number() OVER (PARTITION BY e.did ORDER BY e.seq) AS turn
  FROM events_in e LEFT JOIN minted m ON m.seq = e.seq LEFT JOIN shelves ON lt = lower(coalesce(json_extract_string(e.record, '$.listType'), ''))
  WHERE e.collection IN ('social.popfeed.feed.review', 'social.popfeed.feed.listItem')),
st(k, did, turn, is_review, created, work, shelf, note, pending, deleted, seq, step, kind, anchor, source) USING KEY (k) AS (
  SELECT DISTINCT '!' || did, did, 0::BIGINT, false, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, false, false, false, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM ev
  UNION
  SELECT * FROM (
    WITH now AS (SELECT e.* FROM ev e JOIN recurring.st c ON c.k = '!' || e.did AND e.turn = c.turn + 1),
    have AS (SELECT s.* FROM recurring.st s JOIN now n ON n.did = s.did WHERE s.k LIKE 'at://%'),
    met AS (SELECT n.*, h.k IS NOT NULL AS known, coalesce(h.note, false) AS r_note, coalesce(h.pending, false) AS r_pending, coalesce(h.deleted, false) AS r_deleted,
      h.work AS r_work, h.shelf AS r_shelf, coalesce(h.created, n.seq) AS r_created FROM now n LEFT JOIN have h ON h.k = n.uri),
    sorted AS (SELECT *, r_note AND NOT r_deleted AS had_note, r_pending AND NOT r_deleted AS was_pending, CASE WHEN NOT r_deleted THEN r_work END AS old,
      CASE WHEN operation = 'delete' THEN CASE WHEN NOT known THEN 'unknown' WHEN r_note THEN 'gone' WHEN NOT r_deleted AND r_work IS NOT NULL AND (is_review OR r_shelf IS NOT NULL) THEN 'part' ELSE 'plain' END
        WHEN work LIKE 'tv_episode:%' THEN 'episode' WHEN NOT is_review AND (work IS NULL OR shelf IS NULL) THEN 'silent' WHEN work IS NULL THEN 'alone' ELSE 'pair' END AS way FROM met),
    moved AS (SELECT *, way = 'pair' AND had_note AND old IS DISTINCT FROM work AND EXISTS (SELECT 1 FROM have h WHERE h.did = sorted.did AND h.work = sorted.work AND NOT h.deleted
        AND (h.is_review OR h.shelf IS NOT NULL) AND h.note AND h.k <> sorted.uri) AS leaves FROM sorted),
    me AS (SELECT uri AS k, did, is_review, r_created AS created, CASE WHEN operation = 'delete' THEN r_work ELSE work END AS work, CASE WHEN operation = 'delete' THEN r_shelf ELSE shelf END AS shelf,
      CASE WHEN operation = 'delete' THEN r_note WHEN way IN ('episode', 'silent') OR leaves THEN false WHEN way = 'alone' THEN true ELSE had_note END AS note,
      CASE WHEN operation = 'delete' THEN r_pending WHEN way = 'silent' THEN false WHEN (way = 'episode' AND had_note) OR leaves THEN true ELSE was_pending END AS pending,
      operation = 'delete' AS deleted FROM moved WHERE way <> 'unknown'),
    cur AS (SELECT * FROM me UNION ALL SELECT h.k, h.did, h.is_review, h.created, h.work, h.shelf, h.note, h.pending, h.deleted FROM have h WHERE h.k NOT IN (SELECT uri FROM now)),
    said AS (SELECT did, seq, CASE WHEN way = 'alone' THEN operation ELSE 'delete' END AS kind, uri AS anchor, CASE WHEN way = 'alone' THEN uri END AS source
      FROM moved WHERE way IN ('unknown', 'gone', 'alone') OR (way = 'episode' AND had_note) OR leaves),
    asked AS (SELECT did, seq, work, uri AS trigger, 1 AS place FROM moved WHERE way = 'pair' UNION ALL SELECT did, seq, r_work, uri, 1 FROM moved WHERE way = 'part'
      UNION ALL SELECT did, seq, old, NULL, 2 FROM moved WHERE way IN ('pair', 'episode') AND old IS NOT NULL AND old IS DISTINCT FROM work),
    summed AS (SELECT a.did, a.seq, a.work, a.place, coalesce(a.trigger, arg_min(c.k, c.created)) AS trigger, arg_max(c.k, c.created) FILTER (c.is_review) AS review, arg_max(c.k, c.created) FILTER (NOT c.is_review) AS item,
      arg_max(c.shelf, c.created) FILTER (NOT c.is_review) AS shelf, arg_max(c.k, c.created) FILTER (c.note) AS holder
      FROM asked a JOIN cur c ON c.did = a.did AND c.work = a.work AND NOT c.deleted AND (c.is_review OR c.shelf IS NOT NULL) WHERE a.work NOT LIKE 'tv_episode:%' GROUP BY a.did, a.seq, a.work, a.place, a.trigger),
    derived AS (SELECT s.*, CASE WHEN holder IS NULL THEN 'create' ELSE 'update' END AS kind, coalesce(holder, CASE WHEN NOT t.pending THEN trigger WHEN NOT r.pending THEN review WHEN NOT i.pending THEN item ELSE trigger END) AS anchor
      FROM summed s LEFT JOIN cur t ON t.k = trigger LEFT JOIN cur r ON r.k = review LEFT JOIN cur i ON i.k = item),
    out AS (SELECT did, seq, 0 AS place, kind, anchor, source, NULL AS shelf, NULL AS work FROM said
      UNION ALL SELECT did, seq, place, kind, anchor, coalesce(review, item), shelf, work FROM derived)
    SELECT '!' || did, did, turn, false, 0, NULL, NULL, false, false, false, NULL, NULL, NULL, NULL, NULL FROM now
    UNION ALL SELECT c.k, c.did, 0, c.is_review, c.created, c.work, c.shelf, c.note OR c.k IN (SELECT anchor FROM derived), c.pending AND c.k NOT IN (SELECT anchor FROM derived), c.deleted, NULL, NULL, NULL, NULL, NULL
      FROM cur c WHERE c.k IN (SELECT uri FROM now) OR c.k IN (SELECT anchor FROM derived)
    UNION ALL SELECT '#' || seq || '#' || row_number() OVER (PARTITION BY seq ORDER BY place), did, 0, false, 0, work, shelf, false, false, false, seq, row_number() OVER (PARTITION BY seq ORDER BY place) - 1, kind, anchor, source FROM out)
)"""


@query(f"WITH RECURSIVE {_PAIRS}, {_FOLD} SELECT did, seq, step, kind, anchor, source, shelf, work AS work_key FROM st WHERE k LIKE '#%'")
def pair_activities(spark, folder):
    """Every activity that reviews and list items cause."""
    rows = R.with_work(R.fields(events(spark, folder).where(F.col("collection").isin(R.REVIEW, R.LIST_ITEM))))
    made = P.activities(rows, W.mint(rows.where(F.col("operation") != "delete")))
    return made.withColumn("step", F.col("step").cast("bigint"))


def notes_of(spark, folder):
    """Published live records with all that their notes need."""
    rows = stage_table(archive(spark, folder), "archive")
    lists = R.fields(rows.where(F.col("collection") == R.LIST)).select("at_uri", R.list_label(F.col("doc.name"), F.col("doc.description")).alias("label"))
    live = published(rows).where(F.col("is_published") & ~F.col("deleted")).withColumnsRenamed({"op": "operation"})
    live = A.with_list_label(R.with_work(live), lists, F.col("doc.listUri")).join(actors(spark, folder).select("did", "handle"), "did")
    live = live.withColumn("time_us", F.unix_micros(F.col("updated_at").cast("timestamp")))
    return live.withColumn("text_html", T.render_facets(F.coalesce(F.col("doc.text"), F.lit("")), F.col("doc.facets")))


_CLOCK = f"'{NOW}'"
_PARA_SQL = """array_to_string(list_transform(list_filter(
  regexp_split_to_array(regexp_replace({0}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), '\\n{{2,}}'),
  lambda p: trim(regexp_replace(p, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) <> ''),
  lambda p: '<p>' || replace({1}, chr(10), '<br/>') || '</p>'), '')"""
_ACTOR = f"'{BASE}/users/' || handle"


def _json_sql(*members: tuple[str, str]) -> str:
    """A JSON object of (name, JSON text or null); null members are left out."""
    return "'{' || array_to_string(list_filter([" + ", ".join(f"'\"{n}\":' || {v}" for n, v in members) + "], lambda m: m IS NOT NULL), ',') || '}'"


def _text_sql(value: str) -> str:
    return f"to_json({value})::VARCHAR"


def _facet_sql(kind: str, *extra: tuple[str, str]) -> str:
    own = f"note_id || '#{kind.lower()}'"
    return _json_sql(
        ("id", _text_sql(own)), ("type", f"'\"{kind}\"'"), ("withRegardTo", _text_sql("work_url")), ("attributedTo", _text_sql("actor")), ("href", _text_sql(own)),
        ("published", _text_sql("published")), ("updated", _text_sql("coalesce(updated, published)")), *extra,
    )


_NOTES = f"""
live AS (SELECT p.*, handle FROM posts p JOIN actors a ON a.did = p.did WHERE is_published AND NOT deleted),
source AS (SELECT updated_seq AS seq, did, collection, rkey, op AS operation, record FROM live),
{works_sql("source")},
{_rendered_sql("live")},
{_TITLED},
told AS (SELECT l.at_uri, l.op, l.collection = 'buzz.bookhive.book' AS is_book, l.collection = 'social.popfeed.feed.review' AS is_review, w.work_type, w.work_key,
  {_ACTOR} AS actor, {_ACTOR} || '/posts/' || l.rkey AS note_id, '{BASE}/catalog/' || split_part(w.work_key, ':', 1) || '/' || substr(w.work_key, length(split_part(w.work_key, ':', 1)) + 2) AS work_url,
  substr(w.work_key, length(split_part(w.work_key, ':', 1)) + 2) AS work_name, nullif(c.title, '') AS work_title, nullif(c.poster, '') AS poster, nullif(w.title, '') AS own_title, text_html, l.record, l.updated_at,
  CASE WHEN l.collection = 'buzz.bookhive.book' THEN CASE WHEN json_type(l.record, '$.stars') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(l.record, '$.stars') AS DOUBLE) END
    WHEN l.collection = 'social.popfeed.feed.review' THEN CASE WHEN json_type(l.record, '$.rating') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(l.record, '$.rating') AS DOUBLE) END END AS rating,
  nullif(CASE WHEN l.collection = 'buzz.bookhive.book' THEN CASE WHEN json_type(l.record, '$.review') = 'VARCHAR' THEN json_extract_string(l.record, '$.review') END
    WHEN l.collection = 'social.popfeed.feed.review' THEN json_extract_string(l.record, '$.text') END, '') AS body,
  CASE WHEN l.collection = 'buzz.bookhive.book' THEN CASE lower(split_part(json_extract_string(l.record, '$.status'), '#', -1)) WHEN 'wanttoread' THEN 'wishlist' WHEN 'reading' THEN 'progress'
    WHEN 'finished' THEN 'complete' WHEN 'abandoned' THEN 'dropped' END ELSE l.shelf END AS shelf,
  (SELECT nullif(trim(coalesce(nullif(json_extract_string(x.record, '$.name'), ''), json_extract_string(x.record, '$.description'))), '') FROM archive x
    WHERE x.at_uri = json_extract_string(l.record, '$.listUri') AND x.collection = 'social.popfeed.feed.list') AS label,
  json_type(l.record, '$.createdAt') AS created_kind, json_extract_string(l.record, '$.createdAt') AS created, nullif(json_extract_string(l.record, '$.addedAt'), '') AS added,
  l.collection = 'social.popfeed.feed.review' AND coalesce(try_cast(json_extract_string(l.record, '$.containsSpoilers') AS BOOLEAN), false) AS spoilers
  FROM live l JOIN works w ON w.seq = l.updated_seq JOIN called c ON c.seq = l.updated_seq JOIN rendered r ON r.at_uri = l.at_uri),
dated AS (SELECT *, coalesce(work_title, own_title, CASE WHEN is_book THEN 'a book' ELSE 'a work' END) AS title,
  coalesce(CASE WHEN nullif(created, '') IS NOT NULL AND NOT (created_kind = 'OBJECT' AND created = '{{}}') THEN CASE WHEN created_kind = 'VARCHAR' THEN created END ELSE added END,
    strftime(updated_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(updated_at) % 1000000 > 0 THEN '.' || lpad((epoch_us(updated_at) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00', {_CLOCK}) AS published,
  CASE WHEN op <> 'create' THEN {_CLOCK} END AS updated,
  CASE WHEN body IS NULL THEN '' WHEN is_book THEN {_PARA_SQL.format("body", _escape_sql("p"))} ELSE text_html END AS body_html FROM told),
worded AS (SELECT *, '<p>' || CASE WHEN rating IS NOT NULL THEN 'Rated' WHEN is_review OR body IS NOT NULL THEN 'Reviewed' WHEN is_book AND shelf IS NOT NULL THEN {_case(D.BOOK_LEAD, 'shelf')} ELSE 'Added' END || ' ' ||
  coalesce('<a href="' || {_escape_sql(f"regexp_replace(work_url, '^([^:/]+://[^/]*)', '\\1/{MARKER}')")} || '">' || {_escape_sql("title")} || '</a>', '<strong>' || {_escape_sql("title")} || '</strong>') ||
  CASE WHEN is_book OR is_review THEN CASE WHEN rating IS NOT NULL THEN ' ' || regexp_replace(rating::VARCHAR, '\\.0$', '') || '/{D.BEST}' ELSE '' END
    ELSE coalesce(' to <strong>' || {_escape_sql("label")} || '</strong>', ' to a list') END || '</p>' AS lead FROM dated),
tagged AS (SELECT *,
  list_concat(CASE WHEN is_review AND json_type(record, '$.tags') = 'ARRAY' THEN list_transform(json_extract(record, '$.tags[*]'), lambda t: CASE WHEN json_type(t) = 'NULL' THEN '{{"type":"Hashtag"}}'
      ELSE '{{"type":"Hashtag","name":' || {_text_sql("('#' || json_extract_string(t, '$'))")} || '}}' END) ELSE [] END,
    CASE WHEN work_key IS NOT NULL THEN [{_json_sql(("type", _text_sql(f"coalesce({_case(R.ITEM_TYPE, 'work_type')}, 'Link')")), ("href", _text_sql("work_url")), ("name", _text_sql("coalesce(work_title, work_name)")), ("image", _text_sql("poster")))},
      '{{"type":"Hashtag","name":' || {_text_sql(f"('#' || coalesce({_case(R.CATEGORY, 'work_type')}, 'item'))")} || '}}'] ELSE [] END) AS tags,
  list_filter(CASE WHEN work_key IS NOT NULL THEN [
    CASE WHEN rating IS NOT NULL THEN {_facet_sql("Rating", ("value", _text_sql("rating")), ("best", f"'{D.BEST}'"), ("worst", f"'{D.WORST}'"))} END,
    CASE WHEN body IS NOT NULL THEN {_facet_sql("Comment", ("content", _text_sql("body_html")))} END,
    CASE WHEN shelf IS NOT NULL THEN {_facet_sql("Status", ("status", _text_sql("shelf")))} END] ELSE [] END, lambda f: f IS NOT NULL) AS related FROM worded)"""
_NOTE_SQL = _json_sql(
    ("id", _text_sql("note_id")), ("type", "'\"Note\"'"), ("attributedTo", _text_sql("actor")), ("published", _text_sql("published")), ("to", f"'[\"{D.PUBLIC}\"]'"),
    ("cc", "'[' || " + _text_sql("(actor || '/followers')") + " || ']'"), ("url", _text_sql("note_id")), ("content", _text_sql("(lead || body_html)")), ("updated", _text_sql("updated")),
    ("sensitive", "CASE WHEN spoilers THEN 'true' END"), ("summary", "CASE WHEN spoilers THEN " + _text_sql("('Spoilers: ' || title)") + " END"),
    ("tag", "CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, ',') || ']' END"), ("relatedWith", "CASE WHEN len(related) > 0 THEN '[' || array_to_string(related, ',') || ']' END"),
)


@query(
    f"""WITH RECURSIVE {_P}, {_H}, {_NOTES} SELECT at_uri, {_NOTE_SQL} AS note, note_id || CASE WHEN op = 'create' THEN '#create' ELSE '#updates/' || epoch_us(TIMESTAMP {_CLOCK}) END AS activity_id,
  CASE WHEN op = 'create' THEN 'Create' ELSE 'Update' END AS activity FROM tagged"""
)
def note_documents(spark, folder):
    """The note of each published record as JSON, and the activity around it."""
    clock = F.lit(NOW)
    rows = notes_of(spark, folder).withColumn("note", D.note(BASE, clock, MARKER))
    kind = F.when(F.col("operation") == "create", "create").otherwise("update")
    wrapped = D.activity(kind, F.col("note"), F.col("note.id"), F.col("note.attributedTo"), F.col("note.published"), F.col("note.updated"))
    return rows.select("at_uri", F.to_json("note").alias("note"), wrapped["id"].alias("activity_id"), wrapped["type"].alias("activity"))


@query(
    f"""WITH {_C}, {_H} SELECT did, '{BASE}/users/' || handle AS id, handle AS name, 'acct:' || handle || '@bridge.example' AS subject FROM actors"""
)
def actor_documents(spark, folder):
    one = D.person(F.col("handle"), F.lit(None).cast("string"), F.lit(None).cast("string"), BASE)
    found = D.discovery(F.col("handle"), "bridge.example", BASE)
    return actors(spark, folder).select("did", one["id"].alias("id"), one["name"].alias("name"), found["subject"].alias("subject"))
