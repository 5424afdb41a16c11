"""Queries of problems 1 to 5 over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import changefeed, drift, orphans, redelivery, shredding
from tidemark.session import fill_cores


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def commit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.commits(table(spark, folder, "jetstream_sample"))


def read_commits(spark: SparkSession, folder: str) -> DataFrame:
    """The same for operators that parse records in Python."""
    return changefeed.commits(fill_cores(table(spark, folder, "jetstream_sample")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.live_records(commit_rows(spark, folder))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_references(
        commit_rows(spark, folder), table(spark, folder, "delivery_log"), table(spark, folder, "did_dim")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("src_table", "src_key", "target_uri")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder))


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder), "reason")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return redelivery.redundant_rows(commit_rows(spark, folder))


def _departures(spark: SparkSession, folder: str) -> DataFrame:
    return drift.departures(read_commits(spark, folder), table(spark, folder, "lexicon_field"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _departures(spark, folder).select("batch_no", "collection", "old_field", "new_field").distinct()


def p4_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of whole nested schemas; tree edit scripts, tested on small streams."""
    return drift.nested_departures(read_commits(spark, folder))


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unify(commit_rows(spark, folder), table(spark, folder, "lexicon_field"), _departures(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return shredding.children(read_commits(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_reasons": p2_reasons,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_unified": p4_unified,
    "p4_nested": p4_nested,
    "p5_found": p5_found,
}

_COMMITS = """
commits AS (
  SELECT seq, batch_no, received_at, did, commit.rev AS rev, coalesce(commit.operation, 'create') AS operation,
         commit.collection AS collection, commit.rkey AS rkey, commit.record AS record, commit.cid AS cid
  FROM jetstream_sample WHERE kind = 'commit'
)"""

_LIVE = (
    _COMMITS
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY did, collection, rkey
                               ORDER BY (rev IS NOT NULL) DESC, rev DESC NULLS LAST, seq DESC) AS place
  FROM commits WHERE did IS NOT NULL AND collection IS NOT NULL AND rkey IS NOT NULL
),
live AS (
  SELECT 'at://' || did || '/' || collection || '/' || rkey AS at_uri, cid, collection, record, received_at
  FROM ranked WHERE place = 1 AND operation <> 'delete'
)"""
)

_ORPHANS = (
    _LIVE
    + """,
refs AS (
  SELECT DISTINCT 'jetstream_sample' AS src_table, at_uri AS src_key, CAST(received_at AS DATE) AS day,
         json_extract_string(record, '$.listUri') AS target_uri
  FROM live WHERE collection = 'social.popfeed.feed.listItem' AND json_extract_string(record, '$.listUri') <> ''
  UNION
  SELECT 'jetstream_sample', at_uri, day, post FROM (
    SELECT at_uri, CAST(received_at AS DATE) AS day, unnest(json_extract_string(record, '$.crossPosts.*')) AS post
    FROM live WHERE collection = 'social.popfeed.feed.review')
  WHERE post LIKE 'at://%'
  UNION
  SELECT 'delivery_log', CAST(id AS VARCHAR), CAST(created_at AS DATE), record_uri FROM delivery_log WHERE record_uri LIKE 'at://%'
),
owners AS (
  SELECT substr(alias, 6) AS handle, min(did) AS owner FROM (SELECT did, unnest(also_known_as) AS alias FROM did_dim)
  WHERE alias LIKE 'at://%' GROUP BY 1
),
placed AS (
  SELECT r.*, CASE WHEN split_part(target_uri, '/', 3) LIKE 'did:%' THEN target_uri
                   ELSE 'at://' || owner || substr(target_uri, 6 + length(split_part(target_uri, '/', 3))) END AS target
  FROM refs r LEFT JOIN owners ON handle = split_part(target_uri, '/', 3)
),
found AS (SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.at_uri = p.target))"""
)

_FIELDS = (
    _COMMITS
    + """,
docs AS (SELECT seq, batch_no, collection, record FROM commits
         WHERE record IS NOT NULL AND collection IN (SELECT collection FROM lexicon_field)),
fields AS (
  SELECT d.seq, d.batch_no, d.collection, e.key AS name,
         CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array'
                     WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
         CASE WHEN e.type = 'VARCHAR' THEN json_extract_string(e.value, '$') END AS word
  FROM docs d, json_each(d.record) e WHERE e.type <> 'NULL'
),
need AS (SELECT * FROM lexicon_field WHERE required),
unlisted AS (
  SELECT f.* FROM fields f WHERE NOT EXISTS (
    SELECT 1 FROM lexicon_field l WHERE l.collection = f.collection AND l.field_name = f.name)
),
tested AS (
  SELECT u.batch_no, u.collection, u.name AS g, n.field_name AS f, bool_and(
      u.kind = 'string' AND (CASE WHEN len(n.known_values) > 0 THEN list_contains(n.known_values, u.word)
        WHEN n.value_format = 'datetime' THEN regexp_full_match(u.word, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:?\\d{2})')
        ELSE false END) AND h.seq IS NULL) AS ok
  FROM unlisted u JOIN need n ON n.collection = u.collection AND (len(n.known_values) > 0 OR n.value_format IS NOT NULL)
  LEFT JOIN fields h ON h.seq = u.seq AND h.name = n.field_name
  GROUP BY ALL
),
pairs AS (SELECT batch_no, collection, f, g FROM tested WHERE ok),
missing AS (
  SELECT d.seq, d.batch_no, d.collection, n.field_name AS f FROM docs d JOIN need n ON n.collection = d.collection
  WHERE NOT EXISTS (SELECT 1 FROM fields h WHERE h.seq = d.seq AND h.name = n.field_name)
)"""
)

# the names of lexicon_field (fixed values)
_COLUMNS = (
    "$type", "addedAt", "authors", "avatar", "backdropUrl", "containsSpoilers", "createdAt", "creativeWorkType", "crossPosts", "description", "displayName",
    "facets", "genres", "hiveId", "identifiers", "isRevisit", "listType", "listUri", "mainCredit", "mainCreditRole", "name", "ordered", "posterUrl", "rating",
    "releaseDate", "review", "stars", "status", "tags", "text", "title", "watchedEpisodes",
)
_UNIFIED = (
    _FIELDS
    + f""",
texts AS (SELECT * FROM commits WHERE record IS NOT NULL),
vals AS (
  SELECT seq, key AS name, last(text ORDER BY id) AS text, max(id) AS id FROM (
    SELECT t.seq, e.key, e.id, CASE e.type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string(e.value, '$') ELSE CAST(e.value AS VARCHAR) END AS text
    FROM texts t, json_each(t.record) e WHERE json_type(t.record) = 'OBJECT') GROUP BY seq, key
),
filled AS (SELECT * FROM vals WHERE text IS NOT NULL),
taken AS (
  SELECT t.seq, p.f, min(p.g) AS g FROM texts t JOIN pairs p ON p.batch_no = t.batch_no AND p.collection = t.collection JOIN filled v ON v.seq = t.seq AND v.name = p.g
  WHERE NOT EXISTS (SELECT 1 FROM filled o WHERE o.seq = t.seq AND o.name = p.f) GROUP BY t.seq, p.f
),
columned AS (SELECT seq, name, text FROM filled UNION ALL SELECT k.seq, k.f, v.text FROM taken k JOIN filled v ON v.seq = k.seq AND v.name = k.g),
wide AS (SELECT seq, {", ".join(f"max(text) FILTER (name = '{n}') AS f_{n.replace('$', '')}" for n in _COLUMNS)} FROM columned GROUP BY seq),
more AS (SELECT seq, '{{' || string_agg(to_json(name) || ':' || to_json(text), ',' ORDER BY id) || '}}' AS added FROM filled f
  WHERE name NOT IN ({", ".join(f"'{n}'" for n in _COLUMNS)}) AND NOT EXISTS (SELECT 1 FROM taken k WHERE k.seq = f.seq AND k.g = f.name) GROUP BY seq)"""
)

SQL: dict[str, str] = {
    "p1_found": f"WITH {_LIVE} SELECT at_uri, cid FROM live",
    "p2_found": f"WITH {_ORPHANS} SELECT src_table, src_key, target_uri FROM found",
    "p2_report": f"WITH {_ORPHANS} SELECT src_table, day, count(*) AS orphans FROM found GROUP BY ALL",
    "p2_reasons": f"""WITH {_ORPHANS}
SELECT src_table, day, CASE WHEN NOT regexp_full_match(target_uri, 'at://[^/]+/[^/]+/[^/]+') OR target IS NULL THEN 'unresolved' WHEN target IN (
    SELECT 'at://' || did || '/' || collection || '/' || rkey FROM ranked WHERE place = 1 AND operation = 'delete') THEN 'deleted' ELSE 'never' END AS reason,
  count(*) AS orphans FROM found GROUP BY ALL""",
    "p3_found": f"""WITH {_COMMITS},
strong AS (SELECT seq, row_number() OVER (PARTITION BY did, rev, collection, rkey ORDER BY seq) AS place FROM commits WHERE rev IS NOT NULL),
weak AS (
  SELECT w.seq, row_number() OVER (PARTITION BY did, collection, rkey, cid ORDER BY seq) AS place,
         EXISTS (SELECT 1 FROM commits s WHERE s.rev IS NOT NULL AND s.did IS NOT DISTINCT FROM w.did
                 AND s.collection IS NOT DISTINCT FROM w.collection AND s.rkey IS NOT DISTINCT FROM w.rkey
                 AND s.cid IS NOT DISTINCT FROM w.cid) AS marked
  FROM commits w WHERE rev IS NULL)
SELECT seq FROM strong WHERE place > 1 UNION ALL SELECT seq FROM weak WHERE marked OR place > 1""",
    "p4_found": f"""WITH {_FIELDS}
SELECT DISTINCT f.batch_no, f.collection, f.name AS old_field, f.name AS new_field
FROM fields f JOIN lexicon_field l ON l.collection = f.collection AND l.field_name = f.name
WHERE NOT list_contains(l.json_types, f.kind)
UNION SELECT batch_no, collection, f, g FROM pairs
UNION SELECT batch_no, collection, '', name FROM unlisted u
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.batch_no = u.batch_no AND p.collection = u.collection AND p.g = u.name)
UNION SELECT batch_no, collection, f, '' FROM missing m
  WHERE NOT EXISTS (SELECT 1 FROM pairs p JOIN fields x ON x.seq = m.seq AND x.name = p.g
                    WHERE p.batch_no = m.batch_no AND p.collection = m.collection AND p.f = m.f)""",
    "p4_unified": f"""WITH {_UNIFIED}
SELECT t.seq, batch_no, did, collection, rkey, {", ".join(f"f_{n.replace('$', '')}" for n in _COLUMNS)},
  CASE WHEN json_type(t.record) = 'OBJECT' THEN coalesce(added, '{{}}') END AS added
FROM texts t LEFT JOIN wide w ON w.seq = t.seq LEFT JOIN more m ON m.seq = t.seq""",
    "p5_found": f"""WITH {_COMMITS},
lists AS (
  SELECT seq, child, CASE WHEN json_type(v) = 'VARCHAR' THEN json_array(v) ELSE v END AS v FROM (
    SELECT seq, unnest(['genres', 'tags']) AS child, unnest([json_extract(record, '$.genres'), json_extract(record, '$.tags')]) AS v
    FROM commits WHERE record IS NOT NULL)),
flat AS (
  SELECT seq, child, i - 1 AS pos1, -1 AS pos2, json_extract(v, '$[' || (i - 1) || ']') AS e
  FROM lists, unnest(range(1, CAST(json_array_length(v) AS BIGINT) + 1)) r(i) WHERE json_type(v) = 'ARRAY'),
facets AS (
  SELECT seq, i - 1 AS pos1, json_extract(record, '$.facets[' || (i - 1) || ']') AS e
  FROM commits, unnest(range(1, CAST(json_array_length(record, '$.facets') AS BIGINT) + 1)) r(i)
  WHERE json_type(record, '$.facets') = 'ARRAY'),
features AS (
  SELECT seq, pos1, i - 1 AS pos2, json_extract(e, '$.features[' || (i - 1) || ']') AS e
  FROM facets, unnest(range(1, CAST(json_array_length(e, '$.features') AS BIGINT) + 1)) r(i)
  WHERE json_type(e, '$.features') = 'ARRAY'),
episodes AS (
  SELECT seq, i - 1 AS pos1, json_extract(record, '$.watchedEpisodes[' || (i - 1) || ']') AS e
  FROM commits, unnest(range(1, CAST(json_array_length(record, '$.watchedEpisodes') AS BIGINT) + 1)) r(i)
  WHERE json_type(record, '$.watchedEpisodes') = 'ARRAY')
SELECT seq, child, pos1, CAST(pos2 AS BIGINT) AS pos2,
       CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.name') ELSE json_extract_string(e, '$') END AS item
FROM flat WHERE json_type(e) <> 'NULL'
UNION ALL
SELECT seq, 'facets', pos1, -1, CASE WHEN json_type(e, '$.index') = 'OBJECT'
    THEN coalesce(json_extract_string(e, '$.index.byteStart'), '') || '-' || coalesce(json_extract_string(e, '$.index.byteEnd'), '') ELSE '' END
FROM facets WHERE json_type(e) = 'OBJECT'
UNION ALL
SELECT seq, 'features', pos1, pos2, coalesce(json_extract_string(e, '$.uri'), json_extract_string(e, '$.tag'), json_extract_string(e, '$.did'))
FROM features WHERE json_type(e) = 'OBJECT'
UNION ALL
SELECT seq, 'episodes', pos1, -1, coalesce(json_extract_string(e, '$.seasonNumber'), '') || ':' || coalesce(json_extract_string(e, '$.episodeNumber'), '')
FROM episodes WHERE json_type(e) = 'OBJECT'""",
}
