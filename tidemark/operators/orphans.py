"""References to records that do not exist (problem 2).

A Bloom filter of the parent keys, itself a table (word, bits), is probed by a
join on the word: a reference that misses it has no parent for certain. Only
references that hit it are verified by an exact anti join. The filter has 16 bits
for each key in 64-bit words (register-blocked), so that it proves nearly all
orphans at any number of keys, and is built by ``bit_or`` with partial
aggregation. It is broadcast while its words are at most ``BROADCAST_WORDS``;
a larger one is probed by a shuffle on the word, which spreads hot targets no
worse than the exact join does. References are resolved and probed once, into a
staged table that both ways read.

Defined results for odd input: a null reference or one that is not ``at://`` is
no reference; a reference that is not authority/collection/rkey, or whose
handle nobody lists, names no record and is an orphan; a handle listed by
several accounts stands for the smallest did; repeated references from one
source, repeated log rows included, give one row; with no live records every
reference is an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.changefeed import VERSION, at_uri, record_state
from tidemark.session import stage_table

LIST_ITEM = "social.popfeed.feed.listItem"
REVIEW = "social.popfeed.feed.review"

BITS_PER_KEY = 16
BROADCAST_WORDS = 1 << 20  # about 32 MB once broadcast
PROBES = 4


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words).cast("bigint"))


def _mask(key: Column) -> Column:
    draw = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(draw, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def filter_words(n_keys: int) -> int:
    """Number of words for so many keys: a power of two with at least BITS_PER_KEY bits a key."""
    return 1 << max(10, (max(1, n_keys) * BITS_PER_KEY // 64).bit_length())


def bloom(keys: DataFrame, key: str, words: int) -> DataFrame:
    """The filter as a table of at most ``words`` rows (word, bits)."""
    return keys.groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def probed(references: DataFrame, target: str, parents: DataFrame, key: str, n_parents: int, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``references`` with ``_possible``, false where the filter proves that there is no parent; null targets have none."""
    words = filter_words(n_parents)
    sieve = bloom(parents, key, words).toDF("_word", "_bits")
    at = F.col(target)
    met = references.withColumn("_word", _word(at, words)).join(F.broadcast(sieve) if words <= broadcast_words else sieve, "_word", "left")
    hit = at.isNotNull() & F.coalesce(F.col("_bits").bitwiseAND(_mask(at)) == _mask(at), F.lit(False))
    return met.select(*references.columns, hit.alias("_possible"))


def orphans(references: DataFrame, target: str, parents: DataFrame, key: str, n_parents: int, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Rows of ``references`` whose ``target`` is no ``key`` of ``parents``; null targets are orphans."""
    known = stage_table(probed(references, target, parents, key, n_parents, broadcast_words), "probed")
    definite = known.where("NOT _possible")
    verified = known.where("_possible").join(parents.select(F.col(key).alias(target)), target, "left_anti")
    return definite.select(*references.columns).unionByName(verified.select(*references.columns))


# --- the record stream and the delivery log ----------------------------------


def record_references(rows: DataFrame) -> Column:
    """The references in one record, as an array of texts; taken before the shuffle, so the JSON stays behind."""
    is_live = F.col("operation") != "delete"
    doc = F.from_json("record", "struct<listUri string, crossPosts string>")
    lists = F.when(F.col("collection") == LIST_ITEM, F.array(doc["listUri"]))
    posts = F.when(F.col("collection") == REVIEW, F.map_values(F.from_json(doc["crossPosts"], "map<string,string>")))
    kept_list = F.filter(lists, lambda x: x.isNotNull() & (x != ""))
    kept_posts = F.filter(posts, lambda x: x.isNotNull() & x.startswith("at://"))
    return F.when(is_live, F.coalesce(kept_list, kept_posts))


def handle_owners(did_dim: DataFrame) -> DataFrame:
    """(handle, did) for each ``at://`` alias."""
    return (
        did_dim.select("did", F.explode("also_known_as").alias("alias"))
        .where(F.col("alias").startswith("at://"))
        .groupBy(F.substr("alias", F.lit(6)).alias("handle"))
        .agg(F.min("did").alias("owner"))
    )


def resolve_targets(references: DataFrame, did_dim: DataFrame) -> DataFrame:
    """Adds ``target``, the at_uri with a did as authority; null where it names no record."""
    rest = F.regexp_extract("target_uri", "^at://([^/]+)(/[^/]+/[^/]+)$", 2)
    authority = F.regexp_extract("target_uri", "^at://([^/]+)(/[^/]+/[^/]+)$", 1)
    parts = references.withColumn("authority", authority).withColumn("rest", rest)
    by_did = F.col("authority").startswith("did:")
    direct = parts.where(by_did).withColumn("target", F.col("target_uri"))
    named = (
        parts.where(~by_did)
        .join(handle_owners(did_dim), F.col("authority") == F.col("handle"), "left")
        .withColumn("target", F.concat(F.lit("at://"), F.col("owner"), F.col("rest")))
    )
    columns = [*references.columns, "target"]
    return direct.select(*columns).unionByName(named.select(*columns))


def staged_records(rows: DataFrame) -> DataFrame:
    """All records ever named as a written table (at_uri, deleted, refs, day), read by the filter, the references and the joins."""
    day = F.to_date(F.col("received_at").cast("timestamp"))
    state = record_state(rows, F.struct(record_references(rows).alias("refs"), day.alias("day")))
    payload = F.col(f"{VERSION}.payload")
    return stage_table(state.select(at_uri().alias("at_uri"), F.col(f"{VERSION}.deleted").alias("deleted"), payload["refs"].alias("refs"), payload["day"].alias("day")), "records")


def all_references(alive: DataFrame, delivery_log: DataFrame) -> DataFrame:
    """(src_table, src_key, day, target_uri); distinct but for repeated rows of the log."""
    # array_distinct works inside the row: no shuffle is needed to make references distinct
    records = alive.select(
        F.lit("jetstream_sample").alias("src_table"),
        F.col("at_uri").alias("src_key"),
        "day",
        F.explode(F.array_distinct("refs")).alias("target_uri"),
    )
    log = delivery_log.where(F.col("record_uri").startswith("at://")).select(
        F.lit("delivery_log").alias("src_table"),
        F.col("id").cast("string").alias("src_key"),
        F.to_date(F.col("created_at").cast("timestamp")).alias("day"),
        F.col("record_uri").alias("target_uri"),
    )
    return records.unionByName(log)


def orphan_references(rows: DataFrame, delivery_log: DataFrame, did_dim: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(src_table, src_key, day, target_uri, reason) of each reference whose target is not live.

    ``reason`` is deleted, never (no row names the record) or unresolved (the reference names no record).
    """
    records = staged_records(rows)
    alive = records.where("NOT deleted")
    references = resolve_targets(all_references(alive, delivery_log), did_dim)
    found = orphans(references, "target", alive.select(F.col("at_uri").alias("parent")), "parent", alive.count(), broadcast_words)
    gone = records.where("deleted").select(F.col("at_uri").alias("target"), F.lit("deleted").alias("gone"))
    reason = F.coalesce("gone", F.when(F.col("target").isNull(), "unresolved").otherwise("never"))
    # only orphans are made distinct and looked up among the tombstones
    return found.distinct().join(gone, "target", "left").withColumn("reason", reason).drop("target", "gone")


def orphan_report(found: DataFrame, *by: str) -> DataFrame:
    """Orphan references per referring table and day, and by what else is named."""
    return found.groupBy("src_table", "day", *by).agg(
        F.count(F.lit(1)).alias("orphans")
    )
