"""Deeply nested records as related flat tables (problem 5).

``adjacency`` stores each node of a JSON document as one row: node and parent
number, label, ordinal in the array and scalar text, with keys that spare
later joins: ``entity``, the nearest enclosing array element (the row a scalar
belongs to), and the positions of the enclosing array elements. ``entities``
joins each element with its scalar children and pivots them into columns in one
aggregation, so that documents are parsed and shredded once; all nodes of an
element are written by one task, so the partial aggregation finishes it and the
shuffle carries one row per element. ``entity_tables`` gives a flat table for
each kind of array, its rows linked to those of the array around it.

Defined results for odd input: a null, empty or malformed document gives no
node; null nodes give no row but keep their position; of repeated keys in one
object the last wins; elements that are arrays themselves are nested further
(their elements get one more position); very long documents are walked without
recursion limits on arrays; a document with a null id is shredded like others.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators.jsontree import parse, scalar_text, type_name
from tidemark.session import ship

ADJACENCY = (
    "node int, parent int, entity int, above int, path string, label string, ordinal int, pos array<int>, kind string, scalar string"
)


def walk(document, keep: Sequence[str] | None = None, lone_strings: Sequence[str] = ()) -> Iterator[tuple]:
    """Nodes of a parsed object: (node, parent, entity, above, path, label, ordinal, pos, kind, scalar).

    ``path`` names the array the entity is an element of, ``above`` the entity around
    that array, ``label`` the way from the entity to the node. Top-level fields not in ``keep`` are skipped; those
    in ``lone_strings`` count as arrays of one if they hold a string.
    """
    if not isinstance(document, dict):
        return
    yield 0, -1, 0, 0, "", "", -1, [], "object", None
    count = 1
    todo = []
    for key in reversed(list(document)):
        if keep is None or key in keep:
            value = document[key]
            if key in lone_strings and type_name(value) == "string":
                value = [value]
            todo.append((value, 0, 0, 0, "", key, -1, []))
    while todo:
        value, parent, entity, above, path, label, ordinal, pos = todo.pop()
        if value is None:
            continue
        node, kind = count, type_name(value)
        count += 1
        if ordinal >= 0:
            entity, above = node, entity
        yield node, parent, entity, above, path, label, ordinal, pos, kind, scalar_text(value)
        if kind == "object":
            prefix = f"{label}." if label else ""
            todo.extend((value[k], node, entity, above, path, prefix + k, -1, pos) for k in reversed(list(value)))
        elif kind == "array":
            inner = ".".join(x for x in (path, label) if x)
            todo.extend((value[i], node, entity, above, inner, "", i, [*pos, i]) for i in range(len(value) - 1, -1, -1))


def adjacency(documents: DataFrame, key: str, text: str, keep: Sequence[str] | None = None, lone_strings: Sequence[str] = ()) -> DataFrame:
    """(key, node columns) of every document; ``keep`` limits it to some top-level fields."""
    ship(documents.sparkSession)
    picked = frozenset(keep) if keep is not None else None
    lone = frozenset(lone_strings)
    key_type = documents.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, {ADJACENCY}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = len(rows)
                rows.extend(walk(parse(t), picked, lone))
                keys.extend([k] * (len(rows) - before))
                if len(rows) >= 50_000:
                    yield _batch(keys, rows)
                    keys, rows = [], []
            yield _batch(keys, rows)

    def _batch(keys: list, rows: list) -> pa.RecordBatch:
        columns = [keys, *(zip(*rows) if rows else [[] for _ in range(len(arrow) - 1)])]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return documents.select(key, text).mapInArrow(shred, schema)


def entities(nodes: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """One row per element of an array: its place, its own scalar, and one column ``c_i`` per label with the scalar there.

    ``above`` is the enclosing element, 0 for elements of the document's own arrays.
    """
    own = F.col("ordinal") >= 0
    pivots = [F.max(F.when(~own & (F.col("label") == name), F.col("scalar"))).alias(f"c_{i}") for i, name in enumerate(labels)]
    marks = [F.max(F.when(~own & (F.col("label") == name), F.lit(True))).alias(f"has_{i}") for i, name in enumerate(labels)]
    place = F.struct("path", "above", F.get("pos", F.lit(0)).alias("pos1"), F.when(F.size("pos") > 1, F.try_element_at("pos", F.lit(-1))).alias("pos2"), "kind", "scalar")
    grouped = nodes.where(F.col("entity") > 0).groupBy(key, "entity").agg(F.max(F.when(own, place)).alias("place"), *pivots, *marks)
    pivoted = (c for i in range(len(labels)) for c in (f"c_{i}", f"has_{i}"))
    return grouped.where(F.col("place").isNotNull()).select(key, "entity", "place.*", *pivoted)


def entity_tables(nodes: DataFrame, key: str, columns: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """A table for each path in ``columns``: (key, id, parent_id, pos1, pos2, value, columns named) of its elements.

    ``parent_id`` is the ``id`` of the row that the array lies in, in the table of
    the path around it, and 0 where that is the document.
    """
    labels = sorted({c for names in columns.values() for c in names})
    rows = entities(nodes.where(F.col("path").isin(*columns)), key, labels)
    at = {name: i for i, name in enumerate(labels)}
    return {
        path: rows.where(F.col("path") == path).select(
            key, F.col("entity").alias("id"), F.col("above").alias("parent_id"), "pos1", "pos2", F.col("scalar").alias("value"), *(F.col(f"c_{at[n]}").alias(n) for n in names)
        )
        for path, names in columns.items()
    }


# --- the child tables of the commit stream -----------------------------------

CHILD_FIELDS = ("genres", "tags", "facets", "watchedEpisodes")
LONE_STRINGS = ("genres", "tags")
LABELS = ("name", "index.byteStart", "index.byteEnd", "index", "uri", "tag", "did", "seasonNumber", "episodeNumber")
_AT = {name: i for i, name in enumerate(LABELS)}


def _joined(left: str, mark: str, right: str) -> Column:
    return F.concat(
        F.coalesce(F.col(f"c_{_AT[left]}"), F.lit("")), F.lit(mark), F.coalesce(F.col(f"c_{_AT[right]}"), F.lit(""))
    )


def children(rows: DataFrame) -> DataFrame:
    """(seq, child, pos1, pos2, item) of every element nested in ``record``, for all collections.

    A genre or tag object without a name, and a feature without uri, tag and
    did, has a null item; a missing byte offset, season or episode number is
    written as nothing beside the mark.
    """
    # the text test only skips documents in which none of the names occurs at all
    wanted = F.col("record").isNotNull() & F.col("record").rlike("|".join(CHILD_FIELDS) + r"|\\u00")
    nodes = adjacency(rows.where(wanted), "seq", "record", CHILD_FIELDS, LONE_STRINGS)
    needed = (F.col("ordinal") >= 0) | F.col("label").isin(*LABELS)
    inside = nodes.where(needed & F.col("path").isin("genres", "tags", "facets", "facets.features", "watchedEpisodes"))
    c = lambda name: F.col(f"c_{_AT[name]}")
    has_index = F.coalesce(F.col(f"has_{_AT['index']}"), F.lit(False))
    item = (
        F.when(F.col("path").isin("genres", "tags"), F.coalesce("scalar", c("name")))
        .when(F.col("path") == "facets", F.when(has_index, _joined("index.byteStart", "-", "index.byteEnd")).otherwise(F.lit("")))
        .when(F.col("path") == "facets.features", F.coalesce(c("uri"), c("tag"), c("did")))
        .otherwise(_joined("seasonNumber", ":", "episodeNumber"))
    )
    child = (
        F.when(F.col("path") == "facets.features", F.lit("features"))
        .when(F.col("path") == "watchedEpisodes", F.lit("episodes"))
        .otherwise(F.col("path"))
    )
    # genres and tags may be plain, all others are objects
    wanted = (F.col("kind") == "object") | (F.col("path").isin("genres", "tags") & F.col("scalar").isNotNull())
    return entities(inside, "seq", LABELS).where(wanted).select(
        "seq", child.alias("child"), F.col("pos1").cast("bigint").alias("pos1"), F.coalesce("pos2", F.lit(-1)).cast("bigint").alias("pos2"), item.alias("item")
    )
