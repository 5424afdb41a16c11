"""One note per author and work: the ordered fold over an author's reviews and list items.

Records move between works, so what one fold must see together is the set of an
author's works that some record has ever been about. Those sets are components
of the (work, record) graph inside each author, so an account that holds a third
of all rows is cut into as many groups as it has unrelated works.

The rules of the fold, in short. A review contributes to the note of its work,
and a list item does if its list stands for a shelf. The note stays with the
record that first carried it; while nobody carries it, it is created on the
changed record, else the newest review, else the newest item, a record whose
note was deleted before only if there is no other. Its content is the newest
review's with the newest item's shelf, else the item's. A carrier that leaves
for a work whose note has a carrier, becomes an episode or is deleted gets a
Delete; the works left behind are derived anew.

Kept on purpose: a delete is answered with a Delete again when it is repeated;
after a delete without another carrier the note may be created on the deleted
record's own key; a list item that turns to a list without shelf loses its note
silently (``stranded`` counts these).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.operators import works as W
from tidemark.operators.folding import fold_groups
from tidemark.session import stage_table

EMITTED = "did string, seq bigint, step int, kind string, anchor string, source string, shelf string, work_key string"


@dataclass
class Row:
    """State of one record."""

    uri: str
    is_review: bool
    created: int
    work: str | None = None
    shelf: str | None = None
    note: bool = False  # carries a published note
    pending: bool = False  # carries a Delete that replaced its note
    deleted: bool = False

    def contributes(self) -> bool:
        return self.is_review or self.shelf is not None


class Author:
    """The fold over one group of an author's works; feed events in arrival order."""

    def __init__(self):
        self.rows: dict[str, Row] = {}
        self.of_work: dict[str, dict[str, Row]] = {}
        self.out: list[tuple] = []
        self.stranded = 0

    def emit(self, seq: int, kind: str, anchor: str, source: str | None = None, shelf: str | None = None, work: str | None = None) -> None:
        step = sum(1 for x in self.out[-8:] if x[0] == seq)
        self.out.append((seq, step, kind, anchor, source, shelf, work))

    def _members(self, work: str | None) -> list[Row]:
        """Active contributing records of a work, newest first; ties by key."""
        rows = [r for r in self.of_work.get(work, {}).values() if not r.deleted and r.contributes()]
        return sorted(rows, key=lambda r: (-r.created, r.uri))

    def _move(self, row: Row, work: str | None) -> None:
        if row.work is not None:
            self.of_work.get(row.work, {}).pop(row.uri, None)
        row.work = work
        if work is not None:
            self.of_work.setdefault(work, {})[row.uri] = row

    def derive(self, seq: int, work: str, trigger: Row | None) -> None:
        """Publish the note of a work as it stands now."""
        if work.startswith("tv_episode:"):
            return
        rows = self._members(work)
        review = next((r for r in rows if r.is_review), None)
        item = next((r for r in rows if not r.is_review), None)
        if review is None and item is None:
            return
        anchor = next((r for r in rows if r.note), None)
        kind = "update"
        if anchor is None:
            kind = "create"
            order = [r for r in (trigger, review, item) if r is not None]
            anchor = next((r for r in order if r.note or not r.pending), order[0])
        anchor.note, anchor.pending = True, False
        source = review or item
        self.emit(seq, kind, anchor.uri, source.uri, item.shelf if item else None, work)

    def rederive(self, seq: int, work: str | None) -> None:
        """Derive a work that a record has left, from its carrier or else its oldest contributing record."""
        if work is None or work.startswith("tv_episode:"):
            return
        rows = self._members(work)[::-1]
        trigger = next((r for r in rows if r.note), rows[0] if rows else None)
        if trigger is not None:
            self.derive(seq, work, trigger)

    def event(self, seq: int, uri: str, is_review: bool, operation: str, work: str | None, shelf: str | None) -> None:
        row = self.rows.get(uri)
        if operation == "delete":
            self._delete(seq, uri, row)
            return
        before = (row.note and not row.deleted, row.work if not row.deleted else None) if row else (False, None)
        if row is None:
            row = self.rows[uri] = Row(uri, is_review, seq)
        elif row.deleted:  # revived: it starts without forms
            row.deleted = row.note = row.pending = False
        had_note, old = before
        row.shelf = None if is_review else shelf
        is_episode = work is not None and work.startswith("tv_episode:")
        if is_episode:
            self._move(row, work)
            if had_note:
                row.note, row.pending = False, True
                self.emit(seq, "delete", uri)
            if old != work:
                self.rederive(seq, old)
        elif not is_review and (work is None or shelf is None):
            self.stranded += had_note
            row.note = row.pending = False
            self._move(row, work)
        elif work is None:  # a review without a work has a note of its own
            self._move(row, None)
            row.note = True
            self.emit(seq, operation, uri, uri)
        else:
            others = any(r.note and r.uri != uri for r in self._members(work))
            if had_note and old != work and others:
                row.note, row.pending = False, True
                self.emit(seq, "delete", uri)
            self._move(row, work)
            self.derive(seq, work, row)
            if old is not None and old != work:
                self.rederive(seq, old)

    def _delete(self, seq: int, uri: str, row: Row | None) -> None:
        if row is None or row.note:
            if row is not None:
                row.deleted = True
            self.emit(seq, "delete", uri)
            return
        was_part = not row.deleted and row.work is not None and row.contributes()
        row.deleted = True
        if was_part:
            self.derive(seq, row.work, row)


COLUMNS = ("did", "seq", "at_uri", "is_review", "operation", "work_key", "shelf")


def pairing():
    """The fold of one group: COLUMNS of an event to the activities it causes."""
    author = Author()

    def step(did, seq, uri, is_review, operation, work, shelf) -> list[tuple]:
        author.event(seq, uri, is_review, operation, work, shelf)
        out = [(did, *x) for x in author.out]
        author.out.clear()
        return out

    return step


def activities(rows: DataFrame, minted: DataFrame) -> DataFrame:
    """(did, seq, step, kind, anchor, source, shelf, work_key): every activity that the events of reviews and list items cause.

    ``rows`` are results of ``with_work``, ``minted`` tells the work each joined.
    """
    uri = F.concat(F.lit("at://"), "did", F.lit("/"), "collection", F.lit("/"), "rkey")
    shelf = R.shelf_of_item(F.col("doc.listType"), F.col("doc.creativeWorkType"))
    upsert = F.col("operation") != "delete"
    events = rows.where(F.col("collection").isin(R.REVIEW, R.LIST_ITEM)).select(
        "did",
        "seq",
        uri.alias("at_uri"),
        (F.col("collection") == R.REVIEW).alias("is_review"),
        "operation",
        F.when(upsert & (F.col("collection") == R.LIST_ITEM), shelf).alias("shelf"),
    )
    events = stage_table(events.join(minted.select("seq", F.col("minted_key").alias("work_key")), "seq", "left"), "pair-events")
    # records and works as nodes: a record's works over time belong together
    groups = events.groupBy("did", "at_uri").agg(F.collect_set("work_key").alias("works"))
    nodes = F.concat(F.array(F.col("at_uri")), F.transform("works", lambda w: F.concat(F.col("did"), F.lit("|"), w)))
    parts = W.components(groups.select(nodes.alias("nodes"))).where(F.startswith("node", F.lit("at://")))
    placed = events.join(parts, events["at_uri"] == parts["node"])
    return fold_groups(placed, "component", ["seq"], COLUMNS, pairing, EMITTED)
