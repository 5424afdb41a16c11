"""Schemas that drift between files (problem 4).

1. ``profile`` parses each document once and reduces it to its signature
   against the published schema: required fields it lacks, listed fields of
   another type, unlisted fields with type and the required fields whose
   vocabulary or format their value meets. Equal signatures of a batch and type
   are counted before and after the shuffle, so a batch that holds a third of
   all rows is a few rows per task.
2. ``edit_script`` computes the minimum-cost script between two nested schemas,
   the tree edit distance for unordered trees in which equal names stay
   together: add, delete, rename, move and retype. The other children of a node
   are matched by an optimal assignment.
3. ``departures`` takes every row of its report from scripts between the
   published schema and the signatures. Which fields may be renamed at all is
   decided over the whole batch, in the engine: never beside the field they
   stand for, all values fit. A rename counts if a script with it is cheaper
   than the best one that leaves both fields alone; fields no script renames are
   added or deleted. Scripts are computed once for each distinct signature of
   all batches and joined back.
4. ``nested_departures`` compares whole trees, every field at any depth, with
   the most frequent shape of their collection; here fields move as well.
5. ``unify`` compiles the renames into one projection over all files, with all
   fields that have no column in one JSON object beside them, so that no value is lost.

Defined results for odd input: a null, empty or malformed document, or one that
is no object, has no fields and no departures; a null field counts as absent;
of repeated keys the last wins; collections without published fields are not
reported; an empty table gives an empty report.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.text import plain_json
from tidemark.operators.jsontree import parse, type_name
from tidemark.session import ship, stage_table

#: Formats of texts by name, as regular expressions.
FORMATS = {
    "datetime": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})",
    "nsid": r"[A-Za-z]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+\.[A-Za-z][A-Za-z0-9]*",
    "at-uri": r"at://[^\s/]+(/[^\s/]+(/[^\s/]+)?)?",
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:[^\s]+",
}
MAX_PUBLISHED = 100_000  # fields of the published schema; it is metadata, not data


# --- trees and scripts --------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A field of a schema: name, allowed types, whether records must have it, and nested fields."""

    name: str
    types: frozenset[str] = frozenset()
    required: bool = True
    children: tuple[Node, ...] = field(default=())

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def required_size(self) -> int:
        return (1 + sum(c.required_size() for c in self.children)) if self.required else 0


@dataclass(frozen=True)
class Edit:
    """One step of a script; paths are dotted, empty where there is no field on that side."""

    kind: str  # add, delete, rename, move, retype
    old: str
    new: str


def schema_tree(value, name: str = "") -> Node:
    """The schema of one JSON value; elements of an array are merged under the name ``[]``."""
    if isinstance(value, dict):
        kids = tuple(schema_tree(v, k) for k, v in sorted(value.items()) if v is not None)
        return Node(name, frozenset(["object"]), True, kids)
    if isinstance(value, list):
        merged = None
        for v in value:
            if v is not None:
                one = schema_tree(v, "[]")
                merged = one if merged is None else merge(merged, one)
        return Node(name, frozenset(["array"]), True, (merged,) if merged else ())
    return Node(name, frozenset([type_name(value)]))


def merge(a: Node, b: Node) -> Node:
    """The schema of values of either schema; fields of only one side become optional."""
    left, right = {c.name: c for c in a.children}, {c.name: c for c in b.children}
    kids = []
    for n in sorted({*left, *right}):
        x, y = left.get(n), right.get(n)
        if x and y:
            kids.append(merge(x, y))
        else:
            z = x or y
            kids.append(Node(z.name, z.types, False, z.children))
    return Node(a.name, a.types | b.types, a.required and b.required, tuple(kids))


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in the cheapest assignment; there are no more rows than columns.

    Shortest augmenting paths with potentials (Kuhn-Munkres), O(rows^2 columns).
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    far = float("inf")
    row_pot, col_pot, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        best, via, done = [far] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            done[at] = True
            row, step, nxt = owner[at], far, 0
            for j in range(1, m + 1):
                if not done[j]:
                    slack = cost[row - 1][j - 1] - row_pot[row] - col_pot[j]
                    if slack < best[j]:
                        best[j], via[j] = slack, at
                    if best[j] < step:
                        step, nxt = best[j], j
            for j in range(m + 1):
                if done[j]:
                    row_pot[owner[j]] += step
                    col_pot[j] -= step
                else:
                    best[j] -= step
            at = nxt
        while at:
            owner[at] = owner[via[at]]
            at = via[at]
    result = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            result[owner[j] - 1] = j - 1
    return result


def same_shape(old: Node, new: Node) -> bool:
    """The rename test for nested schemas without values: same types and same nested names."""
    return old.types == new.types and {c.name for c in old.children} == {c.name for c in new.children}


def edit_script(old: Node, new: Node, may_rename: Callable[[Node, Node], bool] = same_shape, moves: bool = True) -> tuple[int, list[Edit]]:
    """(cost, script) that turns ``old`` into ``new``.

    Adding a field costs 1 with each nested one, deleting costs 1 for each
    required one (an optional field may be absent for nothing), renaming and
    retyping cost 1, a move 1 instead of the delete and the add.
    """
    cost, script = _children_script(old, new, "", may_rename, {})
    return _with_moves(cost, script, old, new) if moves else (cost, script)


def _children_script(old: Node, new: Node, prefix: str, may_rename, memo: dict) -> tuple[int, list[Edit]]:
    if (known := memo.get((id(old), id(new), prefix))) is not None:
        return known
    left, right = {c.name: c for c in old.children}, {c.name: c for c in new.children}
    cost, script = 0, []
    for name in left.keys() & right.keys():
        a, b, path = left[name], right[name], prefix + name
        if a.types and not b.types <= a.types:
            cost += 1
            script.append(Edit("retype", path, path))
        if a.children:  # a field published without nested fields is open
            c, s = _children_script(a, b, f"{path}.", may_rename, memo)
            cost += c
            script += s
    lone = [c for n, c in sorted(left.items()) if n not in right]
    extra = [c for n, c in sorted(right.items()) if n not in left]
    renamed: dict[int, int] = {}
    if lone and extra:
        # square: fields against fields, or against nothing
        total, size = sum(c.size() for c in (*lone, *extra)) + 1, len(lone) + len(extra)
        table = [[0.0] * size for _ in range(size)]
        for i in range(size):
            for j in range(size):
                if i < len(lone) and j < len(extra):
                    a, b = lone[i], extra[j]
                    if may_rename(a, b):
                        inner = _children_script(a, b, "", may_rename, memo)[0] if a.children else 0
                        table[i][j] = 1 + inner + (not b.types <= a.types if a.types else 0)
                    else:
                        table[i][j] = 2 * total
                elif i < len(lone):
                    table[i][j] = lone[i].required_size()
                elif j < len(extra):
                    table[i][j] = extra[j].size()
        for i, j in enumerate(assign(table)):
            if i < len(lone) and j < len(extra) and table[i][j] < 2 * total:
                renamed[i] = j
    for i, a in enumerate(lone):
        if i in renamed:
            b = extra[renamed[i]]
            cost += 1
            script.append(Edit("rename", prefix + a.name, prefix + b.name))
            if a.types and not b.types <= a.types:
                cost += 1
                script.append(Edit("retype", prefix + a.name, prefix + b.name))
            if a.children:
                c, s = _children_script(a, b, f"{prefix}{a.name}.", may_rename, memo)
                cost += c
                script += s
        elif a.required:
            cost += a.required_size()
            script.append(Edit("delete", prefix + a.name, ""))
    for j, b in enumerate(extra):
        if j not in renamed.values():
            cost += b.size()
            script.append(Edit("add", "", prefix + b.name))
    memo[id(old), id(new), prefix] = cost, script
    return cost, script


def _find(tree: Node, path: str) -> Node | None:
    for name in path.split("."):
        tree = next((c for c in tree.children if c.name == name), None)
        if tree is None:
            return None
    return tree


def _with_moves(cost: int, script: list[Edit], old: Node, new: Node) -> tuple[int, list[Edit]]:
    """A field deleted in one place and added with the same name and shape in another has moved."""
    added = defaultdict(list)
    for e in script:
        if e.kind == "add" and (node := _find(new, e.new)):
            added[node.name].append((e, node))
    out, gone = [], set()
    for e in script:
        if e.kind == "delete" and (a := _find(old, e.old)):
            match = next(((x, b) for x, b in added[a.name] if x not in gone and same_shape(a, b)), None)
            if match:
                gone.add(match[0])
                cost += 1 - a.required_size() - match[1].size()
                out.append(Edit("move", e.old, match[0].new))
                continue
        out.append(e)
    return cost, [e for e in out if e not in gone]


# --- profiles -----------------------------------------------------------------


def published(lexicon: DataFrame) -> dict[str, list[dict]]:
    """The published schema by collection, on the driver; its size is checked, it does not grow with the data."""
    names = ("field_name", "json_types", "required", "known_values", "value_format")
    rows = lexicon.select("collection", *names).limit(MAX_PUBLISHED + 1).collect()
    if len(rows) > MAX_PUBLISHED:
        raise ValueError(f"the published schema has more than {MAX_PUBLISHED} fields")
    out: dict[str, list[dict]] = defaultdict(list)
    for r in rows:
        out[r["collection"]].append({n: r[n] for n in names})
    return dict(out)


class Signer:
    """Signatures of documents against the published fields of one collection."""

    def __init__(self, fields: list[dict]):
        self.types = {f["field_name"]: frozenset(f["json_types"] or ()) for f in fields}
        self.required = sorted(f["field_name"] for f in fields if f["required"])
        self.tests: list[tuple[str, Callable[[str], bool]]] = []
        for f in fields:
            if f["required"] and (test := self._test(f)):
                self.tests.append((f["field_name"], test))
        self.tests.sort(key=lambda t: t[0])

    @staticmethod
    def _test(f: dict) -> Callable[[str], bool] | None:
        if f["known_values"]:
            return frozenset(f["known_values"]).__contains__
        if f["value_format"]:
            pattern = re.compile(FORMATS.get(f["value_format"], r"(?!)"), re.ASCII)
            return lambda v: pattern.fullmatch(v) is not None
        return None

    def sign(self, record: dict) -> tuple:
        """(missing, mistyped, unlisted): the last as (name, type, fields whose values it fits)."""
        lacks = tuple(f for f in self.required if record.get(f) is None)
        mistyped, unlisted = [], []
        for name, value in record.items():
            if value is None:
                continue
            kind = type_name(value)
            allowed = self.types.get(name)
            if allowed is None:
                fits = tuple(f for f, test in self.tests if kind == "string" and test(value))
                unlisted.append((name, kind, fits))
            elif kind not in allowed:
                mistyped.append((name, kind))
        return lacks, tuple(sorted(mistyped)), tuple(sorted(unlisted))


PROFILE = "batch_no bigint, collection string, signature string, records bigint"


def profile(rows: DataFrame, schema: dict[str, list[dict]]) -> DataFrame:
    """(batch_no, collection, signature, records): how many records of a batch have each signature."""
    ship(rows.sparkSession)
    arrow = pa.schema([("batch_no", pa.int64()), ("collection", pa.string()), ("signature", pa.string()), ("records", pa.int64())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signers = {c: Signer(f) for c, f in schema.items()}
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            data = [(b, c, _written(s), n) for (b, c, s), n in counts.items()]
            counts.clear()
            columns = list(zip(*data)) if data else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for b, c, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                record = parse(t)
                if isinstance(record, dict):
                    counts[b, c, signers[c].sign(record)] += 1
            if len(counts) > 20_000:
                yield flush()
        yield flush()

    wanted = rows.where(F.col("record").isNotNull() & F.col("collection").isin(*schema)).select("batch_no", "collection", "record")
    return wanted.mapInArrow(reduce, PROFILE).groupBy("batch_no", "collection", "signature").agg(F.sum("records").alias("records"))


SIGNATURE = "struct<lacks:array<string>, mistyped:array<struct<name:string, kind:string>>, unlisted:array<struct<name:string, kind:string, fits:array<string>>>>"


def _written(signature: tuple) -> str:
    """The signature as JSON; equal ones are equal texts."""
    lacks, mistyped, unlisted = signature
    named = lambda rows, *names: [dict(zip(names, r)) for r in rows]
    return json.dumps({"lacks": lacks, "mistyped": named(mistyped, "name", "kind"), "unlisted": named(unlisted, "name", "kind", "fits")})


def stand_ins(signatures: DataFrame) -> DataFrame:
    """(batch_no, collection, pairs): which unlisted fields may stand for which required ones in a batch.

    A pair (required field, unlisted field) holds if it does in every signature
    with the unlisted field, that is, if it occurs as often as that field.
    """
    one = signatures.select("batch_no", "collection", "s.lacks", F.explode("s.unlisted").alias("u"))
    # the empty name counts the signatures with the field
    fields = F.explode(F.concat(F.array(F.lit("")), F.array_intersect("u.fits", "lacks")))
    counts = one.select("batch_no", "collection", F.col("u.name").alias("new"), fields.alias("old")).groupBy("batch_no", "collection", "new", "old").agg(F.count(F.lit(1)).alias("n"))
    by_field = counts.groupBy("batch_no", "collection", "new").agg(
        F.max(F.when(F.col("old") == "", F.col("n"))).alias("all"), F.collect_list(F.when(F.col("old") != "", F.struct("old", "n"))).alias("old")
    )
    held = by_field.select("batch_no", "collection", "new", F.explode(F.filter("old", lambda o: o["n"] == F.col("all"))).alias("o"))
    return held.groupBy("batch_no", "collection").agg(F.array_sort(F.collect_set(F.struct(F.col("o.old").alias("old"), "new"))).alias("pairs"))


class Comparer:
    """Departures from the published fields of one collection."""

    def __init__(self, fields: list[dict]):
        self.base = Node("", children=tuple(Node(f["field_name"], frozenset(f["json_types"] or ()), bool(f["required"])) for f in fields))

    def _shape(self, signature: dict) -> Node:
        wrong = {x["name"]: x["kind"] for x in signature["mistyped"]}
        typed = lambda n: Node(n.name, frozenset([wrong[n.name]]) if n.name in wrong else n.types)
        lacks = frozenset(signature["lacks"])
        seen = [typed(n) for n in self.base.children if (n.name not in lacks if n.required else n.name in wrong)]
        return Node("", children=(*seen, *(Node(x["name"], frozenset([x["kind"]])) for x in signature["unlisted"])))

    def departures(self, signature: dict, pairs: Iterable[tuple[str, str]]) -> set[tuple[str, str, str]]:
        """(kind, old, new) of a signature, from scripts in which only ``pairs`` may be renamed."""
        pairs = frozenset(pairs)
        shape = self._shape(signature)

        def script(old: Node, allowed: frozenset) -> tuple[int, list[Edit]]:
            # a stand-in fits by its values, so only the pair decides what may be renamed
            return edit_script(old, shape, lambda a, b: (a.name, b.name) in allowed, moves=False)

        _, best = script(self.base, pairs)
        renamed = set()
        for f, g in sorted(pairs):
            # nothing else may take f or g: with the pair, and with neither of them renamed
            others = frozenset(x for x in pairs if x[0] != f and x[1] != g)
            if script(self.base, others | {(f, g)})[0] < script(self.base, others)[0]:
                renamed.add((f, g))
        # scripts of equal cost: a field may be taken for any it fits, and any fitting field may be taken
        stood_for, standing = {f for f, _ in renamed}, {g for _, g in renamed}
        found = {("renamed", f, g) for f, g in renamed}
        for e in best:
            if e.kind == "retype" and e.old == e.new:
                found.add(("type", e.old, e.new))
            elif e.kind == "add" and e.new not in standing:
                found.add(("added", "", e.new))
            elif e.kind == "delete" and e.old not in stood_for:
                found.add(("removed", e.old, ""))
        return found


STEPS = "array<struct<kind:string, old_field:string, new_field:string>>"


def scripts(signatures: DataFrame, schema: dict[str, list[dict]]) -> DataFrame:
    """(script, steps) of distinct rows (script, collection, signature, pairs)."""
    ship(signatures.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(f"script string, steps {STEPS}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparers = {c: Comparer(f) for c, f in schema.items()}
        for batch in batches:
            steps = []
            for _, collection, signature, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                found = comparers[collection].departures(json.loads(signature), [(p["old"], p["new"]) for p in pairs])
                steps.append([dict(zip(("kind", "old_field", "new_field"), x)) for x in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps, arrow[1].type)], schema=arrow)

    return signatures.select("script", "collection", "signature", "pairs").mapInArrow(run, f"script string, steps {STEPS}")


def departures(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(batch_no, collection, kind, old_field, new_field) of each departure from the published schema."""
    schema = published(lexicon)
    signed = stage_table(profile(rows, schema).withColumn("s", F.from_json("signature", SIGNATURE)), "signatures")
    none = F.array().cast("array<struct<old:string,new:string>>")
    allowed = F.filter(F.coalesce("pairs", none), lambda p: F.exists("s.unlisted", lambda u: u["name"] == p["new"]))
    met = signed.join(stand_ins(signed), ["batch_no", "collection"], "left").withColumn("pairs", allowed)
    met = met.withColumn("script", F.sha2(F.concat_ws("\n", "collection", "signature", F.to_json("pairs")), 256))
    met = stage_table(met.select("batch_no", "collection", "signature", "pairs", "script"), "compared")
    # few bytes but much work: a fixed number of partitions keeps AQE from putting all scripts into one task
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = stage_table(scripts(met.dropDuplicates(["script"]).repartition(tasks, "script"), schema), "scripts")
    return met.join(known, "script").select("batch_no", "collection", F.explode("steps").alias("x")).select("batch_no", "collection", "x.*").distinct()


# --- whole trees --------------------------------------------------------------


def _as_text(node: Node) -> list:
    return [node.name, sorted(node.types), node.required, [_as_text(c) for c in node.children]]


def _as_node(text: list) -> Node:
    return Node(text[0], frozenset(text[1]), text[2], tuple(_as_node(c) for c in text[3]))


def shapes(rows: DataFrame) -> DataFrame:
    """(collection, shape, records): the nested schemas of records, and how many records have each."""
    ship(rows.sparkSession)
    arrow = pa.schema([("collection", pa.string()), ("shape", pa.string()), ("records", pa.int64())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            data = [(c, s, n) for (c, s), n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*data) if data else ((), (), ()), arrow)], schema=arrow)

        for batch in batches:
            for c, t in zip(*(batch.column(i).to_pylist() for i in range(2))):
                record = parse(t)
                if isinstance(record, dict):
                    counts[c, json.dumps(_as_text(schema_tree(record)))] += 1
            if len(counts) > 20_000:
                yield flush()
        yield flush()

    wanted = rows.where(F.col("record").isNotNull()).select("collection", "record")
    counted = wanted.mapInArrow(reduce, "collection string, shape string, records bigint")
    return counted.groupBy("collection", "shape").agg(F.sum("records").alias("records"))


def nested_departures(rows: DataFrame) -> DataFrame:
    """(collection, kind, old_field, new_field, records): edits from the most frequent shape of a collection, and how many records show each.

    Paths are dotted, elements of arrays are named ``[]``; of equally frequent
    shapes the first as text is taken.
    """
    found = stage_table(shapes(rows), "shapes")
    base = found.groupBy("collection").agg(F.min_by("shape", F.struct(-F.col("records"), "shape")).alias("base"))
    # one row for each collection, so the join adds nothing to the shapes but their base
    pairs = found.join(base, "collection").select("collection", "base", "shape", "records")
    schema = "collection string, records bigint, kind string, old_field string, new_field string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases: dict[str, Node] = {}
        for batch in batches:
            out = []
            for c, base_text, shape, n in zip(*(x.to_pylist() for x in batch.columns)):
                old = bases.get(base_text) or bases.setdefault(base_text, _as_node(json.loads(base_text)))
                out += [(c, n, e.kind, e.old, e.new) for e in edit_script(old, _as_node(json.loads(shape)))[1]]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out) if out else [()] * 5, arrow)], schema=arrow)

    edits = pairs.mapInArrow(compare, schema)
    return edits.groupBy("collection", "kind", "old_field", "new_field").agg(F.sum("records").alias("records"))


# --- one consistent table -----------------------------------------------------


def unify(rows: DataFrame, lexicon: DataFrame, found: DataFrame) -> DataFrame:
    """All records of all collections with the published fields as columns, renamed fields put back in their place.

    Every column is text: scalars plain, arrays and objects as JSON. A field
    that the record has itself goes before one that stands for it, and of
    several that stand for it the first by name; of repeated keys the last counts.
    A field of another type than published keeps its text. ``added`` is a JSON object of every
    other field that is not null: the unlisted ones, a second one that stands
    for the same field, and all without a column of collections that are not published.
    """
    schema = published(lexicon)
    names = sorted({f["field_name"] for fields in schema.values() for f in fields})
    required = {f["field_name"] for fields in schema.values() for f in fields if f["required"]}
    scripts = (
        found.where(F.col("kind") == "renamed")
        .groupBy("batch_no", "collection")
        .agg(F.array_sort(F.collect_set(F.struct("old_field", "new_field"))).alias("renames"))
    )
    doc = rows.where(F.col("record").isNotNull()).select(
        "seq", "batch_no", "did", "collection", "rkey", "record", F.from_json("record", "map<string,string>").alias("doc")
    )
    keys, entries = F.map_keys("doc"), F.map_entries("doc")
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(F.map_keys("doc"), i + 2, F.size("doc")), e["key"]))
    doc = doc.withColumn("doc", F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(last)).otherwise(F.col("doc")))
    beyond = F.rlike("record", F.lit(r"[\x{10000}-\x{10FFFF}]|\\u[dD][89abAB]"))
    doc = doc.withColumn("doc", F.when(beyond, F.transform_values("doc", lambda _, v: plain_json(v))).otherwise(F.col("doc"))).drop("record")
    joined = doc.join(scripts, ["batch_no", "collection"], "left")
    # the renames that the record needs and has a value for, then the first of each published field; sorted by it
    value = F.col("doc")
    needed = F.filter("renames", lambda r: value[r["old_field"]].isNull() & value[r["new_field"]].isNotNull())
    first = F.filter("needed", lambda r, i: (i == 0) | (F.get("needed", i - 1)["old_field"] != r["old_field"]))
    placed = joined.withColumn("needed", F.coalesce(needed, F.expr("array()").cast(joined.schema["renames"].dataType)))
    placed = placed.withColumn("taken", first)

    def column(name: str) -> Column:
        if name not in required:
            return value[name]
        return F.coalesce(value[name], value[F.get(F.filter("taken", lambda r: r["old_field"] == name), F.lit(0))["new_field"]])

    listed = F.array(*map(F.lit, names)).cast("array<string>")
    elsewhere = F.array_union(listed, F.transform("taken", lambda r: r["new_field"]))
    added = F.map_filter("doc", lambda k, v: v.isNotNull() & ~F.array_contains(elsewhere, k))
    plain = {n: n.replace("$", "") for n in names}
    return placed.select("seq", "batch_no", "did", "collection", "rkey", *(column(n).alias(f"f_{plain[n]}") for n in names), F.to_json(added).alias("added"))
