import itertools
import json
import random

from tests.stream import frame
from tidemark.operators import drift as D
from tidemark.operators.changefeed import commits

LEXICON = "collection string, field_name string, json_types array<string>, required boolean, known_values array<string>, value_format string"
FIELDS = [
    ("c", "kind", ["string"], True, ["book", "movie"], None),
    ("c", "at", ["string"], True, None, "datetime"),
    ("c", "title", ["string"], True, None, None),
    ("c", "n", ["number"], False, None, None),
    ("d", "kind", ["string"], True, ["book"], None),
]
GOOD = {"kind": "book", "at": "2022-01-10T00:00:00.1Z", "title": "t"}


def run(spark, records):
    """Departures of records given as (batch, collection, dict or text)."""
    rows = [(i * 3, "a", "1", "create", c, f"k{i}", r if isinstance(r, str) or r is None else json.dumps(r), "x") for i, (_, c, r) in enumerate(records)]
    df = commits(frame(spark, rows))
    cases = " ".join(f"WHEN seq = {i * 3} THEN {b}" for i, (b, _, _) in enumerate(records)) or "WHEN false THEN 0"
    df = df.selectExpr("*", f"CAST(CASE {cases} END AS bigint) AS b").drop("batch_no").withColumnRenamed("b", "batch_no")
    return df, spark.createDataFrame(FIELDS, LEXICON)


def found(spark, records):
    df, lexicon = run(spark, records)
    return sorted((r.batch_no, r.collection, r.kind, r.old_field, r.new_field) for r in D.departures(df, lexicon).collect())


def without(*names, **more):
    return {k: v for k, v in GOOD.items() if k not in names} | more


def test_each_kind(spark):
    records = [
        (1, "c", GOOD),
        (2, "c", without("kind", sort="book")),  # renamed
        (3, "c", without("kind", sort="book")),
        (3, "c", GOOD | {"sort": "book"}),  # beside the field: added, and removed in the other record
        (4, "c", without("kind", sort="song")),  # a value that does not fit
        (5, "c", GOOD | {"title": None, "n": "1"}),  # null counts as absent, n has another type
        (6, "c", without("at", when="2022-01-10T00:00:00Z", then="2022-01-10T00:00:00+01:00")),  # both stand for it
        (7, "c", without("at", when="2022-01-10T00:00:00Z")),
        (7, "c", without("at")),  # another record simply lacks it
        (8, "d", {"kind": "book", "x": 2.50}),
        (9, "e", {"any": 1}),  # not published
        (10, "c", "[1]"),
        (10, "c", "broken"),
        (10, "c", None),
        (11, "c", GOOD | {"kind": 7}),
    ]
    assert found(spark, records) == sorted(
        [
            (2, "c", "renamed", "kind", "sort"),
            (3, "c", "added", "", "sort"),
            (3, "c", "removed", "kind", ""),
            (4, "c", "added", "", "sort"),
            (4, "c", "removed", "kind", ""),
            (5, "c", "removed", "title", ""),
            (5, "c", "type", "n", "n"),
            (6, "c", "renamed", "at", "when"),
            (6, "c", "renamed", "at", "then"),
            (7, "c", "renamed", "at", "when"),
            (7, "c", "removed", "at", ""),
            (8, "d", "added", "", "x"),
            (11, "c", "type", "kind", "kind"),
        ]
    )


def test_every_row_comes_from_a_script(spark, monkeypatch):
    records = [(2, "c", without("kind", sort="book")), (3, "c", GOOD | {"sort": "book"}), (4, "c", without("title")), (5, "c", GOOD | {"n": "1"})]
    assert len(found(spark, records)) == 4
    comparer = D.Comparer([dict(zip(("field_name", "json_types", "required"), f[1:4])) for f in FIELDS[:4]])
    signature = {"lacks": ["kind"], "mistyped": [], "unlisted": [{"name": "sort", "kind": "string", "fits": ["kind"]}]}
    assert comparer.departures(signature, [("kind", "sort")]) == {("renamed", "kind", "sort")}
    # a rename that costs as much as to delete and to add is none, and without scripts there is no row at all
    script = D._children_script
    dear = lambda *a: (lambda cost, edits: (cost + sum(e.kind == "rename" for e in edits), edits))(*script(*a))
    monkeypatch.setattr(D, "_children_script", dear)
    assert comparer.departures(signature, [("kind", "sort")]) == set()
    monkeypatch.setattr(D, "_children_script", lambda *a: (0, []))
    assert comparer.departures(signature, [("kind", "sort")]) == set()


def test_fields_that_fit_several(spark):
    """g1 fits one absent field and g2 both: each fitting pair is a rename, though one script cannot hold all."""
    rows = [{"field_name": n, "json_types": ["string"], "required": True} for n in ("f1", "f2")]
    unlisted = [{"name": "g1", "kind": "string", "fits": ["f1"]}, {"name": "g2", "kind": "string", "fits": ["f1", "f2"]}]
    pairs = [("f1", "g1"), ("f1", "g2"), ("f2", "g2")]
    assert D.Comparer(rows).departures({"lacks": ["f1", "f2"], "mistyped": [], "unlisted": unlisted}, pairs) == {("renamed", *p) for p in pairs}


def test_nested_departures(spark):
    usual = {"a": {"x": "t", "y": "t"}, "b": [{"k": 1}]}
    records = [(1, "c", usual)] * 3 + [
        (1, "c", {"a": {"y": "t"}, "b": [{"k": 1}], "x": "t"}),  # moved
        (2, "c", {"a": {"x": "t", "z": "t"}, "b": [{"k": "1"}]}),  # renamed and of another type
        (2, "c", {"a": {"x": "t", "z": "t"}, "b": [{"k": 1}, {"l": True}]}),
        (3, "e", {"only": 1}),
        (3, "e", None),
        (3, "e", "broken"),
    ]
    df, _ = run(spark, records)
    assert sorted(tuple(r) for r in D.nested_departures(df).collect()) == [
        ("c", "add", "", "b.[].l", 1),
        ("c", "move", "a.x", "x", 1),
        ("c", "rename", "a.y", "a.z", 2),
        ("c", "retype", "b.[].k", "b.[].k", 1),
    ]
    assert D.nested_departures(df.limit(0)).count() == 0


def test_empty(spark):
    assert found(spark, []) == []


def test_unify_puts_renamed_fields_back(spark):
    df, lexicon = run(spark, [(1, "c", GOOD), (2, "c", without("kind", sort="movie", n=2.50)), (3, "d", {"kind": None})])
    rows = {r.batch_no: r for r in D.unify(df, lexicon, D.departures(df, lexicon)).collect()}
    assert (rows[1].f_kind, rows[2].f_kind, rows[3].f_kind) == ("book", "movie", None)
    assert float(rows[2].f_n) == 2.5 and rows[1].f_n is None


def test_unify_keeps_every_value(spark):
    records = [
        (1, "c", GOOD | {"x": [1, {"y": "z"}], "none": None, "empty": ""}),  # added
        (2, "c", without("at", when="2022-01-10T00:00:00Z", then="2022-01-11T00:00:00Z")),  # two for one
        (3, "c", without("kind", sort="movie")),
        (3, "c", without("kind", sort="song")),  # does not fit, so that sort is added in the whole batch
        (4, "e", {"any": 1, "title": "u"}),  # not published
        (5, "c", without("kind", sort="movie", more="m")),  # renamed and added
        (6, "c", None),
        (7, "c", "broken"),
        (8, "c", '{"kind": "book", "n": 1, "x": 1, "n": 2, "x": null, "y": 1, "y": 3}'),  # of repeated keys the last
        (9, "c", GOOD | {"x": ["🎮\\uD83C\\uDFAE", "é"], "y": "🎮"}),
    ]
    df, lexicon = run(spark, records)
    rows = {r.seq // 3: r for r in D.unify(df, lexicon, D.departures(df, lexicon)).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert json.loads(rows[9].added) == {"x": '["🎮\\\\uD83C\\\\uDFAE","é"]', "y": "🎮"}
    assert rows[8].f_n == "2" and json.loads(rows[8].added) == {"y": "3"}
    added = {i: json.loads(r.added or "{}") for i, r in rows.items()}
    assert added[0] == {"x": '[1,{"y":"z"}]', "empty": ""} and rows[0].f_kind == "book"
    assert rows[1].f_at == "2022-01-11T00:00:00Z" and added[1] == {"when": "2022-01-10T00:00:00Z"}
    assert (rows[2].f_kind, added[2], added[3]) == (None, {"sort": "movie"}, {"sort": "song"})
    assert (rows[4].collection, rows[4].f_title, added[4]) == ("e", "u", {"any": "1"})
    assert (rows[5].f_kind, added[5]) == ("movie", {"more": "m"})
    assert rows[7].f_kind is None and not added[7]


def test_assignment_is_optimal():
    rng = random.Random(1)
    for n in range(1, 6):
        for _ in range(30):
            cost = [[rng.randint(0, 9) for _ in range(n + rng.randint(0, 1))] for _ in range(n)]
            m = min(map(len, cost))
            cost = [r[:m] for r in cost]
            if m < n:
                continue
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            assert sum(cost[i][j] for i, j in enumerate(D.assign(cost))) == best


def tree(value):
    return D.schema_tree(value)


def test_nested_scripts():
    cost, script = D.edit_script(tree({"a": {"x": "t", "y": "t"}, "b": 1 == 1}), tree({"a": {"x": "t", "z": "t"}, "b": "t"}))
    assert cost == 2 and {(e.kind, e.old, e.new) for e in script} == {("rename", "a.y", "a.z"), ("retype", "b", "b")}
    cost, script = D.edit_script(tree({"a": {"x": "t"}, "b": {"k": "t"}}), tree({"a": {"k2": True}, "b": {"k": "t", "x": "t"}}))
    assert ("move", "a.x", "b.x") in {(e.kind, e.old, e.new) for e in script}
    same = tree({"a": [{"b": 1}, {"b": "t", "c": None}]})
    assert D.edit_script(same, same) == (0, [])
    assert D.edit_script(tree({}), tree({"a": {"b": "t"}})) == (2, [D.Edit("add", "", "a")])
