import json
from collections import Counter

from tests.stream import frame
from tidemark.operators.changefeed import commits
from tidemark.operators.jsontree import parse, scalar_text
from tidemark.operators.shredding import adjacency, children, entity_tables, walk


def run(spark, records):
    rows = [(i, "a", "1", "create", "c", f"k{i}", r if isinstance(r, str) or r is None else json.dumps(r), "x") for i, r in enumerate(records)]
    return Counter(tuple(r) for r in children(commits(frame(spark, rows))).collect())


def test_forms(spark):
    records = [
        {"genres": ["a", None, " b ", {"name": "c", "id": 3}, {"id": 4}, 5, True, ""], "tags": "lone", "other": ["x"]},
        {"genres": [], "tags": None, "facets": [], "watchedEpisodes": None},
        {
            "facets": [
                {"index": {"byteStart": 1, "byteEnd": 20}, "features": [{"uri": "u", "tag": "t"}, None, {"tag": "t"}, {"did": "d"}, {}]},
                None,
                {"features": [{"uri": "v"}]},
                {"index": None},
            ],
            "watchedEpisodes": [{"seasonNumber": 1, "episodeNumber": 2}, {"episodeNumber": "x"}],
        },
        '{"genres": ["1"], "genres": ["2"]}',
        "[]", "", "broken", None, '"text"',
        '{"\\u0067enres": ["escaped"]}',
        '{"tags": [2.50, 1e3, 12345678901234567890]}',
    ]
    assert run(spark, records) == Counter(
        [
            (0, "genres", 0, -1, "a"),
            (0, "genres", 2, -1, " b "),
            (0, "genres", 3, -1, "c"),
            (0, "genres", 4, -1, None),
            (0, "genres", 5, -1, "5"),
            (0, "genres", 6, -1, "true"),
            (0, "genres", 7, -1, ""),
            (0, "tags", 0, -1, "lone"),
            (2, "facets", 0, -1, "1-20"),
            (2, "facets", 2, -1, ""),
            (2, "facets", 3, -1, ""),
            (2, "features", 0, 0, "u"),
            (2, "features", 0, 2, "t"),
            (2, "features", 0, 3, "d"),
            (2, "features", 0, 4, None),
            (2, "features", 2, 0, "v"),
            (2, "episodes", 0, -1, "1:2"),
            (2, "episodes", 1, -1, ":x"),
            (3, "genres", 0, -1, "2"),
            (9, "genres", 0, -1, "escaped"),
            (10, "tags", 0, -1, "2.50"),
            (10, "tags", 1, -1, "1e3"),
            (10, "tags", 2, -1, "12345678901234567890"),
        ]
    )


def test_empty(spark):
    assert run(spark, []) == Counter()


def test_tables_are_linked(spark):
    text = '{"facets": [{"features": [{"uri": "u"}, {"uri": "v"}]}, null, {"index": {"byteStart": 3}, "features": [{"tag": "t"}]}], "tags": ["x"]}'
    df = spark.createDataFrame([("d", text), ("e", text)], "id string, t string")
    tables = entity_tables(adjacency(df, "id", "t").withColumnRenamed("id", "doc"), "doc", {"facets": ["index.byteStart"], "facets.features": ["uri", "tag"], "tags": []})
    joined = tables["facets.features"].alias("k").join(tables["facets"].alias("p"), ["doc"]).where("k.parent_id = p.id")
    got = sorted((r.doc, r.up, r.at, r.uri or r.tag) for r in joined.selectExpr("doc", "p.pos1 AS up", "k.pos2 AS at", "uri", "tag").collect())
    assert got == sorted((d, *x) for d in "de" for x in [(0, 0, "u"), (0, 1, "v"), (2, 0, "t")])
    assert [(r.parent_id, r.value) for r in tables["tags"].where("doc = 'd'").collect()] == [(0, "x")]
    assert {r["index.byteStart"] for r in tables["facets"].collect()} == {None, "3"}


def rebuilt(rows):
    """The document again from its adjacency rows: the shredding loses nothing but nulls."""
    kids = {}
    for row in rows:
        kids.setdefault(row[1], []).append(row)

    def build(row):
        _, _, _, _, _, label, _, _, kind, scalar = row
        inner = kids.get(row[0], [])
        if kind == "object":
            return {r[5].removeprefix(f"{label}.") if label else r[5]: build(r) for r in inner}
        if kind == "array":
            return [(r[6], build(r)) for r in inner]
        return scalar

    return build(kids[-1][0])


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [(i, plain(v)) for i, v in enumerate(value) if v is not None]
    return scalar_text(value)


def test_round_trip():
    text = '{"a": {"b": [1, [2.0, {"c": null, "d": [true]}], null, "x"], "e": {}}, "f": 12345678901234567890, "g": []}'
    assert rebuilt(list(walk(parse(text)))) == plain(parse(text))


def test_long_documents_and_key_types(spark):
    deep = '{"tags": [' + ",".join(f'"{i}"' for i in range(20_000)) + "]}"
    df = spark.createDataFrame([("x", deep), (None, '{"tags": ["y"]}')], "id string, t string")
    assert adjacency(df, "id", "t").groupBy("id").count().orderBy("id").collect()[1]["count"] == 20_002
