import random

from tidemark.operators import works as W

ROWS = "seq bigint, work_type string, work_key string, aliases array<struct<key string, id string>>, work_title string, poster string"


def expected(rows):
    """The ordered fold by a plain loop over all rows."""
    owner, out = {}, {}
    for seq, kind, key, aliases, *_ in sorted(rows):
        if key is None:
            continue
        names = [(kind, *a) for a in aliases]
        found = next((owner[a] for a in names if a in owner), key)
        for a in names:
            owner.setdefault(a, found)
        out[seq] = found
    return out


def record(seq, *ids, kind="m", title=None):
    return (seq, kind, f"{kind}:{ids[0][0]}-{ids[0][1]}" if ids else None, list(ids), title, None)


def mint(spark, rows):
    return {r.seq: r.minted_key for r in W.mint(spark.createDataFrame(rows, ROWS)).collect()}


def test_bridge_joins_the_first_and_leaves_the_other(spark):
    rows = [record(1, ("imdb", "1")), record(2, ("tmdb", "2")), record(3, ("imdb", "1"), ("tmdb", "2")), record(4, ("tmdb", "2")), record(5), record(6, ("imdb", "1"), kind="s")]
    assert mint(spark, rows) == {1: "m:imdb-1", 2: "m:tmdb-2", 3: "m:imdb-1", 4: "m:tmdb-2", 6: "s:imdb-1"}


def test_random_streams(spark):
    rng = random.Random(7)
    rows = [record(i, *dict.fromkeys((rng.choice("abc"), str(rng.randint(0, 12))) for _ in range(rng.randint(1, 3)))) for i in range(150)]
    assert mint(spark, rows) == expected(rows)


def test_components(spark):
    groups = [["a", "b"], ["b", "c"], ["d"], ["e", "f"], *[[f"n{i}", f"n{i + 1}"] for i in range(60)]]
    got = {r.node: r.component for r in W.components(spark.createDataFrame([(g,) for g in groups], "nodes array<string>")).collect()}
    assert got["a"] == got["c"] == "a" and got["d"] == "d" and got["f"] == "e"
    assert len({got[f"n{i}"] for i in range(61)}) == 1


def test_empty_and_catalog(spark):
    assert mint(spark, []) == {}
    rows = spark.createDataFrame([record(1, ("i", "1"), title=""), record(2, ("i", "1"), title="T"), record(3, ("i", "1"), title="U")], ROWS)
    r = W.catalog(rows, W.mint(rows)).first()
    assert (r.title, r.poster, r.records, r.first_seq) == ("T", None, 3, 1)


def test_groups_are_streamed_in_order(spark):
    from tidemark.operators.folding import fold_groups

    def start():
        seen = []

        def step(seq, value):
            seen.append(value)
            return [(seq, "".join(seen))] if value != "skip" else []

        return step

    rows = spark.createDataFrame([(g, s, v) for g in ("a", "b", None) for s, v in ((2, "y"), (1, "x"), (3, "skip"))], "g string, seq bigint, v string")
    got = sorted((r.seq, r.text) for r in fold_groups(rows.repartition(5), "g", ["seq"], ["seq", "v"], start, "seq bigint, text string").collect())
    assert got == [(1, "x")] * 3 + [(2, "xy")] * 3
    assert fold_groups(rows.limit(0), "g", ["seq"], ["seq", "v"], start, "seq bigint, text string").count() == 0
