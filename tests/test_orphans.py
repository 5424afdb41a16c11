from tests.stream import frame
from tidemark.operators import orphans as O
from tidemark.operators.changefeed import commits

ITEM, REVIEW, LIST = O.LIST_ITEM, O.REVIEW, "social.popfeed.feed.list"
LOG = "id bigint, record_uri string, created_at timestamp_ntz, extra string"
DIDS = "did string, also_known_as array<string>"


def run(spark, rows, log=(), dids=(), **more):
    found = O.orphan_references(commits(frame(spark, list(rows))), spark.createDataFrame(list(log), LOG), spark.createDataFrame(list(dids), DIDS), **more)
    return sorted((r.src_table, r.src_key, r.target_uri) for r in found.collect())


def item(seq, key, target, rev="1", did="did:a"):
    return (seq, did, rev, "create", ITEM, key, '{"listUri": "%s"}' % target, f"c{seq}")


def alist(seq, key, rev="1", operation="create"):
    return (seq, "did:a", rev, operation, LIST, key, "{}" if operation != "delete" else None, None)


def uri(key, collection=LIST, did="did:a"):
    return f"at://{did}/{collection}/{key}"


def test_kinds_of_references(spark):
    rows = [
        item(1, "i1", uri("late")),
        alist(2, "late"),  # arrives after its reference
        item(3, "i2", uri("gone")),
        alist(4, "gone"),
        alist(5, "gone", "2", "delete"),
        item(6, "i3", uri("never")),
        item(7, "i4", ""),  # no reference
        item(8, "i5", "at://ann.test/" + LIST + "/late"),
        item(9, "i6", "at://nobody.test/" + LIST + "/late"),
        item(10, "i7", "at://did:a/odd"),
        (11, "did:a", "1", "create", REVIEW, "r", '{"crossPosts": {"x": "at://did:a/p/1", "y": "https://z", "w": null, "v": "%s"}}' % uri("late"), "c"),
        (12, "did:a", "1", "create", REVIEW, "r2", '{"crossPosts": null}', "c"),
        (13, "did:a", "1", "create", ITEM, "i8", "not json", "c"),
        (14, "did:a", "1", "create", ITEM, "i9", None, "c"),
    ]
    log = [(1, uri("late"), None, ""), (2, uri("never"), None, ""), (3, "https://x/1", None, ""), (4, None, None, ""), (5, uri("never"), None, "")]
    dids = [("did:a", ["at://ann.test", "https://x"]), ("did:a", ["at://ann.test"]), ("did:b", None), ("did:c", [])]
    assert run(spark, rows, log, dids) == sorted(
        [
            ("delivery_log", "2", uri("never")),
            ("delivery_log", "5", uri("never")),
            ("jetstream_sample", uri("i2", ITEM), uri("gone")),
            ("jetstream_sample", uri("i3", ITEM), uri("never")),
            ("jetstream_sample", uri("i6", ITEM), "at://nobody.test/" + LIST + "/late"),
            ("jetstream_sample", uri("i7", ITEM), "at://did:a/odd"),
            ("jetstream_sample", uri("r", REVIEW), "at://did:a/p/1"),
        ]
    )


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [], [(1, uri("x"), None, "")]) == [("delivery_log", "1", uri("x"))]


def test_a_filter_too_large_to_broadcast(spark):
    rows = [alist(i, f"l{i}") for i in range(400)] + [item(1000 + i, f"i{i}", uri(f"l{i}")) for i in range(300, 500)]
    exact = sorted(("jetstream_sample", uri(f"i{i}", ITEM), uri(f"l{i}")) for i in range(400, 500))
    assert run(spark, rows) == exact
    assert run(spark, rows, broadcast_words=1) == exact


def test_filter_grows_with_the_keys(spark):
    assert O.filter_words(1) == 1 << 10
    assert all(64 * O.filter_words(n) >= O.BITS_PER_KEY * n for n in (10**6, 10**9, 10**12))
    keys = spark.range(5000).selectExpr("cast(id as string) as k")
    assert O.bloom(keys, "k", 64).count() <= 64


def test_filter_proves_nearly_all_orphans(spark):
    """Less than one in a hundred references without a parent gets past the filter, whatever the number of keys."""
    for n in (1000, 300_000):
        parents = spark.range(n).selectExpr("concat('at://', id) AS k")
        references = spark.range(n, n + 50_000).selectExpr("concat('at://', id) AS target")
        for words in (O.BROADCAST_WORDS, 1):
            past = O.probed(references, "target", parents, "k", n, words).where("_possible").count()
            assert past < 500
        assert O.probed(parents.withColumnRenamed("k", "target"), "target", parents, "k", n).where("NOT _possible").count() == 0


def test_repeated_log_rows_and_reasons(spark):
    rows = [alist(4, "gone"), alist(5, "gone", "2", "delete"), alist(6, "here")]
    log = [(1, uri("gone"), None, ""), (1, uri("gone"), None, "x"), (2, uri("never"), None, ""), (3, "at://did:a/odd", None, ""), (4, uri("here"), None, "")]
    found = O.orphan_references(commits(frame(spark, rows)), spark.createDataFrame(log, LOG), spark.createDataFrame([], DIDS))
    assert sorted((r.src_key, r.reason) for r in found.collect()) == [("1", "deleted"), ("2", "never"), ("3", "unresolved")]


def test_report(spark):
    log = [(1, uri("x"), None, ""), (2, uri("y"), None, "")]
    found = O.orphan_references(commits(frame(spark, [])), spark.createDataFrame(log, LOG), spark.createDataFrame([], DIDS))
    assert [tuple(r) for r in O.orphan_report(found).collect()] == [("delivery_log", None, 2)]


def test_any_references_and_clashing_columns(spark):
    references = spark.createDataFrame([("p1", "w", 1), ("p2", None, 2), (None, "x", 3), ("p2", None, 2)], "target string, word string, bits int")
    parents = spark.createDataFrame([("p1", "w"), ("p1", "v"), (None, "u")], "k string, word string")
    found = O.orphans(references, "target", parents, "k", 2)
    assert sorted(map(tuple, found.collect()), key=str) == [("p2", None, 2), ("p2", None, 2), (None, "x", 3)]
    assert found.columns == ["target", "word", "bits"]
