import random

from pyspark.sql import functions as F

from tidemark.operators import accounts as U


def test_opting_out_and_in(spark):
    events = spark.createDataFrame([("a", i, "x") for i in range(1, 8)] + [("b", 3, "x"), (None, 4, "x")], "did string, seq bigint, controls string")
    controls = spark.createDataFrame([("a", 2, "opt_out"), ("a", 5, "opt_in"), ("a", 2, "opt_out")], "did string, seq bigint, control string")
    got = U.accepted(events.drop("controls"), controls).collect()
    assert sorted((r.did or "", r.seq) for r in got) == [("", 4), ("a", 1), ("a", 2), ("a", 6), ("a", 7), ("b", 3)]
    archive = spark.createDataFrame([("a", 1, False), ("a", 3, False), ("a", 1, True), ("b", 1, False)], "did string, updated_seq bigint, deleted boolean")
    got = sorted((r.did, r.updated_seq, r.deleted, r.purged) for r in U.purged(archive, controls).collect())
    assert got == [("a", 1, True, False), ("a", 1, True, True), ("a", 3, False, False), ("b", 1, False, False)]
    assert U.accepted(events.limit(0).drop("controls"), controls.limit(0)).count() == 0


def test_profiles_keep_what_is_not_empty(spark):
    rows = spark.createDataFrame([("a", 1, "n1", "v1"), ("a", 2, "", None), ("a", 3, None, "v3"), ("b", 1, None, "")], "did string, seq bigint, n string, v string")
    assert sorted(map(tuple, U.profile_state(rows, F.col("n"), F.col("v")).collect())) == [("a", "n1", "v3"), ("b", None, None)]


def test_merged_identifiers(spark):
    rows = spark.createDataFrame([(1, {"x": "1", "y": "1"}), (2, {"x": "2"}), (3, {}), (4, None)], "seq bigint, ids map<string,string>")
    minted = spark.createDataFrame([(1, "w"), (2, "w"), (3, "w"), (4, "z")], "seq bigint, minted_key string")
    assert [(r.work_key, r.ids) for r in U.merged_identifiers(rows, minted).collect()] == [("w", {"x": "2", "y": "1"})]


def test_answers(spark):
    cases = [(False, True, "h", True, False, False), (True, False, "h", True, False, False), (True, True, "h", False, False, True), (True, True, "h", True, True, True), (True, True, "h", True, True, False), (True, True, None, False, False, False), (True, True, "h", True, False, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a boolean, r boolean, h string, k boolean, o boolean, own boolean")
    answer = U.follow_answer(*(F.col(c) for c in ("a", "r", "h", "k", "o", "own")))
    got = [tuple(r.x) for r in df.select("i", answer.alias("x")).orderBy("i").collect()]
    assert got == [(400, None), (202, None), (404, None), (202, "Accept"), (202, "Reject"), (202, "Reject"), (202, "Accept")]
    kinds = spark.createDataFrame([("Follow", "1"), ("Like", "1"), (None, "1"), ("Note", "1"), (None, None)], "t string, i string")
    assert [r.k for r in kinds.select(U.undo_kind(F.col("t"), F.col("i")).alias("k")).collect()] == ["follow", "like", "like", "ignored", "ignored"]


def test_buckets_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    controls = [(rng.choice("ab"), rng.randint(0, 60), rng.choice([U.OPT_OUT, U.OPT_IN])) for _ in range(30)]
    events = [(rng.choice("abc"), i) for i in range(0, 70, 2)]
    want = set()
    for did, seq in events:
        past = sorted((s, c) for d, s, c in controls if d == did and s < seq)
        if not past or past[-1][1] != U.OPT_OUT:
            want.add((did, seq))
    frames = spark.createDataFrame(events, "did string, seq bigint"), spark.createDataFrame(controls, "did string, seq bigint, control string")
    for span in (1, 5, 1 << 16):
        monkeypatch.setattr(U, "SPAN", span)
        assert {tuple(r) for r in U.accepted(*frames).collect()} == want
    assert U.accepted(frames[0].limit(0), frames[1]).count() == 0 and U.accepted(frames[0], frames[1].limit(0)).count() == len(events)
