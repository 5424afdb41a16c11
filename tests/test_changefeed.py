import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.stream import frame
from tidemark.operators.changefeed import RECORD, ChangeTable, commit_rank, commits, live_records, versioned


def expected(rows):
    """Live records by a plain loop."""
    groups = {}
    for seq, did, rev, operation, collection, rkey, _, cid in rows:
        if None not in (did, collection, rkey):
            groups.setdefault((did, collection, rkey), []).append((rev is not None, rev or "", seq, operation or "create", cid))
    best = {k: max(v, key=lambda x: x[:3]) for k, v in groups.items()}
    return {(f"at://{d}/{c}/{r}", v[4]) for (d, c, r), v in best.items() if v[3] != "delete"}


def found(spark, rows):
    return [tuple(r) for r in live_records(commits(frame(spark, rows))).collect()]


ROWS = [
    (1, "a", "3", "create", "c", "k", "{}", "x1"),
    (2, "a", "5", "delete", "c", "k", None, None),
    (3, "a", "4", "update", "c", "k", "{}", "x2"),  # ranks before the delete: stays dead
    (4, "b", None, "create", "c", "k", "{}", "y1"),
    (5, "b", None, None, "c", "k", "{}", "y2"),  # no revisions at all: the last arrival
    (6, "c", "1", "create", "c", "k", "{}", "z1"),
    (7, "c", None, "create", "c", "k", "{}", "z2"),  # a row without revision never beats one with
    (8, "d", "1", None, "c", "k", "{}", "w1"),
    (9, "d", "1", None, "c", "k", "{}", "w1"),  # repeated
    (10, None, "1", "create", "c", "k", "{}", "n"),
    (11, "e", "1", "create", None, "k", "{}", "n"),
    (12, "e", "1", "create", "c", None, "{}", "n"),
    (13, "f", "1", "create", "", "", "{}", "empty"),
]


def test_cases(spark):
    got = found(spark, ROWS)
    assert set(got) == expected(ROWS) and len(got) == len(set(got))
    assert ("at://f//", "empty") in got


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = commits(frame(spark, ROWS)).withColumns({"version": F.lit(1), "payload": F.lit("x"), "at_uri": F.lit("y"), "rank": F.lit(0)})
    assert {tuple(r) for r in live_records(rows).collect()} == expected(ROWS)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.sampled_from([None, "1", "2", "3"]), st.sampled_from([None, "create", "update", "delete"]), st.sampled_from("kl")),
        max_size=25,
    )
)
def test_any_order(spark, changes):
    rows = [(i, d, r, o, "c", k, None, f"{i}") for i, (d, r, o, k) in enumerate(changes)]
    assert set(found(spark, list(reversed(rows)))) == expected(rows)


def test_batches_in_any_order_give_one_table(spark, tmp_path):
    results = []
    for n, order in enumerate(itertools.islice(itertools.permutations(range(3)), 0, 6, 2)):
        table = ChangeTable(spark, f"file://{tmp_path}/t{n}", RECORD)
        for i in (*order, order[0]):  # the first batch comes twice
            batch = commits(frame(spark, [r for r in ROWS if r[0] % 3 == i]))
            table.apply(versioned(batch, RECORD, commit_rank(), F.col("operation") == "delete", F.col("cid")))
        results.append({(f"at://{r.did}/{r.collection}/{r.rkey}", r.payload) for r in table.live().collect()})
    assert all(r == expected(ROWS) for r in results)


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    table = ChangeTable(spark, f"file://{tmp_path}/t", RECORD, buckets=16)
    apply = lambda rows: table.apply(versioned(commits(frame(spark, rows)), RECORD, commit_rank(), F.col("operation") == "delete", F.col("cid")))
    with pytest.raises(LookupError):
        table.live()
    apply([])
    assert table.version() == 1 and table.state() is None
    apply([(i, "did:a", "1", "create", "c", f"k{i}", None, "x") for i in range(60)])
    before = table._versions()
    assert 8 < len(before) <= 16 and set(map(tuple, before.values())) == {(2,)}
    apply([(60, "did:a", "2", "delete", "c", "k7", None, None)])
    after = table._versions()
    assert sum(v[-1] == 3 for v in after.values()) == 1 and sum(v[-1] == 2 for v in after.values()) == len(before) - 1
    assert table.live().count() == 59 and table.state().count() == 60
    apply([])
    apply([(61, "did:a", "3", "update", "c", "k7", None, "y")])
    # of the changed bucket the version before last is gone
    assert max(map(len, table._versions().values())) <= 2 and table.live().count() == 60
