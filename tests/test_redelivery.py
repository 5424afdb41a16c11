import random

import pytest

from tests.stream import frame
from tidemark.operators.changefeed import commits
from tidemark.operators.redelivery import SeenStore, exactly_once, redundant_rows


def expected(rows):
    """Redundant rows by a plain loop over all of them."""
    first, marked, weak, out = {}, set(), {}, set()
    for seq, did, rev, _, c, k, _, cid in sorted(rows):
        if rev is not None:
            marked.add((did, c, k, cid))
            if first.setdefault((did, rev, c, k), seq) != seq:
                out.add(seq)
        elif weak.setdefault((did, c, k, cid), seq) != seq:
            out.add(seq)
    return out | {seq for key, seq in weak.items() if key in marked}


def stream(n, seed=0):
    rng = random.Random(seed)
    pick = lambda x: rng.choice(x)
    return [(i, pick(["a", "b", None]), pick([None, "1", "2", ""]), "create", pick("cd"), pick("kl"), None, pick(["x", "y", None])) for i in range(n)]


def seqs(df):
    got = [r.seq for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("rows", [stream(60), stream(200, 1), [], stream(1), [(i, "a", "1", None, "c", "k", None, "x") for i in range(50)]])
def test_whole_table(spark, rows):
    assert seqs(redundant_rows(commits(frame(spark, rows)))) == expected(rows)


def test_whole_table_is_decided_by_bits(spark):
    rows = stream(200, 5)
    path = SeenStore(spark).path
    assert seqs(redundant_rows(commits(frame(spark, rows)), path)) == expected(rows)
    store = SeenStore(spark, path)
    assert store.version() > 1
    # later runs meet identities of earlier ones, and overtake some
    assert store.dictionary().count() == len({x for r in rows for x in [(r[1], r[7], r[4], r[5], 0)] + [(r[1], r[2], r[4], r[5], 1)] * (r[2] is not None)})
    assert sum(store._read("overtaken", [n]).count() for n in range(2, store.version() + 1)) > 0


@pytest.mark.parametrize("cuts", [[20, 40, 41], [1, 2, 3], [0, 30]])
def test_batches_give_the_same(spark, cuts):
    rows = stream(80, 2)
    store, got = SeenStore(spark), set()
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        got |= seqs(store.accept(commits(frame(spark, rows[low:high]))))
    assert got == expected(rows)


def test_repeated_and_failed_batches(spark, monkeypatch):
    rows = stream(90, 3)
    store = SeenStore(spark)
    first, second = commits(frame(spark, rows[:50])), commits(frame(spark, rows[50:]))
    got = seqs(store.accept(first, 0))
    assert seqs(store.accept(first, 0)) == got and store.version() == 1
    write = SeenStore._write

    def fails(self, df, what, number):
        if what == "bitmaps":
            raise OSError("lost")
        return write(self, df, what, number)

    monkeypatch.setattr(SeenStore, "_write", fails)
    with pytest.raises(OSError):
        store.accept(second, 1)
    monkeypatch.setattr(SeenStore, "_write", write)
    assert store.version() == 1
    # the dictionary has grown, but no bit was set: the batch runs again as if new
    assert got | seqs(store.accept(second, 1)) == expected(rows)


def test_no_bits_no_decision(spark, monkeypatch):
    """Emptied between the runs, the bitmaps let copies in again."""
    rows = stream(200, 5)
    monkeypatch.setattr(SeenStore, "bitmaps", lambda self: None)
    with pytest.raises(AssertionError):
        assert seqs(redundant_rows(commits(frame(spark, rows)))) == expected(rows)


def test_compaction_changes_nothing(spark):
    rows = stream(120, 6)
    part = lambda a, b: commits(frame(spark, rows[a:b]))
    store = SeenStore(spark)
    store.compact()  # nothing yet
    got = seqs(store.accept(part(0, 40), 0)) | seqs(store.accept(part(40, 80), 1))
    known = store.dictionary().count()
    store.compact()
    assert len(store._dictionary_parts()) == 1 and store.dictionary().count() == known and store.version() == 2
    assert seqs(store.accept(part(40, 80), 1)) <= got  # a batch of before is still known
    got |= seqs(store.accept(part(80, 100), 2))
    store.compact()
    got |= seqs(store.accept(part(100, 120), 3))
    assert got == expected(rows)
    codes = [r.code for r in store.dictionary().collect()]
    assert len(codes) == len(set(codes))


def test_codes_run_out_loudly(spark, monkeypatch):
    store = SeenStore(spark)
    store.accept(commits(frame(spark, stream(20))))
    monkeypatch.setattr("tidemark.operators.redelivery.TASK_BITS", 0)
    with pytest.raises(OverflowError):
        store.accept(commits(frame(spark, stream(20, 9))))


def test_bitmaps_hold_one_bit_per_identity(spark):
    rows = stream(120, 4)
    store = SeenStore(spark)
    store.accept(commits(frame(spark, rows)))
    bits = store.bitmaps().selectExpr("sum(bitmap_count(seen)) AS n").first().n
    assert bits == store.dictionary().count()


def test_exactly_once(spark):
    rows = stream(60, 5)
    kept = exactly_once(commits(frame(spark, rows)))
    assert {r.seq for r in kept.collect()} == {r[0] for r in rows} - expected(rows)
