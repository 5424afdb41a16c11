import json

import pytest
from pyspark.sql import functions as F

from tests.stream import frame
from tidemark.operators.changefeed import RECORD, ChangeTable, commits, live_records
from tidemark.operators.redelivery import SeenStore, redundant_rows
from tidemark.sources import events as E
from tidemark.streaming import ingest


def line(did, operation, key, rev="1", record=None, collection="c"):
    commit = {"rev": rev, "operation": operation, "collection": collection, "rkey": key, "cid": f"{key}-{rev}"}
    return json.dumps({"did": did, "time_us": 5, "kind": "commit", "commit": commit | ({"record": record} if record else {})})


LINES = [line("a", "create", "k", record={"t": [1, "é"]}), "", "  ", json.dumps({"did": "b", "kind": "identity", "identity": {"did": "b", "handle": "h"}}), line("a", "delete", "k", "2"), line("a", "create", "l", collection="d")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    return tmp_path


def test_lines(spark, folder):
    rows = E.read_events(spark, f"{folder}/in").orderBy("seq").collect()
    assert [(r.kind, r.did) for r in rows] == [("commit", "a"), ("identity", "b"), ("commit", "a"), ("commit", "a")]
    assert json.loads(rows[0].commit.record) == {"t": [1, "é"]} and rows[2].commit.record is None
    assert E.read_events(spark, f"{folder}/in").where(E.wanted(["d"])).count() == 1


def test_order_of_files(spark, tmp_path):
    """Arrival is by name and line, whatever the sizes of the files and the splits Spark makes of them."""
    sizes = {"1-old": 1, "2-new": 50, "3-last": 7}
    for name, n in sizes.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(line("a", "create", f"{name}-{i:02}", record={"pad": "x" * 200}) for i in range(n)))
    want = [f"{name}-{i:02}" for name, n in sizes.items() for i in range(n)]
    for size in ("1000b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = E.read_events(spark, str(tmp_path)).orderBy("seq").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.commit.rkey for r in rows] == want and [r.seq for r in rows] == list(range(58))


def test_stream_of_files_is_read_by_the_operators(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text("\n".join([line("a", "create", "k"), line("a", "update", "k", "3"), line("a", "create", "l")]))
    (tmp_path / "in/2.jsonl").write_text("\n".join([line("a", "delete", "l", "4"), line("a", "update", "k", "3"), "{broken"]))
    table = ChangeTable(spark, f"file://{tmp_path}/state", RECORD)
    ingest.keep_state(E.stream_events(spark, f"{tmp_path}/in", 1), table, F.col("cid"), f"{tmp_path}/c1").awaitTermination()
    assert [(r.rkey, r.payload) for r in table.live().collect()] == [("k", "k-3")]
    store = SeenStore(spark, f"file://{tmp_path}/seen")
    ingest.drop_redundant(E.stream_events(spark, f"{tmp_path}/in", 1), store, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.rkey, r.rev) for r in kept) == [("k", "1"), ("k", "3"), ("l", "1"), ("l", "4")]
    assert {r.seq // E.BATCH_ROWS for r in kept} == {0, 1} and all(r.batch_no == r.seq // E.BATCH_ROWS for r in kept)


def test_replay(spark, tmp_path):
    review, item = "social.popfeed.feed.review", "social.popfeed.feed.listItem"
    film = {"creativeWorkType": "movie", "identifiers": {"tmdbId": "7"}}
    lines = [line("did:a", "create", "r", record=film, collection=review), line("did:a", "create", "i", "2", film | {"listType": "finished"}, item), line("did:a", "delete", "r", "3", collection=review)]
    (tmp_path / "1.jsonl").write_text("\n".join(lines[:2]))
    (tmp_path / "2.jsonl").write_text(lines[2])
    got = [(r.seq, r.kind, r.anchor.split("/")[-1], r.shelf) for r in ingest.replay(spark, str(tmp_path)).orderBy("seq", "step").collect()]
    assert got == [(0, "create", "r", None), (1, "update", "r", "complete"), (2, "delete", "r", None)]


def test_malformed_line(spark, folder):
    (folder / "in/2.jsonl").write_text("{broken")
    assert E.read_events(spark, f"{folder}/in", strict=False).where("kind IS NULL").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        E.read_events(spark, f"{folder}/in").collect()


def test_data_source(spark, folder):
    E.register(spark)
    rows = spark.read.format("commitlog").option("path", f"{folder}/in").load()
    assert rows.count() == 3
    assert [r.rkey for r in rows.where("collection = 'd'").collect()] == ["l"]
    assert rows.where(F.col("collection").isin("c", "x")).count() == 2


def test_repository_records(spark):
    records = spark.createDataFrame([("at://did:a/c/k", "x", "{}"), (None, None, None)], "uri string, cid string, value string")
    got = E.from_repository(records).orderBy(F.col("did").desc_nulls_last()).collect()
    assert (got[0].did, got[0].commit.collection, got[0].commit.rkey, got[0].commit.rev) == ("did:a", "c", "k", None)
    assert got[1].did is None


ROWS = [(i, "ab"[i % 2], str(i % 5), ["create", "update", "delete"][i % 3], "c", "kl"[i % 4 // 2], "{}", str(i % 5)) for i in range(40)]


def streamed(spark, tmp_path):
    frame(spark, ROWS).repartitionByRange(4, "seq").write.parquet(f"{tmp_path}/files")
    stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/files")
    return commits(stream)


def test_stream_keeps_the_same_state(spark, tmp_path):
    table = ChangeTable(spark, f"file://{tmp_path}/state", RECORD)
    ingest.keep_state(streamed(spark, tmp_path), table, F.col("cid"), f"{tmp_path}/check").awaitTermination()
    got = {(f"at://{r.did}/{r.collection}/{r.rkey}", r.payload) for r in table.live().collect()}
    assert table.version() >= 4
    assert got == {tuple(r) for r in live_records(commits(frame(spark, ROWS))).collect()}


def test_stream_drops_redeliveries(spark, tmp_path):
    store = SeenStore(spark, f"file://{tmp_path}/seen")
    ingest.drop_redundant(streamed(spark, tmp_path), store, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out").count()
    assert kept == len(ROWS) - redundant_rows(commits(frame(spark, ROWS))).count()


def test_windows(spark, tmp_path):
    rows = commits(frame(spark, ROWS)).withColumn("received_at", F.timestamp_seconds(F.col("seq") * 600))
    counts = ingest.counts_by_window(rows).groupBy("start").agg(F.sum("n").alias("n")).orderBy("start").collect()
    assert [r.n for r in counts] == [6, 6, 6, 6, 6, 6, 4]
