import json

import pytest

import __spark_entry__ as entry
from tests.stream import frame

REVIEW, ITEM = "social.popfeed.feed.review", "social.popfeed.feed.listItem"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One author's records of works with all kinds of identifiers."""
    record = lambda kind, ids, **more: json.dumps({"creativeWorkType": kind, "identifiers": ids} | more)
    shelf = {"listType": "finished"}
    events = [
        (REVIEW, "film", record("movie", {"tmdbId": "7"})),
        (REVIEW, "series", record("tv_show", {"tmdbId": "7"})),  # another work with the same number
        (REVIEW, "game", record("video_game", {"igdbId": "5"})),
        (ITEM, "game", record("video_game", {"igdbId": "5"}, **shelf)),
        (ITEM, "album", record("album", {"mbId": "x"}, **shelf)),
        (REVIEW, "both", record("movie", {"imdbId": "tt1", "tmdbId": "8"})),
        (ITEM, "half", record("movie", {"tmdbId": "8"}, **shelf)),  # the same film by its other identifier
        (REVIEW, "none", record("movie", {})),
        (REVIEW, "gone", record("video_game", {"igdbId": "9"})),
    ]
    rows = [(i, "did:a", f"{i:03}", "create", c, k, r, "x") for i, (c, k, r) in enumerate(events)]
    rows.append((len(rows), "did:a", "999", "delete", REVIEW, "gone", None, None))
    path = str(tmp_path_factory.mktemp("pairs"))
    frame(spark, rows).write.parquet(f"{path}/jetstream_sample.parquet")
    dim = "did string, also_known_as array<string>, service array<struct<id string, serviceendpoint string>>"
    spark.createDataFrame([("did:a", ["at://a.b"], [("#pds", "https://p.example")])], dim).write.parquet(f"{path}/did_dim.parquet")
    return path


def rows(spark, folder, name):
    return sorted(tuple(x.split("feed.")[-1] if isinstance(x, str) else x for x in r) for r in entry.queries()[name](spark, folder).collect())


def test_latest(spark, folder):
    assert rows(spark, folder, "pair_latest") == sorted(
        [
            ("did:a", "movie:tmdbId-7", "review/film", None, None),
            ("did:a", "tv_show:tmdbId-7", "review/series", None, None),
            ("did:a", "video_game:igdbId-5", "review/game", "listItem/game", "complete"),
            ("did:a", "album:mbId-x", None, "listItem/album", "complete"),
            ("did:a", "movie:imdbId-tt1", "review/both", "listItem/half", "complete"),
        ]
    )


def test_holders(spark, folder):
    assert rows(spark, folder, "other_holder") == [("listItem/game",), ("listItem/half",), ("review/both",), ("review/game",)]
    found = {r.work: r.holders for r in entry.queries()["pair_holder"](spark, folder).collect()}
    assert found == {"movie:tmdbId-7": 1, "tv_show:tmdbId-7": 1, "video_game:igdbId-5": 2, "album:mbId-x": 1, "movie:imdbId-tt1": 2}
    # of two the newer one
    assert {r.work: r.anchor.split("/")[-1] for r in entry.queries()["pair_holder"](spark, folder).collect()}["video_game:igdbId-5"] == "game"
    assert {r.work: r.anchor.split(".")[-1] for r in entry.queries()["pair_holder"](spark, folder).collect()}["movie:imdbId-tt1"] == "listItem/half"
