import json

from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import records as R
from tidemark.functions import text as T

SCHEMA = "did string, collection string, rkey string, record string, time_us bigint, operation string, label string, shelf string, handle string"


def notes(spark, *rows):
    data = [("did:a", c, f"k{i}", json.dumps(r), 5, op, label, shelf, "ann.test") for i, (c, r, op, label, shelf) in enumerate(rows)]
    df = R.with_work(R.fields(spark.createDataFrame(data, SCHEMA)))
    df = df.withColumn("text_html", T.render_facets(F.coalesce("doc.text", F.lit("")), F.col("doc.facets")))
    made = df.select("rkey", F.to_json(D.note("https://b", F.lit("2022-01-01T00:00:00Z"), "~neodb~")).alias("n")).orderBy("rkey").collect()
    return [json.loads(r.n) for r in made]


def test_notes(spark):
    review = {"title": "A & B", "text": "so <good>", "rating": 9.0, "tags": ["x"], "createdAt": "2021-01-01T00:00:00Z", "creativeWorkType": "movie", "identifiers": {"imdbId": "tt1"}, "posterUrl": "https://p"}
    a, b, c, d, e = notes(
        spark,
        (R.REVIEW, review, "create", None, "complete"),
        (R.REVIEW, {"text": "", "rating": True, "createdAt": {}, "addedAt": "t", "containsSpoilers": True}, "update", None, None),
        (R.LIST_ITEM, {"title": "T", "identifiers": {"tmdbId": 2}, "creativeWorkType": "movie"}, "create", "My <list>", "wishlist"),
        (R.BOOK, {"$type": R.BOOK, "title": "B", "hiveId": "h", "status": "x#reading"}, "create", None, None),
        (R.BOOK, {"$type": R.BOOK, "hiveId": "h", "stars": 8, "review": "one\n\ntwo", "createdAt": {"a": 1}, "addedAt": "t"}, "create", None, None),
    )
    url = "https://b/catalog/movie/imdbId-tt1"
    assert a["id"] == a["url"] == "https://b/users/ann.test/posts/k0" and a["published"] == "2021-01-01T00:00:00Z"
    assert a["content"] == '<p>Rated <a href="https://b/~neodb~/catalog/movie/imdbId-tt1">A &amp; B</a> 9/10</p><p>so &lt;good&gt;</p>'
    assert [x["type"] for x in a["relatedWith"]] == ["Rating", "Comment", "Status"] and a["relatedWith"][0]["value"] == 9.0
    assert a["tag"] == [{"type": "Hashtag", "name": "#x"}, {"type": "Movie", "href": url, "name": "A & B", "image": "https://p"}, {"type": "Hashtag", "name": "#movie"}]
    assert "updated" not in a and "sensitive" not in a
    assert b["content"] == "<p>Reviewed <strong>a work</strong></p>" and b["summary"] == "Spoilers: a work" and b["sensitive"] is True
    assert "tag" not in b and "relatedWith" not in b and b["published"] == "t" and b["updated"] == "2022-01-01T00:00:00Z"
    assert c["content"].endswith("</a> to <strong>My &lt;list&gt;</strong></p>") and c["relatedWith"][0]["status"] == "wishlist"
    assert d["content"].startswith("<p>Reading <a ") and d["published"] == "1970-01-01T00:00:00.000005+00:00"
    assert e["content"].startswith("<p>Rated <a ") and e["content"].endswith(" 8/10</p><p>one</p><p>two</p>") and [x["type"] for x in e["relatedWith"]] == ["Rating", "Comment"]
    assert e["published"] == "1970-01-01T00:00:00.000005+00:00"  # a filled object hides addedAt


def test_activities(spark):
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([("create",), ("update",), ("delete",)], "kind string")
    made = D.activity(F.col("kind"), F.struct(F.lit("n").alias("id")), F.lit("https://b/1"), F.lit("a"), none, F.lit("1970-01-01T00:00:01Z"))
    rows = {r.kind: json.loads(r.x) for r in df.select("kind", F.to_json(made).alias("x")).collect()}
    assert (rows["create"]["id"], rows["create"]["type"]) == ("https://b/1#create", "Create")
    assert rows["update"]["id"] == "https://b/1#updates/1000000"
    assert rows["delete"]["tombstone"] == {"id": "https://b/1", "type": "Tombstone", "formerType": "Note"} and "note" not in rows["delete"]


def test_post_page(spark):
    rows = [(R.REVIEW, {"title": "A", "text": "so <good>", "tags": ["x", "y"], "creativeWorkType": "movie", "identifiers": {"imdbId": "tt1"}, "posterUrl": "https://p"}, "create", None, None), (R.REVIEW, {"text": "", "containsSpoilers": True}, "create", None, None)]
    data = [("did:a", c, f"k{i}", json.dumps(r), 5, op, label, shelf, "ann.test") for i, (c, r, op, label, shelf) in enumerate(rows)]
    df = R.with_work(R.fields(spark.createDataFrame(data, SCHEMA))).withColumn("text_html", F.concat(F.lit('<a href="javascript:x">'), F.coalesce("doc.text", F.lit("")), F.lit("</a>")))
    made = df.withColumn("n", D.note("https://b", F.lit("2022-01-01T00:00:00Z"), "~neodb~")).select("rkey", D.post_page(F.col("n"), F.col("handle")).alias("p"), D.shown_json(F.struct("rkey")).alias("j")).orderBy("rkey").collect()
    a, b = made[0].p, made[1].p
    assert a.hashtags == ["#x", "#y", "#movie"] and (a.work.type, a.work.image) == ("Movie", "https://p") and "javascript" not in a.content
    assert a.og_title == "Post by @ann.test" and a.url == "https://b/users/ann.test/posts/k0" and "<" not in a.description
    assert b.description == "Spoilers: a work" and b.work is None and b.hashtags == []
    assert made[0].j == '{\n  "rkey" : "k0"\n}'
