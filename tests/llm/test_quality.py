import os
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import prose
from tidemark.llm import quality as Q
from tidemark.llm.prose import Reader, lines_of, runs_of

COMMON = {"en": "the of and to in is that it was for i you this have at he she we all when there".split(), "ja": ["の", "は"], "de": "die der und ist das nicht ich es mit".split()}
PROSE = [
    "The harbour was quiet when we came back, and she told me that it had rained for days.",
    "the harbour was quiet when we came back and she told me that it had rained for days",
    "THE HARBOUR WAS QUIET WHEN WE CAME BACK, AND SHE TOLD ME THAT IT HAD RAINED.",
    "<p>It was a long night, and the lights of the town went out.</p><p>I did not sleep.</p>",
    "- It was a long night, and the lights of the town went out.\n- I did not sleep at all in this place.",
    "The harbour was quiet when we came back, and\nshe told me that it had rained for days in the\nvalley.",
    "この音楽はとても不思議なもので、最後まで見てよかったです。",
    "Die Stadt ist leer, und der Hund wartet nicht mit mir.",
    "Был поздний вечер, и никто не пришёл.",
]
OTHER = [
    "The Silent Harbour of Tolm\nThe Grey Hound\nRiver of Glass\nLights over Vell",
    "1. The Silent Harbour\n2. The Grey Hound\n3. River of Glass",
    "| title | year |\n|---|---|\n| The Grey Hound | 1999 |\n| River of Glass | 2001 |",
    "title\tyear\nThe Grey Hound\t1999\nRiver of Glass\t2001",
    '[{"id": 1, "ok": true, "name": "the hound"}, {"id": 2, "ok": false}]',
    "word word word word word word word word word",
    "2024-01-01T00:00:00Z INFO worker[3] queue=1 status=200",
    "a9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08",
    ".a{margin:0px;color:#fff}.b{margin:1px}",
    "owrhliqh fhioqjlkekfto els ekoerrresqoeqk ugepskqslz jtkkqglaqqees shpuadwasg",
    "<ul><li>The Grey Hound</li><li>River of Glass</li></ul>",
    "12 44 99 1034\n55 66 77 88",
    "Home\nLogin\nAbout\nNext »\nHelp",
]


def frames(spark, texts):
    docs = spark.createDataFrame([(i, t, "xx", 0.0) for i, t in enumerate(texts)], "doc_id bigint, text string, language string, words double")
    words = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws] + [(None, "x"), ("en", None)], "lang string, word string")
    return docs, words


def shares(spark, texts):
    docs, words = frames(spark, texts)
    found = {r.doc_id: r.sentence_share for r in Q.statistics(docs, words, names=()).collect()}
    return [found.get(i) for i in range(len(texts))]


def test_prose(spark):
    assert [t for t, x in zip(PROSE, shares(spark, PROSE)) if not x > 0.5] == []


def test_no_prose(spark):
    assert [t for t, x in zip(OTHER, shares(spark, OTHER)) if not x < 0.5] == []


def test_nothing_to_read(spark):
    docs, words = frames(spark, [None, "", " \n\t　", "​", "\x01\x02\x03", "a\x03b c"])
    rows = {r.doc_id: r for r in Q.statistics(docs, words).collect()}
    assert set(rows) == {3, 4, 5} and all(0 <= rows[i][s] < 1e9 for i in rows for s in Q.STATISTICS)
    assert rows[5].words == 2 and rows[4].words == 0 and rows[3].sentence_share == 0
    assert Reader({}).segments([["Some words here."]]).language == ["und"]


def test_parts_of_words_are_common():
    reader = Reader({"fr": ["l", "qu", "il", "est"]})
    common = lambda t: reader.segments([[t]]).common.tolist()
    assert common("L'homme qu'il aime") == [2] and common("L’homme est-il là") == [2] and common("aujourd'hui porte-clef") == [0]


STOP = re.compile(r"[.!?…]['\"”’»)\]]?(?=\s)|[。！？]")


@given(st.lists(st.lists(st.text("abZÉ 12'.-,\t<|;:!_の漢Я…\"’\u0307", max_size=40), max_size=4), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_counts_equal_counting(lines):
    """The counts over the whole batch are those of each segment read by itself."""
    lines = [lines_of("\n".join(x)) for x in lines]
    m = Reader(COMMON).segments(lines)
    one = []
    for i, text in enumerate(lines):
        for run in runs_of(text):
            for group in prose._CUT.split(run):
                cuts = [0, *(x.end() for x in STOP.finditer(group)), len(group)]
                one += [(i, group[a:b]) for a, b in zip(cuts, cuts[1:]) if group[a:b].strip()]
    assert m.text.tolist() == [i for i, _ in one]
    for k, (_, t) in enumerate(one):
        words = prose._WORD.findall(t)
        folded = Counter(w.casefold() for w in words)
        assert m.size[k] == prose.solid(t) and m.words[k] == len(words) and m.letters[k] == sum(map(len, words))
        assert m.numbers[k] == len(re.findall(r"\d+(?:[.,:/\-]\d+)*", t)) and m.odd[k] == len(prose._ODD.findall(t))
        assert m.capitals[k] == sum(w[0].isupper() for w in words[1:]) and m.shouted[k] == sum(map(str.isupper, words))
        assert m.most[k] == max(folded.values(), default=0) and m.distinct[k] == len(folded)
        assert m.ended[k] == (prose._ENDED.search(t) is not None)
        assert m.kana[k] == len(prose._KANA.findall(t)) and m.latin[k] == len(prose._LATIN.findall(t))


def test_wrapped_lines_are_joined():
    assert runs_of(["x" * 60, "and more", "- entry", "next"]) == ["x" * 60 + " and more", "entry", "next"]
    assert runs_of(["x" * 900 + " word", "and more", "", "short", "line"]) == ["x" * 900 + " word and more", "short", "line"]


def test_sketches_decide(spark):
    """A language in which most words have capitals: its own sentences say that this is no title."""
    words = {**COMMON, "xx": ["vo", "ku", "sen", "tal"]}
    names = ["Marok", "Tivel", "Surin", "Palek", "Gorat", "Lunif", "Besol", "Havir"]
    rng = random.Random(4)
    own = [" ".join([*(x for _ in range(4) for x in (rng.choice(["vo", "ku", "sen", "tal"]), *rng.sample(names, 2)))]) + "." for _ in range(600)]
    case = "vo Marok Tivel ku Surin Palek sen Gorat Lunif tal Besol Havir."
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    common = spark.createDataFrame([(k, w) for k, ws in words.items() for w in ws], "lang string, word string")
    measured = Q.read(frame([*own, case]), common)
    share = lambda yards: Q.with_share(measured, yards).where(F.col("doc_id") == 600).first().sentence_share
    learnt = Q.yardsticks(Q.segment_sketches(measured))
    assert share(learnt) == 1 and share({"*": Q.PRIOR, "ja": Q.PRIOR_KANA}) == 0
    # where the language's sentences hold many common words, one with few of them is none
    many = ["vo ku sen tal vo ku sen tal marok tivel."] * 600
    few = "vo marok tivel surin palek gorat lunif besol havir marin."
    measured = Q.read(frame([*many, few]), common)
    assert share(Q.yardsticks(Q.segment_sketches(measured))) == 0 and share({"*": Q.PRIOR | {"common": (0.2, 0.1, 0.1)}, "ja": Q.PRIOR_KANA}) == 1


def test_tails_are_found(spark):
    texts = [*PROSE * 4, *OTHER, None, "", "  "]
    docs, words = frames(spark, texts)
    first = 4 * len(PROSE)
    assert sorted(r.doc_id for r in Q.not_prose(docs, words).collect()) == list(range(first, first + len(OTHER)))


@pytest.mark.parametrize("good, bad", [(1, 4), (1, 1), (2, 1)])
def test_cases_are_found_in_any_mix(spark, good, bad):
    """Mostly junk, or texts of very different shares: no case is hidden by the others."""
    half = "It was a long night, and the lights went out. | 12 | 1999 | 44 | 3.50 | 17 | 2001 | 88 | 1034 | 2024 | 7781 | 90210 | 4455 |"
    assert 0.2 < shares(spark, [half])[0] < 0.5
    texts = [*PROSE * good, *OTHER * bad, *[half] * bad]
    docs, words = frames(spark, texts)
    assert sorted(r.doc_id for r in Q.not_prose(docs, words).collect()) == list(range(good * len(PROSE), len(texts)))


def test_scores(spark):
    docs, words = frames(spark, [*PROSE * 4, *OTHER])
    rows = Q.quality(docs, words).collect()
    assert len(rows) == 4 * len(PROSE) + len(OTHER)
    assert all(0 <= r[f"p_{s}"] <= 1 for r in rows for s in Q.STATISTICS)
    assert all((r.z_sentence_share < 0) == (r.sentence_share < 0.9) or r.sentence_share > 0.5 for r in rows)


def test_sketches_merge(spark):
    docs, words = frames(spark, PROSE * 20)
    measured = Q.statistics(docs, words)
    n = {r.language: r.n for r in Q.sketches(measured).collect()}
    assert n.pop(Q.ALL) == sum(n.values()) == 20 * len(PROSE)


def test_empty(spark):
    docs, words = frames(spark, ["x"])
    assert Q.not_prose(docs.limit(0), words).count() == 0 and Q.quality(docs.limit(0), words).count() == 0
    assert Q.quality(docs, words.limit(0)).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_agrees_with_hand_labels(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    found = {r.doc_id for r in Q.not_prose(read("documents"), read("common_words")).collect()}
    labels = [(r.doc_id, r.label) for r in read("doc_labels").collect()]
    blank = {r.doc_id for r in read("documents").where("text IS NULL OR trim(text) = ''").collect()}
    right = [(d in found) == (x != "prose") for d, x in labels if d not in blank]
    assert sum(right) > 0.9 * len(right)  # some labels are wrong
    low = read("documents").alias("d")
    scored = Q.quality(low, read("common_words"))
    assert {r.doc_id for r in scored.where("sentence_share < 0.5").collect()} == found
