import json
import random

from tests.stream import frame
from tidemark.operators import jsontree as J
from tidemark.operators import shredding
from tidemark.operators.changefeed import commits

DEEP = "[" * 100_000 + "]" * 100_000
RECORD = '{"genres": ["a"], "tags": "b", "x": ' + DEEP + ', "n": 2.50}'


def test_deep_texts_are_read():
    value = J.parse(RECORD)
    assert (value["genres"], value["tags"], value["n"]) == (["a"], "b", "2.50")
    deep = value["x"]
    for _ in range(99_999):
        (deep,) = deep
    assert deep == []
    assert J.parse(RECORD[:-1]) is None and J.parse(RECORD + "]") is None and J.parse(DEEP[:-1]) is None


def test_deep_reading_equals_the_decoder():
    rng = random.Random(3)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"\\u00e9"', "1", "-2.50", "01", "true", "null", "NaN", " ", "\n", "x"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(40_000)]
    texts += [json.dumps({"a": [1, {"b": [], "c": {}}], "d": None, "e": "t"}, indent=i) for i in (None, 2)] + ['{"a":1,"a":2}', "[-Infinity]", "[1,]", '{"a":1,}']
    for text in texts:
        try:
            expected = repr(J._DECODER.decode(text))
        except ValueError:
            expected = None
        try:
            got = repr(J._parse_deep(text))
        except (ValueError, IndexError):
            got = None
        assert got == expected, text


def test_deep_record_keeps_its_children(spark):
    rows = commits(frame(spark, [(1, "a", "1", "create", "c", "k", RECORD, "x")]))
    assert sorted((r.child, r.item) for r in shredding.children(rows).collect()) == [("genres", "a"), ("tags", "b")]
