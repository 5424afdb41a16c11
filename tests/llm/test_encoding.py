import base64

import pytest

from tidemark.llm import encoding as E
from tidemark.llm.vocabulary import WORDS

SCHEMA = "doc_id bigint, text string, ids string, tokens int"


def test_encode_frames(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(E.rank_file("byte_bpe_50k"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    texts = ["a b", None, "", "   ", "<|endoftext|>", "long " * 20_000, "a b"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id", None, None)], SCHEMA)
    got = {r.doc_id: r.ids for r in E.encode(df).collect()}
    assert got[None] == other.encode_ordinary("null id")
    assert all(got[i] == (other.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert E.encode(df.limit(0)).collect() == [] and E.encode(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_lengths_of_all_kinds_of_vocabularies(spark):
    names = ["byte_bpe_50k", "piece_bpe_32k", "word_bpe_49k", "byte_bpe_50k"]
    df = spark.createDataFrame([(1, "Hello world</s>", "", 0), (2, None, "", 0), (3, "", "", 0)], SCHEMA)
    rows = E.lengths(df, names).collect()
    assert len(rows) == 9 and all((r.tokens > 0) == (r.doc_id == 1) for r in rows)
    import sentencepiece

    path = f"{E.tokenizer_folder()}/piece_bpe_32k.model"
    exact = len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello world</s>"))
    assert [r.tokens for r in rows if r.doc_id == 1 and r.tokenizer == "piece_bpe_32k"] == [exact]
    with pytest.raises(FileNotFoundError):
        E.counter("none_such")


def test_portions(monkeypatch):
    monkeypatch.setattr(E, "PORTION_TEXTS", 3)
    monkeypatch.setattr(E, "PORTION_CHARS", 10)
    texts = ["a" * n if n is not None else None for n in (1, None, 0, 1, 30, 9, 2, 8)]
    assert list(E.portions(texts)) == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 8)]
    assert list(E.portions([])) == []
