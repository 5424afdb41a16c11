"""Byte-level BPE against another library and against plain merging."""

import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.encoding import rank_file, tokenizer_folder
from tidemark.llm.vocabulary import WORDS, ByteBPE, WordPieces

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def pair(request):
    path = rank_file(request.param)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return ByteBPE(path), tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


CASES = ["", " ", "a", "aaaaaaa", "Hello  world\n\n\tfoo", "<|endoftext|> it's", "日本語のテキスト", "é́ \U0001f600​", "x" * 3000, "ab" * 2000, "\r\n  \r\n ", "1234567890 ½", "ſ'S'RE"]


@pytest.mark.parametrize("text", CASES)
def test_cases(pair, text):
    own, other = pair
    assert own.encode(text) == other.encode_ordinary(text)


def test_both_patterns_split_alike(pair):
    own, _ = pair
    for c in map(chr, [*range(0x600), *range(0x2000, 0x2100), 0x1F600, 0xD7FF]):
        for text in (f"a{c}a{c} {c}1_", f"1{c}{c} {c}", f" {c}'s_{c}\n{c}", f"_{c}  {c}.{c}"):
            assert own.split_words(text) == own._split(text)


@settings(max_examples=200, deadline=None)
@given(st.text("aé²¼1_' ’.\n\t\x1c\u00a0\u2009½Я", max_size=30))
def test_any_near_text_splits_alike(pair, text):
    own, _ = pair
    assert own.split_words(text) == own._split(text)


def test_null(pair):
    assert pair[0].encode(None) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(pair, text):
    own, other = pair
    assert own.encode(text) == other.encode_ordinary(text)


def test_random_letters(pair):
    own, other = pair
    rng = random.Random(3)
    for alphabet in ("abc", "etaoin shr", "aAéあ"):
        text = "".join(rng.choice(alphabet) for _ in range(5000))
        assert own.encode(text) == other.encode_ordinary(text)


def test_pairs_are_tested_right(pair):
    import numpy as np

    own, _ = pair
    rng = random.Random(5)
    tokens = sorted(own.proposed.items(), key=lambda x: x[1])
    some = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(1500)]
    words = [w for w, _ in tokens if len(w) > 3]
    for _ in range(1500):  # cuts of real tokens, of which most are incompatible
        w = rng.choice(words)
        i = rng.randint(1, len(w) - 1)
        if w[:i] in own.proposed and w[i:] in own.proposed:
            some.append(((w[:i], own.ranks[w[:i]]), (w[i:], own.ranks[w[i:]])))
    verdict = own.compatible(np.array([a[1] for a, _ in some]), np.array([b[1] for _, b in some]))
    for ((a, i), (b, j)), ok in zip(some, verdict):
        assert (own.merge(a + b) == [i, j]) == ok


def test_batches_and_a_full_cache(pair, monkeypatch):
    own, other = pair
    monkeypatch.setattr("tidemark.llm.vocabulary.CACHED_WORDS", 3)
    texts = [None, "one two", "", "three one two", "four five six"]
    for _ in range(3):
        ids, offsets = own.encode_batch(texts)
        assert [list(ids[offsets[i] : offsets[i + 1]]) for i in range(len(texts))] == [other.encode_ordinary(t) if t else [] for t in texts]
        assert own.count_batch(texts).tolist() == [len(other.encode_ordinary(t)) if t else 0 for t in texts]


PIECES = os.path.join(tokenizer_folder(), "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    pytest.importorskip("sentencepiece")
    return WordPieces(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab  \n\t\u2581é日</s>", max_size=30)), max_size=6))
def test_lengths_by_word_are_those_of_whole_texts(pieces, texts):
    assert pieces.by_word
    assert pieces.count_batch(texts).tolist() == [len(pieces.model.encode(t)) if t else 0 for t in texts]


def test_models_of_other_kinds_are_counted_whole(pieces, monkeypatch):
    monkeypatch.setattr(pieces, "by_word", False)
    assert pieces.count_batch(["a  b", None, "", " "]).tolist() == [len(pieces.model.encode(t)) if t else 0 for t in ("a  b", None, "", " ")]


def test_folder_is_a_parameter(monkeypatch, tmp_path):
    monkeypatch.setenv("TOKENIZER_DIR", str(tmp_path))
    assert tokenizer_folder() == str(tmp_path) and tokenizer_folder("/x") == "/x"
    assert not os.path.exists(rank_file("byte_bpe_50k"))
