"""Encoding of a whole corpus with a public tokenizer (problem 6), and lengths in tokens.

Each task builds the vocabulary once per Python worker and streams Arrow
batches; nothing is shuffled, so repeated texts and very long ones cost their
own length only. Texts are encoded whole; strings that look like special tokens
are ordinary text.

Defined results for odd input: null and empty texts give the empty list (length
0); blank texts are encoded like any other; other columns are ignored; an empty
table gives an empty result; ids with a null document id are kept.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.session import ship

FOLDER = "/opt/tokenizers"


def tokenizer_folder(folder: str | None = None) -> str:
    """The folder of the vocabulary files: the argument, the environment's, or that of the installed package."""
    if folder or (folder := os.environ.get("TOKENIZER_DIR")):
        return folder
    if os.path.isdir(FOLDER):
        return FOLDER
    found = importlib.util.find_spec("public_tokenizers")
    if found is None or not found.submodule_search_locations:
        raise FileNotFoundError("no folder of tokenizer files: pass one or set TOKENIZER_DIR")
    return found.submodule_search_locations[0]


_LOADED: dict[str, object] = {}


def _loaded(path: str, make: Callable[[str], object]):
    if path not in _LOADED:
        _LOADED[path] = make(path)
    return _LOADED[path]


def rank_file(name: str, folder: str | None = None) -> str:
    return os.path.join(tokenizer_folder(folder), f"{name}.tiktoken")


def counter(name: str, folder: str | None = None) -> Callable[[Sequence[str | None]], np.ndarray]:
    """A function from texts to their lengths in tokens of the named vocabulary."""
    folder = tokenizer_folder(folder)
    path = os.path.join(folder, name)
    if os.path.exists(f"{path}.tiktoken"):
        from tidemark.llm.vocabulary import ByteBPE

        return _loaded(f"{path}.tiktoken", ByteBPE).count_batch
    if os.path.exists(f"{path}.model"):
        from tidemark.llm.vocabulary import WordPieces

        return _loaded(f"{path}.model", WordPieces).count_batch
    if os.path.exists(f"{path}.json"):
        from tokenizers import Tokenizer

        def load(p: str):
            whole = Tokenizer.from_file(p)
            whole.encode_special_tokens = True
            return whole

        whole = _loaded(f"{path}.json", load)
        return lambda texts: np.array([len(whole.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts], np.int64)
    raise FileNotFoundError(f"no tokenizer {name} in {folder}")


PORTION_TEXTS, PORTION_CHARS = 1000, 4_000_000  # bounds what a worker holds; a longer text is a portion of its own


def portions(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts that are worked on together."""
    start = size = 0
    for i, text in enumerate(texts):
        length = len(text) if text else 0
        if i > start and (i - start >= PORTION_TEXTS or size + length > PORTION_CHARS):
            yield start, i
            start, size = i, 0
        size += length
    if start < len(texts):
        yield start, len(texts)


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(key, ids) of every document."""
    ship(documents.sparkSession)
    path = rank_file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.vocabulary import ByteBPE

        bpe = _loaded(path, ByteBPE)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in portions(texts):
                ids, offsets = bpe.encode_batch(texts[start:stop])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def lengths(documents: DataFrame, tokenizers: Sequence[str], key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(key, tokenizer, tokens) of every document and each of the tokenizers, in one pass over the texts."""
    ship(documents.sparkSession)
    folder = tokenizer_folder(folder)
    names = list(dict.fromkeys(tokenizers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {name: counter(name, folder) for name in names}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in portions(texts):
                keys = batch.column(0).slice(start, stop - start)
                for name in names:
                    tokens = pa.array(count[name](texts[start:stop]), pa.int64())
                    yield pa.RecordBatch.from_arrays([keys, pa.array([name] * len(keys)), tokens], names=[key, "tokenizer", "tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, tokenizer string, tokens bigint")
