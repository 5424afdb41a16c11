"""Byte-level BPE: exact merging, and speculate-and-verify on top of it.

A split of a word into tokens is the one that merging gives if and only if each
adjacent pair of tokens is compatible, that is, if merging the two tokens' bytes
alone gives just these two tokens. So a greedy longest match proposes tokens,
all distinct adjacent pairs of a batch are tested at once with numpy, and only
words with a failing pair are merged exactly.

A pair is tested by undoing merges from the last to the first: a token with id t
comes into being at time t (single bytes before all merges). At each step the
two parts that touch at the boundary must not form a token earlier than the
merge that was undone last; equal times count for the pair if the undone merge
lies right of the boundary, since merging goes from left to right.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import regex

#: The public pattern that splits text into words before merging (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in the classes of the standard library, which is faster; both agree on texts without the characters of _FAR.
_NEAR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼-¾]+| ?[\d²³¹¼-¾]+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+"""
#: Beyond Latin, Greek, Cyrillic and general punctuation, and separators that only one of both takes for blanks.
_FAR = re.compile("[\x1c-\x1f" + chr(0x500) + "-" + chr(0x1FFF) + chr(0x2070) + "-" + chr(0x10FFFF) + "]")
_BLANK_WORDS = re.compile(" +[^ ]+| +").findall
CACHED_WORDS = 200_000  # the cache is emptied beyond that


class ByteBPE:
    """A rank file (token in base64, rank; one per line) with its merges."""

    def __init__(self, path: str, pattern: str = WORDS):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._split = regex.compile(pattern).findall
        self._split_near = re.compile(_NEAR).findall if pattern == WORDS else self._split
        self.size = max(self.ranks.values()) + 1
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.born = np.full(self.size, -1, np.int64)
        self.proposed = dict(self.ranks)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                continue
            parts = self._parts(token, rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank], self.born[rank] = *parts, rank
            else:
                del self.proposed[token]  # merging never makes it
        made = np.nonzero(self.left >= 0)[0]
        codes = self.left[made] * self.size + self.right[made]
        order = np.argsort(codes)
        self.pair_codes, self.pair_ids = codes[order], made[order]
        # length of the longest token that begins with three bytes; other tokens have at most two
        self.reach: dict[bytes, int] = {}
        for token in self.proposed:
            if len(token) > 2 and len(token) > self.reach.get(token[:3], 2):
                self.reach[token[:3]] = len(token)
        self.words = self.exact_words = 0
        self._forget()

    def _forget(self) -> None:
        """Empty the cache: words by number, and the tokens of all of them one after the other."""
        self.number: dict[str, int] = {}
        self.begin = np.zeros(1, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def split_words(self, text: str) -> list[str]:
        """The words that are merged by themselves."""
        return self._split(text) if _FAR.search(text) else self._split_near(text)

    def _parts(self, token: bytes, rank: int) -> list[int]:
        get = self.ranks.get
        cuts = [(a, b) for i in range(1, len(token)) if (a := get(token[:i], rank)) < rank and (b := get(token[i:], rank)) < rank]
        return list(cuts[0]) if len(cuts) == 1 else self.merge(token, rank)

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging by a heap of candidate pairs, O(n log n); only merges with a rank under ``below``."""
        limit = self.size if below is None else below
        n = len(word)
        ends = list(range(1, n + 1))  # of the part that begins here; 0 once merged away
        before = list(range(-1, n - 1))
        get = self.ranks.get
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n and (rank := get(word[i : ends[j]], limit)) < limit:
                heapq.heappush(heap, (rank, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue  # one of the parts has changed since
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        get, reach, n = self.proposed.get, self.reach.get, len(word)
        out, i = [], 0
        while i < n:
            for j in range(min(n, i + reach(word[i : i + 3], 2)), i, -1):
                if (token := get(word[i:j])) is not None:
                    out.append(token)
                    i = j
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their bytes gives just these two."""
        ok = np.ones(len(first), bool)
        at = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), np.iinfo(np.int64).max)
        while len(at):
            codes = a * self.size + b
            place = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
            joins = (self.pair_codes[place] == codes) & (self.pair_ids[place] < limit)
            ok[at[joins]] = False
            born_a, born_b = self.born[a], self.born[b]
            go = ~joins & ((born_a >= 0) | (born_b >= 0))
            at, a, b, born_a, born_b = at[go], a[go], b[go], born_a[go], born_b[go]
            undo_a = born_a > born_b
            limit = np.where(undo_a, born_a, born_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def _learn(self, words: Iterable[str]) -> None:
        """Encode words that are not in the cache yet."""
        words = list(words)
        raw = [w.encode() for w in words]
        guesses = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(guesses)), lengths)
        inside = owner[1:] == owner[:-1]
        codes, back = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        good = self.compatible(codes // self.size, codes % self.size)
        failing = np.unique(owner[1:][inside][~good[back]])
        for i in failing.tolist():
            guesses[i] = self.merge(raw[i])
        self.words += len(words)
        self.exact_words += len(failing)
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(guesses), np.int32, int(sizes.sum()))])

    def _numbered(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, offsets of the texts in them); unknown words are learnt."""
        split = [self.split_words(t) if t else () for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.number) > CACHED_WORDS:
            self._forget()
        self._learn(set(words).difference(self.number))
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), offsets

    def count_batch(self, texts: Sequence[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, offsets = self._numbered(texts)
        sums = np.concatenate([[0], np.cumsum(np.diff(self.begin)[numbers])])
        return np.diff(sums[offsets])

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]], none for null and empty."""
        numbers, offsets = self._numbered(texts)
        ends = np.concatenate([[0], np.cumsum(np.diff(self.begin)[numbers])])
        # where each id stands in the tokens of the cache: the begin of its word's, and its place among them
        at = np.repeat(self.begin[numbers] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
        return self.tokens[at], ends[offsets]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


class WordPieces:
    """Lengths in tokens of a SentencePiece model, counted once for each different word.

    Where no piece reaches over the end of a word (it would hold a blank after
    another character), merges on both sides do not touch each other, so the
    tokens of a text are those of its words with the blanks before them. Models
    of other kinds, and texts with the sign that stands for blanks, are counted whole.
    """

    BLANK = chr(0x2581)

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = self._is_by_word()
        self.size: dict[str, int] = {}

    def _is_by_word(self) -> bool:
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        form, kind = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = form.name == "identity" and form.add_dummy_prefix and form.escape_whitespaces and not form.remove_extra_whitespaces
        inside = any(self.BLANK in p.piece.lstrip(self.BLANK) or p.type == kind.USER_DEFINED for p in spec.pieces)
        return plain and spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and not inside

    def _whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    @staticmethod
    def split_words(text: str) -> list[str]:
        """Words with the blanks before them but one, which the model itself puts before each text."""
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in _BLANK_WORDS(f" {text}")]
        return text.split(" ")

    def count_batch(self, texts: Sequence[str | None]) -> np.ndarray:
        """Number of tokens of each text, 0 for null and empty ones."""
        if not self.by_word:
            return np.array([self._whole(t) if t else 0 for t in texts], np.int64)
        split = [self.split_words(t) if t and self.BLANK not in t else () for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.size) > CACHED_WORDS:
            self.size.clear()
        new = list(set(words).difference(self.size))
        self.size.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        self.size[""] = 1  # a blank of its own, where the model would see no text
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(self.size.__getitem__, words), np.int64, len(words)))])
        counts = np.diff(sums[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])])
        for i, t in enumerate(texts):
            if t and self.BLANK in t:
                counts[i] = self._whole(t)
        return counts
