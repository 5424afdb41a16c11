"""What texts are made of: words, characters, lines, and segments that may be running sentences.

``Reader`` reads a batch of texts at once. Each text is cut into lines (markup
goes, wrapped lines are joined), groups (at what separates cells and entries)
and segments (sentences of a group). All segments of the batch are one string
whose characters are classed by a table, so that every count is a numpy
operation over the batch and no Python code runs for a segment. What a segment's
counts mean is not decided here: ``quality`` measures them against sketches.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

_HIDDEN = re.compile(r"<(script|style)\b[^<>]*>.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|<!--.*?-->|<!\w[^<>]*>", re.DOTALL)
_BLOCKS = frozenset("p br li ul ol div td th tr table h1 h2 h3 h4 h5 h6 blockquote section article header footer pre nav".split())
_NEWLINE = re.compile("\r\n|[\n\r\v\f\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029) + "]")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_MARKER = re.compile(
    r"\s*(?:[-*•·‣◦▪●○–—+>]+\s|\[[ xX✓✔]?\]\s|[☐☑☒✓✔✗]\s|\(?[0-9]{1,4}[.)\]:]\s|\([a-z0-9]{1,3}\)\s|[a-zA-Z][.)]\s|#[0-9]+\s)"
)
# no cut reaches over the end of a line, as lines are cut in one string
_CUT = re.compile(r"[\t|¦{}<>]+|[^\S\n](?:[/\\→»«›‹~=:–—•·◦▪●-]+[^\S\n]|[^\S\n]{3})|;[^\S\n]")
_ENDED = re.compile(r"[.!?…。！？؟।]['\"”’»)\]」』\s]*$")

# separators inside the string of a batch: control characters, taken out of the texts before
_CUT_MARK, _TEXT_MARK, _LINE_MARK = "\x01", "\x03", "\n"
_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")


def _ranges(*bounds: tuple[int, int]) -> re.Pattern:
    """A class of the code points between each pair of bounds."""
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in bounds) + "]")


_KANA = _ranges((0x3040, 0x309F))
_CJK = _ranges((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))
_LATIN = _ranges((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))
_ODD = re.compile(r"[^\w\s.,!?'\"’‘“”„«»;:()¿¡…。、！？「」『』・\-–—&]|_")
# control and format characters that are no line ends
_INVISIBLE = _ranges(
    (0x00, 0x08), (0x0E, 0x1B), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x600, 0x605),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFEFF, 0xFEFF),
)

# classes of characters, as bits
LETTER, DIGIT, UPPER, ODD, KANA, CJK, LATIN, SPACE, END, CLOSE, JOIN, POINT, STOP, FULL_STOP, QUOTE, KNOWN = (1 << i for i in range(16))
_CLASSES = (
    (ODD, _ODD), (KANA, _KANA), (CJK, _CJK), (LATIN, _LATIN), (END, re.compile("[.!?…。！？؟।]")),
    (CLOSE, re.compile(r"['\"”’»)\]」』]")), (JOIN, re.compile(r"['’\-]")), (POINT, re.compile(r"[.,:/\-]")),
    (STOP, re.compile("[.!?…]")), (FULL_STOP, re.compile("[。！？]")), (QUOTE, re.compile(r"['\"”’»)\]]")),
)
_TABLE = np.zeros(0x110000, np.uint16)  # filled in as characters are met
_MET_WORDS = 200_000  # words whose common languages are remembered; emptied beyond that


def _class_of(code: int) -> int:
    c = chr(code)
    bits = KNOWN | SPACE * c.isspace() | DIGIT * c.isdecimal() | UPPER * c.isupper() | LETTER * (c.isalnum() and not c.isdecimal())
    return bits | sum(bit for bit, pattern in _CLASSES if pattern.match(c))


def classes(text: str) -> np.ndarray:
    """The class bits of every character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _TABLE[codes]
    if not found.all():
        for code in np.unique(codes[found == 0]).tolist():
            _TABLE[code] = _class_of(code)
        found = _TABLE[codes]
    return found


def lines_of(text: str) -> list[str]:
    """Lines of the visible text; tags that end a block end a line."""
    if "<" in text:
        text = _HIDDEN.sub("\n", text)
        text = _TAG.sub(lambda m: "\n" if (m.group(2) or "").lower() in _BLOCKS else "", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _NEWLINE.split(_CONTROL.sub("", text))


def solid(text: str) -> int:
    """Characters that are not blank."""
    return sum(map(len, text.split()))


def _wraps(before: str, after: str) -> bool:
    """Whether the break between two lines only wraps: the line is long enough, and what follows would not have fitted."""
    if len(before) < 40 or _ENDED.search(before):
        return False
    first = after.split(maxsplit=1)[0]
    return first[0].islower() or len(before) + len(first) + 1 > 55


def runs_of(lines: Iterable[str]) -> list[str]:
    """Entries of lists without their marks, and lines, wrapped ones joined."""
    out: list[str] = []
    open_line = ""  # the last line, if the next may continue it
    for line in lines:
        text = line.strip()
        if not text:
            open_line = ""
        elif marked := _MARKER.match(line):
            out.append(line[marked.end() :])
            open_line = ""
        else:
            if open_line and _wraps(open_line, text):
                out[-1] += " " + text
            else:
                out.append(text)
            open_line = text
    return out


@dataclass
class Measured:
    """Counts of segments that hold characters: one number each, in the order of the texts."""

    text: np.ndarray  # number of the text in the batch
    group: np.ndarray  # number of the group in the batch
    size: np.ndarray  # characters that are not blank
    words: np.ndarray
    letters: np.ndarray  # characters of words
    numbers: np.ndarray
    digits: np.ndarray
    odd: np.ndarray  # characters seldom met in sentences
    capitals: np.ndarray  # words after the first that begin with a capital
    initials: np.ndarray  # words that begin with a capital
    shouted: np.ndarray  # words all in capitals
    common: np.ndarray  # words that are common in some language, or have a part that is
    most: np.ndarray  # how often the most frequent word occurs
    distinct: np.ndarray  # different words
    entropy: np.ndarray  # of the words, in bits
    kana: np.ndarray
    cjk: np.ndarray
    latin: np.ndarray
    ended: np.ndarray  # whether it ends as a sentence does
    language: list[str]  # of each text


class _Numbers(dict):
    """Words to the numbers of their folded forms, which are given as words are met."""

    def __init__(self):
        self.folded: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        number = self[word] = self.folded.setdefault(word.casefold(), len(self.folded))
        return number


class Reader:
    """Reads texts with the words that are common in each language."""

    def __init__(self, common: Mapping[str, Iterable[str]]):
        self.languages = sorted(common)
        self.of_word: dict[str, int] = {}  # languages as bits
        for i, lang in enumerate(self.languages):
            for word in {w.casefold() for w in common[lang]}:
                self.of_word[word] = self.of_word.get(word, 0) | 1 << i
        self._forget()

    def _forget(self) -> None:
        self.ids = _Numbers()
        self.is_common = np.zeros(0, bool)
        self.spoken = np.zeros(0, np.int64)

    def _has_common_part(self, folded: str) -> bool:
        """Whether a part of an elided or hyphenated word is common."""
        return any(part in self.of_word for part in folded.replace("’", "'").replace("-", "'").split("'"))

    def _numbered(self, words: list[str]) -> np.ndarray:
        """The number of each word in ``is_common`` and ``spoken``."""
        if len(self.ids) > _MET_WORDS:
            self._forget()
        out = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids.folded) > len(self.spoken):
            new = list(self.ids.folded)[len(self.spoken) :]
            langs = [self.of_word.get(w, 0) for w in new]
            known = [bool(x) or (not w.isalpha() and self._has_common_part(w)) for w, x in zip(new, langs)]
            self.spoken = np.concatenate([self.spoken, np.array(langs, np.int64)])
            self.is_common = np.concatenate([self.is_common, np.array(known, bool)])
        return out

    @staticmethod
    def _stops(bits: np.ndarray) -> np.ndarray:
        """Where a sentence may end inside a group: behind a full stop, and before a blank behind another one, maybe with a quote."""
        at = np.flatnonzero(bits & STOP) + 1
        at = at[at < len(bits)]
        at += bits[at] & QUOTE != 0
        at = at[at < len(bits)]
        return np.concatenate([at[bits[at] & SPACE != 0], np.flatnonzero(bits & FULL_STOP) + 1])

    def measure(self, joined: str, texts: int, stops: bool = True) -> Measured:
        """Counts of the segments in a string of ``texts`` texts with separators, cut into sentences if ``stops``."""
        bits = classes(joined)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        marks = np.flatnonzero((codes < 4) | (codes == 10))
        inner = self._stops(bits) if stops else marks[:0]
        # a separator is no part of a segment, a stop is the end of one
        ends, widths = np.concatenate([marks, inner]), np.repeat([1, 0], [len(marks), len(inner)])
        order = np.argsort(ends, kind="stable")
        ends, widths = ends[order], widths[order]
        kinds = np.where(widths, codes[np.minimum(ends, len(codes) - 1)], 0) if len(ends) else ends
        starts, ends = np.concatenate([[0], ends + widths]), np.concatenate([ends, [len(codes)]])
        text_of = np.concatenate([[0], np.cumsum(kinds == 3)])
        group_of = np.concatenate([[0], np.cumsum(kinds != 0)])
        filled_at = np.flatnonzero((bits & SPACE == 0) & (codes > 3))

        def between(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(at, ends) - np.searchsorted(at, starts)

        size = between(filled_at)
        keep = size > 0
        starts, ends, text_of, group_of, size = starts[keep], ends[keep], text_of[keep], group_of[keep], size[keep]
        # one pass finds all characters of the classes that few belong to
        seldom_at = np.flatnonzero(bits & (DIGIT | ODD | KANA | CJK))
        seldom = bits[seldom_at]
        count = lambda bit: between(seldom_at[seldom & bit != 0] if bit & (DIGIT | ODD | KANA | CJK) else np.flatnonzero(bits & bit))

        def runs(inside: int, link: int) -> tuple[np.ndarray, np.ndarray]:
            """Where runs of characters begin that single links may join, and where such links stand."""
            here = bits & inside != 0
            linked = np.zeros(len(here), bool)
            linked[1:-1] = (bits[1:-1] & link != 0) & here[:-2] & here[2:] & ~here[1:-1]
            body = here | linked
            return np.flatnonzero(body & ~np.concatenate([[False], body[:-1]])), np.flatnonzero(linked)

        word_at, linked_at = runs(LETTER, JOIN)
        number_at, _ = runs(DIGIT, POINT)
        words = _WORD.findall(joined)
        ids = self._numbered(words)
        segment = np.searchsorted(ends, word_at, "right")
        n = np.bincount(segment, minlength=len(starts))
        total = lambda flag: np.bincount(segment[flag], minlength=len(starts))
        initial = bits[word_at] & UPPER != 0
        first = np.concatenate([[True], segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, bool)
        capitals = total(initial & ~first)
        shouted = total(np.fromiter(map(str.isupper, words), bool, len(words)))

        # the different words of each segment with their counts
        pairs, times = np.unique(segment * (len(self.spoken) + 1) + ids, return_counts=True)
        owner = pairs // (len(self.spoken) + 1)
        distinct = np.bincount(owner, minlength=len(starts))
        most = np.zeros(len(starts), np.int64)
        np.maximum.at(most, owner, times)
        spread = np.bincount(owner, times * np.log2(times), len(starts)) if len(times) else np.zeros(len(starts))
        entropy = np.where(n > 0, np.log2(np.maximum(n, 1)) - spread / np.maximum(n, 1), 0.0)

        # the last character that closes nothing and is not blank
        last = np.searchsorted(plain := np.flatnonzero((bits & (SPACE | CLOSE) == 0) & (codes > 3)), ends) - 1
        last_at = plain[last] if len(plain) else np.zeros(len(ends), np.int64)
        ended = (last >= 0) & (last_at >= starts) & (bits[np.minimum(last_at, len(bits) - 1)] & END != 0) if len(bits) else np.zeros(0, bool)

        letters = count(LETTER) + between(linked_at)
        kana = count(KANA)
        language = self._languages(text_of, text_of[segment], self.spoken[ids], letters, kana, texts)
        return Measured(
            text_of, group_of, size, n, letters, between(number_at), count(DIGIT), count(ODD), capitals, total(initial), shouted,
            total(self.is_common[ids]), most, distinct, entropy, kana, count(CJK), count(LATIN), ended, language,
        )

    def _languages(self, text_of, text_of_word, spoken, letters, kana, texts: int) -> list[str]:
        """The language with most common words in each text; ja by its script, und if there are too few."""
        words = np.bincount(text_of_word, minlength=texts)
        hits = np.zeros((len(self.languages) + 1, texts))
        for i in range(len(self.languages)):
            hits[i] = np.bincount(text_of_word[spoken & (1 << i) != 0], minlength=texts)
        best = hits.argmax(axis=0)
        enough = hits.max(axis=0) > 0.04 * words
        japanese = np.bincount(text_of, kana, texts) > 0.15 * np.bincount(text_of, letters, texts)
        names = [*self.languages, "und"]
        return ["ja" if j else names[b] if e else "und" for j, e, b in zip(japanese, enough, best)]

    def segments(self, lines: Sequence[list[str]]) -> Measured:
        """The segments of texts, given as their lines."""
        joined = f"{_LINE_MARK}{_TEXT_MARK}{_LINE_MARK}".join(_LINE_MARK.join(runs_of(x)) for x in lines)
        return self.measure(_CUT.sub(_CUT_MARK, joined), len(lines))

    def whole(self, lines: Sequence[list[str]]) -> Measured:
        """The texts themselves, each as one segment; texts without a visible character have none."""
        return self.measure(_TEXT_MARK.join(" ".join(x) for x in lines), len(lines), stops=False)


def entry_lines(lines: Iterable[str]) -> int:
    """Lines that begin with the mark of a list entry."""
    return sum(_MARKER.match(x) is not None for x in lines if x.strip())


def ended_lines(lines: Iterable[str]) -> int:
    """Lines that end as a sentence does."""
    return sum(_ENDED.search(x) is not None for x in lines if x.strip())
