"""Per-document text quality statistics (problem 8).

``read`` takes each text once: the segments of it that may be sentences with
their counts, and the statistics asked for. Two kinds of KLL quantile sketches
are built from it, one of each statistic per language; sketches are mergeable, so
partial aggregation leaves a few kilobytes per language and task, and the sketch
over all languages is the merge of theirs.

* Sketches of *segments* say what sentences of a language are like: the share of
  letters, numbers, odd characters, capitals, repeated and common words, and the
  length. ``yardsticks`` turns them into a median and a spread of each tail, and
  a segment is no running sentence if one of its robust z-scores lies in a tail.
  ``not_prose`` flags the documents of which less than half is left.
* Sketches of *documents* turn the statistics of each document into percentiles
  and robust z-scores (``scores``).

Sentences are learnt from segments that end like one and have eight words or
more, at least one of them common. A language with few of these leans on all
languages: its quantiles weigh its segments against ``PRIOR_WEIGHT`` of theirs,
and those of all languages as many of ordinary prose (``PRIOR``).

Defined results for odd input: null, empty and blank texts have no statistics
and are never flagged; repeated texts each count; the columns ``lang`` and
``source`` are not trusted and not read; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.encoding import portions
from tidemark.llm.prose import Measured, Reader, ended_lines, entry_lines, lines_of, solid
from tidemark.session import ship, stage_table

MAX_COMMON = 1_000_000  # common words read by the driver; a vocabulary, not data
MAX_LANGUAGES = 10_000  # languages of that vocabulary
ALL, JAPANESE = "*", "ja"
HALF = 0.5

#: Statistics of a text, read beside its segments.
TEXT_STATISTICS = (
    "words", "mean_word", "symbol_ratio", "digit_ratio", "ended_lines", "common_ratio", "capital_ratio", "word_entropy", "line_words", "entry_lines",
)
STATISTICS = (*TEXT_STATISTICS, "sentence_share")

# --- reading --------------------------------------------------------------------

#: What is known of a segment: its group in the text, size without blanks, words, script, end, and the statistics of ``TAILS``.
TAILS = ("letters", "numbers", "odd", "capitals", "repeat", "common", "length")
PARTS = "array<struct<part:int, size:int, words:int, script:tinyint, ended:boolean, " + ", ".join(f"{n}:float" for n in TAILS) + ">>"
LATIN, KANA, OTHER = 0, 1, 2  # scripts of a segment: with common words, with kana as such, without a measure of them


def common_by_language(common_words: DataFrame) -> dict[str, list[str]]:
    rows = common_words.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def _segments(m: Measured, texts: int, kind: pa.DataType) -> pa.ListArray:
    """The segments of each text as structs; in text with kana letters stand for words, and kana for common words."""
    kana = m.cjk > 0.5 * m.letters
    words = np.maximum(1, np.where(kana, m.letters, m.words))
    columns = {
        "part": m.group,
        "size": m.size,
        "words": np.where(kana & (m.words > 0), m.letters, m.words),
        "script": np.where(kana, KANA, np.where(m.latin >= 0.5 * m.letters, LATIN, OTHER)),
        "ended": m.ended,
        "letters": m.letters / m.size,
        "numbers": m.numbers / np.maximum(1, m.words + m.numbers),
        "odd": m.odd / m.size,
        "capitals": np.where(m.shouted > 0.7 * m.words, 0.0, m.capitals / np.maximum(1, m.words - 1)),  # a text all in capitals has none
        "repeat": np.maximum(0, m.most - 1) / np.maximum(1, m.words),
        "common": np.where(kana, m.kana, m.common) / words,
        "length": np.log2(words),
    }
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    arrays = [pa.array(columns[f.name].astype(f.type.to_pandas_dtype()), f.type) for f in fields]
    offsets = np.searchsorted(m.text, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, fields=fields), type=kind)


def _described(reader: Reader, lines: Sequence[list[str]], wholes: np.ndarray) -> dict[str, np.ndarray]:
    """TEXT_STATISTICS of texts; texts of nothing but invisible characters have zeros."""
    m = reader.whole(lines)
    full = lambda counts: np.bincount(m.text, counts, len(lines))
    words, letters, digits = full(m.words), full(m.letters), full(m.digits)
    visible = np.maximum(1, [sum(not x.isspace() and x != "" for x in text) for text in lines])
    is_ja = np.array([x == JAPANESE for x in m.language], bool)
    return {
        "words": words,
        "mean_word": letters / np.maximum(1, words),
        "symbol_ratio": np.maximum(0, wholes - letters - digits) / wholes,
        "digit_ratio": digits / wholes,
        "ended_lines": np.array([ended_lines(x) for x in lines]) / visible,
        "common_ratio": np.where(is_ja, full(m.kana) / np.maximum(1, letters), full(m.common) / np.maximum(1, words)),
        "capital_ratio": full(m.initials) / np.maximum(1, words),
        "word_entropy": full(m.entropy),
        "line_words": words / visible,
        "entry_lines": np.array([entry_lines(x) for x in lines]) / visible,
    }


def read(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", names: Sequence[str] = ()) -> DataFrame:
    """(key, language, whole, statistics named..., parts) of every text that is not blank; nothing is shuffled."""
    ship(documents.sparkSession)
    common = common_by_language(common_words)
    kind = documents.schema[key].dataType.simpleString()
    schema = ", ".join([f"{key} {kind}", "language string", "whole bigint", *(f"{n} double" for n in names), f"parts {PARTS}"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(common)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for start, stop in portions(every):
                texts, keys = every[start:stop], batch.column(0).slice(start, stop - start)
                wholes = [solid(t) if t else 0 for t in texts]
                some = [i for i, n in enumerate(wholes) if n]
                if not some:
                    continue
                lines = [lines_of(texts[i]) for i in some]
                sizes = np.array([wholes[i] for i in some])
                m = reader.segments(lines)
                described = _described(reader, lines, sizes) if names else {}
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(some)).cast(arrow[0].type),
                        pa.array(m.language, pa.string()),
                        pa.array(sizes, pa.int64()),
                        *(pa.array(described[n], pa.float64()) for n in names),
                        _segments(m, len(some), arrow[-1].type),
                    ],
                    schema=arrow,
                )

    return documents.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


# --- what sentences are like ----------------------------------------------------

#: Median and spread of the low and of the high tail of each statistic in ordinary prose, and of those that differ in text with kana.
PRIOR = {
    "letters": (0.96, 0.05, 0.05), "numbers": (0.0, 0.05, 0.05), "odd": (0.0, 0.05, 0.05), "capitals": (0.05, 0.05, 0.1),
    "repeat": (0.03, 0.05, 0.06), "common": (0.44, 0.1, 0.1), "length": (3.6, 0.9, 0.5),
}
PRIOR_KANA = PRIOR | {"common": (0.6, 0.1, 0.1), "length": (4.3, 0.75, 0.5)}
PRIOR_WEIGHT = 100
#: Least spread of a statistic: shares are multiples of one over the number of words.
FLOOR = dict.fromkeys(TAILS, 0.05) | {"length": 0.3}
LONG = 3  # length, in powers of two, of the segments that sentences are learnt from
QUANTILES = (0.05, 0.5, 0.95)
NORMAL = 1.645  # standard deviations from the median to the outer quantiles of a normal distribution
#: Robust z-scores beyond which a segment lies in a tail.
TAIL_COMMON, TAIL = 2.5, 4.5
#: Bound of the z-scores of length and common words together, where a segment does not end like a sentence.
TAIL_UNENDED = 2.0


def segment_sketches(measured: DataFrame) -> DataFrame:
    """(language, learnt, ended, sketch of each of TAILS): sentences of each language, kana as such counting as ja."""
    p = F.col("p")
    rows = measured.select("language", F.explode("parts").alias("p")).where(p["ended"] & (p["words"] > 0) & (p["script"] != OTHER))
    name = F.when(p["script"] == KANA, F.lit(JAPANESE)).when(F.col("language") == JAPANESE, F.lit("und")).otherwise(F.col("language"))
    learnt = (p["length"] >= LONG) & (p["common"] > 0)
    # few languages but many segments: partial sketches are a row per language and task
    return rows.groupBy(name.alias("language")).agg(
        F.count_if(learnt).alias("learnt"),
        F.count(F.lit(1)).alias("ended"),
        *(F.kll_sketch_agg_double((p[n] if n == "length" else F.when(learnt, p[n])).cast("double")).alias(n) for n in TAILS),
    )


def yardsticks(sketches: DataFrame) -> dict[str, dict[str, tuple[float, float, float]]]:
    """(median, spread of the low tail, spread of the high tail) of each of TAILS, by language; ``*`` is all but ja."""
    merged = sketches.where(F.col("language") != JAPANESE).agg(
        F.lit(ALL).alias("language"), F.sum("learnt").alias("learnt"), F.sum("ended").alias("ended"), *(F.kll_merge_agg_double(n).alias(n) for n in TAILS)
    )
    known = sketches.where(F.col("language") != "und").unionByName(merged)
    at = F.array(*map(F.lit, QUANTILES))
    quantiles = [F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(n, at)).alias(n) for n in TAILS]
    rows = {r["language"]: r for r in known.select("language", "learnt", "ended", *quantiles).limit(MAX_LANGUAGES + 1).collect()}
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def leaning(language: str, on: Mapping[str, tuple[float, ...]]) -> dict[str, tuple[float, ...]]:
        out, row = {}, rows.get(language)
        for name in TAILS:
            n = (row["ended" if name == "length" else "learnt"] or 0) if row else 0
            if not n or row[name] is None:
                out[name] = on[name]
                continue
            low, middle, high = row[name]
            own = (middle, (middle - low) / NORMAL, (high - middle) / NORMAL)
            out[name] = tuple((n * a + PRIOR_WEIGHT * b) / (n + PRIOR_WEIGHT) for a, b in zip(own, on[name]))
        return out

    every = leaning(ALL, PRIOR)
    return {ALL: every, JAPANESE: leaning(JAPANESE, PRIOR_KANA)} | {k: leaning(k, every) for k in rows if k not in (ALL, JAPANESE)}


class Judge:
    """Tells running sentences by yardsticks."""

    def __init__(self, yards: Mapping[str, Mapping[str, tuple[float, ...]]]):
        self.of = {name: i for i, name in enumerate(yards)}
        spread = lambda name, x: max(FLOOR[name], x)
        # by statistic: median, spreads of the tails; one column for each yardstick
        self.yard = {
            n: np.array([(y[n][0], spread(n, y[n][1]), spread(n, y[n][2])) for y in yards.values()], float).T for n in TAILS
        }

    def sentences(self, parts: Mapping[str, np.ndarray], languages: Sequence[str]) -> np.ndarray:
        """Whether no robust z-score of a segment lies in a tail; ``languages`` are those of the segments' texts."""
        other = self.of[ALL]
        own = np.array([self.of.get(x, other) if x != JAPANESE else other for x in languages], np.int64)
        at = np.where(parts["script"] == KANA, self.of[JAPANESE], own) if len(own) else own

        def z(name: str, low: bool) -> np.ndarray:
            middle, below, above = self.yard[name]
            away = middle[at] - parts[name] if low else parts[name] - middle[at]
            return away / (below if low else above)[at]

        measured = parts["script"] != OTHER
        # the share of common words in n words varies by chance as well
        middle, below, _ = self.yard["common"]
        chance = np.sqrt(np.maximum(0, middle * (1 - middle))[at] / np.maximum(1, parts["words"]))
        common = np.where(measured, (middle[at] - parts["common"]) / np.maximum(below[at], chance), 0.0)
        length = z("length", True)
        shape = np.maximum.reduce([z("letters", True), z("numbers", False), z("odd", False), z("capitals", False), z("repeat", False), length])
        unended = np.maximum(0, common) + np.maximum(0, length)
        running = parts["ended"] | (measured & (unended <= TAIL_UNENDED))
        return (parts["words"] > 0) & (shape <= TAIL) & (common <= TAIL_COMMON) & running

    def share(self, parts: pa.ListArray, languages: Sequence[str], wholes: np.ndarray) -> np.ndarray:
        """Share of each text's characters that stand in running sentences."""
        offsets = parts.offsets.to_numpy()
        inner = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        own = {f.name: inner.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(inner.type)}
        text = np.repeat(np.arange(len(parts)), np.diff(offsets))
        ok = self.sentences(own, np.asarray(languages, object)[text])
        # groups follow each other, and so do the segments of one
        new = np.concatenate([[True], (np.diff(own["part"]) != 0) | (np.diff(text) != 0)]) if len(text) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        size, mass = np.bincount(group, own["size"]), np.bincount(group, own["size"] * ok)
        # a short clause between sentences belongs to them
        found = np.bincount(text[new], np.where(mass >= 0.7 * size, size, mass), len(parts))
        return np.minimum(1.0, found / wholes)


def with_share(measured: DataFrame, yards: Mapping[str, Mapping[str, tuple[float, ...]]], key: str = "doc_id", names: Sequence[str] = ()) -> DataFrame:
    """(key, language, statistics named..., sentence_share): the share of characters in running sentences; nothing is shuffled."""
    ship(measured.sparkSession)
    kept = measured.select(key, "language", *names, "whole", "parts")
    schema = ", ".join([*(f"{n} {kept.schema[n].dataType.simpleString()}" for n in (key, "language", *names)), "sentence_share double"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(yards)
        for batch in batches:
            *same, whole, parts = batch.columns
            share = judge.share(parts, same[1].to_pylist(), whole.to_numpy())
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(same, arrow)), pa.array(share, pa.float64())], schema=arrow)

    return kept.mapInArrow(run, schema)


def statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", names: Sequence[str] = TEXT_STATISTICS) -> DataFrame:
    """(key, language, statistics named..., sentence_share) of every text that is not blank."""
    measured = stage_table(read(documents, common_words, key, text, names), "segments")
    return with_share(measured, yardsticks(stage_table(segment_sketches(measured), "sketches")), key, names)


def not_prose(documents: DataFrame, common_words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of the documents of which less than half stands in running sentences."""
    return statistics(documents, common_words, key, names=()).where(F.col("sentence_share") < HALF).select(key)


# --- what documents are like ----------------------------------------------------

#: Least spread of each statistic by which its z-score is divided.
SPREAD = dict.fromkeys(STATISTICS, 1e-3) | {"sentence_share": 0.02}
GRID = [i / 100 for i in range(1, 101)]  # percentiles are read off the sketches at these


def sketches(measured: DataFrame) -> DataFrame:
    """(language, n, sketch of each statistic), and the merge of all as language ``*``."""
    by = measured.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(s).alias(s) for s in STATISTICS)
    )
    whole = by.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(s).alias(s) for s in STATISTICS))
    return by.unionByName(whole.where("n > 0").withColumn("language", F.lit(ALL)))


def scores(measured: DataFrame, built: DataFrame) -> DataFrame:
    """``measured`` with ``p_`` (percentile) and ``z_`` (robust z-score) of each statistic against its ``yardstick``.

    A language whose median text is prose stands for itself, else for all; the
    broadcast side has one row for each language of the common words.
    """
    quartiles = built.select(
        F.col("language").alias("yardstick"),
        *(F.kll_sketch_get_quantile_double(s, F.lit(GRID)).alias(f"g_{s}") for s in STATISTICS),
        *(F.kll_sketch_get_quantile_double(s, F.lit(q)).alias(f"q{i}_{s}") for s in STATISTICS for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))),
    ).where((F.col("yardstick") != "und") & ((F.col("q2_sentence_share") >= HALF) | (F.col("yardstick") == ALL)))
    known = F.broadcast(quartiles.select(F.col("yardstick").alias("language"), F.col("yardstick").alias("own")))
    named = measured.join(known, "language", "left").withColumn("yardstick", F.coalesce("own", F.lit(ALL))).drop("own")
    of = lambda s: F.greatest((F.col(f"q3_{s}") - F.col(f"q1_{s}")) / 1.349, F.lit(SPREAD[s]))
    percentiles = [(F.size(F.filter(f"g_{s}", lambda g: g < F.col(s))) / len(GRID)).alias(f"p_{s}") for s in STATISTICS]  # noqa: B023
    z = [((F.col(s) - F.col(f"q2_{s}")) / of(s)).alias(f"z_{s}") for s in STATISTICS]
    return named.join(F.broadcast(quartiles), "yardstick").select(*measured.columns, "yardstick", *percentiles, *z)


def quality(documents: DataFrame, common_words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Statistics, percentiles and z-scores of every document."""
    measured = stage_table(statistics(documents, common_words, key), "quality")
    return scores(measured, sketches(measured))
