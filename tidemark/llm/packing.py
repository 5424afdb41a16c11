"""Filling fixed-capacity containers (problem 7): shortest-pack-first over the length histogram.

Only the histogram of lengths reaches the driver, bounded by the capacity
whatever the corpus holds. Lengths are placed longest first, all items of a
length at once: each goes to the packs with the most room left (the shortest
packs), else opens a new one. Packs with equal contents are one pattern with a
count, its contents are lengths with how often each occurs, and one length splits
at most one pattern, so there are at most thrice as many patterns as lengths. The
patterns are a table of intervals: ranks ``low`` to ``high`` of the items, sorted
by length, belong to consecutive containers, ``each`` to one.

Items get their rank without a global sort: counts per (length, hash bucket) give
each bucket its offset, and only the ranks inside a bucket are numbered, so a
length that a third of all items have is spread over many tasks. A bucket's row
carries the intervals that its ranks meet, so items find their container in the
join that gives them their offset.

Items longer than the capacity are cut: whole containers of their own, and the
rest is packed like any item. Nothing else is split.

Defined results for odd input: null and empty texts are no items; an item of
length 0 (white space, for some tokenizers) lies in container 0; a container
specification with a null or non-positive capacity has no containers; equal
lengths are ordered by bucket and then by key, so the result does not depend on
the partitioning; an empty corpus gives an empty result. Beyond a capacity of
``EXACT`` long lengths are rounded up by at most one part in 4096 before they are
packed, which bounds the histogram there too.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import encoding
from tidemark.session import stage_table

BUCKET_ROWS = 200_000  # items ranked by one window partition
BUCKETS_TOGETHER = 1024  # buckets whose counts one window partition adds up
EXACT = 1 << 20  # capacity up to which every length has a place of its own in the histogram
PRECISION = 12  # bits of a length that are kept beyond that
MAX_SPECS = 10_000  # container specifications; configuration, not data

Pattern = tuple[tuple[tuple[int, int], ...], int]


def pack_histogram(histogram: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Patterns (((length, times in a container), ...), number of such containers) for items by length.

    Shortest pack first; where that leaves room for fewer containers (few short
    items), fullest pack first is tried as well and the better of both is taken.
    """
    patterns = _patterns(histogram, capacity, shortest=True)
    used = sum(count for _, count in patterns)
    if used * capacity - sum(length * n for length, n in histogram.items()) >= capacity:
        other = _patterns(histogram, capacity, shortest=False)
        if sum(count for _, count in other) < used:
            return other
    return patterns


def _patterns(histogram: Mapping[int, int], capacity: int, shortest: bool) -> list[Pattern]:
    open_packs: dict[int, list[list]] = {}  # room left -> [content as a linked list of (length, times, rest), count]
    rooms: list[int] = []  # the keys of open_packs, sorted

    def push(left: int, content, count: int) -> None:
        if left not in open_packs:
            open_packs[left] = []
            bisect.insort(rooms, left)
        open_packs[left].append([content, count])

    def pull(length: int):
        """(room, content, count) of the pack to fill next, taken out; None if the length fits nowhere."""
        at = len(rooms) - 1 if shortest else bisect.bisect_left(rooms, length)
        if not rooms or at >= len(rooms) or rooms[at] < length:
            return None
        room = rooms[at]
        content, count = open_packs[room].pop()
        if not open_packs[room]:
            del open_packs[room], rooms[at]
        return room, content, count

    def with_items(content, length: int, times: int):
        if content is not None and content[0] == length:
            return length, content[1] + times, content[2]
        return length, times, content

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"an item of length {length} does not fit a container of {capacity}")
        while todo > 0:
            if (taken := pull(length)) is not None:
                room, content, count = taken
                # as many for each as go in before another pack is the one to fill
                next_room = rooms[-1] if shortest and rooms else 0
                times = max(1, min((room - next_room) // length, room // length, todo // count))
                used = min(todo, count)
                if used < count:
                    push(room, content, count - used)
                push(room - times * length, with_items(content, length, times), used)
                todo -= times * used
                continue
            each = capacity // length
            whole, rest = divmod(todo, each)
            for items, count in ((each, whole), (rest, 1)):
                if items and count:
                    push(capacity - items * length, (length, items, None), count)
            todo = 0
    patterns = []
    for packs in open_packs.values():
        for content, count in packs:
            lengths = []
            while content is not None:
                lengths.append(content[:2])
                content = content[2]
            patterns.append((tuple(reversed(lengths)), count))
    return sorted(patterns, reverse=True)


def intervals(patterns: Iterable[Pattern], histogram: Mapping[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, first, each): the item of rank r of an interval lies in container first + (r - low) // each.

    Ranks count the items of one length.
    """
    start = dict.fromkeys(histogram, 0)
    out, container = [], 0
    for lengths, count in patterns:
        for length, times in lengths:
            out.append((length, start[length], start[length] + count * times, container, times))
            start[length] += count * times
        container += count
    return out


def _sum_before(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``counts`` (by..., bucket, value) with ``before``, the sum over earlier buckets, added up in two steps."""
    group = F.floor(F.col("bucket") / BUCKETS_TOGETHER)
    inside = Window.partitionBy(*by, "_group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("_group", group).withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    over = Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.withColumn("_group", group).groupBy(*by, "_group").agg(F.sum(value).alias("_sum"))
    groups = groups.withColumn("_skip", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    return rows.join(groups, [*by, "_group"]).withColumn("before", F.col("before") + F.col("_skip")).drop("_group", "_skip")


def _rounded(rest: Column, capacity: Column) -> Column:
    """The length that is packed: the item's own, rounded up beyond EXACT where it has more bits than are kept."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(rest)) - PRECISION, F.lit(0))).cast("bigint")
    up = F.least(F.ceil(rest / step).cast("bigint") * step, capacity)
    return F.when((capacity > EXACT) & (rest > 0), up).otherwise(rest)


def pack(items: DataFrame, capacities: Mapping[int, int], key: str = "doc_id") -> DataFrame:
    """(spec_id, key, part, container, tokens) for ``items`` (spec_id, key, tokens), tokens > 0; these are read more than once.

    ``capacities`` is the capacity by spec_id. Parts of a cut item are numbered
    from 0; all but the last fill their container.
    """
    spark = items.sparkSession
    sized = items.join(
        F.broadcast(spark.createDataFrame(list(capacities.items()), "spec_id bigint, capacity bigint")), "spec_id"
    )
    n = max(1, sized.count() // BUCKET_ROWS)
    fits = F.col("tokens") <= F.col("capacity")
    # rest: tokens of the part that is packed; whole: containers that a long item fills
    parts = sized.select(
        "spec_id",
        key,
        "capacity",
        F.when(fits, F.col("tokens")).otherwise(F.col("tokens") % F.col("capacity")).alias("rest"),
        F.when(fits, 0).otherwise(F.floor(F.col("tokens") / F.col("capacity"))).cast("bigint").alias("whole"),
        F.pmod(F.xxhash64(key), F.lit(n)).alias("bucket"),
    )
    packed = parts.where("rest > 0").withColumn("length", _rounded(F.col("rest"), F.col("capacity")))
    counted = packed.groupBy("spec_id", "length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counted = stage_table(counted, "histogram")
    histograms: dict[int, dict[int, int]] = {}
    for row in counted.groupBy("spec_id", "length").agg(F.sum("n").alias("n")).collect():  # bounded by EXACT and PRECISION
        histograms.setdefault(row["spec_id"], {})[row["length"]] = row["n"]
    table, used = [], {}
    for spec, histogram in histograms.items():
        patterns = pack_histogram(histogram, capacities[spec])
        used[spec] = sum(count for _, count in patterns)
        table += [(spec, *x) for x in intervals(patterns, histogram)]
    # rank of an item among those of its length = counts of earlier buckets + number inside the bucket
    offsets = _sum_before(counted, ("spec_id", "length"), "n")
    spans = spark.createDataFrame(table, "spec_id bigint, length bigint, low bigint, high bigint, first bigint, each bigint")
    met = offsets.join(spans, ["spec_id", "length"]).where("low < before + n AND high > before")
    met = met.groupBy("spec_id", "length", "bucket", "before").agg(F.collect_list(F.struct("low", "high", "first", "each")).alias("spans"))
    inside = Window.partitionBy("spec_id", "length", "bucket").orderBy(key)
    rank = F.col("place") + F.col("before")
    ranked = packed.withColumn("place", F.row_number().over(inside) - 1).join(met, ["spec_id", "length", "bucket"]).withColumn("rank", rank)
    ranked = ranked.withColumn("span", F.get(F.filter("spans", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), F.lit(0)))
    container = F.col("span.first") + F.floor((F.col("rank") - F.col("span.low")) / F.col("span.each"))
    small = ranked.select("spec_id", key, F.col("whole").alias("part"), container.alias("container"), F.col("rest").alias("tokens"))

    # containers that long items fill are numbered after the packed ones, bucket by bucket
    long = parts.where("whole > 0")
    sums = _sum_before(long.groupBy("spec_id", "bucket").agg(F.sum("whole").alias("n")), ("spec_id",), "n").drop("n")
    number = Window.partitionBy("spec_id", "bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    after = F.create_map(*(F.lit(x).cast("bigint") for pair in used.items() for x in pair)) if used else F.create_map().cast("map<bigint,bigint>")
    first = F.coalesce(after[F.col("spec_id")], F.lit(0)) + F.col("before") + F.col("skip")
    full = (
        long.withColumn("skip", F.coalesce(F.sum("whole").over(number), F.lit(0)))
        .join(sums, ["spec_id", "bucket"])
        .select("spec_id", key, "capacity", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("part"))
        .select("spec_id", key, "part", (F.col("first") + F.col("part")).alias("container"), F.col("capacity").alias("tokens"))
    )
    return small.unionByName(full)


def specifications(specs: DataFrame) -> list[tuple[int, str, int]]:
    """(spec_id, tokenizer, capacity) of the containers to fill; their number is checked."""
    rows = specs.select("spec_id", "tokenizer", "capacity").limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} container specifications")
    return [tuple(r) for r in rows if r["capacity"] and r["capacity"] > 0]


def pack_documents(documents: DataFrame, specs: DataFrame, folder: str | None = None) -> DataFrame:
    """(spec_id, doc_id, part, container, tokens) of every non-empty text for each row of ``specs``."""
    rows = specifications(specs)
    texts = documents.where(F.col("text").isNotNull() & (F.col("text") != ""))
    spark = documents.sparkSession
    if not rows:
        return spark.createDataFrame([], "spec_id bigint, doc_id bigint, part bigint, container bigint, tokens bigint")
    sized = stage_table(encoding.lengths(texts, [tokenizer for _, tokenizer, _ in rows], folder=folder), "lengths")
    wanted = F.broadcast(spark.createDataFrame([r[:2] for r in rows], "spec_id bigint, tokenizer string"))
    items = sized.join(wanted, "tokenizer").select("spec_id", "doc_id", "tokens")
    nothing = items.where("tokens = 0").select("spec_id", "doc_id", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("container"), "tokens")
    return pack(items.where("tokens > 0"), {spec: capacity for spec, _, capacity in rows}).unionByName(nothing)


def balance(packs: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, texts, overfull, needless, tight) of each specification that has packs.

    ``texts`` counts the texts packed, ``overfull`` containers over their capacity,
    ``needless`` texts cut although one container would hold them; ``tight`` says
    that at most one in a hundred containers could be spared by filling all to the brim.
    """
    capacity = F.broadcast(packs.sparkSession.createDataFrame([(r[0], r[2]) for r in specifications(specs)], "spec_id bigint, capacity bigint"))
    loads = packs.groupBy("spec_id", "container").agg(F.sum("tokens").alias("load")).join(capacity, "spec_id")
    filled = loads.groupBy("spec_id", "capacity").agg(
        F.count_if(F.col("load") > F.col("capacity")).alias("overfull"), F.count(F.lit(1)).alias("used"), F.sum("load").alias("tokens")
    )
    whole = packs.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts")).join(capacity, "spec_id")
    texts = whole.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("parts") != F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1))).alias("needless")
    )
    tight = F.col("used") <= 1.01 * F.ceil(F.col("tokens") / F.col("capacity")) + 1
    return texts.join(filled, "spec_id").select("spec_id", "texts", "overfull", "needless", tight.alias("tight"))
