import math
import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import packing as P


def check(histogram, capacity):
    patterns = P.pack_histogram(histogram, capacity)
    placed = Counter()
    for lengths, count in patterns:
        assert sum(length * times for length, times in lengths) <= capacity and count > 0
        for length, times in lengths:
            placed[length] += count * times
    assert placed == Counter({k: v for k, v in histogram.items() if v})
    # an upper bound on patterns, so that the table stays small
    assert len(patterns) <= 3 * len(histogram) + 1
    return sum(count for _, count in patterns)


@pytest.mark.parametrize("seed", range(8))
def test_random_histograms(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 64, 512])
    histogram = {rng.randint(1, capacity): rng.randint(1, 10 ** rng.randint(0, 6)) for _ in range(40)}
    used = check(histogram, capacity)
    least = math.ceil(sum(k * v for k, v in histogram.items()) / capacity)
    assert used >= least
    if min(histogram) <= capacity // 16 and histogram[min(histogram)] > 1000:
        assert used <= 1.25 * least + 2


def test_small_cases():
    assert P.pack_histogram({}, 10) == []
    assert check({10: 3}, 10) == 3 and check({6: 2, 4: 2}, 10) == 2 and check({1: 25}, 10) == 3
    with pytest.raises(ValueError):
        P.pack_histogram({11: 1}, 10)


def test_contents_are_run_lengths():
    """Many equal items in few containers are few numbers, also where they fill what longer ones left."""
    assert P.pack_histogram({1 << 19: 1, 1: 1 << 19}, 1 << 20) == [(((1 << 19, 1), (1, 1 << 19)), 1)]
    for capacity in (1 << 15, 1 << 20):
        patterns = P.pack_histogram({capacity // 2: 3, 7: 5 * capacity // 7, 1: capacity}, capacity)
        assert len(P.intervals(patterns, {capacity // 2: 3, 7: 5 * capacity // 7, 1: capacity})) < 40


def packs(spark, sizes, capacities):
    items = spark.createDataFrame([(s, i, n) for s in capacities for i, n in enumerate(sizes)], "spec_id bigint, doc_id bigint, tokens bigint")
    return [tuple(r) for r in P.pack(items, capacities).select("spec_id", "doc_id", "part", "container", "tokens").collect()]


@pytest.mark.parametrize("bucket_rows", [5, 200_000])
def test_items_are_whole_and_fit(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(2)
    sizes = [rng.choice([7, 7, 7, rng.randint(1, 40), rng.randint(1, 260)]) for _ in range(300)]
    capacities = {1: 40, 2: 100}
    rows = packs(spark, sizes, capacities)
    parts, load = defaultdict(list), Counter()
    for spec, doc, part, container, tokens in rows:
        parts[spec, doc].append((part, tokens))
        load[spec, container] += tokens
    for (spec, doc), own in parts.items():
        capacity = capacities[spec]
        own.sort()
        assert sum(t for _, t in own) == sizes[doc] and len(own) == math.ceil(sizes[doc] / capacity)
        assert [p for p, _ in own] == list(range(len(own))) and all(t == capacity for _, t in own[:-1])
    assert len(parts) == 2 * len(sizes)
    for spec, capacity in capacities.items():
        used = [load[s, c] for s, c in load if s == spec]
        assert max(used) <= capacity and {c for s, c in load if s == spec} == set(range(len(used)))
        # half of the items have length 7, which does not divide the capacities: no packing reaches the sum
        assert len(used) <= 1.03 * math.ceil(sum(sizes) / capacity)


def test_result_does_not_depend_on_partitions(spark):
    items = spark.createDataFrame([(1, i, 1 + i % 9) for i in range(200)], "spec_id bigint, doc_id bigint, tokens bigint")
    one = {tuple(r) for r in P.pack(items.coalesce(1), {1: 20}).collect()}
    assert one == {tuple(r) for r in P.pack(items.repartition(7), {1: 20}).collect()}


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", 0), (2, "", 0), (3, None, 0), (4, " ", 0), (5, "word " * 50, 0)], "doc_id bigint, text string, container int")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 16), (2, "piece_bpe_32k", 16), (3, "byte_bpe_50k", None), (4, "byte_bpe_50k", 0)], "spec_id bigint, tokenizer string, capacity bigint")
    rows = P.pack_documents(docs, specs).collect()
    assert {(r.spec_id, r.doc_id) for r in rows} == {(s, d) for s in (1, 2) for d in (1, 4, 5)}
    assert max(r.tokens for r in rows) == 16
    assert P.pack_documents(docs.limit(0), specs).count() == 0 and P.pack_documents(docs, specs.limit(0)).count() == 0


def test_any_capacity(spark):
    """Beyond EXACT lengths are rounded up: nothing is over its capacity, and hardly any room is lost."""
    capacity, rng = 5 << 20, random.Random(6)
    sizes = [rng.randint(1, 6 << 20) for _ in range(60)] + [1, 2, 3, capacity, capacity + 1] + [rng.randint(1, 1 << 14) for _ in range(300)]
    rows, load, total = packs(spark, sizes, {1: capacity}), Counter(), Counter()
    for _, doc, _, container, tokens in rows:
        load[container] += tokens
        total[doc] += tokens
    assert dict(total) == dict(enumerate(sizes)) and max(load.values()) <= capacity
    assert len(load) <= 1.02 * math.ceil(sum(sizes) / capacity) + 1


def test_sums_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKETS_TOGETHER", 3)
    rows = spark.createDataFrame([(s, b, 1 + (b * 7 + s) % 5) for s in (1, 2) for b in range(0, 20, 1 + s)], "spec_id int, bucket bigint, n bigint")
    data = rows.collect()
    for r in P._sum_before(rows, ("spec_id",), "n").collect():
        assert r.before == sum(x.n for x in data if x.spec_id == r.spec_id and x.bucket < r.bucket)


def test_balance_tells_faults(spark):
    specs = spark.createDataFrame([(1, "x", 10)], "spec_id bigint, tokenizer string, capacity bigint")
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "spec_id bigint, doc_id bigint, part bigint, container bigint, tokens bigint")
    one = lambda rows: tuple(P.balance(frame(rows), specs).first())
    assert one([(1, 0, 0, 6), (2, 0, 0, 4), (3, 0, 1, 5)]) == (1, 3, 0, 0, True)
    assert one([(1, 0, 0, 6), (2, 0, 0, 5)]) == (1, 2, 1, 0, True)
    assert one([(1, 0, 0, 3), (1, 1, 1, 3)]) == (1, 1, 0, 1, True)
    assert one([(i, 0, i, 2) for i in range(10)]) == (1, 10, 0, 0, False)
