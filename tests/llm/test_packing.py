"""Length buckets and batches against brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import packing

SCHEMA = "doc_id long, page_idx int, n_tokens long"


def padded(sizes, bounds):
    return sum(n * min(b for b in bounds if b >= length) for length, n in sizes.items())


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    pick = random.Random(seed)
    sizes = {pick.randint(1, 40): pick.randint(1, 30) for _ in range(pick.randint(1, 10))}
    for buckets in range(1, 6):
        found = packing.best_bounds(sizes, buckets)
        assert len(found) <= buckets and found == sorted(set(found)) and found[-1] == max(sizes)
        others = itertools.combinations(sizes, min(buckets, len(sizes)))
        assert padded(sizes, found) == min(padded(sizes, b) for b in others if max(sizes) in b)


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SHARD", 16)
    monkeypatch.setattr(packing, "SHARDS_PER_GROUP", 4)
    pick = random.Random(2)
    rows = [(i, pick.randrange(2), pick.choice([3, 3, 3, pick.randint(1, 90), 64, 65, 128])) for i in range(700)]
    rows += [(1, 1, 5), (1, 1, 5), (None, None, 7), (800, 0, 1000), (801, 0, None), (802, 0, 0), (803, 0, -4)]
    found = packing.pack_pages(spark.createDataFrame(rows, SCHEMA), 64, 4, 200).collect()
    tokens = Counter()
    for r in found:
        tokens[r.doc_id, r.page_idx] += r.n_tokens
    expected = Counter()
    for doc, page, n in rows:
        expected[doc, page] += max(n or 0, 0)
    assert tokens == expected
    empty = [r for r in found if not r.n_tokens]
    assert sorted(r.doc_id for r in empty) == [801, 802, 803] and all(r.batch_no is None for r in empty)
    full = [r for r in found if r.n_tokens]
    assert len({(r.bucket_tokens, r.batch_no, r.batch_row) for r in full}) == len(full)
    sizes = Counter(r.n_tokens for r in full)
    bounds = packing.best_bounds(sizes, 4)
    assert all(r.bucket_tokens == min(b for b in bounds if b >= r.n_tokens) for r in full)
    for bound in bounds:
        batches = Counter(r.batch_no for r in full if r.bucket_tokens == bound)
        assert set(batches) == set(range(len(batches)))
        assert all(n == 200 // bound for b, n in batches.items() if b < len(batches) - 1)
    assert [r.n_tokens for r in sorted((r for r in full if r.doc_id == 800), key=lambda r: r.piece_no)] == [64] * 15 + [40]


def test_empty_and_clashing(spark):
    assert packing.pack_pages(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, 0, 3)], SCHEMA)
    for name in ("total", "draw", "shard", "batch_no", "place"):
        rows = rows.withColumn(name, F.lit("x"))
    assert [tuple(r) for r in packing.pack_pages(rows).collect()] == [(1, 0, 0, 3, 3, 0, 0)]
    with pytest.raises(ValueError):
        packing.pack_pages(rows, max_tokens=10, batch_tokens=5)


def test_word_count(spark):
    texts = [None, "", " \n", "a", " a b\tc\x0b\x0cd\r\n", "a b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(packing.word_count(F.col("text"))).collect()] == [0, 0, 0, 1, 4, 2]
