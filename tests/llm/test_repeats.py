"""Removal of passages that pages share, against a plain count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import repeats

SCHEMA = "doc_id long, page_idx int, text string"


def slow(rows, window):
    split = [(t or "").encode().split() for _, _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, page, _), words in zip(rows, split, strict=True):
        gone = {j for i in range(len(words) - window + 1) if seen[tuple(words[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, page, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out


def library(seed, pages=120):
    pick = random.Random(seed)
    word = lambda: pick.choice("abcdefghijklmnopqrstuvwxyz") * pick.randint(1, 3)
    shared = [[word() for _ in range(pick.choice([5, 20, 35, 36, 60]))] for _ in range(8)]
    rows = []
    for doc in range(pages):
        words = []
        for _ in range(pick.randint(0, 6)):
            words += pick.choice(shared) if pick.random() < 0.4 else [word() for _ in range(pick.randint(0, 40))]
        rows.append((doc, doc % 3, pick.choice([" ", "\n", " \t"]).join(words)))
    rows += [(d, p, t) for d, p, t in rows[:20]] + [(1000 + i, 0, rows[5][2]) for i in range(30)]
    rows += [(None, None, None), (None, 0, ""), (7, None, "  "), (None, None, rows[6][2]), (2000, 0, "x " * 300), (2001, 0, "x y " * 40)]
    return rows


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("window", [1, 2, 8, 35])
def test_against_all_windows(spark, window):
    rows = library(window)
    found = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), window)
    expected = slow(rows, window)
    assert order(map(tuple, found.collect())) == order(expected)
    assert 0 < sum(r[3] for r in expected) and (window == 1 or any(0 < r[3] < r[2] for r in expected))


def test_frequent_minimisers_and_cut_buckets(spark, monkeypatch):
    """A line of 20 words on every page, alone too short to be removed, and little room in a task."""
    pick = random.Random(3)
    line = [f"line{i}" for i in range(20)]
    rows = [(i, 0, " ".join([f"w{pick.random()}" for _ in range(40)] + line + [f"v{i // 2}-{j}" for j in range(40)])) for i in range(300)]
    rows += [(500 + i, 0, rows[9][2]) for i in range(200)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(7)
    often = repeats._often(pages, len(rows), 35)
    assert often and all(parts > 1 for parts in often.values())
    expected = order(slow(rows, 35))
    assert order(map(tuple, repeats.without_repeats(pages).collect())) == expected
    monkeypatch.setattr(repeats, "SENT_AT_ONCE", 5000)
    monkeypatch.setattr(repeats, "COUNTED_AT_ONCE", 20_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 200_000)
    sent = pages.mapInArrow(repeats._packer(35, {}, 3, 5000), repeats.PACKED).toArrow().sort_by("bucket")
    parts = list(repeats._buckets(sent.to_batches(), 20_000))
    assert sum(is_part for _, is_part in parts) > 3 and len(sent) > 20
    assert order(map(tuple, repeats.without_repeats(pages).collect())) == expected
    monkeypatch.setattr(repeats, "_often", lambda pages, n_pages, window: {})
    assert order(map(tuple, repeats.without_repeats(pages).collect())) == expected


def test_windows_with_equal_hashes():
    """Different windows stay apart, whatever the rolling hash says."""
    ids = np.array([0, 1, 2, 0, 1, 2, 3, 0, 1, 3], np.int32)
    at = np.arange(8)
    kinds = repeats._kinds(ids, at, 3)
    plain = [tuple(ids[i:i + 3]) for i in at]
    assert [[a == b for b in kinds] for a in kinds] == [[a == b for b in plain] for a in plain]


def test_long_text_in_stretches(spark, monkeypatch):
    import marginalia.llm.batches as batches
    monkeypatch.setattr(batches, "STRETCH", 50)
    rows = library(11, 40)
    hashes = repeats.Hashes()
    for _, _, text in rows:
        words = (text or "").encode().split()
        starts = [first + i for _, first, packed in repeats._strings((text or "").encode(), 8, hashes)
                  for i in range(len(packed.split()) - 7)]
        assert starts == list(range(len(words) - 7))
    covered = [{"first": 3, "more": 37}, {"first": 20, "more": 10}, {"first": 38, "more": 22}, {"first": 90, "more": 5}]
    words = [b"w%d" % i for i in range(120)]
    gone = {i for c in covered for i in range(c["first"], c["first"] + c["more"] + 1)}
    assert repeats._rest(b" ".join(words), covered) == (120, len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_empty_table_and_other_columns(spark):
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "a b", 5, "x"), (2, 0, "a b", 6, "y")]
    pages = spark.createDataFrame(rows, SCHEMA + ", bucket long, digest string")
    found = repeats.without_repeats(pages, 2)
    assert found.columns == ["doc_id", "page_idx", "n_words", "n_removed", "text"]
    assert order(map(tuple, found.collect())) == [(1, 0, 2, 2, ""), (2, 0, 2, 2, "")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_are_counted_once(spark):
    """Stretches and single windows are read from the same count of the strings."""
    pages = spark.createDataFrame(library(5), SCHEMA)
    counted = (pages.mapInArrow(repeats._packer(8, {}, 3, 5000), repeats.PACKED).repartition(3, "bucket")
               .sortWithinPartitions("bucket").mapInArrow(repeats._counter(8, 20_000), repeats.COUNTED))
    assert plan(repeats._covered(counted, 8)).count("MapInArrow") == plan(counted).count("MapInArrow") == 2


def test_pages_pass_python_once(spark):
    """The filter is tested where pages are rewritten, so a task holds no second Python worker with the pages."""
    pages = spark.createDataFrame(library(6), SCHEMA)
    covered = spark.createDataFrame([], "digest binary, covered array<struct<first:bigint,more:int>>")
    assert "EvalPython" not in plan(repeats._without(pages, covered))


def test_long_words(spark, monkeypatch):
    """Words that differ behind their hashed bytes, in lines that are hashed apart and in lines that are not."""
    rows = library(4, 30)
    long = [" ".join(("x" * 100 + str(i % 7 if i < 20 else i)) for i in range(start, start + 60)) for start in (0, 0, 30, 200)]
    rows += [(3000 + i, 0, text) for i, text in enumerate(long)] + [(3010, 0, "y " * 20 + long[0])]
    expected = order(slow(rows, 8))
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert order(map(tuple, repeats.without_repeats(pages, 8).collect())) == expected
    short = [found for _, _, t in rows for found in repeats._strings((t or "").encode(), 8, repeats.Hashes())]
    monkeypatch.setattr(repeats, "STRETCH", 50)
    assert [found for _, _, t in rows for found in repeats._strings((t or "").encode(), 8, repeats.Hashes())] == short
