"""Benchmark passages in pages against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontamination

PAGES, ITEMS = "doc_id long, page_idx int, text string", "item_id long, text string"


def split(text):
    lower = (text or "").translate(str.maketrans(decontamination.UPPER, decontamination.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow(pages, items):
    result = []
    for doc, page, text in pages:
        words, hit, named = split(text), set(), set()
        for item, passage in items:
            own = split(passage)
            n = min(13, len(own))
            for i in range(len(own) - n + 1 if own and item is not None else 0):
                for at in range(len(words) - n + 1):
                    if words[at:at + n] == own[i:i + n]:
                        hit.update(range(at, at + n))
                        named.add(str(item))
        result.append((doc, page, len(words), len(hit), len(named), sorted(named),
                       len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(result, key=repr)


def check(spark, pages, items):
    found = decontamination.contaminated_pages(spark.createDataFrame(pages, PAGES),
                                               spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, found.collect()), key=repr) == slow(pages, items)


@pytest.mark.parametrize("most_broadcast", [1 << 20, 0])
def test_matches_brute_force(spark, monkeypatch, most_broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", most_broadcast)
    pick = random.Random(5)
    common = ["a", "b", "É", "é", "7"]
    items = [(i, " ".join(pick.choice(common + [f"w{pick.randrange(60)}"]) for _ in range(pick.choice([1, 2, 4, 5, 6, 12, 13, 14, 30]))))
             for i in range(25)]
    items += [(100, items[24][1].upper()), (24, "a a a a a a a a a a a a a a a"), (101, None), (102, ""), (103, "!!"), (None, "a b")]
    pages = []
    for i in range(60):
        words = [pick.choice(common + [f"w{pick.randrange(60)}"]) for _ in range(pick.randint(0, 80))]
        for _ in range(pick.randint(0, 2)):
            passage = split(pick.choice(items)[1])
            cut = passage[pick.randint(0, 2):len(passage) - pick.randint(0, 2)]
            place = pick.randint(0, len(words))
            words[place:place] = cut
        pages.append((i, pick.randrange(2), pick.choice([" ", "-", "\n."]).join(words)))
    pages += [(3, 0, pages[3][2]), (None, None, "a a a a a a a a a a a a a a"), (70, 0, None), (71, 0, ""), (72, 0, "..."),
              (73, 0, " ".join(["a"] * 500)), (74, 0, " ".join(["x"] * 3000 + split(items[24][1])))]
    check(spark, pages, items)


def test_empty_tables_and_clashing_columns(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, 0, "a b c"), (2, 0, None)], [])
    pages = spark.createDataFrame([(1, 0, "x a B c")], PAGES)
    for name in ("words", "row", "pos", "key", "item_id", "n_hit"):
        pages = pages.withColumn(name, F.lit(5))
    items = spark.createDataFrame([(1, "A b")], ITEMS).withColumn("window", F.lit(0)).withColumn("words", F.lit(1))
    found = decontamination.contaminated_pages(pages, items).collect()
    assert [tuple(r) for r in found] == [(1, 0, 4, 2, 1, ["1"], True)]


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, 0, "x a B c")], PAGES)
    plan = decontamination.contaminated_pages(pages, spark.createDataFrame([(1, "A b")], ITEMS))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text
