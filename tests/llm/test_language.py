"""Language identification: held-out accuracy, and the cases with defined results."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import language

SCHEMA = "doc_id long, page_idx int, text string, lang string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ré"], "bb": ["sch", "ein", "ung", "ber", "über"],
             "cc": ["th", "ing", "wh", "ou", "st"]}


def pages(seed, n, words=(3, 200)):
    pick = random.Random(seed)
    for i in range(n):
        lang = pick.choice(list(SYLLABLES))
        text = " ".join("".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randint(1, 3)))
                        for _ in range(pick.randint(*words)))
        yield i, 0, pick.choice([text, text.upper(), text.replace(" ", ", 12 ")]), lang


@pytest.fixture(scope="module")
def dictionaries(spark):
    rows = [*pages(1, 400), (900, 0, None, "aa"), (901, 0, "text", None), (902, 0, "", "dd"), (903, 0, "x", "ee")]
    return language.fit_dictionaries(spark.createDataFrame(rows, SCHEMA))


def test_held_out_accuracy(spark, dictionaries):
    assert set(dictionaries) == {"aa", "bb", "cc", "dd", "ee"}
    rows = list(pages(2, 600))
    found = {r.doc_id: r for r in language.page_languages(spark.createDataFrame(rows, SCHEMA), dictionaries).collect()}
    assert len(found) == 600 and all(0 <= r.score <= 1 for r in found.values())
    right = [found[i].lang_pred == lang for i, _, _, lang in rows]
    assert sum(right) / 600 > 0.98
    assert sum(r.rejected for r in found.values()) < 12


def test_prediction_uses_the_text_alone(spark, dictionaries):
    rows = spark.createDataFrame(list(pages(4, 50)), SCHEMA)
    first = language.page_languages(rows, dictionaries).collect()
    second = language.page_languages(rows.withColumn("lang", F.lit("zz")).withColumn("score", F.lit("x")), dictionaries).collect()
    assert first == second


def test_defined_cases(spark, dictionaries):
    rows = [(1, 0, None, None), (2, 0, "", None), (3, 0, "123 -- 4", None), (None, None, "schein ung ein", None),
            (5, 0, "kalo mitu " * 200_000, None), (5, 0, "kalo mitu " * 200_000, None), (6, 0, "中文", None)]
    found = language.page_languages(spark.createDataFrame(rows, SCHEMA), dictionaries).collect()
    assert [r.lang_pred for r in found[:6]] == ["und", "und", "und", "bb", "aa", "aa"]
    assert [r.score for r in found[:3]] == [0, 0, 0] and all(r.rejected for r in found[:3])
    assert found[6].lang_pred in dictionaries
    mixed = language.page_languages(spark.createDataFrame(rows, SCHEMA), dictionaries, min_margin=1.0).collect()
    assert all(r.rejected for r in mixed)


def test_short_texts(spark, dictionaries):
    rows = list(pages(7, 300, words=(3, 6)))
    found = {r.doc_id: r for r in language.page_languages(spark.createDataFrame(rows, SCHEMA), dictionaries).collect()}
    assert sum(found[i].lang_pred == lang for i, _, _, lang in rows) / 300 > 0.97


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.fit_dictionaries(empty) == {}
    assert language.page_languages(empty, {"aa": language.Dictionary(b"a", b"")}).count() == 0
    one = spark.createDataFrame([(1, 0, "some text", None)], SCHEMA)
    assert [(r.lang_pred, r.rejected) for r in language.page_languages(one, {}).collect()] == [("und", True)]
    assert [(r.lang_pred, r.score) for r in language.page_languages(one, {"aa": language.Dictionary(b"a", b"")}).collect()] == [("aa", 1.0)]
