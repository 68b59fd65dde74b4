"""The pipeline's stages against plain Python over small tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import language, packing, simhash
from marginalia.llm.queries import as_page_text, labelled_for_training

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ein", "ung", "ber", "tz"]}


def sentence(pick, lang, n):
    return " ".join("".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(11)
    made = []
    for i in range(120):
        lang = pick.choice(list(SYLLABLES))
        made.append([i, sentence(pick, lang, pick.randint(30, 120)), lang])
    for i in range(120, 150):
        made.append([i, made[pick.randrange(100)][1], "aa"])
    items = [(1, sentence(pick, "aa", 20)), (2, sentence(pick, "bb", 15))]
    for i in range(150, 160):
        made.append([i, sentence(pick, "aa", 30) + " " + items[i % 2][1] + " " + sentence(pick, "aa", 10), "aa"])
    made.append([160, sentence(pick, "aa", 2000) + " " + items[0][1], "aa"])  # far below a twentieth
    made += [[161, None, None], [162, "12 34 !!", "aa"], [5, made[5][1], "aa"], [7, sentence(pick, "bb", 60), "bb"]]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in made], items


def test_stages(spark, rows, tmp_path):
    table, items = rows
    docs = spark.createDataFrame(table, SCHEMA).withColumn("row", F.lit(1)).withColumn("id", F.lit("x"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "SimHash near-dedup", "benchmark decontamination", "packing"]

    told = stages["language ID"](spark, docs, str(tmp_path))
    assert told.columns == docs.columns
    judge = language.Judge(language.fit_dictionaries(labelled_for_training(docs)))
    clear = [r for r in table if judge((r[1] or "").encode())[1] >= language.MIN_MARGIN]
    assert sorted((r.doc_id, r.text) for r in told.collect()) == sorted((r[0], r[1]) for r in clear)
    assert {161, 162}.isdisjoint(r[0] for r in clear) and len(clear) > 155

    single = stages["SimHash near-dedup"](spark, told, str(tmp_path))
    assert single.columns == docs.columns
    prints = [simhash.fingerprint(r[1].encode()) for r in clear]
    root = list(range(len(clear)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(clear)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(clear):
        groups.setdefault(find(i), []).append(r)
    kept = [min(g)[:2] for g in groups.values()]
    assert sorted((r.doc_id, r.text) for r in single.collect()) == sorted(kept)
    assert sum(doc == 7 for doc, _ in kept) == 2  # two documents under one id are not one group

    clean = stages["benchmark decontamination"](spark, single, str(tmp_path))
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert left == {doc for doc, _ in kept} - set(range(150, 160)) and 160 in left

    packed = stages["packing"](spark, clean, str(tmp_path)).collect()
    words = {}
    for r in packed:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_tokens
    expected = {}
    for doc, text in kept:
        if doc in left:
            expected[doc] = expected.get(doc, 0) + len(text.split())
    assert words == expected and max(r.n_tokens for r in packed) <= packing.MAX_TOKENS


def test_run_joins_the_stages(spark, rows, tmp_path):
    table, items = rows
    spark.createDataFrame(table, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_nulls_and_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = spark.createDataFrame([(None, "kalomi ture " * 9, None, None, None), (None, "kalomi ture " * 9, "aa", None, None),
                                 (1, "kalomi loka " * 9, "aa", None, None)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        found = stage(spark, odd, str(tmp_path))
        assert found.count() == {"SimHash near-dedup": 2}.get(name, 3)
    assert as_page_text(empty).columns[-1] == "page_idx"


@pytest.mark.parametrize("doc_id", [None, 3])
def test_bad_rows_take_no_others_along(spark, tmp_path, doc_id):
    pick = random.Random(12)
    item = sentence(pick, "aa", 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    learned = [(100 + i, sentence(pick, lang, 60), lang) for i in range(40) for lang in SYLLABLES]
    clean = [(doc_id, sentence(pick, lang, 50), lang) for lang in SYLLABLES]
    bad = {"language ID": [(doc_id, "12 34 !!", "aa"), (doc_id, None, None)],
           "benchmark decontamination": [(doc_id, "lomi " + item, "aa")]}
    for name, own in bad.items():
        docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in learned + clean + own], SCHEMA)
        kept = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).collect()
        assert sorted(r.text for r in kept if r.doc_id == doc_id) == sorted(t for _, t, _ in clean)
        assert len(kept) == len(learned) + len(clean)
