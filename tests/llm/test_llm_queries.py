"""The training-data queries: against their SQL at the smallest scale, and without SQL against plain Python."""

import math
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_lm_scoring import corpus
from test_lm_scoring import slow as slow_scores
from test_simhash import slow_classes, slow_fingerprint
from test_token_counts import slow_length

import __spark_entry__ as contract
from marginalia.llm import language, lm_scoring, packing, queries, token_counts

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "pages", "benchmark", "conversations"]


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    exact = lambda r: [repr(v) for v in r if not isinstance(v, float)]
    return [columns[i] for i in places], sorted((tuple(r[i] for i in places) for r in rows), key=exact)


def same(found, expected):
    assert len(found) == len(expected)
    for own, other in zip(found, expected, strict=True):
        assert [type(v) is float for v in own] == [type(v) is float for v in other]
        assert all(math.isclose(a, b, abs_tol=1.1e-6) if isinstance(a, float) else a == b for a, b in zip(own, other, strict=True))


def test_every_query_is_looked_at_here():
    by_hand = {"op1_simhash_near_dedup", "op3_language_id", "op5_token_counts", "op6_lm_scoring", "op7_packing"}
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) | by_hand
    assert contract.oracle_sql().items() >= queries.ORACLE_SQL.items()


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = database.execute(contract.oracle_sql()[name])
    columns, expected = ordered([c[0] for c in cursor.description], cursor.fetchall())
    found = contract.queries()[name](spark, FOLDER)
    own_columns, own = ordered(found.columns, found.collect())
    assert expected and own_columns == columns
    same(own, expected)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick = random.Random(21)
    rows = [(i, text, pick.choice(["aa", "bb"])) for i, _, text, _ in corpus(21, 80)]
    rows += [(80 + i, rows[i][1] + " zz", "aa") for i in range(15)] + [(95, None, None), (96, "", "aa"), (97, "word " * 5000, "bb")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def run(spark, name, folder, columns):
    found = contract.queries()[name](spark, folder)
    assert found.columns == columns
    return sorted(map(tuple, found.collect()))


def left_out(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


def test_op1(spark, folder):
    path, rows = folder
    prints = [slow_fingerprint(text) for _, text, _ in rows]
    classes = slow_classes([doc for doc, *_ in rows], prints)
    expected = [(doc, f"{own:016x}", first) for (doc, *_), own, first in zip(rows, prints, classes, strict=True)]
    assert run(spark, "op1_simhash_near_dedup", path, ["doc_id", "fingerprint", "component_id"]) == expected


def test_op3(spark, folder):
    path, rows = folder
    learned = [(doc, 0, text, lang) for doc, text, lang in rows if not left_out(doc, 5, 0)]
    judge = language.Judge(language.fit_dictionaries(
        spark.createDataFrame(learned, "doc_id long, page_idx int, text string, lang string")))
    expected = []
    for doc, text, _ in rows:
        lang, score = judge(None if text is None else text.encode())
        expected.append((doc, left_out(doc, 5, 0), lang, score, lang == "und" or score < language.MIN_MARGIN))
    assert run(spark, "op3_language_id", path, ["doc_id", "held_out", "lang_pred", "score", "rejected"]) == expected
    assert 0 < sum(held for _, held, *_ in expected) < len(rows) / 2


def test_op5(spark, folder):
    if not os.path.isfile(queries.VOCABULARY):
        pytest.skip("no vocabulary")
    path, rows = folder
    vocabulary = set(token_counts.read_ranks(queries.VOCABULARY))
    expected = []
    for doc, text, _ in rows:
        sizes = [slow_length(word.encode(), vocabulary, b" ") for word in (text or "").split()]
        expected.append((doc, len(sizes), sum(sizes), 0))
    assert run(spark, "op5_token_counts", path, ["doc_id", "n_words", "n_tokens", "n_unknown"]) == expected


def test_op6(spark, folder):
    path, rows = folder
    keys = spark.createDataFrame([(doc, 0) for doc, *_ in rows], "doc_id long, page_idx int")
    deleted = {tuple(r) for r in keys.where(F.pmod(F.xxhash64("doc_id", "page_idx"), F.lit(lm_scoring.DELETED_PART)) == 0).collect()}
    expected = [(doc, left_out(doc, 7, 2), *scores) for doc, _, *scores in slow_scores(
        [(doc, 0, text, not left_out(doc, 7, 2)) for doc, text, _ in rows], deleted)]
    found = run(spark, "op6_lm_scoring", path,
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    same([(*r[:5], *map(float, r[5:])) for r in found], [(*r[:5], *map(float, r[5:])) for r in expected])


def test_op7(spark, folder):
    path, rows = folder
    found = contract.queries()["op7_packing"](spark, path)
    assert found.columns == ["doc_id", "piece_no", "n_tokens", "bucket_tokens", "batch_no", "batch_row"]
    pieces = [r for r in found.collect() if r.n_tokens]
    words = {}
    for r in pieces:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= min(r.bucket_tokens, packing.MAX_TOKENS)
    assert words == {doc: len(text.split()) for doc, text, _ in rows if text and text.split()}
    assert len({(r.bucket_tokens, r.batch_no, r.batch_row) for r in pieces}) == len(pieces) > len(words)
