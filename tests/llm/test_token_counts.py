"""Greedy word-piece lengths against a search for the longest piece at each place."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from marginalia.llm import token_counts

SCHEMA = "doc_id long, page_idx int, text string"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def slow_length(word, vocabulary, mark):
    word, at, count = mark + word, 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = word[at:end]
            if piece in vocabulary and piece.startswith(mark) == (at == 0):
                break
        else:
            return -1
        at, count = end, count + 1
    return count


@pytest.mark.parametrize("seed", range(8))
def test_automaton(seed):
    pick = random.Random(seed)
    letters = b"abc"[:pick.randint(1, 3)]
    piece = lambda most: bytes(pick.choice(letters) for _ in range(pick.randint(1, most)))
    vocabulary = {piece(6) for _ in range(pick.randint(1, 25))} | {b" " + piece(5) for _ in range(12)} | {b""}
    if seed % 2:
        vocabulary |= {b" ", *(bytes([c]) for c in letters)}
    automaton = token_counts.Automaton(vocabulary, b" ")
    for _ in range(400):
        word = piece(30)
        assert automaton.length(b" " + word) == slow_length(word, vocabulary, b" ")


def test_pages(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS_REMEMBERED", 3)
    vocabulary = [b" a", b" b", b"b", b"bc", b"\xc3\xa9", b" "]
    rows = [(1, 0, "a ab abc\taé x"), (2, 1, None), (3, 0, ""), (4, 0, " \n"), (None, None, "b"), (5, 0, "ab"), (5, 0, "ab"),
            (6, 0, "a " * 700_000), (7, 0, "a" + "b" * 2_000_000)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("x"))
    found = [tuple(r) for r in token_counts.page_tokens(table, vocabulary).collect()]
    assert found == [(1, 0, 5, 8, 1), (2, 1, 0, 0, 0), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0), (None, None, 1, 1, 0), (5, 0, 1, 2, 0),
                     (5, 0, 1, 2, 0), (6, 0, 700_000, 700_000, 0), (7, 0, 1, 2_000_001, 0)]
    assert token_counts.page_tokens(table.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        monkeypatch.setattr(token_counts, "MOST_PIECES", 2)
        token_counts.page_tokens(table, vocabulary)


def test_public_vocabulary():
    if not os.path.exists(RANKS):
        pytest.skip("no vocabulary")
    pieces = token_counts.read_ranks(RANKS)
    lengths, vocabulary, pick = token_counts.WordLengths(pieces, b" "), set(pieces), random.Random(1)
    for _ in range(300):
        word = "".join(pick.choice("etaoinschüß中!7") for _ in range(pick.randint(1, 14))).encode()
        assert lengths[word] == slow_length(word, vocabulary, b" ") > 0


def test_time_is_linear():
    automaton = token_counts.Automaton([b"a", b"aa", b"a" * 40 + b"b", b" "], b" ")
    start = time.perf_counter()
    assert automaton.length(b" " + b"a" * 1_000_000) == 1 + 500_000
    assert time.perf_counter() - start < 20
