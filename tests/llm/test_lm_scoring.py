"""The interpolated bigram model against a direct one on dictionaries."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import lm_scoring

SCHEMA = "doc_id long, page_idx int, text string, training boolean"


def tokens(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def counts(rows):
    one, two = Counter(), Counter()
    for text in rows:
        own = tokens(text)
        one.update(own)
        two.update(zip(["\n", *own], own, strict=False))
    return one, two


def slow(rows, deleted):
    """Scores by the same formulas; weights learned from exact probabilities."""
    train = [(d, p, t) for d, p, t, training in rows if training]
    kept_one, kept_two = counts(t for d, p, t in train if (d, p) not in deleted)
    data = Counter()
    for d, p, t in train:
        if (d, p) in deleted:
            own = tokens(t)
            for v, w in zip(["\n", *own], own, strict=False):
                level = lambda x: -1 if not x else round(-lm_scoring.STEPS * math.log2(x))
                context = kept_one[v]
                data[(int(math.log2(context)) + 1 if context else 0, level(kept_two[v, w] / max(context, 1)),
                      level(kept_one[w] / max(kept_one.total(), 1)))] += 1
    weights = lm_scoring.learn_weights([(*k, n) for k, n in data.items()], len(kept_one))
    one, two = counts(t for _, _, t in train)
    total, known = one.total(), len(one)
    result = []
    for d, p, t, _ in rows:
        own = tokens(t)
        base = sum(math.log10((one[w] + 1) / (total + known + 1)) for w in own)
        score = 0
        for v, w in zip(["\n", *own], own, strict=False):
            a, b, z = weights[int(math.log2(one[v])) + 1 if one[v] else 0]
            score += math.log10(a * two[v, w] / max(one[v], 1) + b * one[w] / total + z / (known + 1)) if total else 0
        result.append((d, p, len(own), sum(one[w] > 0 for w in own), total, base, score))
    return result


def corpus(seed, n):
    """Each word prefers three successors, so that bigrams tell something."""
    pick = random.Random(seed)
    names = [f"w{i}" for i in range(60)]
    after = {w: pick.sample(names, 3) for w in names}
    for i in range(n):
        word, words = pick.choice(names), []
        for _ in range(pick.randint(0, 80)):
            words.append(word.upper() if pick.random() < 0.2 else word)
            word = pick.choice(after.get(word, names)) if pick.random() < 0.8 else pick.choice([*names, f"rare{pick.randrange(500)}"])
        yield i, i % 2, " ".join(words), pick.random() < 0.8


def check(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    left_out = F.pmod(F.xxhash64("doc_id", "page_idx"), F.lit(lm_scoring.DELETED_PART)) == 0
    deleted = {(r.doc_id, r.page_idx) for r in table.where(left_out).collect()}
    for name in ("role", "block", "n_tokens", "score"):
        table = table.withColumn(name, F.lit("x"))
    found = sorted(map(tuple, lm_scoring.score_pages(table).collect()), key=repr)
    expected = sorted(slow(rows, deleted), key=repr)
    assert len(found) == len(expected)
    for own, other in zip(found, expected, strict=True):
        assert own[:5] == other[:5]
        assert own[5:] == pytest.approx(other[5:], abs=1e-6)
    return found


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 700)
    rows = [*corpus(1, 300), (900, 0, None, True), (901, 0, "", False), (902, 0, "é É unseen", None), (None, None, "w1 w2", True),
            (903, 0, "w3 w4", True), (903, 0, "w3 w4", True), (904, 0, "w5 " * 3000, True)]
    found = check(spark, rows)
    held = {(d, p) for d, p, _, training in rows if not training}
    base, score = (sum(r[i] for r in found if (r[0], r[1]) in held) for i in (5, 6))
    assert score > 0.9 * base  # the model tells held-out text better than single words do


def test_without_training(spark):
    found = check(spark, [(1, 0, "a b", False), (2, 0, None, None)])
    assert all(r[5] == r[6] == 0 for r in found)
    assert lm_scoring.score_pages(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, 0, "a b", True)])


def test_probabilities_add_up_to_one():
    rows = [("a b a c", True), ("b b", True), ("c a", True)]
    one, two = counts(t for t, _ in rows)
    weights = lm_scoring.learn_weights([(1, 4, 8, 3), (2, -1, 8, 2), (0, -1, -1, 1)], 4)
    assert weights.sum(1) == pytest.approx(1)
    for v in one:
        a, b, z = weights[int(math.log2(one[v])) + 1]
        total = sum(a * two[v, w] / one[v] + b * one[w] / one.total() + z / (len(one) + 1) for w in one) + z / (len(one) + 1)
        assert total == pytest.approx(1)


def test_packing_of_numbers():
    numbers = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64))
    assert (lm_scoring._from_steps(lm_scoring._steps(numbers)) == numbers).all()
    pairs = np.arange(20, dtype=np.int32).reshape(-1, 2)
    assert (lm_scoring._from_planes(lm_scoring._planes(pairs), np.int32).reshape(-1, 2) == pairs).all()
