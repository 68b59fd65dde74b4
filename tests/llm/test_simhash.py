"""Near-duplicate pages against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import simhash

SCHEMA = "doc_id long, page_idx int, text string"


def slow_fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in words.replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [words[i:i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64)
               if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_classes(keys, prints):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    lowest = {}
    for i, key in enumerate(keys):
        lowest[find(i)] = min(lowest.get(find(i), key), key)
    return [lowest[find(i)] for i in range(len(keys))]


def check(spark, rows):
    found = simhash.near_duplicate_pages(spark.createDataFrame(rows, SCHEMA))
    prints = [slow_fingerprint(t) for *_, t in rows]
    classes = slow_classes([(d, p) for d, p, _ in rows], prints)
    expected = sorted((d, p, f - (f >> 63 << 64), *c) for (d, p, _), f, c in zip(rows, prints, classes, strict=True))
    rows_found = found.collect()
    assert sorted((*r[:3], *r[4:]) for r in map(tuple, rows_found)) == expected
    lowest = {}
    for r in rows_found:
        key = r.class_doc_id, r.class_page_idx
        lowest[key] = min(lowest.get(key, r.fingerprint), r.fingerprint)
    assert all(r.class_fingerprint == lowest[r.class_doc_id, r.class_page_idx] for r in rows_found)
    return expected


def texts(seed, n):
    pick = random.Random(seed)
    words = [f"Wort{i}" for i in range(300)]
    base = [[pick.choice(words) for _ in range(pick.randint(1, 60))] for _ in range(n // 4)]
    for i in range(n):
        own = list(pick.choice(base))
        for _ in range(pick.choice([0, 0, 1, 2])):
            own[pick.randrange(len(own))] = pick.choice(words)
        yield i, 0, " ".join(own)


def test_classes_match_brute_force(spark):
    rows = [*texts(1, 400), (5000, 1, None), (5001, 0, ""), (5002, 0, " \n\t"), (5003, 0, "one"),
            (5004, 2, "one two"), (5004, 3, "ONE two"), (5005, 0, "élan ÉLAN x y z"), (5005, 0, "élan ÉLAN x y z")]
    assert len({c[3] for c in check(spark, rows)}) < 400


def test_fingerprint_column(spark):
    rows = spark.createDataFrame([(t,) for t in [None, "", "a b c d", "É"]], "text string")
    found = [r[0] % (1 << 64) for r in rows.select(simhash.fingerprint_of(F.col("text"))).collect()]
    assert found == [slow_fingerprint(t) for t in [None, "", "a b c d", "É"]]


def test_near_fingerprints_meet(spark, monkeypatch):
    """Chains of flipped bits, with full cells cut into blocks."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    pick = random.Random(3)
    prints = set()
    for _ in range(60):
        at = pick.getrandbits(64)
        for _ in range(12):
            prints.add(at - (at >> 63 << 64))
            for bit in pick.sample(range(64), pick.randint(1, 4)):
                at ^= 1 << bit
    at = pick.getrandbits(64)
    for _ in range(300):
        bits = pick.sample(range(64), pick.randint(0, 2))
        near = at ^ sum(1 << b for b in bits)
        prints.add(near - (near >> 63 << 64))
    prints = sorted(prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fingerprint long")).collect()
    places = {p: i for i, p in enumerate(prints)}
    unsigned = [p % (1 << 64) for p in prints]
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 3 and r.a < r.b for r in links)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        root[find(places[r.a])] = find(places[r.b])
    expected = slow_classes(list(range(len(prints))), unsigned)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), set()).add(expected[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected))
    assert len(links) < 8 * len(prints)


def test_long_text_is_cut_between_words():
    pick = random.Random(9)
    text = " ".join(f"w{pick.randrange(10 ** 6)}" for _ in range(400_000))
    assert len(text) > 2 << 20
    assert simhash.fingerprint(text.encode()) == pytest.approx(slow_numpy(text), abs=0)


def slow_numpy(text):
    words = text.split()
    ones = [0] * 64
    for i in range(len(words) - 2):
        h = xxhash.xxh64(" ".join(words[i:i + 3]).encode(), seed=42).intdigest()
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(words) - 2)


def test_empty_table_nulls_and_clashing_columns(spark):
    empty = simhash.near_duplicate_pages(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "page_idx", "fingerprint", "class_fingerprint", "class_doc_id", "class_page_idx"]
    assert empty.count() == 0
    rows = spark.createDataFrame([(None, None, "a b c d"), (3, 0, "A b c D")], SCHEMA)
    clashing = rows.withColumn("fingerprint", F.lit("x")).withColumn("run", F.lit(1)).withColumn("first", F.lit(2))
    assert {(r.class_doc_id, r.class_page_idx) for r in simhash.near_duplicate_pages(clashing).collect()} == {(None, None)}
