"""The trie of documents by their annotations, against a trie of nested dictionaries."""

import hashlib
import random

import pytest

from marginalia.llm import openings

ANNOTATIONS = "doc_id long, page_idx int, annot_idx int, kind string, contents string"


def slow(rows, docs):
    docs = sorted({d for d in docs if d is not None})
    first = lambda v: (v is not None, v or 0)
    paths = {d: [] for d in docs}
    for doc, page, place, kind, contents in sorted(rows, key=lambda r: (first(r[1]), first(r[2]))):
        if doc in paths:
            paths[doc].append((kind or "", contents or ""))
    members, ends = {}, {}
    for doc, path in paths.items():
        for depth in range(len(path) + 1):
            members.setdefault(tuple(path[:depth]), []).append(doc)
        ends.setdefault(tuple(path), []).append(doc)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(o) > len(n) and o[:len(n)] == n for o in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves), saved, digest))
    return sorted(out, key=repr)


def found(spark, rows, docs):
    names = spark.createDataFrame([(d, f"{d}.pdf") for d in docs], "doc_id long, name string")
    nodes = openings.shared_openings(spark.createDataFrame(rows, ANNOTATIONS).repartition(3), names)
    assert nodes.columns == ["doc_id", "depth", "parent_doc_id", "n_docs", "n_children", "n_leaves", "saved_words", "ends_sha256"]
    return sorted(map(tuple, nodes.collect()), key=repr)


def library(seed, docs):
    pick = random.Random(seed)
    kinds, notes = ["highlight", "note", None, ""], ["see above", "a  b\tc", None, "", "  x", "same", "one two three four"]
    rows = []
    for doc in range(docs):
        for place in range(pick.choice([0, 1, 2, 3, 5, 9])):
            few = place < 3 and pick.random() < 0.8
            rows.append((doc - 5, place // 3, place, kinds[0] if few else pick.choice(kinds), notes[place] if few else pick.choice(notes)))
    return rows


@pytest.mark.parametrize("shard_paths,steps", [(1 << 12, 32), (3, 32), (3, 1), (1, 2)])
def test_against_plain_trie(spark, monkeypatch, shard_paths, steps):
    """One shard, many, and splitters that are cut."""
    monkeypatch.setattr(openings, "SHARD_PATHS", shard_paths)
    monkeypatch.setattr(openings, "SPLITTER_STEPS", steps)
    monkeypatch.setattr(openings, "SAMPLED", 4)
    rows = library(shard_paths, 80)
    docs = [*range(-5, 75), 3, 200, None]
    rows += [(500, 0, 0, "note", "of no document"), (None, 0, 0, "note", "of none")]
    assert found(spark, rows, docs) == slow(rows, docs)


def test_copies_and_long_paths(spark, monkeypatch):
    monkeypatch.setattr(openings, "SHARD_PATHS", 4)
    monkeypatch.setattr(openings, "PIECE", 16)
    one = [("note", f"n {i}") for i in range(300)]
    rows = [(doc, 0, i, *step) for doc in range(0, 120, 3) for i, step in enumerate(one[:40])]
    rows += [(doc, None if i == 0 else i, None, *step) for doc in (1, 4) for i, step in enumerate(one)]
    rows += [(doc, 0, 0, "note", f"own {doc}") for doc in range(2, 120, 3)]
    docs = range(130)
    assert found(spark, rows, docs) == slow(rows, docs)


def test_no_documents(spark):
    assert found(spark, [(1, 0, 0, "note", "x")], []) == []
    assert found(spark, [], [7, 8]) == slow([], [7, 8])


def test_equal_places_and_other_columns(spark):
    rows = [(1, 0, 0, "note", "b"), (1, 0, 0, "note", "a"), (2, 0, 0, "note", "a"), (2, 0, 0, "note", "b")]
    assert [r[:4] for r in found(spark, rows, [1, 2])] == [(1, 0, None, 2), (1, 1, 1, 2), (1, 2, 1, 2)]
    annotations = spark.createDataFrame([(*rows[0], 5, "p")], ANNOTATIONS + ", path long, step string")
    assert openings.shared_openings(annotations, spark.createDataFrame([(1, "x")], "doc_id long, path string")).count() == 2
