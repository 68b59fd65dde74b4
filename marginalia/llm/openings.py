"""Trie of documents by their annotations: how many documents open with the same ones, and what that saves.

A document is the path of its annotations in list order. The paths are sorted in shards, by ranges whose
splitters are paths of a sample. A node whose documents lie in more than one shard is a prefix of a
splitter, so the trie of the splitters, the skeleton, is sent to all shards; it is small, whatever the
library. A shard finishes all other nodes on its own, in one pass with the open nodes on a stack, and
gives for skeleton nodes what it knows of them. These partial results are added up and carried from the
skeleton's leaves to its root.

Texts never travel: a step of a path is 128 bits of a digest of the annotation and its number of words. Equal
paths are put together before anything is sorted, so copies of a document cost no more than one.
"""

import bisect
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.stored import stored

# Characters of a step: 32 of a digest, 8 of the number of words, both in hexadecimal.
DIGEST, STEP = 32, 40
# Paths of a shard, about; shards at most, steps of a splitter at most, and sampled paths for each splitter.
SHARD_PATHS, MOST_SHARDS, SPLITTER_STEPS, SAMPLED = 1 << 12, 1024, 32, 16
# Document numbers of one piece of the list that a node's digest is taken of.
PIECE = 1024
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = sha256(b"").hexdigest()

NODE = ("doc_id long, depth int, parent_doc_id long, parent int, n_docs long, n_children long, n_leaves long, "
        "saved_words long, path_id string")
PART = "node int, doc_id long, n_docs long, n_children long, n_leaves long, saved_words long, path_id string"


def shared_openings(annotations: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, depth, parent_doc_id, n_docs, n_children, n_leaves, saved_words, ends_sha256): the nodes of
    the trie of all documents of `names` (doc_id) by their annotations (doc_id, page_idx, annot_idx, kind,
    contents), in the order of page and place, nulls first; equal places are in an order of their own that
    hangs on kind and contents alone.

    A node of depth d is a distinct sequence of the first d annotations (kind, contents), null being empty; its
    documents start with it, the root has all. doc_id is the smallest of them, parent_doc_id that of the
    node above (null for the root). n_leaves counts the nodes without children below and at the node,
    saved_words adds up (n_docs - 1) times the words `[^\\x20\\x09-\\x0D]+` of the last contents over the same nodes.
    ends_sha256 is the SHA-256 of the ascending, comma-joined doc_ids of the documents that end at the node.

    Documents without annotations end at the root. Annotations whose document has no name, and rows without doc_id,
    belong to no document; repeated names count once. Without documents there are no nodes. Other columns
    are ignored. A document's path, 40 characters an annotation, is one value.
    """
    paths = stored(_paths(annotations, names))
    ends = stored(_ends(paths))
    distinct = stored(paths.groupBy("path").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
                      .withColumn("path_id", _path_id()))
    skeleton = Skeleton(_splitters(distinct))
    finished = stored(_in_shards(distinct, skeleton).mapInArrow(_finisher(skeleton), NODE))
    whole = _reduced(finished, skeleton)
    parents = whole.select(F.col("node").alias("parent"), F.col("doc_id").alias("above"))
    own = (finished.where("depth is not null").join(F.broadcast(parents), "parent", "left")
           .withColumn("parent_doc_id", F.coalesce("parent_doc_id", "above")))
    nodes = own.select(*NODES).unionByName(whole.join(parents, "parent", "left").withColumnRenamed("above", "parent_doc_id").select(*NODES))
    inner = F.concat(F.lit("-"), F.hex(F.xxhash64("doc_id", "depth")))
    return (nodes.withColumn("path_id", F.coalesce("path_id", inner)).join(ends, "path_id", "left").drop("path_id")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))


NODES = ["doc_id", "depth", "parent_doc_id", "n_docs", "n_children", "n_leaves", "saved_words", "path_id"]


def _paths(annotations: DataFrame, names: DataFrame) -> DataFrame:
    kind, contents = (F.coalesce(F.col(c), F.lit("")) for c in ("kind", "contents"))
    step = F.concat(F.substring(F.sha2(F.concat(F.octet_length(kind).cast("string"), F.lit(" "), kind, contents), 256), 1, DIGEST),
                    F.lpad(F.hex(F.coalesce(F.regexp_count(contents, F.lit(WORD)), F.lit(0))), STEP - DIGEST, "0"))
    place = F.struct("page_idx", "annot_idx", step.alias("step"))
    paths = (annotations.where("doc_id is not null").select("doc_id", place.alias("place"))
             .groupBy("doc_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
             .select("doc_id", F.array_join("places.step", "").alias("path")))
    documents = names.where("doc_id is not null").select("doc_id").distinct()
    return documents.join(paths, "doc_id", "left").select("doc_id", F.coalesce("path", F.lit("")).alias("path"))


def _path_id() -> Column:
    return F.sha2("path", 256)


def _ends(paths: DataFrame) -> DataFrame:
    """Digest of the documents of each path. A list is made in pieces, so that only short rows of a hot path meet
    in one task, which takes their digest in order.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    pieces = (paths.select("doc_id", _path_id().alias("path_id"), F.floor(F.col("doc_id") / PIECE).alias("place"))
              .groupBy("path_id", "place").agg(piece.alias("ids")))
    return (pieces.repartition("path_id").sortWithinPartitions("path_id", "place")
            .mapInArrow(_list_digests, "path_id string, ends_sha256 string"))


def _list_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, digest = None, None
    for batch in batches:
        done = []
        for path_id, ids in zip(batch["path_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if path_id == last:
                digest.update(b"," + ids.encode())
                continue
            if last is not None:
                done.append((last, digest.hexdigest()))
            last, digest = path_id, sha256(ids.encode())
        yield _batch(done, ["path_id", "ends_sha256"], [pa.string()] * 2)
    if last is not None:
        yield _batch([(last, digest.hexdigest())], ["path_id", "ends_sha256"], [pa.string()] * 2)


def _splitters(distinct: DataFrame) -> list[str]:
    """Paths that cut the sorted distinct paths into shards of about SHARD_PATHS, cut to SPLITTER_STEPS."""
    shards = min(MOST_SHARDS, -(-distinct.count() // SHARD_PATHS))
    if shards < 2:
        return []
    cut = F.substring("path", 1, SPLITTER_STEPS * STEP)
    sample = distinct.orderBy(F.xxhash64("path")).select(cut.alias("path")).limit(shards * SAMPLED).collect()
    ordered = sorted(r.path for r in sample)
    return sorted({ordered[len(ordered) * i // shards] for i in range(1, shards)})


class Skeleton:
    """Trie of the splitters. Node 0 is the root; a node comes after its parent."""

    def __init__(self, splitters: list[str]):
        self.splitters = splitters
        self.children: dict[tuple[int, str], int] = {}
        self.above, self.depth, self.words = [-1], [0], [0]
        for path in splitters:
            node = 0
            for at in range(0, len(path), STEP):
                step = path[at:at + STEP]
                below = self.children.get((node, step))
                if below is None:
                    below = self.children[node, step] = len(self.above)
                    self.above.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.words.append(int(step[DIGEST:], 16))
                node = below

    def shard_of(self, path: str) -> int:
        return bisect.bisect_right(self.splitters, path)


def _in_shards(distinct: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Distinct paths in shards, sorted. Which shard a path is in hangs on its first SPLITTER_STEPS alone."""
    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [skeleton.shard_of(p) for p in batch["path"].to_pylist()]
            yield batch.append_column("shard", pa.array(shards, pa.int32()))

    rows = distinct.select("path", "doc_id", "n", "path_id")
    if not skeleton.splitters:
        placed = rows.withColumn("shard", F.lit(0))
        return placed.repartition(1, "shard").sortWithinPartitions("path").drop("shard")
    placed = rows.mapInArrow(dealt, "path string, doc_id long, n long, path_id string, shard int")
    return placed.repartition("shard").sortWithinPartitions("shard", "path").drop("shard")


class Open:
    """A node on the stack, with what is known of the nodes below it."""

    def __init__(self, depth: int, words: int, skeleton: int | None):
        self.depth, self.words, self.skeleton = depth, words, skeleton
        self.doc_id, self.n_docs, self.n_children, self.n_leaves, self.saved, self.path_id = None, 0, 0, 0, 0, None
        self.waiting: list[tuple] = []


def _finisher(skeleton: Skeleton):
    """Nodes of a shard. Those of the skeleton come as partial results, with a null depth and themselves as parent.

    A child waits for its parent's smallest document, which is known when the parent is done.
    """
    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = [Open(0, 0, 0)]
        done: list[tuple] = []
        last = ""

        def close() -> None:
            node = stack.pop()
            for child in node.waiting:
                done.append((*child[:2], node.doc_id, *child[3:]))
            if node.skeleton is not None:
                done.append((node.doc_id, None, None, node.skeleton, node.n_docs, node.n_children, node.n_leaves, node.saved, node.path_id))
                if stack:
                    _gather(stack[-1], node)
                return
            above = stack[-1]
            leaves, saved = node.n_leaves or 1, node.saved + (node.n_docs - 1) * node.words
            row = (node.doc_id, node.depth, None, above.skeleton, node.n_docs, node.n_children, leaves, saved, node.path_id)
            (done if above.skeleton is not None else above.waiting).append(row)
            above.n_children += 1
            above.n_leaves += leaves
            above.saved += saved
            _gather(above, node)

        for batch in batches:
            for path, doc_id, n, path_id in zip(*(batch[c].to_pylist() for c in ("path", "doc_id", "n", "path_id")), strict=True):
                common = _common(last, path)
                while len(stack) - 1 > common:
                    close()
                for at in range(common * STEP, len(path), STEP):
                    step, above = path[at:at + STEP], stack[-1]
                    own = None if above.skeleton is None else skeleton.children.get((above.skeleton, step))
                    stack.append(Open(above.depth + 1, int(step[DIGEST:], 16), own))
                node = stack[-1]
                node.doc_id = doc_id if node.doc_id is None else min(node.doc_id, doc_id)
                node.n_docs += n
                node.path_id = path_id
                last = path
            if len(done) >= 10_000:
                yield _nodes(done)
                done.clear()
        while stack:
            close()
        yield _nodes([row for row in done if row[0] is not None])
    return finish


def _gather(above: Open, node: Open) -> None:
    above.doc_id = node.doc_id if above.doc_id is None else min(above.doc_id, node.doc_id)
    above.n_docs += node.n_docs


def _common(a: str, b: str) -> int:
    """Equal steps at the start of two paths."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a.startswith(b[:middle * STEP]):
            low = middle
        else:
            high = middle - 1
    return low


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in NODE.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return _batch(rows, [name for name, _ in fields], [types[kind] for _, kind in fields])


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _reduced(finished: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Skeleton nodes: the shards' parts added up, and then what skeleton nodes give to those above them.

    A skeleton node adds to each node above it, and to itself, its own saving and what non-skeleton nodes right
    below it have gathered; without any child it is a leaf.
    """
    spark = finished.sparkSession
    rows = [(i, above if above >= 0 else None, skeleton.depth[i], skeleton.words[i]) for i, above in enumerate(skeleton.above)]
    shape = spark.createDataFrame(rows, "node int, parent int, depth int, words long")
    below = shape.where("parent is not null").groupBy("parent").agg(F.count("*").alias("below")).withColumnRenamed("parent", "node")
    parts = (finished.where("depth is null").groupBy(F.col("parent").alias("node"))
             .agg(F.min("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_docs", "n_children", "n_leaves", "saved_words")),
                  F.max("path_id").alias("path_id")))
    own = (shape.join(parts, "node").join(below, "node", "left")
           .withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0)))
           .withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
           .withColumn("saved_words", F.col("saved_words") + (F.col("n_docs") - 1) * F.col("words")).drop("below", "words"))
    own = stored(own)
    lines = [(i, line) for i in range(len(rows)) for line in _upwards(skeleton.above, i)]
    sums = (spark.createDataFrame(lines, "node int, upper int").join(own.select("node", "n_leaves", "saved_words"), "node")
            .groupBy(F.col("upper").alias("node")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_words").alias("saved_words")))
    return own.drop("n_leaves", "saved_words").join(sums, "node")


def _upwards(above: list[int], node: int) -> Iterator[int]:
    while node >= 0:
        yield node
        node = above[node]
