"""Exact top-k search in page text: BM25 over an inverted index, pruned by block maxima.

Pages lie in shards, each with an inverted index of its own; idf and lengths are those of all pages. In a
shard pages that are alike stand together, in order of length, in blocks of 512, the same for all posting lists. The
postings of a list in a block are a cell, which keeps its largest impact. The sum of these over a query's terms bounds
every score in a block; as in block-max WAND, blocks whose bound cannot reach the query's k-th best score so far are
skipped, with all lists at once. The blocks with the largest bounds come first.

Queries go through a shard in batches of queries that are alike, so that a block is scored once for all of them that it is
open to: cells that hold a good part of the block are rows of a table and multiplied as a matrix, the others are looked
up posting by posting. That is done in float32, with a margin for what it may be off by; the pages that reach the k-th
best score with it are scored again, exactly. That score is carried from shard to shard of a task, and starts from what
a part of the shards, searched before, has reached.
"""

import itertools
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.batches import stretches, texts
from marginalia.operators.stored import new_path, stored

K1, B = 1.2, 0.75
TOP = 10
# Limits of a shard of the index, pages of a block, and queries that are sent to all shards at once.
SHARD_PAGES, SHARD_TOKENS, BLOCK_PAGES, QUERIES_AT_ONCE = 8192, 1 << 23, 512, 8192
# Blocks scored in the first round of a batch in a shard; each round takes sixteen times as many.
FIRST_ROUND = 1
# A term of one page in so many of a block is common there; a block has a table of so many common terms at most.
PAGES_PER_COMMON, MOST_COMMON = 64, 1024
# Products in a table that take the time of one posting looked up: a row that would save fewer is not multiplied.
PRODUCTS_PER_POSTING = 500
# One shard in so many, but of few shards about the square root, is searched before the others, so that these start from
# scores to be reached.
AHEAD = 16
# Limits of a batch of queries, and postings that are looked up at once.
BOUNDS_AT_ONCE, TERMS_AT_ONCE, POSTINGS_AT_ONCE = 256, 1 << 17, 1 << 17
# Terms are counted in ranges, which have the terms of so many shards each.
SHARDS_PER_RANGE = 4
# Groups of texts that are alike, the terms they are told by, and rounds to find them.
GROUPS, GROUP_TERMS, GROUP_ROUNDS = 8, 512, 5
# Scores are compared to so many decimals, so that copies tie whatever the order of their sums.
DECIMALS = 9
NO_DOC, NO_PAGE = -(1 << 63), -(1 << 31)

PAGE = ["doc_id", "page_idx"]
SHARD = "pages binary, lengths binary, terms binary, starts binary, docs binary, times binary"
SEPARATORS = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))


def search_pages(page_text: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, page_idx, score): the `top` best pages for each row of queries (query_id,
    text).

    BM25 with idf ln(1 + (N - n + 0.5) / (n + 0.5)); a word counts as often as the query has it. Words are
    runs of ASCII letters and digits and of all other characters, A-Z in lower case. Equal scores (to 9
    decimals) are in order of doc_id and page_idx, nulls first. A query has fewer rows if fewer pages share
    a word with it, none if it is null or empty. Null and empty pages count in N and are never found. Rows
    that repeat a page are found each; query_id must not repeat. Other columns are ignored.

    Queries are taken in blocks of QUERIES_AT_ONCE, which bounds what the driver and the tasks hold of them.
    """
    shards = stored(page_text.select(*PAGE, "text").mapInArrow(_index, SHARD))
    totals = shards.select("lengths").mapInArrow(_totals, "pages long, tokens long").agg(F.sum("pages"), F.sum("tokens"), F.count("*")).first()
    n_pages, tokens, n_shards = (x or 0 for x in totals)
    counted = shards.select("terms", "starts").mapInArrow(_counted(-(-n_shards // SHARDS_PER_RANGE)), "part int, terms binary, n binary")
    holders = stored(counted.groupBy("part").applyInArrow(_holders, "terms binary, n binary"))
    asked = stored(queries.where("query_id is not null").select("query_id", "text")
                   .mapInArrow(_queries, "query_id long, terms binary, times binary").withColumn("number", F.monotonically_increasing_id()))
    parts = -(-asked.count() // QUERIES_AT_ONCE)
    ahead = F.pmod(F.xxhash64("lengths"), F.lit(min(AHEAD, max(1, math.isqrt(n_shards))))) == 0
    spark = page_text.sparkSession
    found = new_path(spark)
    spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in FOUND.split(", ")))).write.parquet(found)
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == part).select("number", "terms", "times").collect()
        if rows:
            _search(shards.withColumn("ahead", ahead), holders, Queries.of(rows), n_pages, tokens / n_pages if n_pages else 0, top, found)
    best = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id", "page_idx")
    ranked = spark.read.schema(FOUND).parquet(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(asked.select("number", "query_id"), "number").select("query_id", "rank", *PAGE, "score")


FOUND = "number long, doc_id long, page_idx int, score double"


def _search(shards: DataFrame, holders: DataFrame, queries: "Queries", n_pages: int, mean_length: float, top: int, found: str) -> None:
    """Add the best pages of each task for a block of queries to the table of those found."""
    context = shards.sparkSession.sparkContext
    words = context.broadcast(queries.terms)
    held = holders.mapInArrow(_asked(words), "term int, n long").toArrow()
    n = np.zeros(len(queries.terms))
    n[np.asarray(held["term"])] = np.asarray(held["n"])
    queries.weigh(np.log(1 + (n_pages - n + 0.5) / (n + 0.5)))
    sent = context.broadcast(queries)
    none = context.broadcast(np.full(len(queries.ids), -np.inf))
    early = stored(shards.where("ahead").drop("ahead").mapInArrow(_searcher(sent, none, mean_length, top), FOUND))
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score")))
    reached = early.withColumn("place", place).where(F.col("place") == top).select("number", "score").collect()
    least = context.broadcast(queries.start_from({r.number: r.score for r in reached}))
    rest = shards.where(~F.col("ahead")).drop("ahead").mapInArrow(_searcher(sent, least, mean_length, top), FOUND)
    early.unionByName(rest).write.mode("append").parquet(found)
    for given in (words, sent, none, least):
        given.unpersist()


def _searcher(sent, least, mean_length: float, top: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(least.value, top)
        for batch in batches:
            for row in batch.to_pylist():
                Shard(row, mean_length).search(sent.value, best)
        yield best.rows(sent.value.ids)
    return search


def _words(text: bytes | None) -> Iterator[list[bytes]]:
    return (stretch.lower().translate(SEPARATORS).split() for stretch in stretches(text))


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    building = Building()
    for batch in batches:
        for doc_id, page_idx, text in zip(batch["doc_id"].to_pylist(), batch["page_idx"].to_pylist(), texts(batch["text"]), strict=True):
            building.add(doc_id, page_idx, text)
            if len(building.lengths) >= SHARD_PAGES or building.tokens >= SHARD_TOKENS:
                yield building.packed()
                building = Building()
    if building.lengths:
        yield building.packed()


class Building:
    """Pages of a shard to be, with their words as numbers in the order of appearance."""

    def __init__(self):
        self.pages, self.lengths, self.parts, self.tokens = [], [], [], 0
        self.places = defaultdict(itertools.count().__next__)

    def add(self, doc_id: int | None, page_idx: int | None, text: bytes | None) -> None:
        length = 0
        for words in _words(text):
            self.parts.append(np.fromiter(map(self.places.__getitem__, words), np.int32, len(words)))
            length += len(words)
        self.pages.append((NO_DOC if doc_id is None else doc_id, NO_PAGE if page_idx is None else page_idx))
        self.lengths.append(length)
        self.tokens += length

    def packed(self) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.places), np.uint64, len(self.places))
        terms, rank = np.unique(hashes, return_inverse=True)
        lengths = np.array(self.lengths, np.int32)
        n = len(lengths)
        tokens = rank[np.concatenate(self.parts)] if self.tokens else np.zeros(0, np.int64)
        postings, times = np.unique(tokens * n + np.repeat(np.arange(n), lengths), return_counts=True)
        of_term, of_page = np.divmod(postings, n)
        order = np.lexsort((lengths, _alike(of_page, of_term, n, len(terms))))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        postings = of_term * n + place[of_page]
        sorted_ = np.argsort(postings, kind="stable")
        starts = np.searchsorted(of_term, np.arange(len(terms) + 1))
        columns = [np.array(self.pages, np.int64)[order], lengths[order], terms, starts.astype(np.int32),
                   place[of_page[sorted_]].astype(np.int32), times[sorted_].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns],
                                          [c.split()[0] for c in SHARD.split(", ")])


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [np.frombuffer(x, np.int32) for x in batch["lengths"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(x) for x in lengths], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in lengths], pa.int64())],
            ["pages", "tokens"])


def _queries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts(batch["text"]):
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for words in _words(text) for w in words), np.uint64)
            rows.append(np.unique(hashes, return_counts=True))
        yield pa.RecordBatch.from_arrays(
            [batch["query_id"], pa.array([t.tobytes() for t, _ in rows], pa.binary()),
             pa.array([n.astype(np.int32).tobytes() for _, n in rows], pa.binary())], ["query_id", "terms", "times"])


class Queries:
    """A block of queries: all their terms in order, and the places of each query's terms among them with
    weights, one query after the other. Queries that are alike stand together, in batches; `by_term` has the numbers of
    each batch's places in the order of the terms.
    """

    def __init__(self, ids: np.ndarray, terms: np.ndarray, places: list[np.ndarray], weights: list[np.ndarray]):
        self.ids, self.terms = ids, terms
        sizes = np.array([len(p) for p in places], np.int64)
        group = _alike(np.repeat(np.arange(len(ids)), sizes), np.concatenate(places), len(ids), len(terms))
        self.order = np.lexsort((sizes, group))
        self.starts = np.r_[0, np.cumsum(sizes[self.order])]
        self.places = np.concatenate([places[i] for i in self.order]).astype(np.int32)
        self.weights = np.concatenate([weights[i] for i in self.order])
        self.batches = [0]
        for i in range(1, len(ids)):
            first = self.batches[-1]
            if i - first >= BOUNDS_AT_ONCE or group[self.order[i]] != group[self.order[first]] or self.starts[i + 1] - self.starts[first] > TERMS_AT_ONCE:
                self.batches.append(i)
        self.batches.append(len(ids))
        own = (slice(*self.starts[[first, last]]) for first, last in itertools.pairwise(self.batches))
        self.by_term = np.concatenate([own.start + np.argsort(self.places[own], kind="stable") for own in own]).astype(np.int32)
        self.least = np.full(len(ids), -np.inf)

    @classmethod
    def of(cls, rows: list) -> "Queries":
        own = [np.frombuffer(r.terms, np.uint64) for r in rows]
        terms = np.unique(np.concatenate(own))
        return cls(np.array([r.number for r in rows], np.int64), terms, [np.searchsorted(terms, t) for t in own],
                   [np.frombuffer(r.times, np.int32).astype(float) for r in rows])

    def weigh(self, idf: np.ndarray) -> None:
        self.weights = self.weights * idf[self.places]

    def start_from(self, scores: dict[int, float]) -> np.ndarray:
        """Scores that the k-th best of a query will reach at least."""
        self.least = np.array([scores.get(i, -np.inf) for i in self.ids.tolist()])
        return self.least


def _alike(texts: np.ndarray, terms: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """A group for each of n texts, by the commonest terms they share: k-means on directions. texts and terms: the places
    of each distinct term of each text. Only the order of work depends on it.
    """
    sizes = np.bincount(terms, minlength=n_terms)
    common = np.argsort(-sizes, kind="stable")[:GROUP_TERMS]
    row = np.full(n_terms, -1)
    row[common] = np.arange(len(common))
    at = row[terms]
    table = np.zeros((len(common), n), np.float32)
    table[at[at >= 0], texts[at >= 0]] = 1
    table *= np.log((n + 1) / np.maximum(sizes[common], 1)).astype(np.float32)[:, None]
    table /= np.maximum(np.linalg.norm(table, axis=0), 1e-9)
    centres = table[:, np.linspace(0, n - 1, min(GROUPS, n)).astype(np.int64)]
    for _ in range(GROUP_ROUNDS):
        group = np.argmax(centres.T @ table, axis=0)
        centres = table @ (group[:, None] == np.arange(centres.shape[1])).astype(np.float32)
        centres /= np.maximum(np.linalg.norm(centres, axis=0), 1e-9)
    return group


def _counted(parts: int):
    """How many pages of a shard have each of its terms, in ranges of terms."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(1 << 64) * i // parts for i in range(1, parts)], np.uint64)
        for batch in batches:
            for terms, starts in zip(batch["terms"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                terms, n = np.frombuffer(terms, np.uint64), np.diff(np.frombuffer(starts, np.int32))
                cuts = np.searchsorted(terms, bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(parts), pa.int32()), *(pa.array([x.tobytes() for x in np.split(y, cuts)], pa.binary()) for y in (terms, n))],
                    ["part", "terms", "n"])
    return count


def _holders(rows: pa.Table) -> pa.Table:
    """How many pages have each term of a range."""
    terms = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["terms"].to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int32) for x in rows["n"].to_pylist()])
    own, place = np.unique(terms, return_inverse=True)
    return pa.table({"terms": [own.tobytes()], "n": [np.bincount(place, n, len(own)).astype(np.int64).tobytes()]})


def _asked(words):
    """The places of a block of queries' terms, and how many pages have them."""
    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, n in zip(batch["terms"].to_pylist(), batch["n"].to_pylist(), strict=True):
                here, at = _known(words.value, np.frombuffer(terms, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(at[here].astype(np.int32)), pa.array(np.frombuffer(n, np.int64)[here])], ["term", "n"])
    return places


def _known(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted terms a shard has, and where."""
    at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
    return (terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)), at


class Best:
    """The best pages of each query so far, the worst of them last, and scores to be reached."""

    def __init__(self, start: np.ndarray, top: int):
        self.top, self.start = top, start
        self.scores = np.full((len(start), top), -np.inf)
        self.pages = np.zeros((len(start), top, 2), np.int64)

    def least(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[queries, -1], self.start[queries])

    def add(self, query: int, scores: np.ndarray, pages: np.ndarray) -> None:
        scores = np.concatenate([self.scores[query], scores])
        pages = np.concatenate([self.pages[query], pages])
        order = np.lexsort((pages[:, 1], pages[:, 0], -scores))[:self.top]
        self.scores[query], self.pages[query] = scores[order], pages[order]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        query, place = np.nonzero(self.scores > 0)
        doc, page = self.pages[query, place].T
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[query]), pa.array(doc, mask=doc == NO_DOC), pa.array(page.astype(np.int32), mask=page == NO_PAGE),
             pa.array(self.scores[query, place])], ["number", *PAGE, "score"])


class Shard:
    """An inverted index with impacts. Postings of a term in a block of pages are a cell; it has its largest impact, and
    a row of a table if it holds a good part of the block.
    """

    def __init__(self, row: dict, mean_length: float):
        self.pages = np.frombuffer(row["pages"], np.int64).reshape(-1, 2)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        docs, lengths = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["lengths"], np.int32)
        starts, times = np.frombuffer(row["starts"], np.int32), np.frombuffer(row["times"], np.int32)
        n_terms, n_pages = len(self.terms), len(self.pages)
        damping = K1 * (1 - B + B * lengths / (mean_length or 1))
        impacts = times + damping[docs]
        np.divide(times * (K1 + 1), impacts, out=impacts)
        self.width = min(BLOCK_PAGES, len(self.pages))
        self.blocks = -(-len(self.pages) // self.width)
        of_term = np.repeat(np.arange(n_terms, dtype=np.int32), np.diff(starts))
        block = (docs // self.width).astype(np.uint16 if self.blocks < 1 << 16 else np.int32)
        first = np.flatnonzero(np.r_[len(docs) > 0, (of_term[1:] != of_term[:-1]) | (block[1:] != block[:-1])])
        self.cell_block = block[first]
        self.of_cells = np.r_[0, np.cumsum(np.bincount(of_term[first], minlength=n_terms))]
        self.cell_size = np.diff(np.r_[first, len(docs)])
        self.cell_most = (np.maximum.reduceat(impacts, first) if len(first) else np.zeros(0)).astype(np.float32)
        # Postings page by page.
        order = np.argsort(docs.astype(np.uint16) if n_pages <= 1 << 16 else docs, kind="stable").astype(np.int32)
        self.of_pages = np.r_[0, np.cumsum(np.bincount(docs, minlength=n_pages))]
        self.page_terms, self.page_impacts = of_term[order], impacts[order]
        del of_term
        # Postings block by block, and where those of a cell begin among them.
        impacts = impacts.astype(np.float32)
        order = np.argsort(block, kind="stable").astype(np.int32)
        self.in_block, self.block_impacts = (docs % self.width)[order], impacts[order]
        del block, impacts
        order = np.argsort(self.cell_block, kind="stable")
        self.cell_start = np.zeros(len(self.cell_size), np.int64)
        self.cell_start[order] = np.cumsum(self.cell_size[order]) - self.cell_size[order]
        common = np.flatnonzero(PAGES_PER_COMMON * self.cell_size >= self.width)
        common = common[np.lexsort((-self.cell_size[common], self.cell_block[common]))]
        in_block = self.cell_block[common]
        self.common = common[np.arange(len(common)) - np.searchsorted(in_block, in_block) < MOST_COMMON]
        self.cell_row = np.full(len(self.cell_size), -1, np.int32)
        self.cell_row[self.common] = np.arange(len(self.common))
        sizes = self.cell_size[self.common]
        postings = _ranges(self.cell_start[self.common], sizes)
        self.table = np.zeros((len(self.common), self.width), np.float32)
        self.table.reshape(-1)[np.repeat(np.arange(len(self.common)) * self.width, sizes) + self.in_block[postings]] = self.block_impacts[postings]

    def search(self, queries: Queries, best: Best) -> None:
        here, at = _known(self.terms, queries.terms)
        for first, last in itertools.pairwise(queries.batches):
            Batch(self, queries, first, last, here, at, best).search()

    def _score(self, batch: "Batch", block: int, who: np.ndarray) -> np.ndarray:
        """Scores of all pages of a block for some queries of a batch, but for rounding to float32."""
        rows = np.flatnonzero(batch.by_table[block])
        weights = batch.weight_table[batch.row[rows]]
        everyone = len(who) == len(batch.ids)
        scores = (weights if everyone else weights[:, who]).T @ self.table[self.cell_row[batch.cells[block, rows]]]
        terms = np.flatnonzero(batch.by_postings[block])
        of, entry = _members(batch.first[terms], batch.asking[terms])
        place = np.full(len(batch.ids), -1)
        place[who] = np.arange(len(who))
        bins = place[batch.query[entry]]
        if not everyone:
            asking = np.flatnonzero(bins >= 0)
            of, entry, bins = of[asking], entry[asking], bins[asking]
        if not len(entry):
            return scores
        bins *= self.width
        sizes, starts, weights = batch.sizes[block, terms][of], self.cell_start[batch.cells[block, terms]][of], batch.weights[entry]
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(ends, np.arange(POSTINGS_AT_ONCE, ends[-1], POSTINGS_AT_ONCE)).tolist()
        for part in map(slice, [0, *cuts], [*cuts, len(entry)]):
            of, postings = _members(starts[part], sizes[part])
            found = np.bincount(bins[part][of] + self.in_block[postings], weights[part][of] * self.block_impacts[postings], scores.size)
            scores += found.reshape(scores.shape)
        return scores

    def _exact(self, asked: np.ndarray, weights: np.ndarray, pages: np.ndarray) -> np.ndarray:
        """Scores of some pages, with a weight for each term asked. Added up term by term, so that copies have the same sum to the last bit."""
        of, postings = _members(self.of_pages[pages], self.of_pages[pages + 1] - self.of_pages[pages])
        terms = self.page_terms[postings]
        hits = np.flatnonzero(asked[terms])
        return np.round(np.bincount(of[hits], weights[terms[hits]] * self.page_impacts[postings[hits]], len(pages)), DECIMALS)


class Batch:
    """Queries that look through a shard together. Their terms there stand in columns, with the cells of each block, and
    after each other the queries that ask for each.
    """

    def __init__(self, shard: Shard, queries: Queries, first: int, last: int, here: np.ndarray, at: np.ndarray, best: Best):
        self.shard, self.queries, self.here, self.at, self.best = shard, queries, here, at, best
        self.ids, self.starts = queries.order[first:last], queries.starts[first:last + 1]
        self.least = best.least(self.ids)
        entries = queries.by_term[self.starts[0]:self.starts[-1]]
        entries = entries[here[queries.places[entries]]]
        self.query = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))[entries - self.starts[0]]
        self.weights = queries.weights[entries].astype(np.float32)
        terms = at[queries.places[entries]]
        new = np.r_[True, terms[1:] != terms[:-1]] if len(terms) else np.zeros(0, bool)
        self.first, self.column = np.flatnonzero(new), np.cumsum(new) - 1
        self.asking = np.diff(np.r_[self.first, len(terms)])
        own = terms[self.first]
        of, cells = _members(shard.of_cells[own], shard.of_cells[own + 1] - shard.of_cells[own])
        sizes = shard.cell_size[cells]
        by_table = (shard.cell_row[cells] >= 0) & (self.asking[of] * sizes * PRODUCTS_PER_POSTING > len(self.ids) * shard.width)
        place = shard.cell_block[cells].astype(np.int64) * len(own) + of

        def grid(values: np.ndarray) -> np.ndarray:
            """A row for each block, a column for each term."""
            table = np.zeros(shard.blocks * len(own), values.dtype)
            table[place] = values
            return table.reshape(shard.blocks, len(own))

        self.cells, self.sizes, self.most = grid(cells), grid(sizes), grid(shard.cell_most[cells])
        self.by_table, self.by_postings = grid(by_table), grid(~by_table)
        rows = np.flatnonzero(self.by_table.any(axis=0))
        self.row = np.full(len(own), -1)
        self.row[rows] = np.arange(len(rows))
        row = self.row[self.column]
        self.weight_table = np.zeros((len(rows), len(self.ids)), np.float32)
        self.weight_table[row[row >= 0], self.query[row >= 0]] = self.weights[row >= 0]
        # Sums of so many numbers in float32, none below zero, are off by less than this share.
        self.share = (np.diff(self.starts) + 16) * 2.0 ** -23
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.top_scores = np.zeros((len(self.ids), best.top), np.float32)

    def _bounds(self) -> np.ndarray:
        """The sums of the largest impacts of each block, for each query."""
        bounds = np.zeros((self.shard.blocks, len(self.ids)))
        for block in range(self.shard.blocks):
            bounds[block] = np.bincount(self.query, self.weights * self.most[block][self.column], len(self.ids))
        return bounds * (1 + self.share) + 10.0 ** -DECIMALS

    def _below(self, scores: np.ndarray, queries: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What a page's score in float32 has at least if the page reaches these scores."""
        return (scores - 10.0 ** -DECIMALS) * (1 - self.share[queries])

    def search(self) -> None:
        bounds = self._bounds()
        bounds[bounds <= 2 * 10.0 ** -DECIMALS] = -np.inf
        self.lower = self._below(self.least)
        left = np.argsort(-np.maximum(bounds, 0).sum(axis=1), kind="stable")
        step = FIRST_ROUND
        while len(left):
            reaching = (bounds[left] >= self.lower) & (bounds[left] > -np.inf)
            open_ = reaching.any(axis=1)
            left, reaching = left[open_], reaching[open_]
            for block, who in zip(left[:step].tolist(), reaching[:step], strict=True):
                self._look(block, np.flatnonzero(who))
            left = left[step:]
            step *= 16
        self._add()

    def _look(self, block: int, who: np.ndarray) -> None:
        """Keep the pages of a block that may be among the best, and raise what the next have to reach."""
        scores = self.shard._score(self, block, who)
        reaching = scores.max(axis=1) >= self.lower[who]
        if not reaching.any():
            return
        scores, who = scores[reaching], who[reaching]
        few = max(scores.shape[1] - self.best.top, 0)
        tops = np.concatenate([self.top_scores[who], np.partition(scores, few, axis=1)[:, few:]], axis=1)
        few = tops.shape[1] - self.best.top
        self.top_scores[who] = tops = np.partition(tops, few, axis=1)[:, few:]
        reached = tops.min(axis=1) * (1 - self.share[who])
        self.lower[who] = np.maximum(self.lower[who], self._below(reached, who))
        query, page = np.nonzero((scores >= self.lower[who][:, None]) & (scores > 0))
        self.found.append((who[query], block * self.shard.width + page, scores[query, page]))

    def _add(self) -> None:
        """Score the pages kept, exactly."""
        if not self.found:
            return
        query, page, score = map(np.concatenate, zip(*self.found, strict=True))
        kept = score >= self.lower[query]
        query, page = query[kept], page[kept]
        order = np.lexsort((page, query))
        query, page = query[order], page[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else query
        asked, weights = np.zeros(len(self.shard.terms), bool), np.zeros(len(self.shard.terms))
        for i, pages in zip(query[first].tolist(), np.split(page, first[1:]), strict=len(first) > 0):
            places = self.queries.places[self.starts[i]:self.starts[i + 1]]
            terms = self.at[places[self.here[places]]]
            weights[terms] = self.queries.weights[self.starts[i]:self.starts[i + 1]][self.here[places]]
            asked[terms] = True
            scores = self.shard._exact(asked, weights, pages)
            asked[terms] = False
            found = (scores > 0) & (scores >= self.least[i])
            if found.any():
                self.best.add(self.ids[i], scores[found], self.shard.pages[pages[found]])


def _members(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start, start + 1, ... of each range, one range after the other, behind the place of their range."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, (starts - (np.cumsum(sizes) - sizes))[of] + np.arange(len(of))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return _members(starts, sizes)[1]
