"""Ranked lexical search: the pages of the library that an annotation's text speaks of.

The normaliser m of a page hangs on its number of terms alone. Pages of equal m form a stratum; a term's
postings lie in it in order of tf, so what a posting adds to a score is known from (term, m, tf) and is worked
out once for all pages of such a group. The largest tf of each of a query's terms bounds every score in a
stratum. Strata are visited in the order of their bounds, until none can reach the scores found so far.

The index is in shards, each with the strata of its pages; a stratum with many terms is dealt over several
shards. Document frequencies, the number of pages and of terms are those of the whole library.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import effective_contents
from marginalia.llm.batches import stretches, texts
from marginalia.operators.blocks import ANNOTATION, PAGE
from marginalia.operators.stored import new_path, stored

TOP = 10
# Share of the length in m, of 100, and the damping of tf: a posting gives 10^9 tf div (1000 tf + 8 m).
LENGTH_SHARE, SCALE, TF_FACTOR, M_FACTOR = 90, 1_000_000_000, 1000, 8
# Terms and pages of a shard, and annotations and terms that are sent to all shards at once.
SHARD_TERMS, SHARD_PAGES, ASKED_AT_ONCE, TERMS_AT_ONCE = 1 << 21, 1 << 16, 4096, 1 << 20
# Terms of a stratum that are dealt to one task.
PART_TERMS = 1 << 17
# Strata visited in the first round of a query in a shard; each round takes four times as many.
FIRST_ROUND = 2
NO_DOC, NO_PAGE = -(1 << 63), -(1 << 31)

# Bytes that are not part of a term, as spaces.
SEPARATORS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

# A shard is a compressed Arrow table of one row: its pages in order of m and the m of each; for each term the number
# of its cells, one for each stratum it occurs in; for each cell its stratum and the number of its groups, one for
# each tf, largest first; for each group its tf and the number of its pages; the places of these.
SHARD = "shard binary"
COLUMNS = ["docs", "pages", "m", "terms", "term_cells", "cell_strata", "cell_groups", "group_tf", "group_pages", "postings"]
FOUND = "query long, found_doc_id long, found_page_idx int, score long"


def pages_spoken_of(page_text: DataFrame, annotations: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, page_idx, annot_idx, rank, found_doc_id, found_page_idx, score): the `top` best pages for
    each annotation's text (contents, or note_text where contents are blank).

    Terms are runs of ASCII letters and digits and of all other characters, A-Z in lower case. N counts pages
    with at least one term, L all their terms, n those of one page, df the pages that hold a term, tf its
    occurrences on a page. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), m is
    10 + (90 n N) div L, and the score sums w * ((10^9 tf) div (1000 tf + 8 m)) over the annotation's terms,
    once each, in 64-bit integers.

    Only scores above 0 are found; equal scores are in order of doc_id and page_idx, nulls first. An annotation
    without terms has no rows, a page without terms is never found. Rows that repeat a page are found each,
    and rows that repeat an annotation are answered each. note_text may be absent; other columns are ignored.
    """
    pages = page_text.select(*PAGE, "text")
    lengths = stored(pages.select("text").mapInArrow(_lengths, "n long").groupBy("n").agg(F.count("*").alias("pages")))
    n_pages, n_terms = (x or 0 for x in lengths.agg(F.sum("pages"), F.sum(F.col("n") * F.col("pages"))).first())
    asked = stored(_asked(annotations))
    found = new_path(pages.sparkSession)
    _no_rows(pages.sparkSession, FOUND).write.parquet(found)
    if n_pages:
        shards = stored(_shards(pages, lengths, n_pages, n_terms))
        for part in _parts(asked):
            _search(shards, Queries(part, n_pages), found, top)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "found_doc_id", "found_page_idx")
    ranked = (pages.sparkSession.read.schema(FOUND).parquet(found)
              .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    return ranked.join(asked.drop("text", "n"), "query").select(*ANNOTATION, "rank", "found_doc_id", "found_page_idx", "score")


def _no_rows(spark: SparkSession, schema: str) -> DataFrame:
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))))


def _n_terms(column: pa.Array) -> np.ndarray:
    return np.array([sum(map(len, _terms(text))) for text in texts(column)], np.int64)


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of terms of each text that has any."""
    for batch in batches:
        n = _n_terms(batch["text"])
        yield pa.RecordBatch.from_arrays([pa.array(n[n > 0])], ["n"])


def _with_length(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has terms, with their number as `n`."""
    for batch in batches:
        n = _n_terms(batch["text"])
        yield batch.append_column("n", pa.array(n)).filter(pa.array(n > 0))


def normaliser(n: Column, n_pages: int, n_terms: int) -> Column:
    return F.lit(100 - LENGTH_SHARE) + F.call_function("div", F.lit(LENGTH_SHARE) * n * F.lit(n_pages), F.lit(n_terms))


def _asked(annotations: DataFrame) -> DataFrame:
    """Annotations with terms, numbered; a number is only good for the table it is stored in."""
    more = F.col("note_text") if "note_text" in annotations.columns else F.lit(None).cast("string")
    rows = annotations.select(*ANNOTATION, effective_contents(F.col("contents"), more).alias("text"))
    return (rows.mapInArrow(_with_length, "doc_id long, page_idx int, annot_idx int, text string, n long")
            .withColumn("query", F.monotonically_increasing_id()))


def _parts(asked: DataFrame) -> Iterator[list]:
    """Queries in blocks of about ASKED_AT_ONCE, and of about TERMS_AT_ONCE terms."""
    queries, terms = asked.agg(F.count("*"), F.sum("n")).first()
    parts = max(-(-queries // ASKED_AT_ONCE), -(-(terms or 0) // TERMS_AT_ONCE))
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).select("query", "text").collect()
        if rows:
            yield rows


def _shards(pages: DataFrame, lengths: DataFrame, n_pages: int, n_terms: int) -> DataFrame:
    """The index. A stratum's rows come together, in parts where it has many terms."""
    m = normaliser(F.col("n"), n_pages, n_terms).alias("m")
    large = (lengths.select(m, (F.col("n") * F.col("pages")).alias("terms")).groupBy("m").agg(F.sum("terms").alias("terms"))
             .where(F.col("terms") > PART_TERMS).select("m", F.ceil(F.col("terms") / PART_TERMS).alias("parts")))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(*PAGE, "text"), F.col("parts"))).otherwise(0)
    return (pages.mapInArrow(_with_length, "doc_id long, page_idx int, text string, n long").select("*", m)
            .join(stored(large), "m", "left").withColumn("part", part)
            .repartition("m", "part").sortWithinPartitions("m").select(*PAGE, "m", "text")
            .mapInArrow(_indexer(SHARD_TERMS, SHARD_PAGES), SHARD))


def _terms(text: bytes | None) -> Iterator[list[bytes]]:
    return (stretch.lower().translate(SEPARATORS).split() for stretch in stretches(text))


def _indexer(most_terms: int, most_pages: int):
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        building = Building()
        for batch in batches:
            for doc_id, page_idx, m, text in zip(*(batch[c].to_pylist() for c in (*PAGE, "m")), texts(batch["text"]), strict=True):
                building.add(doc_id, page_idx, m, text)
                if len(building.pages) >= most_pages or building.size >= most_terms:
                    yield building.packed()
                    building = Building()
        if building.pages:
            yield building.packed()
    return index


class Building:
    """Pages of a shard to be, in order of m."""

    def __init__(self):
        self.pages, self.parts, self.lengths, self.size = [], [], [], 0

    def add(self, doc_id: int | None, page_idx: int | None, m: int, text: bytes) -> None:
        length = 0
        for terms in _terms(text):
            self.parts.append(pa.array(terms, pa.binary()))
            length += len(terms)
        self.lengths.append(length)
        self.size += length
        self.pages.append((NO_DOC if doc_id is None else doc_id, NO_PAGE if page_idx is None else page_idx, m))

    def packed(self) -> pa.RecordBatch:
        docs, pages, m = np.array(self.pages, np.int64).T
        of_page = np.repeat(np.arange(len(docs)), self.lengths)
        terms = pa.concat_arrays(self.parts).dictionary_encode()
        places = terms.indices.to_numpy().astype(np.int64)
        postings, tf = np.unique(places * len(docs) + of_page, return_counts=True)
        term, page = np.divmod(postings, len(docs))
        stratum = np.cumsum(np.r_[0, m[1:] != m[:-1]])[page]
        order = np.lexsort((-tf, term * len(docs) + stratum))
        term, stratum, tf, page = term[order], stratum[order], tf[order], page[order]
        new_cell = np.r_[True, (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])]
        groups = np.flatnonzero(new_cell | np.r_[True, tf[1:] != tf[:-1]])
        cells = np.flatnonzero(new_cell)
        columns = [pa.array(docs), _ints(pages), pa.array(m), terms.dictionary,
                   _ints(np.diff(np.searchsorted(term[cells], np.arange(len(terms.dictionary) + 1)))), _ints(stratum[cells]),
                   _ints(np.diff(np.r_[np.searchsorted(groups, cells), len(groups)])), _ints(tf[groups]),
                   _ints(np.diff(np.r_[groups, len(term)])), _ints(page)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        row = pa.RecordBatch.from_arrays(lists, COLUMNS)
        packed = pa.BufferOutputStream()
        with pa.ipc.new_stream(packed, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(row)
        return pa.RecordBatch.from_arrays([pa.array([packed.getvalue().to_pybytes()], pa.binary())], ["shard"])


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


class Queries:
    """A block of queries: their distinct terms, and for each query the places of its own among them."""

    def __init__(self, rows: list, n_pages: int):
        self.n_pages, self.ids = n_pages, [r.query for r in rows]
        places: dict[bytes, int] = {}
        self.own = []
        for row in rows:
            bag = dict.fromkeys(t for terms in _terms(row.text.encode()) for t in terms)
            self.own.append(np.fromiter((places.setdefault(t, len(places)) for t in bag), np.int64, len(bag)))
        self.terms = list(places)
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, holders: list) -> None:
        """Weights from (term, df); a term on no page keeps weight 0, as it is never met."""
        for term, df in holders:
            self.weights[term] = math.floor(1000 * math.log((2 * self.n_pages + 2) / (2 * df + 1)))


def _search(shards: DataFrame, queries: Queries, found: str, top: int) -> None:
    """Add the best pages of each task for a block of queries to the table of those found."""
    holders = shards.mapInArrow(_holders(queries.terms), "term int, df long")
    queries.weigh([(r.term, r.df) for r in holders.groupBy("term").agg(F.sum("df").alias("df")).collect()])
    shards.mapInArrow(_searcher(queries, top), FOUND).write.mode("append").parquet(found)


def _holders(terms: list[bytes]):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for shard in _each(batches):
            at = shard.places(terms)
            here = np.flatnonzero(at >= 0)
            ends = [shard.posting_starts[shard.group_starts[shard.cell_starts[at[here] + i]]] for i in (0, 1)]
            df[here] += ends[1] - ends[0]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([_ints(seen), pa.array(df[seen])], ["term", "df"])
    return count


def _searcher(queries: Queries, top: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.ids), top)
        for shard in _each(batches):
            shard.weigh()
            at = shard.places(queries.terms)
            for query, own in enumerate(queries.own):
                own = own[(at[own] >= 0) & (queries.weights[own] > 0)]
                if len(own):
                    shard.search(query, at[own], queries.weights[own], best)
        yield best.rows(queries.ids)
    return search


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator["Shard"]:
    for batch in batches:
        for packed in batch["shard"]:
            yield Shard(pa.ipc.open_stream(packed.as_buffer()).read_next_batch())


class Best:
    """The best pages of each query so far, the worst of them last."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.scores = np.zeros((queries, top), np.int64)
        self.pages = np.zeros((queries, top, 2), np.int64)

    def add(self, query: int, scores: np.ndarray, pages: np.ndarray) -> None:
        scores, pages = np.r_[self.scores[query], scores], np.r_[self.pages[query], pages]
        order = np.lexsort((pages[:, 1], pages[:, 0], -scores))[:self.top]
        self.scores[query], self.pages[query] = scores[order], pages[order]

    def rows(self, ids: list[int]) -> pa.RecordBatch:
        query, place = np.nonzero(self.scores > 0)
        doc, page = self.pages[query, place].T
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(ids, np.int64)[query]), pa.array(doc, mask=doc == NO_DOC),
             pa.array(page.astype(np.int32), mask=page == NO_PAGE), pa.array(self.scores[query, place])],
            [c.split()[0] for c in FOUND.split(", ")])


class Shard:
    def __init__(self, row: pa.RecordBatch):
        columns = {name: row[name].flatten() for name in COLUMNS}
        self.terms = columns.pop("terms")
        own = {name: c.to_numpy() for name, c in columns.items()}
        self.docs, self.pages, self.m = own["docs"], own["pages"], own["m"]
        self.cell_strata, self.group_tf, self.postings = own["cell_strata"], own["group_tf"].astype(np.int64), own["postings"]
        self.cell_starts, self.group_starts, self.posting_starts = (
            np.r_[0, np.cumsum(own[name], dtype=np.int64)] for name in ("term_cells", "cell_groups", "group_pages"))

    def places(self, terms: list[bytes]) -> np.ndarray:
        """Where the shard has each term, or -1."""
        return pc.index_in(pa.array(terms, pa.binary()), value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)

    def weigh(self) -> None:
        """The impact of each group, and the largest of each cell, which is that of its first group."""
        edges = np.flatnonzero(np.r_[True, self.m[1:] != self.m[:-1]])
        self.strata = len(edges)
        in_stratum = np.repeat(self.cell_strata, np.diff(self.group_starts))
        self.impacts = SCALE * self.group_tf // (TF_FACTOR * self.group_tf + M_FACTOR * self.m[edges][in_stratum])
        self.most = self.impacts[self.group_starts[:-1]]

    def search(self, query: int, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        cells, of_cell = _ranges(self.cell_starts[terms], self.cell_starts[terms + 1])
        weights = weights[of_cell]
        strata = self.cell_strata[cells]
        bounds = np.zeros(self.strata, np.int64)
        np.add.at(bounds, strata, weights * self.most[cells])
        order = np.argsort(-bounds, kind="stable")
        at, step = 0, FIRST_ROUND
        while at < len(order):
            visit = order[at:at + step]
            visit = visit[(bounds[visit] > 0) & (bounds[visit] >= best.scores[query, -1])]
            if not len(visit):
                return
            chosen = np.zeros(self.strata, bool)
            chosen[visit] = True
            kept = chosen[strata]
            self._score(query, cells[kept], weights[kept], best)
            at, step = at + step, step * 4

    def _score(self, query: int, cells: np.ndarray, weights: np.ndarray, best: Best) -> None:
        groups, of_group = _ranges(self.group_starts[cells], self.group_starts[cells + 1])
        gains = self.impacts[groups] * weights[of_group]
        postings, of_posting = _ranges(self.posting_starts[groups], self.posting_starts[groups + 1])
        scores = np.zeros(len(self.docs), np.int64)
        np.add.at(scores, self.postings[postings], gains[of_posting])
        found = np.flatnonzero((scores > 0) & (scores >= best.scores[query, -1]))
        if len(found):
            best.add(query, scores[found], np.stack([self.docs[found], self.pages[found]], 1))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start, ..., end - 1 of each range, one range after the other, and the range of each."""
    sizes = (ends - starts).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return starts[of] + np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of], of
