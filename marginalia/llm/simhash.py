"""Near-duplicate pages: SimHash fingerprints joined in a grid of segment bit counts.

A fingerprint has 32 segments of two bits. The Manhattan distance of two fingerprints' bit counts
by segment is at most their number of differing bits. Of a pair within three bits, at least one half
(16 segments) has counts within distance one: such a pair meets in a grid cell, which is a half
with its 16 counts. Where counts differ by one, one of the two has an even sum; it also visits the
cells next to its own. What meets is compared bit by bit.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import lower_words, texts, whole_runs
from marginalia.operators.components import connected_components
from marginalia.operators.stored import stored

MAX_DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
# Rows of a cell that one task compares; a fuller cell is cut into blocks, compared two by two.
CELL_ROWS = 1 << 17
# Runs up to this length are compared row by row; longer ones spread from link to link.
SHORT_RUN = 24
ROWS_AT_ONCE = 1 << 18

PAGE = ["doc_id", "page_idx"]
EVEN_BITS = np.uint64(0x55555555)


def near_duplicate_pages(page_text: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, page_idx, fingerprint, class_fingerprint, class_doc_id, class_page_idx) for each row of
    page_text.

    Pages whose fingerprints differ in at most `max_distance` (up to 3) bits are linked; a class is what
    links reach, with its smallest fingerprint and its smallest page. Fingerprints are 64-bit, as signed
    longs. Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat
    a page each come back; a null doc_id or page_idx sorts first. Other columns are ignored.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError("the grid finds pairs within three bits")
    pages = stored(page_text.select(*PAGE, "text").mapInArrow(
        _fingerprints, "doc_id long, page_idx int, fingerprint long"))
    first = F.struct(F.col("doc_id"), F.col("page_idx"))
    kinds = stored(pages.groupBy("fingerprint").agg(F.min(first).alias("first")))
    links = stored(fingerprint_links(kinds, max_distance))
    classes = kinds.withColumn("component", F.col("fingerprint"))
    if not links.isEmpty():
        found = connected_components(links, []).withColumnRenamed("node", "fingerprint")
        classes = (kinds.join(found, "fingerprint", "left")
                   .withColumn("component", F.coalesce("component", "fingerprint")))
    firsts = classes.groupBy("component").agg(F.min("first").alias("class"))
    named = classes.join(firsts, "component").select(
        "fingerprint", F.col("component").alias("class_fingerprint"), F.col("class.doc_id").alias("class_doc_id"),
        F.col("class.page_idx").alias("class_page_idx"))
    return (pages.join(named, "fingerprint")
            .select(*PAGE, "fingerprint", "class_fingerprint", "class_doc_id", "class_page_idx"))


def fingerprint_of(text: Column) -> Column:
    """A text's fingerprint as near_duplicate_pages gives it."""
    @F.pandas_udf("long")
    def of(column: pd.Series) -> pd.Series:
        prints = [fingerprint(None if t is None else t.encode()) for t in column]
        return pd.Series(np.array(prints, np.uint64).view(np.int64))
    return of(text)


def hex_fingerprint(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def fingerprint_links(kinds: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b), a < b, that connect all fingerprints which chains of near pairs connect.

    Each link is a near pair; pairs that other links already connect may be missing.
    """
    cells = kinds.select("fingerprint").mapInArrow(_cells, "cell long, fingerprint long")
    size = F.lit(CELL_ROWS)
    full = (cells.groupBy(F.shiftright("cell", 1).alias("place")).agg(F.count("*").alias("n"))
            .where(F.col("n") > size)
            .select("place", F.ceil(F.col("n") / size).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(every, lambda b: F.least(b, F.col("own")) * F.col("blocks")
                        + F.greatest(b, F.col("own")))
    dealt = (cells.withColumn("place", F.shiftright("cell", 1)).join(full, "place", "left")
             .withColumn("own", F.coalesce(own, F.lit(0)))
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.explode(pairs)))
    visitor = F.col("cell").bitwiseAND(F.lit(1)) == 1
    return (dealt.select(F.xxhash64("place", "block").alias("run"), visitor.alias("visitor"), "fingerprint")
            .repartition("run").sortWithinPartitions("run", "visitor")
            .mapInArrow(_linker(max_distance), "a long, b long").distinct())


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in texts(batch["text"])], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["page_idx"], pa.array(prints)],
                                         ["doc_id", "page_idx", "fingerprint"])


def fingerprint(text: bytes | None) -> int:
    """SimHash over XXH64 of the 3-word shingles: a bit set in over half of them is set."""
    ones, count, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in lower_words(text):
        words = tail + words
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        ones, count = ones + _ones(hashes), count + len(hashes)
        tail = words[1 - SHINGLE_WORDS:]
    if not count and tail:
        hashes, count = np.array([digest(b" ".join(tail), SEED)], np.uint64), 1
        ones = _ones(hashes)
    bits = np.packbits((2 * ones > count).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (half, counts, visitor) as one number: a fingerprint's own cells and those it visits."""
    for batch in batches:
        prints = np.asarray(batch["fingerprint"]).view(np.uint64)
        cells, owners = [], []
        for half in (0, 1):
            bits = (prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            counts = bits - ((bits >> np.uint64(1)) & EVEN_BITS)  # two bits hold each segment's count
            base = counts | np.uint64(half << 32)
            cells.append(base << np.uint64(1))
            owners.append(prints)
            even = np.bitwise_count(bits) % 2 == 0
            base, home = base[even], prints[even]
            for segment in range(0, 32, 2):
                one = np.uint64(1 << segment)
                here = (base >> np.uint64(segment)) & np.uint64(3)
                for kept, there in ((here < 2, base + one), (here > 0, base - one)):
                    cells.append((there[kept] << np.uint64(1)) | np.uint64(1))
                    owners.append(home[kept])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (cells, owners)],
            ["cell", "fingerprint"])


def _linker(max_distance: int):
    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "run", ROWS_AT_ONCE):
            runs, visitor = np.asarray(table["run"]), np.asarray(table["visitor"])
            prints = np.asarray(table["fingerprint"]).view(np.uint64)
            a, b = (x.view(np.int64) for x in near_pairs(runs, visitor, prints, max_distance))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                             ["a", "b"])
    return link


def near_pairs(runs: np.ndarray, visitor: np.ndarray, prints: np.ndarray,
               max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs that connect what near pairs within a run connect. Visitors come last in a run."""
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    sizes = np.diff(np.r_[starts, len(runs)])
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    found_a, found_b = [prints[:0]], [prints[:0]]
    for step in range(1, min(SHORT_RUN, int(sizes.max()))):
        together = (runs[step:] == runs[:-step]) & short[:-step] & ~visitor[:-step]
        at = np.flatnonzero(together)
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= max_distance]
        found_a.append(prints[at])
        found_b.append(prints[at + step])
    for start, size in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True):
        if not visitor[start]:
            for a, near in _spread(np.unique(prints[start:start + size]), max_distance):
                found_a.append(np.full(len(near), a))
                found_b.append(near)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return a[a != b], b[a != b]


def _spread(rest: np.ndarray, max_distance: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """Each fingerprint with those near it that no fingerprint before has reached."""
    reached: list[np.uint64] = []
    while len(rest):
        if not reached:
            reached, rest = [rest[0]], rest[1:]
        at = reached.pop()
        near = np.bitwise_count(rest ^ at) <= max_distance
        if near.any():
            yield at, rest[near]
            reached.extend(rest[near])
            rest = rest[~near]
