"""Passages that pages of the library share, removed: windows of words that start in more than one place.

Windows are dealt to buckets by their minimiser, the least hash of three neighbouring words in them. Consecutive
windows with the same minimiser overlap in all but a word each, so they travel as one packed string, a
super-k-mer, and strings of a task that go to the same bucket travel compressed together. All copies of a
window reach the same bucket, where sorting counts them: by a rolling hash first, and those that look
alike word by word.

A minimiser that a sample of pages shows often is dealt over many buckets, and a bucket with more
strings than a task should hold is counted in parts. Windows found once there are counted again by their
digests over all parts; those found twice are removed anyway.
"""

from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.batches import STRETCH, texts, words
from marginalia.operators.stored import stored

WINDOW = 35
# Bytes of a text's digest. Bits for each text that loses something in the filter, and 2^26 bits at most.
DIGEST = 12
BITS_PER_TEXT, MOST_BITS = 16, 26
# Words of a minimiser, and windows of a packed string at most.
M, MOST_WINDOWS = 3, 512
# Bytes of packed strings that a task sends at once and that it counts at once, and those of a bucket, about.
SENT_AT_ONCE, COUNTED_AT_ONCE, BUCKET_BYTES = 16 << 20, 32 << 20, 20 << 20
# Partitions that buckets are spread over at most.
MOST_PARTITIONS = 1 << 14
# Parts of a bucket, by minimiser, that are counted one after the other.
PARTS = 16
# Pages looked at for frequent minimisers, about. Frequent is what has one in so many packed strings.
SAMPLED_PAGES, FREQUENT = 20_000, 2000
# Base of rolling hashes, modulo 2^64, and bytes of a word that are hashed for minimisers.
BASE, HASHED = 0xD1342543DE82EF95, 64
# Pages whose texts a task holds at once.
PAGES_AT_ONCE = 512

PACKED = "bucket int, strings binary"
STRINGS = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("copies", pa.int32()), ("dealt", pa.bool_()), ("part", pa.uint8()),
                     ("packed", pa.binary())])
COUNTED = "digest binary, first long, last long, window binary, twice boolean"
SENT = "doc_id long, page_idx int, digest binary, text binary"
KEPT = "doc_id long, page_idx int, n_words long, n_removed long, text string"


def without_repeats(page_text: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, page_idx, n_words, n_removed, text): each page without what it shares.

    A word `[^\\x20\\x09-\\x0D]+` goes if it lies in a window of `window` words of its page whose word sequence also
    starts anywhere else, on the same page or on another. Windows are judged on the pages as given. `text` is
    the words that stay, joined by one space. A null or empty text has no words, and a page with fewer words
    than a window keeps all. Rows that repeat a page are pages of their own: where they have the same text, it
    repeats itself. Null doc_id and page_idx are kept; other columns are ignored.

    What a page loses hangs on its text alone, so places are named by 96 bits of the SHA-256 of the text. Only
    texts that may lose something meet what they lose; a filter of bounded size tells most others before.
    """
    pages = page_text.select("doc_id", "page_idx", "text")
    n_pages, size = pages.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # Strings overlap in all but one word of a window: together they are about three times as long as the texts.
    buckets = 1 + 3 * (size or 0) // BUCKET_BYTES
    often = _often(pages, n_pages, window)
    packed = pages.mapInArrow(_packer(window, often, buckets, SENT_AT_ONCE), PACKED)
    counted = packed.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(_counter(window, COUNTED_AT_ONCE), COUNTED)
    return _without(pages, stored(_covered(counted, window)))


def _often(pages: DataFrame, n_pages: int, window: int) -> dict[int, int]:
    """Frequent minimisers, less than FREQUENT of them, with the number of parts each is dealt into.

    Which ones are found changes where windows are counted, never the counts.
    """
    sample = pages.sample(min(1.0, SAMPLED_PAGES / max(n_pages, 1)), seed=1).select("text")
    seen = stored(sample.mapInArrow(_minimisers_of(window), "minimiser long").groupBy("minimiser").agg(F.count("*").alias("n")))
    strings = seen.agg(F.sum("n")).first()[0] or 0
    return {r.minimiser: 1 + r.n * FREQUENT // strings
            for r in seen.where(F.col("n") > max(strings // FREQUENT, 32)).collect()}


def _minimisers_of(window: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for text in texts(batch["text"]):
                found = [m for m, _, _ in _strings(text or b"", window, hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["minimiser"])
    return find


def _covered(counted: DataFrame, window: int) -> DataFrame:
    """(digest, covered): stretches of words to be removed from the text of this digest, (first, last) of each."""
    # Stretches go by their text, single windows by their words, in one shuffle: what is counted is read once.
    same = Window.partitionBy(F.coalesce("window", "digest"))
    stretches = (counted.withColumn("n", F.count("*").over(same)).where("window is null or n > 1 and not twice")
                 .select("digest", "first", (F.coalesce("last", F.col("first") + (window - 1)) - F.col("first")).cast("int").alias("more")))
    return stretches.repartition("digest").groupBy("digest").agg(F.collect_list(F.struct("first", "more")).alias("covered"))


def _without(pages: DataFrame, covered: DataFrame) -> DataFrame:
    """Pages without text are spread by their ids, as they match nothing."""
    digest = F.when(F.length("text") > 0, F.substring(F.sha2("text", 256), 1, 2 * DIGEST)).otherwise(F.md5(F.concat_ws(" ", "doc_id", "page_idx")))
    bits = 1 << min(MOST_BITS, max(15, (BITS_PER_TEXT * covered.count()).bit_length()))
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    own = pages.withColumn("digest", F.unhex(digest)).withColumn("place", place)
    may_lose = _filter(covered.select((place + 1).alias("place")), bits)
    losing = own.mapInArrow(_losing(may_lose), SENT).join(covered, "digest", "left")
    others = own.select("doc_id", "page_idx", "text", "place").mapInArrow(_others(may_lose), KEPT)
    return losing.drop("digest").mapInArrow(_remover, KEPT).unionByName(others)


def _losing(may_lose):
    """Pages that may lose something, their texts compressed."""
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            some = batch.filter(may_lose(batch["place"]))
            packed = [zstandard.compress(text or b"", 3) for text in texts(some["text"])]
            yield pa.RecordBatch.from_arrays([some["doc_id"], some["page_idx"], some["digest"], pa.array(packed, pa.binary())],
                                             [c.split()[0] for c in SENT.split(", ")])
    return send


def _others(may_lose):
    """Pages that lose nothing."""
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            some = batch.filter(pc.invert(may_lose(batch["place"])))
            yield _batch([(doc_id, page_idx, *_rest(text, [])) for doc_id, page_idx, text in zip(
                some["doc_id"].to_pylist(), some["page_idx"].to_pylist(), texts(some["text"]), strict=True)], KEPT)
    return keep


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, PAGES_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, PAGES_AT_ONCE))


def _filter(places: DataFrame, bits: int):
    """A test of whether a place is among these (counted from 1), by one bit for each."""
    parts = (places.groupBy(F.bitmap_bucket_number("place").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect())
    packed = np.zeros(bits // 8, np.uint8)
    for row in parts:
        start = (row.part - 1) * len(row.bits)
        packed[start:start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)

    def test(place: pa.Array) -> pa.Array:
        at = place.to_numpy()
        return pa.array((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
    return test


def _packer(window: int, often: dict[int, int], buckets: int, at_once: int):
    """Packed strings of pages by bucket; equal texts side by side travel once, with their number."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        waiting: dict[int, list[tuple]] = defaultdict(list)
        size = 0
        for batch in _slices(batches):
            copies: dict[bytes, int] = defaultdict(int)
            ids: dict[bytes, int] = {}
            for doc_id, page_idx, text in zip(batch["doc_id"].to_pylist(), batch["page_idx"].to_pylist(), texts(batch["text"]), strict=True):
                if text:
                    copies[text] += 1
                    ids.setdefault(text, xxhash.xxh32_intdigest(f"{doc_id} {page_idx}"))
            for text, n in copies.items():
                digest = sha256(text).digest()[:DIGEST]
                for minimiser, first, packed in _strings(text, window, hashes):
                    parts = often.get(minimiser)
                    bucket = minimiser
                    if parts:
                        bucket += (1 + (ids[text] + int.from_bytes(digest[:4])) % parts) << 32
                    part, bucket = divmod(_mixed(bucket), buckets)
                    waiting[bucket].append((digest, first, n, parts is not None, part % PARTS, packed))
                    size += len(packed)
                    if size >= at_once:
                        yield _sent(waiting)
                        size = 0
        if waiting:
            yield _sent(waiting)
    return pack


def _mixed(bucket: int) -> int:
    return (bucket * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32


def _sent(waiting: dict[int, list[tuple]]) -> pa.RecordBatch:
    buckets, blobs = [], []
    for bucket, rows in waiting.items():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, STRINGS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STRINGS, strict=True)], schema=STRINGS))
        buckets.append(bucket)
        blobs.append(sink.getvalue().to_pybytes())
    waiting.clear()
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "strings"])


class Hashes:
    """64-bit hashes of words, by their first bytes. They only deal windows to buckets; equal ones do no harm."""

    def __init__(self):
        self.powers, self.inverse = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def of(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(text) > len(self.powers):
            size = 1 << len(text).bit_length()
            self.powers, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(size, p, np.uint64)]) for p in (BASE, pow(BASE, -1, 1 << 64)))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text + np.uint64(1)) * self.powers[:len(text)], out=sums[1:])
        found = (sums[np.minimum(ends, begins + HASHED)] - sums[begins]) * self.inverse[begins]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0x9E3779B97F4A7C15)
        return found ^ (found >> np.uint64(29))


def _strings(text: bytes, window: int, hashes: Hashes) -> Iterator[tuple[int, int, bytes]]:
    """(minimiser, place of the first word, words) of each run of windows with the same minimiser."""
    held: list[bytes] = []
    start = 0
    for more in words(text):
        held += more
        windows = len(held) - window + 1
        if windows <= 0:
            continue
        line = b" ".join(held)
        letters, begins, ends = _places(line)
        # Long words are hashed apart from the line.
        short = (letters, begins, ends) if len(line) < 2 * STRETCH else _places(b" ".join(w[:HASHED] for w in held))
        least = _minimisers(hashes.of(*short), window)
        edges = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), windows]
        cuts = [cut for first, end in pairwise(edges) for cut in range(first, end, MOST_WINDOWS)]
        last = np.array([*cuts[1:], windows]) + (window - 2)
        for cut, minimiser, begin, end in zip(cuts, least[cuts].tolist(), begins[cuts].tolist(), ends[last].tolist(), strict=True):
            yield minimiser, start + cut, line[begin:end]
        held, start = held[windows:], start + windows


def _places(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words joined by one space, and where each word begins and ends."""
    letters = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(letters == 32)
    return letters, np.concatenate(([0], gaps + 1)), np.append(gaps, len(line))


def _minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least of the mixed 32-bit hashes of neighbouring words in each window."""
    own = hashes
    for _ in range(min(M, window) - 1):
        own = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[len(hashes) - len(own) + 1:]
    own ^= own >> np.uint64(29)
    least = ((own * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64)
    width, wanted = 1, window - min(M, window) + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def _counter(window: int, at_once: int):
    """Windows that occur twice in a bucket, and those that other parts of their minimiser or bucket may have too."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, is_part in _buckets(batches, at_once):
            for part in range(PARTS):
                some = table.filter(pc.equal(table["part"], part))
                if some.num_rows:
                    yield from _counted(some, is_part | np.asarray(some["dealt"]), window)
    return count


def _buckets(batches: Iterable[pa.RecordBatch], at_once: int) -> Iterator[tuple[pa.Table, bool]]:
    """The strings of each bucket, or of a part of one that is too large for a task, and whether it is a part."""
    held: list[pa.RecordBatch] = []
    last, size, is_part = None, 0, False
    for batch in batches:
        for bucket, packed in zip(batch["bucket"].to_pylist(), batch["strings"], strict=True):
            if bucket != last:
                if held:
                    yield pa.Table.from_batches(held), is_part
                last, held, size, is_part = bucket, [], 0, False
            elif size >= at_once:
                is_part = True
                yield pa.Table.from_batches(held), True
                held, size = [], 0
            strings = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            held.append(strings)
            size += strings.nbytes
    if held:
        yield pa.Table.from_batches(held), is_part


def _counted(table: pa.Table, open_: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    packed = table["packed"].combine_chunks()
    split = pc.split_pattern(packed, b" ")
    ids, sizes = split.flatten().dictionary_encode().indices.to_numpy(), pc.list_value_length(split).to_numpy().astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    n_windows = sizes - window + 1
    string = np.repeat(np.arange(len(sizes)), n_windows)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = starts[string] + offset
    kinds = _kinds(ids, at, window)
    copies = np.bincount(kinds, np.asarray(table["copies"])[string])[kinds]
    twice = copies > 1
    first = np.asarray(table["first"])[string] + offset
    digests = table["digest"].to_pylist()
    edge = np.flatnonzero(np.r_[True, (twice[1:] != twice[:-1]) | (string[1:] != string[:-1])])
    last = np.r_[edge[1:], len(twice)] - 1
    rows = list({(digests[s], a, b + window - 1, None, None) for s, a, b in zip(
        string[edge][twice[edge]].tolist(), first[edge][twice[edge]].tolist(), first[last][twice[edge]].tolist(), strict=True)})
    if open_.any():
        one = np.unique(kinds, return_index=True)[1]
        one = one[open_[string[one]]]
        text, begins, ends = _word_bytes(packed, pc.binary_length(split.flatten()).to_numpy(), starts, sizes)
        for i, begin, end in zip(one.tolist(), begins[at[one]].tolist(), ends[at[one] + window - 1].tolist(), strict=True):
            rows.append((digests[string[i]], int(first[i]), None, sha256(text[begin:end]).digest(), bool(twice[i])))
    for part in range(0, len(rows), 65536):
        yield _batch(rows[part:part + 65536], COUNTED)


def _word_bytes(packed: pa.Array, lengths: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The bytes of all packed strings, and where each of their words begins and ends in them."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4).astype(np.int64)
    behind = np.cumsum(lengths.astype(np.int64) + 1)
    begins = behind - lengths - 1
    begins = begins + np.repeat(offsets[:-1] - begins[starts], sizes)
    return memoryview(packed.buffers()[2]), begins, begins + lengths


def _kinds(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A number for each window; windows have the same if and only if their words are the same."""
    base = np.uint64(BASE)
    values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(31)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), base)])
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), inverse)])
    sums = np.r_[np.uint64(0), np.cumsum(values * powers[:-1])]
    _, lead, kinds = np.unique((sums[at + window] - sums[at]) * back[at], return_index=True, return_inverse=True)
    other = np.flatnonzero(lead[kinds] != np.arange(len(at)))
    for part in range(0, len(other), 1 << 16):
        some = other[part:part + (1 << 16)]
        steps = np.arange(window)
        differs = (ids[at[some, None] + steps] != ids[at[lead[kinds[some]], None] + steps]).any(axis=1)
        if differs.any():
            # Hashes of different windows are the same: go by the words alone.
            return np.unique(ids[at[:, None] + steps], axis=0, return_inverse=True)[1].reshape(-1)
    return kinds


def _remover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        yield _batch([(doc_id, page_idx, *_rest(zstandard.decompress(packed), covered or [])) for doc_id, page_idx, packed, covered in zip(
            *(batch[c].to_pylist() for c in ("doc_id", "page_idx", "text", "covered")), strict=True)], KEPT)


def _rest(text: bytes | None, covered: list[dict]) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the words that stay."""
    stretches = sorted((c["first"], c["first"] + c["more"]) for c in covered)
    kept, n_words, n_removed, at = [], 0, 0, 0
    for some in words(text):
        if not stretches:
            kept.append(b" ".join(some))
        else:
            goes = np.zeros(len(some), bool)
            while at < len(stretches) and stretches[at][0] < n_words + len(some):
                goes[max(stretches[at][0] - n_words, 0):max(stretches[at][1] + 1 - n_words, 0)] = True
                if stretches[at][1] >= n_words + len(some):
                    break
                at += 1
            n_removed += int(goes.sum())
            kept.append(b" ".join(some[i] for i in np.flatnonzero(~goes).tolist()))
        n_words += len(some)
    return n_words, n_removed, b" ".join(k for k in kept if k)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    arrays = [pa.array(c, pa.binary() if kind == "string" else types[kind]).cast(types[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])
