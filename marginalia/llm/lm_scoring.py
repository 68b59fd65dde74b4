"""Page text scored by a bigram model with deleted interpolation.

P(w | v) = a * c(v w) / c(v) + b * c(w) / N + z / (V + 1), where the weights a, b, z depend on how often the
context v was seen. They are learned by expectation-maximisation on pages that were left out of the counts
meanwhile, and then used with the counts of all training pages.

Tokens travel in packed blocks of pages, not row by row: a block asks the shards, which are ranges of n-gram
hashes, for the counts of its different n-grams and brings its own; a shard adds up what all blocks bring
and answers each.
"""

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import lower_words, texts
from marginalia.operators.stored import stored

# Tokens a block holds before it is closed, and tokens for each shard of the counts.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 19
# One training page in so many is left out while the weights are learned.
DELETED_PART = 10
EM_ROUNDS = 40
# Probabilities are rounded to this many steps an octave where weights are learned, so that what the driver
# receives is bounded.
STEPS = 4
LEAST_WEIGHT = 1e-6
END = b"\n"  # no word contains it

COUNTED, DELETED, SCORED = 0, 1, 2
PAGE = ["doc_id", "page_idx"]
BLOCK = "block long, n_tokens long, pages binary, words binary, tokens binary, roles binary, lengths binary"
REQUEST = "shard long, block long, ones binary, one_counts binary, twos binary, two_counts binary"
REPLY = "block long, shard long, ones binary, twos binary, known long, known_kept long, tokens long, tokens_kept long"


def score_pages(page_text: DataFrame) -> DataFrame:
    """(doc_id, page_idx, n_tokens, n_known, train_tokens, base_score, score) for each row of page_text.

    `training` (boolean, null is false) tells the rows to learn from. Tokens are the words of the
    lower-cased text (A-Z only) and one end. n_known counts tokens seen in training, train_tokens all
    training tokens N. base_score is the sum over tokens of log10((c + 1) / (N + V + 1)), score the log10
    probability of the text under the interpolated bigram model; the first word's context is an end. Null
    and empty texts are an end alone. Without training rows both scores are zero. N-grams are told apart by
    64-bit hashes. Rows that repeat a page are scored (and learned from) each. Other columns are ignored.
    """
    training = F.coalesce(F.col("training"), F.lit(False))
    left_out = F.pmod(F.xxhash64(*PAGE), F.lit(DELETED_PART)) == 0
    role = F.when(~training, SCORED).when(left_out, DELETED).otherwise(COUNTED)
    blocks = stored(page_text.select(*PAGE, "text", role.alias("role")).mapInArrow(_blocks, BLOCK))
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    shards = tokens // SHARD_TOKENS + 1
    replies = stored(blocks.select("block", "words", "tokens", "roles", "lengths")
                     .mapInArrow(_requests(shards), REQUEST).groupBy("shard").applyInArrow(_reply, REPLY))
    totals = replies.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("known", "known_kept", "tokens", "tokens_kept"))).first()
    answers = replies.select("block", "shard", "ones", "twos")
    deleted = (x.where(F.pmod("block", F.lit(2)) == 1).groupBy("block") for x in (blocks, answers))
    seen = (next(deleted).cogroup(next(deleted))
            .applyInArrow(_deleted_tokens(totals[1], totals[3]), "bucket int, two int, one int, n long")
            .groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect())
    weights = learn_weights([tuple(r) for r in seen], totals[1])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scores(weights, totals[0], totals[2]),
        "doc_id long, page_idx int, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a task in blocks: different words by hash in order, and the tokens as places of these.

    Pages that are left out while the weights are learned have blocks of their own, with odd numbers.
    """
    numbers = [TaskContext.get().partitionId() << 32, (TaskContext.get().partitionId() << 32) + 1]
    blocks = [Block(), Block()]
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in (*PAGE, "role")), texts(batch["text"]), strict=True):
            odd = int(row[2] == DELETED)
            blocks[odd].add(*row)
            if blocks[odd].size >= BLOCK_TOKENS:
                yield blocks[odd].packed(numbers[odd])
                numbers[odd], blocks[odd] = numbers[odd] + 2, Block()
    for number, block in zip(numbers, blocks, strict=True):
        if block.pages:
            yield block.packed(number)


class Block:
    """Pages with their tokens as numbers of words in the order of appearance."""

    def __init__(self):
        self.pages, self.roles, self.lengths, self.parts = [], [], [], []
        self.places: dict[bytes, int] = {END: 0}
        self.size = 0

    def add(self, doc_id: int | None, page_idx: int | None, role: int, text: bytes | None) -> None:
        places, length = self.places, 0
        for words in chain(lower_words(text), [[END]]):
            self.parts.append(np.fromiter((places.setdefault(w, len(places)) for w in words), np.int32, len(words)))
            length += len(words)
        self.pages.append({"doc_id": doc_id, "page_idx": page_idx})
        self.roles.append(role)
        self.lengths.append(length)
        self.size += length

    def packed(self, number: int) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.places), np.uint64, len(self.places))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        pages = pa.RecordBatch.from_pylist(self.pages, PAGE_SCHEMA).serialize().to_pybytes()
        return _batch(BLOCK, [[number], [self.size], [pages], [_steps(hashes[order])], [_planes(rank[np.concatenate(self.parts)])],
                              [_planes(np.array(self.roles, np.int8))], [_planes(np.array(self.lengths, np.int64))]])


PAGE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("page_idx", pa.int32())])
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
                                      [name for name, _ in fields])


class Tokens:
    """A block unpacked: words by hash, tokens, contexts, different bigrams by hash, and what each token is
    of.
    """

    def __init__(self, row: dict):
        self.words = _from_steps(row["words"])
        self.tokens = _from_planes(row["tokens"], np.int32)
        self.lengths = _from_planes(row["lengths"], np.int64)
        self.roles = np.repeat(_from_planes(row["roles"], np.int8), self.lengths)
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        ends = np.cumsum(self.lengths)
        self.contexts[np.r_[0, ends[:-1]]] = self.tokens[ends - 1]  # each text ends with an end
        before, own = self.words[self.contexts], self.words[self.tokens]
        mixed = (before * np.uint64(0x9E3779B97F4A7C15) ^ (own >> np.uint64(29))) + own * np.uint64(0xC2B2AE3D27D4EB4F)
        self.bigrams, self.of_bigram = np.unique(mixed ^ (mixed >> np.uint64(32)), return_inverse=True)

    def counts(self, places: np.ndarray, size: int) -> np.ndarray:
        """How often counted and deleted training pages have each n-gram."""
        return np.stack([np.bincount(places[self.roles == role], minlength=size) for role in (COUNTED, DELETED)], 1)


def _shard_bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted hashes begins, and the end."""
    of = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))


def _requests(shards: int):
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Tokens(row)
                ones = block.counts(block.tokens, len(block.words)).astype(np.int32)
                twos = block.counts(block.of_bigram, len(block.bigrams)).astype(np.int32)
                cut_one, cut_two = (_shard_bounds(h, shards) for h in (block.words, block.bigrams))
                columns: list[list] = [[], [], [], [], [], []]
                for shard in np.flatnonzero((np.diff(cut_one) > 0) | (np.diff(cut_two) > 0)).tolist():
                    one, two = slice(*cut_one[shard:shard + 2]), slice(*cut_two[shard:shard + 2])
                    found = (shard, row["block"], _steps(block.words[one]), _planes(ones[one]), _steps(block.bigrams[two]), _planes(twos[two]))
                    for column, value in zip(columns, found, strict=True):
                        column.append(value)
                yield _batch(REQUEST, columns)
    return ask


def _steps(hashes: np.ndarray) -> bytes:
    """Sorted numbers as differences, the same byte of all together: small ones compress well."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def _from_steps(packed: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(packed, np.uint64), dtype=np.uint64)


def _planes(numbers: np.ndarray) -> bytes:
    octets = np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(octets.tobytes())


def _from_planes(packed: bytes, kind: type) -> np.ndarray:
    octets = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(octets.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _reply(requests: pa.Table) -> pa.Table:
    """Counts over all blocks for each n-gram a block asks for, and totals of the shard in the first answer."""
    ones, one_sums = _answers(requests, "ones", "one_counts")
    twos, _ = _answers(requests, "twos", "two_counts")
    total = one_sums.sum(1)
    stats = [int((total > 0).sum()), int((one_sums[:, 0] > 0).sum()), int(total.sum()), int(one_sums[:, 0].sum())]
    rest = [[value] + [0] * (requests.num_rows - 1) for value in stats]
    return pa.Table.from_batches([_batch(REPLY, [requests["block"].to_pylist(), requests["shard"].to_pylist(), ones, twos, *rest])])


def _answers(requests: pa.Table, hashes: str, counts: str) -> tuple[list[bytes], np.ndarray]:
    asked = [_from_steps(x) for x in requests[hashes].to_pylist()]
    brought = np.concatenate([_from_planes(x, np.int32) for x in requests[counts].to_pylist()]).reshape(-1, 2)
    different, places = np.unique(np.concatenate(asked), return_inverse=True)
    sums = np.stack([np.bincount(places, brought[:, i], len(different)) for i in (0, 1)], 1).astype(np.int64)
    ends = np.cumsum([len(a) for a in asked])
    return [_planes(sums[part]) for part in np.split(places, ends[:-1])], sums


def _resolve(blocks: pa.Table, replies: pa.Table) -> Iterator[tuple[dict, Tokens, np.ndarray, np.ndarray]]:
    """A block's pages and tokens with the counts of its words and bigrams."""
    for row in blocks.to_pylist():
        block = Tokens(row)
        order = np.argsort(np.array(replies["shard"].to_pylist()))
        ones, twos = ([replies[c][int(i)].as_py() for i in order] for c in ("ones", "twos"))
        yield (row, block, *(np.concatenate([_from_planes(x, np.int64) for x in part]).reshape(-1, 2) for part in (ones, twos)))


def buckets(context_counts: np.ndarray) -> np.ndarray:
    """Contexts never seen, seen once, two or three times, four to seven times and so on."""
    return np.where(context_counts > 0, np.floor(np.log2(np.maximum(context_counts, 1))) + 1, 0).astype(np.int32)


def _levels(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-STEPS * np.log2(np.where(p > 0, p, 1))), -1).astype(np.int32)


def _deleted_tokens(known: int, tokens: int):
    """Tokens of deleted pages by context bucket and by what the counted pages tell of them."""
    def count(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        found = [np.zeros((0, 4), np.int64)]
        for _, block, ones, twos in _resolve(blocks, replies):
            own = np.flatnonzero(block.roles == DELETED)
            context = ones[block.contexts[own], 0]
            two = twos[block.of_bigram[own], 0] / np.maximum(context, 1)
            one = ones[block.tokens[own], 0] / max(tokens, 1)
            rows = np.stack([buckets(context), _levels(two), _levels(one)], 1)
            different, n = np.unique(rows, axis=0, return_counts=True)
            found.append(np.c_[different, n])
        rows = np.concatenate(found)
        return pa.Table.from_batches([_batch("bucket int, two int, one int, n long", list(rows.T))])
    return count


def learn_weights(seen: list[tuple[int, int, int, int]], known: int) -> np.ndarray:
    """Weights (bigram, unigram, unseen) of each context bucket, by expectation-maximisation.

    `seen` has (bucket, bigram level, unigram level, tokens); levels are -STEPS * log2 of a probability, -1
    for zero. Buckets without tokens take even weights; no weight for the unseen is zero. Contexts never
    seen have no bigrams.
    """
    rows = np.array(seen, np.int64).reshape(-1, 4)
    weights = np.full((65, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    p = np.where(rows[:, 1:3] >= 0, np.exp2(-rows[:, 1:3] / STEPS), 0)
    p = np.c_[p, np.full(len(rows), 1 / (known + 1))]
    for bucket in np.unique(rows[:, 0]).tolist():
        here = rows[:, 0] == bucket
        n = rows[here, 3]
        for _ in range(EM_ROUNDS):
            shares = p[here] * weights[bucket]
            shares /= shares.sum(1, keepdims=True)
            weights[bucket] = np.maximum((shares * n[:, None]).sum(0) / n.sum(), (0, 0, LEAST_WEIGHT))
            weights[bucket] /= weights[bucket].sum()
    return weights


def _scores(weights: np.ndarray, known: int, tokens: int):
    def score(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        found = []
        for row, block, ones, twos in _resolve(blocks, replies):
            one, two = ones.sum(1), twos.sum(1)
            own, context = one[block.tokens], one[block.contexts]
            weight = weights[buckets(context)]
            p = (weight[:, 0] * two[block.of_bigram] / np.maximum(context, 1) + weight[:, 1] * own / max(tokens, 1)
                 + weight[:, 2] / (known + 1)) if tokens else np.ones(len(own))
            base = np.log10((own + 1) / (tokens + known + 1))
            starts = np.r_[0, np.cumsum(block.lengths)[:-1]]
            sums = [np.add.reduceat(x, starts) for x in ((own > 0).astype(np.int64), base, np.log10(p))]
            pages = pa.ipc.read_record_batch(row["pages"], PAGE_SCHEMA)
            found.append(pa.RecordBatch.from_arrays(
                [pages["doc_id"], pages["page_idx"], pa.array(block.lengths), pa.array(sums[0]),
                 pa.array(np.full(len(starts), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                [*PAGE, "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(found, SCORE_SCHEMA)
    return score


SCORE_SCHEMA = pa.schema([*PAGE_SCHEMA, *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")),
                          ("base_score", pa.float64()), ("score", pa.float64())])
