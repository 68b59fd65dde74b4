"""Greedy word-piece lengths of page text by an automaton that reads each byte once.

The longest-match automaton of Song et al. (Fast WordPiece Tokenization, 2021), with counts instead of
pieces: a trie of the vocabulary, and for each node the number of pieces that are certain once no edge fits
("pops"), with a link to the node of what is left. The root of pieces that start a word and the root of
those that continue one are nodes of the same trie.
"""

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.batches import texts, words

# Bounds: a vocabulary that is sent to every task, and the words whose counts a task remembers.
MOST_PIECES = 1 << 20
WORDS_REMEMBERED = 1 << 18
# What a piece that starts a word begins with in byte-pair vocabularies.
WORD_MARK = b" "

NONE = -1
FIRST, NEXT = 0, 1


def page_tokens(page_text: DataFrame, vocabulary: list[bytes], mark: bytes = WORD_MARK) -> DataFrame:
    """(doc_id, page_idx, n_words, n_tokens, n_unknown) for each row of page_text.

    Words are what white space separates. A word's pieces are found greedily, the longest first: the first
    piece of those in the vocabulary that begin with `mark`, the others of those that do not. A word that
    pieces cannot make up is one token and counted as unknown. Null and empty texts have none. Rows that
    repeat a page come back each. Other columns are ignored.
    """
    if len(vocabulary) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    shared = page_text.sparkSession.sparkContext.broadcast((list(vocabulary), mark))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = WordLengths(*shared.value)
        for batch in batches:
            rows = [lengths.of_text(t) for t in texts(batch["text"])]
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["page_idx"], *counts],
                                             ["doc_id", "page_idx", "n_words", "n_tokens", "n_unknown"])

    return page_text.select("doc_id", "page_idx", "text").mapInArrow(
        count, "doc_id long, page_idx int, n_words long, n_tokens long, n_unknown long")


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a vocabulary file with a line "base64 rank" for each."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class WordLengths(dict):
    """Pieces of each word met so far, negative for unknown words."""

    def __init__(self, vocabulary: list[bytes], mark: bytes):
        super().__init__()
        self.automaton, self.mark = Automaton(vocabulary, mark), mark

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_REMEMBERED:
            self.clear()
        length = self.automaton.length(self.mark + word)
        self[word] = length
        return length

    def of_text(self, text: bytes | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        n_words = n_tokens = unknown = 0
        for some in words(text):
            lengths = list(map(self.__getitem__, some))
            negative = lengths.count(NONE)
            n_words, n_tokens, unknown = n_words + len(some), n_tokens + sum(lengths) + 2 * negative, unknown + negative
        return n_words, n_tokens, unknown


class Automaton:
    """`edges` of each node by byte, its failure `link` (NONE if there is none), and the `pops` on the way
    there.
    """

    def __init__(self, vocabulary: Iterable[bytes], mark: bytes):
        self.edges: list[dict[int, int]] = [{}, {}]
        ends: set[int] = set()
        for piece in vocabulary:
            if not piece:
                continue
            node = FIRST if piece.startswith(mark) else NEXT
            for byte in piece:
                if byte not in self.edges[node]:
                    self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                node = self.edges[node][byte]
            ends.add(node)
        self.link = [NONE] * len(self.edges)
        self.pops = [0] * len(self.edges)
        self._link(ends)

    def _link(self, ends: set[int]) -> None:
        """From the roots down: a piece pops itself; else what its parent pops, and what more has to go
        until the byte fits.
        """
        waiting = deque([FIRST, NEXT])
        while waiting:
            parent = waiting.popleft()
            for byte, node in self.edges[parent].items():
                waiting.append(node)
                if node in ends:
                    self.link[node], self.pops[node] = NEXT, 1
                    continue
                at, popped = self.link[parent], self.pops[parent]
                while at != NONE and byte not in self.edges[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at != NONE:
                    self.link[node], self.pops[node] = self.edges[at][byte], popped

    def length(self, word: bytes) -> int:
        """Number of pieces of a word, NONE if it has none."""
        edges, link, pops = self.edges, self.link, self.pops
        node, count = FIRST, 0
        for byte in word:
            step = edges[node].get(byte)
            while step is None:
                count += pops[node]
                node = link[node]
                if node == NONE:
                    return NONE
                step = edges[node].get(byte)
            node = step
        while node != NEXT:
            count += pops[node]
            node = link[node]
            if node == NONE:
                return NONE
        return count
