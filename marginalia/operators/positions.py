"""Cleaned page text and where its characters stand in the page, and the first places of many passages.

The map of a page is a list of runs: from a place in the cleaned text on, characters stand a fixed number of
places further back in the page. Text without anything to clean is one run, so a page needs a number for
each irregular gap and not for each character.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.functions.text import STRIP, WHITESPACE
from marginalia.operators.blocks import PAGE

# Passages longer than this, and less than so many, are looked for one by one.
LONG_PASSAGE, FEW_PASSAGES = 256, 8


def _class(*parts: str) -> str:
    return "[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda code: f"\\u{int(code[1], 16):04x}", "".join(parts)) + "]"


STRIPPED, SPACES = re.compile(_class(STRIP)), re.compile(_class(WHITESPACE) + "+")
GAP = re.compile(_class(STRIP, WHITESPACE) + "*")
# All gaps but single spaces, which become one space where they stand.
IRREGULAR = re.compile(f"{_class(STRIP, WHITESPACE)}{{2,}}|{_class(STRIP)}")


class PositionMap:
    """Cleaned text with `starts` and `shifts` of its runs, and the size of the text it was made from."""

    def __init__(self, text: str):
        self.size = len(text)
        self.cleaned = SPACES.sub(" ", STRIPPED.sub("", text)).strip(" ")
        self.starts: list[int] = []
        self.shifts: list[int] = []
        if not self.cleaned:
            return
        self._add(0, GAP.match(text).end())
        for gap in IRREGULAR.finditer(text, self.shifts[0]):
            if gap.end() == self.size:
                break
            at = gap.start() - self.shifts[-1]
            space = SPACES.search(text, gap.start(), gap.end())
            if space:
                self._add(at, space.start() - at)
                at += 1
            self._add(at, gap.end() - at)

    def _add(self, start: int, shift: int) -> None:
        if not self.shifts or shift != self.shifts[-1]:
            self.starts.append(start)
            self.shifts.append(shift)

    def source(self, place: int) -> int:
        """Where the character at a place of the cleaned text stands; the end stands at the end."""
        if place >= len(self.cleaned):
            return self.size
        return place + self.shifts[bisect_right(self.starts, place) - 1]

    def rank(self, source: int) -> int:
        """The first place of the cleaned text that stands at this source or behind it."""
        run = bisect_left(self.starts, source, key=lambda start: self.source(start)) - 1
        if run < 0:
            return 0
        end = self.starts[run + 1] if run + 1 < len(self.starts) else len(self.cleaned)
        return min(source - self.shifts[run], end)


def position_maps(page_text: DataFrame) -> DataFrame:
    """(doc_id, page_idx, cleaned, size, runs) of each page: its cleaned text, the number of its characters, and
    the runs (start, shift) of the map from the one to the other, places counted from 0. Null text has no
    runs and no size.
    """
    return page_text.select(*PAGE, "text").mapInArrow(
        _maps, "doc_id long, page_idx int, cleaned string, size int, runs array<struct<start int, shift int>>")


def _maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = pa.list_(pa.struct([("start", pa.int32()), ("shift", pa.int32())]))
    for batch in batches:
        found = [None if t is None else PositionMap(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["page_idx"], pa.array([m and m.cleaned for m in found], pa.string()),
             pa.array([m and m.size for m in found], pa.int32()),
             pa.array([[{"start": a, "shift": b} for a, b in zip(m.starts, m.shifts, strict=True)] if m else [] for m in found], runs)],
            [*PAGE, "cleaned", "size", "runs"])


def place_passages(text: str, passages: set[str]) -> dict[str, tuple[int, int]]:
    """Start and size in `text` of each cleaned passage that is there: as it is, or else as if the text were cleaned.

    Places count from 0. Both texts are read once, however many passages there are.
    """
    found = {p: (at, len(p)) for p, at in first_places(text, passages).items()}
    rest = passages - found.keys()
    if rest:
        positions = PositionMap(text)
        for passage, at in first_places(positions.cleaned, rest).items():
            start = positions.source(at)
            found[passage] = start, positions.source(at + len(passage)) - start
    return found


def first_places(text: str, passages: set[str]) -> dict[str, int]:
    short = {p for p in passages if len(p) <= LONG_PASSAGE}
    if len(short) < FEW_PASSAGES:
        short = set()
    found = {p: at for p in passages - short if (at := text.find(p)) >= 0}
    return found | _automaton(short).first_places(text) if short else found


class Automaton:
    """Trie of passages with failure links: a node's link leads to the longest suffix of it that is a node."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.passage: list[str | None] = [None]
        self.link, self.ends = [0], [0]  # ends: the nearest node up the links that ends a passage, 0 for none

    def add(self, passage: str) -> None:
        node = 0
        for letter in passage:
            node = self.next[node].get(letter) or self._grow(node, letter)
        self.passage[node] = passage

    def _grow(self, node: int, letter: str) -> int:
        own = self.next[node][letter] = len(self.next)
        self.next.append({})
        self.passage.append(None)
        return own

    def linked(self) -> "Automaton":
        self.link, self.ends = [0] * len(self.next), [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            below = []
            for node in level:
                self.ends[node] = node if self.passage[node] is not None else self.ends[self.link[node]]
                for letter, child in self.next[node].items():
                    self.link[child] = self._step(self.link[node], letter)
                    below.append(child)
            level = below
        return self

    def _step(self, node: int, letter: str) -> int:
        while node and letter not in self.next[node]:
            node = self.link[node]
        return self.next[node].get(letter, 0)

    def first_places(self, text: str) -> dict[str, int]:
        """A passage seen before ends the walk up the links, as those behind it were seen then too."""
        found: dict[str, int] = {}
        node = 0
        for at, letter in enumerate(text, 1):
            node = self._step(node, letter)
            end = self.ends[node]
            while end:
                passage = self.passage[end]
                if passage in found:
                    break
                found[passage] = at - len(passage)
                end = self.ends[self.link[end]]
        return found


def _automaton(passages: Iterable[str]) -> Automaton:
    automaton = Automaton()
    for passage in passages:
        automaton.add(passage)
    return automaton.linked()
