"""Arrow batches in tasks: words of a text, and runs of equal keys across batches."""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

# A text is cut into words in stretches of about so many bytes.
STRETCH = 1 << 20


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    return column.cast(pa.large_binary()).to_pylist()


def lower_words(text: bytes | None) -> Iterator[list[bytes]]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, in stretches that end between words."""
    return (stretch.lower().split() for stretch in stretches(text))


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The same words as they are."""
    return (stretch.split() for stretch in stretches(text))


def stretches(text: bytes | None) -> Iterator[bytes]:
    start, size = 0, len(text or b"")
    while start < size:
        end = min(start + STRETCH, size)
        while end < size and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[start:end]
        start = end


def whole_runs(batches: Iterable[pa.RecordBatch], key: str, rows: int,
               run: Callable[[np.ndarray], np.ndarray] = lambda keys: keys) -> Iterator[pa.Table]:
    """Batches put together to at least `rows` rows, cut only where run(key) changes.

    The rows of a task come sorted by key; a run longer than `rows` comes whole.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        runs = run(np.asarray(table[key]))
        end = int(np.searchsorted(runs, runs[-1], side="left"))
        if end:
            yield table.slice(0, end)
        held, count = table.slice(end).to_batches(), table.num_rows - end
    if count:
        yield pa.Table.from_batches(held)
