"""Language of page text by compression with a raw-content dictionary for each language."""

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import texts

# A dictionary is made from so many labelled pages of a language at most, cut to so many characters each: the
# bound on what is fitted. Everything else works on whole texts.
PAGES_PER_LANGUAGE = 256
CHARS_PER_PAGE = 4000
# Words of fewer of these pages stay out of the dictionary, as do names and passages of one page.
PAGES_PER_WORD = 2
# A text is compressed in pieces of so many bytes, so that the end of a long text counts like its start, and not
# what it repeats of itself.
PIECE = 256
# zstandard levels: the second judges again where the first gives a score below SURE. It compresses each piece
# behind a primer, text of the language, since what is short may not compress at all on its own.
QUICK, STRONG, SURE = 6, 12, 0.03
PRIMER_PAGES, PRIMER_CHARS = 4, 600
# A prediction that saves less than this share of the runner-up's bytes is rejected.
MIN_MARGIN = 0.005
UNDECIDED = "und"

PAGE = ["doc_id", "page_idx"]
NO_LETTERS = regex.compile(r"\P{L}+")


class Dictionary(NamedTuple):
    """Raw content for zstandard, and the primer."""
    words: bytes
    primer: bytes


def fit_dictionaries(labelled: DataFrame) -> dict[str, Dictionary]:
    """A zstandard raw-content dictionary and a primer for each language of rows (doc_id, page_idx, text, lang).

    The pages are those with the lowest hashes of their key, one for each of PAGES_PER_LANGUAGE parts of the
    hash range. A dictionary has their words, the most widespread last, where references to it are shortest.
    Rows without text or lang are left out; without any row there are no languages. There must be few enough
    languages for the driver to hold this many pages of each, as for any classifier.
    """
    rows = labelled.where("text is not null and lang is not null").select(
        "lang", "text", F.xxhash64(*PAGE).alias("draw"))
    part = F.pmod(F.col("draw"), F.lit(PAGES_PER_LANGUAGE)).alias("part")
    drawn = rows.groupBy("lang", part).agg(F.min("draw").alias("draw")).select("lang", "draw")
    sample = (rows.join(F.broadcast(drawn), ["lang", "draw"])
              .select("lang", "draw", F.substring("text", 1, CHARS_PER_PAGE).alias("text"))
              .groupBy("lang", "draw").agg(F.min("text").alias("text")))
    pages: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r.lang, r.draw)):
        pages.setdefault(row.lang, []).append(letters(row.text).strip())
    return {lang: Dictionary(_by_spread(own), _primer(own)) for lang, own in pages.items()}


def _by_spread(pages: list[str]) -> bytes:
    counts = Counter(word for page in pages for word in set(page.split()))
    least = PAGES_PER_WORD if max(counts.values(), default=0) >= PAGES_PER_WORD else 1
    words = sorted((n, word) for word, n in counts.items() if n >= least)
    return " ".join(word for _, word in words).encode()


def _primer(pages: list[str]) -> bytes:
    """Starts of pages that do not repeat themselves, as far as there are some."""
    varied = sorted(pages, key=lambda page: -len(set(page[:PRIMER_CHARS].split())))
    return " ".join([*(page[:PRIMER_CHARS] for page in varied[:PRIMER_PAGES]), ""]).encode()


def page_languages(page_text: DataFrame, dictionaries: dict[str, Dictionary],
                   min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, page_idx, lang_pred, score, rejected) for each row of page_text.

    lang_pred is the language whose dictionary gives the fewest bytes over all pieces of the text, its
    letters in lower case; ties go to the first in the alphabet. It is `und`, score 0, for null texts, texts
    without letters, and without dictionaries. The score is the share of the runner-up's bytes that the best
    saves (1 with one language); `und` and scores below min_margin are rejected. Rows that repeat a page
    come back each. Other columns are ignored.
    """
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        for batch in batches:
            found = [judge(t) for t in texts(batch["text"])]
            rejected = [not _told(lang, score, min_margin) for lang, score in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["page_idx"], pa.array([lang for lang, _ in found], pa.string()),
                 pa.array([score for _, score in found], pa.float64()), pa.array(rejected, pa.bool_())],
                [*PAGE, "lang_pred", "score", "rejected"])

    return page_text.select(*PAGE, "text").mapInArrow(
        predict, "doc_id long, page_idx int, lang_pred string, score double, rejected boolean")


def told_rows(rows: DataFrame, dictionaries: dict[str, Dictionary], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows, with all their columns, whose text page_languages does not reject."""
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        for batch in batches:
            found = map(judge, texts(batch["text"]))
            yield batch.filter(pa.array([_told(lang, score, min_margin) for lang, score in found], pa.bool_()))

    return rows.mapInArrow(keep, rows.schema)


def _told(lang: str, score: float, min_margin: float) -> bool:
    return lang != UNDECIDED and score >= min_margin


def letters(text: str) -> str:
    """The text's letters in lower case, with one space for whatever is between them."""
    return NO_LETTERS.sub(" ", text.lower())


class Judge:
    """Compressors of all languages; made once in each task."""

    def __init__(self, dictionaries: dict[str, Dictionary]):
        self.quick, self.strong = [], []
        for lang, own in sorted(dictionaries.items()):
            self.quick.append((lang, b"", 0, _compressor(own.words, QUICK)))
            strong = _compressor(own.words, STRONG)
            self.strong.append((lang, own.primer, len(strong.compress(own.primer)) - 1, strong))

    def __call__(self, text: bytes | None) -> tuple[str, float]:
        words = letters((text or b"").decode()).strip()
        if not words or not self.quick:
            return UNDECIDED, 0.0
        own = words.encode()
        pieces = [own[i:i + PIECE] for i in range(0, len(own), PIECE)]
        lang, score = _smallest(self.quick, pieces)
        return (lang, score) if score >= SURE else _smallest(self.strong, pieces)


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        level, dict_size=len(dictionary), source_size=PIECE,
        write_checksum=False, write_content_size=False, write_dict_id=False)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=parameters)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)


def _smallest(compressors: list[tuple[str, bytes, int, zstandard.ZstdCompressor]], pieces: list[bytes]) -> tuple[str, float]:
    """The language with the fewest bytes, the primer's not counted, and what it saves of the second."""
    sizes = sorted((sum(max(1, len(c.compress(primer + p)) - before) for p in pieces), lang)
                   for lang, primer, before, c in compressors)
    (best, lang), second = sizes[0], sizes[1:2]
    return lang, 1 - best / second[0][0] if second else 1.0
