"""Benchmark passages in page text: a set join on the rarest shingle of each window.

A window is 13 consecutive words of an item. It can only occur where all of its 5-word shingles do, so it is
enough to look for one of them, the necessary prefix: the one that is rarest in the pages. Each occurrence of
it gives one place where the window would start; places where it would not fit into the page are left
out, at the others the words are compared.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.stored import stored

WINDOW_WORDS = 13
SHINGLE_WORDS = 5
# Share of words inside windows from which a page is contaminated: one in twenty.
WORDS_PER_HIT = 20
# Shingle keys of 8 bytes that are sent to every task; more of them are joined by a shuffle.
BROADCAST_SHINGLES = 1 << 20

# Letters that are lower-cased, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

REACH = WINDOW_WORDS - SHINGLE_WORDS
PAGE = ["doc_id", "page_idx"]


def words(text: Column) -> Column:
    """Words of a text, none of a null one; only A-Z are lower-cased."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), SEPARATORS), "")


def contaminated_pages(page_text: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, page_idx, n_words, n_hit, n_items, item_ids, contaminated) for each row of page_text.

    `items` has item_id and text: passages that must not be trained on. A word of a page is hit if it lies
    in an occurrence of a window of an item; n_items and item_ids (sorted as strings) tell the items with
    such windows. An item of 1 to 12 words is one window, one without words has none, and rows without
    item_id are left out; rows that repeat an item add their windows to it. Pages without words are clean.
    Rows that repeat a page are judged each on its own. Other columns are ignored.
    """
    windows, of_items = _windows(items)
    windows = stored(windows)
    lengths = [r.k for r in windows.select("k").distinct().sort("k").collect()] or [SHINGLE_WORDS]
    pieces = windows.select("window", "k", "n", F.posexplode("keys").alias("offset", "key"))
    pages, found = _occurrences(page_text, pieces.select("key").distinct(), lengths)
    counts = found.groupBy("key").agg(F.count("*").alias("times"))
    rarest = (pieces.join(counts, "key").groupBy("window", "k", "n")
              .agg(F.count("*").alias("present"), F.min(F.struct("times", "key", "offset")).alias("rarest"))
              .where(F.col("present") == F.col("n") - F.col("k") + 1)
              .select("window", "k", "n", "rarest.key", "rarest.offset"))
    start = F.col("pos") - F.col("offset")
    there = F.slice("context", start - F.greatest(F.col("pos") - REACH, F.lit(0)) + 1, F.col("n"))
    hits = stored(found.join(rarest, ["k", "key"]).withColumn("start", start)
                  .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
                  .where(F.concat_ws(" ", there) == F.col("window"))
                  .select("row", "start", "n", "window"))
    of_rows = _hit_words(hits).join(_hit_items(hits, of_items), "row")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (pages.join(of_rows, "row", "left")
            .select(*PAGE, "n_words", n_hit.alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    ((n_hit > 0) & (n_hit * WORDS_PER_HIT >= F.col("n_words"))).alias("contaminated")))


def _windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each different window with its shingle keys, and (window, item_id)."""
    rows = (items.where("item_id is not null").select("item_id", words(F.col("text")).alias("words"))
            .where(F.size("words") > 0))
    n = F.least(F.size("words"), F.lit(WINDOW_WORDS))
    rows = (rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - n)))
            .select("item_id", F.slice("words", F.col("at") + 1, n).alias("words")))
    text = F.concat_ws(" ", "words").alias("window")
    n = F.size("words")
    k = F.least(n, F.lit(SHINGLE_WORDS))
    keys = F.transform(F.sequence(F.lit(0), n - k), lambda at: _key(F.col("words"), at, k))
    windows = (rows.select(text, "words").dropDuplicates(["window"])
               .select("window", n.alias("n"), k.alias("k"), keys.alias("keys")))
    return windows, rows.select(text, F.col("item_id").cast("string").alias("item_id")).distinct()


def _key(array: Column, at: Column, k: Column) -> Column:
    """Hash of the k words from `at` on; words past the end or beyond k count as missing."""
    return F.xxhash64(*(F.when(k > i, F.get(array, at + i)) for i in range(SHINGLE_WORDS)))


def _occurrences(page_text: DataFrame, index: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """(row, page, n_words), and (row, n_words, pos, k, key, context) of shingles that occur in windows.

    The context has the words around, as far as a window with this shingle can reach.
    """
    rows = (page_text.select(*PAGE, words(F.col("text")).alias("words"))
            .withColumn("row", F.monotonically_increasing_id())
            .withColumn("n_words", F.size("words").cast("long")))
    index = index.withColumn("known", F.lit(True))
    context = F.slice("words", F.greatest(F.col("pos") - REACH, F.lit(0)) + 1, REACH + WINDOW_WORDS)
    columns = ["row", *PAGE, "n_words", "pos", "k", "key", "known"]
    head = F.coalesce("pos", F.lit(0)) == 0
    if index.count() <= BROADCAST_SHINGLES:
        found = stored(_shingles(rows, lengths).join(F.broadcast(index), "key", "left")
                       .where(F.col("known") | head)
                       .select(*columns, F.when(F.col("known"), context).alias("context")))
        return _heads(found, head, lengths), found.where("known")
    rows = stored(rows)
    found = stored(_shingles(rows, lengths).drop("words").join(index, "key")
                   .join(rows.select("row", "words"), "row").select(*columns, context.alias("context")))
    return rows.drop("words"), found


def _heads(found: DataFrame, head: Column, lengths: list[int]) -> DataFrame:
    return found.where(head & (F.col("k") == lengths[0])).select("row", *PAGE, "n_words")


def _shingles(rows: DataFrame, lengths: list[int]) -> DataFrame:
    places = rows.select("*", F.posexplode_outer("words").alias("pos", "word")).drop("word")
    keys = [F.struct(F.lit(k).alias("k"), _key(F.col("words"), F.col("pos"), F.lit(k)).alias("key")) for k in lengths]
    one = keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    return places.select("*", one.alias("_s")).select("*", "_s.k", "_s.key").drop("_s")


def _hit_words(hits: DataFrame) -> DataFrame:
    """Words of a row inside windows, counted once however many windows overlap there."""
    spans = F.array_sort(F.collect_set(F.struct("start", F.col("n").alias("n"))))
    end = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", end, lambda so_far, span: F.struct(
            (so_far["total"] + F.greatest(
                F.lit(0), span["start"] + span["n"] - F.greatest(span["start"], so_far["end"]))).alias("total"),
            F.greatest(so_far["end"], span["start"] + span["n"]).alias("end")))
    return hits.groupBy("row").agg(spans.alias("spans")).select("row", covered["total"].alias("n_hit"))


def _hit_items(hits: DataFrame, of_items: DataFrame) -> DataFrame:
    return (hits.select("row", "window").distinct().join(of_items, "window")
            .groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
            .withColumn("n_items", F.size("item_ids").cast("long")))
