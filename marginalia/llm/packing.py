"""Pages packed to training batches in length buckets that waste the least padding."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.blocks import block_of, number_rows
from marginalia.operators.stored import stored

# Longest sequence; a longer page is cut into pieces. Also the bound of the histogram the driver receives.
MAX_TOKENS = 2048
BUCKETS = 16
# Tokens of a batch, padding included.
BATCH_TOKENS = 65536
# Rows numbered together, and groups of them whose sizes are added up together.
ROWS_PER_SHARD, SHARDS_PER_GROUP = 1024, 4096

PAGE = ["doc_id", "page_idx"]
PIECE = [*PAGE, "piece_no"]


def pack_pages(page_lengths: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS,
               batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(doc_id, page_idx, piece_no, n_tokens, bucket_tokens, batch_no, batch_row) for each piece of a page.

    `page_lengths` has doc_id, page_idx and n_tokens. A page of more than max_tokens becomes pieces of that
    length and one of the rest. Bucket bounds are those, at most `buckets` of them, that need the least
    padding over all pieces. A bucket's batches take batch_tokens // bucket_tokens rows each, in the order
    of a hash, so that a batch mixes documents; the last may be short. (bucket_tokens, batch_no, batch_row)
    tells pieces apart. A page without tokens (null, zero, negative) comes back once with n_tokens 0 and
    nulls for bucket and batch. Rows that repeat a page are packed each. Other columns are ignored.
    """
    if not 1 <= max_tokens <= batch_tokens or buckets < 1:
        raise ValueError("a batch holds at least one sequence, in at least one bucket")
    pieces = stored(_pieces(page_lengths, max_tokens))
    sizes = {r.n_tokens: r.n for r in pieces.where("n_tokens > 0").groupBy("n_tokens")
             .agg(F.count("*").alias("n")).collect()}
    bounds = best_bounds(sizes, buckets)
    bucket = F.lit(None).cast("int")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    shards = max(1, -(-sum(sizes.values()) // ROWS_PER_SHARD))
    draw = F.xxhash64(*PIECE)
    full = (pieces.where("n_tokens > 0").withColumn("bucket_tokens", bucket).withColumn("draw", draw)
            .withColumn("shard", F.pmod("draw", F.lit(shards))))
    full = full.withColumn("shards", block_of(F.col("shard"), SHARDS_PER_GROUP))
    numbered = number_rows(full, ["bucket_tokens"], [["shards"], ["shard"]], ["draw", *PIECE], "place")
    rows = F.call_function("div", F.lit(batch_tokens), F.col("bucket_tokens"))
    place = F.col("place") - 1
    packed = numbered.select(*PIECE, "n_tokens", "bucket_tokens",
                             F.call_function("div", place, rows).alias("batch_no"), (place % rows).alias("batch_row"))
    none = [F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in packed.columns[4:]]
    return packed.unionByName(pieces.where("n_tokens = 0").select(*PIECE, "n_tokens", *none))


def _pieces(page_lengths: DataFrame, max_tokens: int) -> DataFrame:
    total = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.call_function("div", F.col("total") - 1, F.lit(max_tokens)), F.lit(0))
    return (page_lengths.select(*PAGE, total.alias("total"))
            .select(*PAGE, "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
            .select(*PIECE, F.least(F.col("total") - F.col("piece_no") * max_tokens, F.lit(max_tokens)).cast("int")
                    .alias("n_tokens")))


def best_bounds(sizes: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of the buckets that need the least padding, for a histogram length -> rows.

    Dynamic programming over the lengths that occur: the best k buckets up to a length are the best k - 1 up to
    a shorter one, and one bucket for what is between. Fewer buckets are taken where more gain nothing.
    """
    lengths = np.array(sorted(sizes), np.int64)
    rows = np.array([sizes[n] for n in lengths.tolist()], np.int64)
    before = np.r_[0, np.cumsum(rows)]
    # Padded size of one bucket over lengths[i:j] is lengths[j - 1] * (before[j] - before[i]).
    best = np.r_[np.int64(0), lengths * before[1:]]
    cuts = [np.zeros(len(best), np.int64)]
    for _ in range(min(buckets, len(lengths)) - 1):
        longer, cut = best.copy(), np.arange(len(best))
        for j in range(1, len(best)):
            padded = best[:j] + lengths[j - 1] * (before[j] - before[:j])
            cut[j] = int(padded.argmin())
            longer[j] = padded[cut[j]]
        best = longer
        cuts.append(cut)
    bounds, end = [], len(lengths)
    for cut in reversed(cuts):
        if end:
            bounds.append(int(lengths[end - 1]))
            end = int(cut[end])
    return bounds[::-1]


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, none of a null one."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), ""))
