"""Numbering and joining when one group may hold a large share of all rows.

A group is cut into blocks along its order, so no task sorts or receives a group whole.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_idx"]
ANNOTATION = [*PAGE, "annot_idx"]
ROWS_PER_BLOCK = 65536
PAGES_PER_BLOCK = 1024


def block_of(position: Column, size: int | None = None) -> Column:
    size = size or ROWS_PER_BLOCK
    return F.call_function("div", position, F.lit(size))


def annot_block() -> Column:
    return block_of(F.col("annot_idx"))


def page_block() -> Column:
    return block_of(F.col("page_idx"), PAGES_PER_BLOCK)


def number_rows(df: DataFrame, group: list[str], levels: list[list[str]], order: list[str],
                name: str) -> DataFrame:
    """Add the 1-based position of each row in its group as `name`.

    `levels` and then `order` sort the group; each level cuts the one before into blocks. Rows
    are sorted only within the innermost blocks. Where a block starts comes from the sizes of
    the blocks before it, which are counted before the shuffle and added up level by level.
    """
    keys = [*group, *(c for level in levels for c in level)]
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    starts = _block_starts(df.groupBy(*keys).agg(F.count("*").alias("_n")), group, levels)
    return (df.withColumn("_pos", local).join(starts, keys)
            .withColumn(name, F.col("_pos") + F.col("_start")).drop("_pos", "_start"))


def running_total(df: DataFrame, group: list[str], levels: list[list[str]], order: list[str],
                  value: str, name: str) -> DataFrame:
    """Add the sum of `value` over the rows before each in its group as `name`; levels and order as in
    `number_rows`."""
    keys = [*group, *(c for level in levels for c in level)]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = _block_starts(df.groupBy(*keys).agg(F.sum(value).alias("_n")), group, levels)
    return (df.withColumn("_before", F.coalesce(F.sum(value).over(before), F.lit(0))).join(starts, keys)
            .withColumn(name, F.col("_before") + F.col("_start")).drop("_before", "_start"))


def _block_starts(sizes: DataFrame, group: list[str], levels: list[list[str]]) -> DataFrame:
    outer = [*group, *(c for level in levels[:-1] for c in level)]
    before = (Window.partitionBy(*outer).orderBy(*levels[-1])
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if len(levels) == 1:
        return starts
    totals = sizes.groupBy(*outer).agg(F.sum("_n").alias("_n"))
    outer_starts = _block_starts(totals, group, levels[:-1]).withColumnRenamed("_start", "_outer")
    return (starts.join(outer_starts, outer)
            .withColumn("_start", F.col("_start") + F.col("_outer")).drop("_outer"))


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], position: str,
                how: str = "left") -> DataFrame:
    """Join rows to the one lookup row of their key, with hot keys split over tasks.

    A key's rows are spread by blocks of their position, which is not negative; lookup rows are
    copied to each further block that occurs. Positions beyond the first block are looked for
    with a plain comparison, so where a table has none the scan skips all of it. Keys with such positions
    are few, a list of ROWS_PER_BLOCK rows has none, so they are sent to all and the lookup is shuffled once.
    """
    further = (rows.where(F.col(position) >= ROWS_PER_BLOCK)
               .groupBy(*keys).agg(F.collect_set(block_of(F.col(position))).alias("_further")))
    first = F.array(F.lit(0).cast("bigint"))
    copies = (lookup.join(F.broadcast(further), keys, "left")
              .withColumn("_block", F.explode(F.concat(first, F.coalesce("_further", F.array()))))
              .drop("_further"))
    return (rows.withColumn("_block", block_of(F.col(position)))
            .join(copies, [*keys, "_block"], how).drop("_block"))
