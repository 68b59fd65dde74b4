"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.stored import stored

# Rounds between two looks at whether they were enough; most components need no more.
ROUNDS_PER_LOOK = 2
# The edges of one node are dealt over so many tasks.
PARTS = 16


def connected_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component) of every node on an edge (keys, a, b); a and b differ. Store costly edges.

    Each round hangs nodes below smaller neighbours, until every component is a star. The
    number of rounds grows with the logarithm of the size, not with the length of chains.
    """
    edges = edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while not _is_star_forest(edges, keys):
        for _ in range(ROUNDS_PER_LOOK):
            edges = _round(edges, keys)
        edges = stored(edges)
    ends = _both(edges, keys, ("a", "b"), ("b", "b"))
    return ends.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).distinct()


def _round(edges: DataFrame, keys: list[str]) -> DataFrame:
    large = (_with_lowest(_both(edges, keys, ("a", "b"), ("b", "a")), keys).where("b > a")
             .select(*keys, F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct())
    small = _with_lowest(large, keys)
    return _both(small, keys, ("a", "low"), ("b", "low")).where("a <> b").distinct()


def _with_lowest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the lowest b of their a as `low`; the edges of a hub come in PARTS tasks."""
    part = F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")
    lows = (edges.groupBy(*keys, "a").agg(F.min("b").alias("low"))
            .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))))
    return edges.withColumn("_part", part).join(lows, [*keys, "a", "_part"]).drop("_part")


def _both(edges: DataFrame, keys: list[str], *ends: tuple[str, str]) -> DataFrame:
    """Two edges (a, b) for each given one."""
    def pair(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = F.explode(F.array(*(pair(*end) for end in ends)))
    return edges.select(*keys, pairs.alias("_e")).select(*keys, "_e.*")


def _is_star_forest(edges: DataFrame, keys: list[str]) -> bool:
    """Whether each node hangs below one node, which hangs below none."""
    roles = edges.select(*keys, F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("below")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("below")))).alias("_r"))
    seen = roles.groupBy(*keys, "_r.node").agg(F.sum("_r.below").alias("below"),
                                               F.max(1 - F.col("_r.below")).alias("above"))
    return seen.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()
