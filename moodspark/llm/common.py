"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize

__all__ = ["materialize", "table", "free_names", "split_points", "block_of", "blocks_for", "gapless_rank", "components"]

LOWEST = -(2 ** 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of ``df`` in any case."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = "_" + name
        there.add(name.lower())
        out.append(name)
    return out


def blocks_for(spark: SparkSession, per_partition: int = 8) -> int:
    """Number of blocks: a few for each shuffle partition, so that hashing blocks to partitions stays even."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_points(df: DataFrame, col: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending values of the bigint column that cut the rows into blocks of like size.

    Every point is a value of the column, so the first row of a block is known
    without looking at the block. The list is bounded by ``n``; nulls are not
    counted.
    """
    shares = [k / n for k in range(1, n)]
    if not shares:
        return []
    points = df.agg(F.percentile_approx(col, shares, 10 * n).alias("p")).first()["p"] or []
    low = df.agg(F.min(col).alias("m")).first()["m"]
    return sorted({int(p) for p in points} - {low})


def block_of(col: Column, points: list[int]) -> Column:
    """How many of the sorted ``points`` are <= ``col``: a binary search in log2(n) steps; null counts as lowest."""
    if not points:
        return F.lit(0)
    depth = len(points).bit_length()
    padded = points + [2 ** 63 - 1] * (2 ** depth - 1 - len(points))
    arr = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")     # folded to one literal
    steps = F.array(*[F.lit(2 ** k) for k in reversed(range(depth))])
    value = F.coalesce(col.cast("bigint"), F.lit(LOWEST))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(arr, at + step) <= value, at + step)
                       .otherwise(at))


def gapless_rank(df: DataFrame, group: list[str], block: str, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's rank from 0, without gaps, within its group, in order of (block, ``order``).

    ``df`` must be a stored table (it is read twice) whose ``group`` and
    ``block`` columns hold no nulls. No group is sorted in one task: the count
    of each (group, block) is summed up over the blocks, and only a block's own
    rows are numbered together.
    """
    keys = [*group, block]
    before = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1 + F.col("_start")
    return df.join(starts, keys).withColumn(name, rank.cast("bigint")).drop("_start")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (bigint, no nulls): ``(node, root)``, root the smallest node.

    Large-star and small-star rounds: every round each node's neighbours are
    linked to the smallest of them, until each edge leads from a node to its
    root. Only minima per node are aggregated, so a hub is never gathered in
    one task; each round is written to the shared folder, which cuts the
    lineage and survives lost executors.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a <> b").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(small_least.select("a", F.col("m").alias("b"))).distinct())
        now = materialize(small, "edges")
        last, seen = seen, state(now)
        if seen == last:
            break
    return (now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
            .union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node")
            .agg(F.min("root").alias("root")))
