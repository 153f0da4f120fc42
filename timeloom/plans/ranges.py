"""Keys of any size over many tasks: rows dealt out by ranges of key and order, numbered, and cut into blocks with their neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.plans.scratch import cut


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right where all names agree, null meeting null; right may come from left."""
    own = right.select(*[F.col(f"`{n}`").alias(f"__same {n}") for n in names], *[F.col(f"`{c}`") for c in right.columns if c not in names])
    equal = reduce(lambda a, b: a & b, [F.col(f"`{n}`").eqNullSafe(F.col(f"`__same {n}`")) for n in names])
    return left.join(own, equal, how).drop(*[f"__same {n}" for n in names])


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A written table of df, sorted, with __part (its range, ascending) and __at (ascending over all rows). A number of its own for each row is the last column of the sort,
    so neither a large key nor many equal rows stay in one range."""
    own = df.withColumn("__tie_number", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
    placed = own.repartitionByRange(*keys, *order, "__tie_number").sortWithinPartitions(*keys, *order, "__tie_number").drop("__tie_number")
    return cut(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))


def numbered(df: DataFrame, keys: list[str], order: list[str], index: str = "index", n: str = "n") -> DataFrame:
    """df with index, the number from 0 of each row within its keys by `order`, and n, how many rows its keys have. Each range goes on from where those before it end."""
    placed = in_ranges(df, keys, order)
    sizes = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__num_n"), F.min("__at").alias("__num_first"))
    w = Window.partitionBy(*keys).orderBy("__part")
    before = F.coalesce(F.sum("__num_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "__part", (before - F.col("__num_first")).alias("__num_shift"), F.sum("__num_n").over(Window.partitionBy(*keys)).alias("__num_rows"))
    both = join_same(placed, starts, [*keys, "__part"])
    return both.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") + F.col("__num_shift")).alias(index), F.col("__num_rows").alias(n))


def with_halo(df: DataFrame, index: str, before: int, after: int, block: int) -> DataFrame:
    """df with __block and __own: a row is in its own block of `block` numbers, and once more, not its own, in each neighbour that has it among the `before` rows ahead of
    its first or the `after` rows behind its last."""
    own = F.floor(F.col(index) / block).cast("long")
    first, last = F.floor((F.col(index) - after) / block).cast("long"), F.floor((F.col(index) + before) / block).cast("long")
    return df.withColumn("__block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("__own", F.col("__block") == own)
