"""Global order within groups, without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.session import cut, small


def rank_in_groups(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row within its group, in ascending ``order``.

    ``order`` should identify a row within its group; rows equal in ``order`` get an arbitrary but distinct position.
    Nulls sort first; a null group value is a group of its own. The rows are range partitioned and sorted on (groups,
    order), so a group with a third of all rows spreads over a third of the partitions and the rows are shuffled once;
    each is numbered where it stands, and a group's numbers are shifted by its row counts in earlier partitions (one row
    per group and partition, sent to all tasks only while they are few).
    """
    sorted_ = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    rows = cut(sorted_.withColumn("__rank_at", F.monotonically_increasing_id()).withColumn("__rank_piece", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("__rank_piece").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*groups, "__rank_piece").agg(F.count(F.lit(1)).alias("__rank_n"), F.min("__rank_at").alias("__rank_first"))
    shift = F.coalesce(F.sum("__rank_n").over(before), F.lit(0)) - F.col("__rank_first")
    pieces = small(counted.select(*[F.col(g).alias(f"__rank_g{i}") for i, g in enumerate(groups)], F.col("__rank_piece").alias("__rank_p"), shift.alias("__rank_shift")))
    same = F.col("__rank_piece") == F.col("__rank_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__rank_g{i}"))
    placed = rows.join(pieces, same).withColumn(name, F.col("__rank_at") + F.col("__rank_shift"))
    return placed.drop("__rank_at", "__rank_piece", "__rank_p", "__rank_shift", *[f"__rank_g{i}" for i in range(len(groups))])


def with_halo(df: DataFrame, rank: str, block: int, halo: int, alone: Column | None = None) -> DataFrame:
    """Cut ranked rows into blocks of ``block`` rows; copy ``halo`` rows over each border.

    Adds ``_block`` and ``_own`` (false for copies). A window partitioned by (group, _block) and ordered by rank then
    sees up to ``halo`` neighbours of every own row, and holds at most block + 2 * halo rows. Rows without a rank are
    left out, or with ``alone`` (a block number, below zero) stand in that block.
    """
    at = F.col(rank)
    low, high = F.floor((at - halo) / block).cast("long"), F.floor((at + halo) / block).cast("long")
    spots = F.when(at.isNotNull(), F.sequence(F.greatest(low, F.lit(0)), high))
    own = F.floor(at / block).cast("long")
    if alone is not None:
        spots, own = F.coalesce(spots, F.array(alone)), F.coalesce(own, alone)
    return df.withColumn("_block", F.explode(spots)).withColumn("_own", F.col("_block") == own)
