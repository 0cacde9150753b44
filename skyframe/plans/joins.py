"""Joins of the query language: by link table, by key, by position, and in-query lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators.slabs import neighbours


def q(name: str) -> Column:
    """Column by its exact name."""
    return F.col(f"`{name}`")


def link_cuts(links: DataFrame, rank: str | None, dist: str | None, nmax: int | None, dmax: float) -> DataFrame:
    """The links with rank below ``nmax`` and distance (degrees) below ``dmax`` arc seconds; None and 0 mean no cut."""
    if nmax is not None and rank:
        links = links.where(q(rank) < nmax)
    if dmax and dist:
        links = links.where(q(dist) < dmax / 3600.0)
    return links


def link_join(left: DataFrame, left_key: str, links: DataFrame, m1: str, m2: str, right: DataFrame, right_key: str, outer: bool = False, rank: str | None = None, dist: str | None = None, prefix: str = "", place=None) -> DataFrame:
    """left.key = m1 AND m2 = right.key, with <prefix>_ISNULL, <prefix>_NR and <prefix>_DIST.

    Outer: a left row without a link gives one row without a right side; a link that leads nowhere gives one of its own,
    also beside others that resolve (two left joins in a chain, not a left join of an inner one). Null keys match nothing.
    Only the link columns that are needed are joined. ``place``: key → (_CELL, _T) of the right row with that key, for a right
    side with <prefix>_CELL and <prefix>_T: the join then runs on these too, so its partitions are pruned by the links.
    """
    how = "left" if outer else "inner"
    cols = [q(m1).alias("__m1"), q(m2).alias("__m2"), (q(rank) if rank else F.lit(0)).alias("__nr"), (q(dist) if dist else F.lit(0.0)).alias("__dist")]
    joined = left.join(links.select(*cols), q(left_key) == F.col("__m1"), how)
    there = right.withColumn("__there", F.lit(True))
    joined = joined.join(there, (F.col("__m2") == q(right_key)) & _same_cell(F.col("__m2"), prefix, place), how)
    gone = F.col("__there").isNull()
    return joined.select(
        *[q(c) for c in left.columns], *[q(c) for c in right.columns], gone.alias(f"{prefix}_ISNULL"),
        F.when(gone, F.lit(0)).otherwise(F.coalesce(F.col("__nr"), F.lit(0))).cast("long").alias(f"{prefix}_NR"),
        F.when(gone, F.lit(0.0)).otherwise(F.coalesce(F.col("__dist"), F.lit(0.0))).cast("double").alias(f"{prefix}_DIST"),
    )


def _same_cell(key: Column, prefix: str, place) -> Column:
    if place is None:
        return F.lit(True)
    cell, slice_ = place(key)
    return (q(f"{prefix}_CELL") == cell) & (q(f"{prefix}_T") == slice_)


def key_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, outer: bool = False, prefix: str = "", place=None) -> DataFrame:
    """left.key = right.key with the same pseudo-columns (rank and distance 0). ``place``: as for link_join."""
    there = right.withColumn("__there", F.lit(True))
    joined = left.join(there, (q(left_key) == q(right_key)) & _same_cell(q(left_key), prefix, place), "left" if outer else "inner")
    return joined.select(*[q(c) for c in left.columns], *[q(c) for c in right.columns], F.col("__there").isNull().alias(f"{prefix}_ISNULL"), F.lit(0).cast("long").alias(f"{prefix}_NR"), F.lit(0.0).alias(f"{prefix}_DIST"))


def side_by_side(one: tuple[DataFrame, str, str], two: tuple[DataFrame, str, str]) -> DataFrame:
    """m1, m2 of two tables (frame, key, column) whose k-th rows, in order of their keys, belong together."""
    from skyframe.operators.rows import numbered

    sides = []
    for (df, key, column), name in zip((one, two), ("m1", "m2")):
        sides.append(numbered(df.select(q(key).alias("_key"), q(column).alias(name)), ["_key"], "_row").drop("_key"))
    return sides[0].join(sides[1], "_row").drop("_row")


def nearest(left: DataFrame, left_id: str, left_pos: tuple[str, str], right: DataFrame, right_id: str, right_pos: tuple[str, str], nmax: int | None = 1, radius: float = 1 / 3600) -> DataFrame:
    """The ``nmax`` nearest right rows within ``radius`` degrees (None: all): a, b, dist, nr (0-based; ties by right id)."""
    pairs = neighbours(left, left_id, *left_pos, right, right_id, *right_pos, radius)
    rank = F.row_number().over(Window.partitionBy("a").orderBy("dist", "b")) - 1
    ranked = pairs.withColumn("nr", rank.cast("long"))
    return ranked if nmax is None else ranked.where(F.col("nr") < nmax)


def crossmatch(left: DataFrame, left_id: str, left_pos: tuple[str, str], right: DataFrame, right_id: str, right_pos: tuple[str, str], nmax: int | None = 1, dmax: float = 1.0, outer: bool = False, prefix: str = "", place=None) -> DataFrame:
    """Positional join: each left row with its ``nmax`` nearest right rows closer than ``dmax`` arc seconds.

    Exact over the whole sky, whatever the pixels. Outer keeps left rows without a neighbour. Rows without usable position
    have no neighbours.
    """
    links = nearest(left, left_id, left_pos, right, right_id, right_pos, nmax, dmax / 3600.0)
    links = links.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("dist").alias("__d"), F.col("nr").alias("__n"))
    return link_join(left, left_id, links, "__a", "__b", right, right_id, outer, "__n", "__d", prefix, place)


def lookup(df: DataFrame, key: Column, table: DataFrame, key_name: str, values: list[str], missing=None, prefix: str = "lookup") -> DataFrame:
    """Add <prefix>.<value> for each value of the row of ``table`` whose key equals ``key``.

    A key that is not there, and a null one, give ``missing`` (zero of the type if None). Of several rows with one key the
    smallest by (value, ...) counts, so the rows of ``df`` never multiply. The table's size decides how it is joined.
    """
    from skyframe.types import zero

    kinds = {f.name: f.dataType for f in table.schema.fields}
    one = table.where(q(key_name).isNotNull()).groupBy(q(key_name).alias("__k")).agg(F.min(F.struct(*[q(v) for v in values])).alias("__v"))
    joined = df.join(one, key == F.col("__k"), "left")
    fill = [F.lit(missing).cast(kinds[v]) if missing is not None else zero(kinds[v]) for v in values]
    got = [F.coalesce(F.col("__v").getField(v), f).alias(f"{prefix}.{v}") for v, f in zip(values, fill)]
    return joined.select(*[q(c) for c in df.columns], *got)
