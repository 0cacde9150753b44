"""Table algebra on DataFrames: positional access, comparison, updates, stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.operators.sequence import rank_in_groups


def sort_rows(df: DataFrame, *columns: str) -> DataFrame:
    """By columns, the first counting most; by all of them if none is named."""
    return df.orderBy(*(columns or df.columns))


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Global 0-based row numbers in ``order``, by range partitions (no single task sees all rows)."""
    return rank_in_groups(df.withColumn("__one", F.lit(1)), ["__one"], order, name).drop("__one")


def row_slice(df: DataFrame, order: list[str], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start:stop:step of the order; negative numbers count from the end."""
    n = df.count() if (start or 0) < 0 or (stop or 0) < 0 else None
    start = max(0, (start or 0) + (n if (start or 0) < 0 else 0))
    stop = None if stop is None else stop + (n if stop < 0 else 0)
    rows = numbered(df, order, "__row").where(F.col("__row") >= start)
    rows = rows if stop is None else rows.where(F.col("__row") < stop)
    return rows.where((F.col("__row") - start) % step == 0).drop("__row")


def take_rows(df: DataFrame, order: list[str], index: list[int]) -> DataFrame:
    """The rows at these positions, in the order of ``index``, repeated where it repeats."""
    spark = df.sparkSession
    want = spark.createDataFrame([(k, i) for k, i in enumerate(index)], "__at long, __row long")
    return numbered(df, order, "__row").join(want, "__row").orderBy("__at").drop("__row", "__at")


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """A copy with columns replaced where the condition holds (null counts as not)."""
    hit = F.coalesce(condition, F.lit(False))
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(*[F.when(hit, lit(values[c])).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


def with_column(df: DataFrame, name: str, value) -> DataFrame:
    """Add or replace a column; a plain value is repeated."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def rows_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, equal: whether all common columns agree (null and NaN agree with themselves, arrays element by element)."""
    common = [c for c in left.columns if c in right.columns and c != key]
    other = right.select(F.col(key).alias("__key"), F.struct(*common).alias("__other"))
    same = F.struct(*[F.col(c) for c in common]).eqNullSafe(F.col("__other"))
    return left.join(other, left[key] == F.col("__key")).select(key, same.alias("equal"))


def stack(frames: list[DataFrame], empty: DataFrame | None = None) -> DataFrame:
    """All rows of frames with the same columns; of no frames, ``empty`` (which carries the schema)."""
    if not frames:
        if empty is None:
            raise ValueError("nothing to stack and no schema given")
        return empty.limit(0)
    return reduce(lambda a, b: a.unionByName(b), frames)


def semi(df: DataFrame, column: str, values: DataFrame, value_column: str, negate: bool = False) -> DataFrame:
    """Rows whose value is (not) among ``values``; for lists too long for a literal."""
    return df.join(values.select(F.col(value_column).alias("__v")), df[column] == F.col("__v"), "left_anti" if negate else "left_semi")
