"""Column types: dtype strings of table definitions, their Spark types, zero values, and unsigned 64-bit helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unsigned types take the next wider signed type; u8 keeps its bit pattern in a long.
SCALARS = {
    "bool": T.BooleanType(), "b1": T.BooleanType(), "i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(),
    "i4": T.IntegerType(), "u4": T.LongType(), "i8": T.LongType(), "u8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType(),
}
NAMES = {"boolean": "bool", "tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8", "string": "a", "binary": "O8"}


def spark_type(dtype: str) -> T.DataType:
    """'f8' → double, 'a20' → string, '5f4' and '(5,10)f4' → (nested) arrays, 'O8' → binary."""
    m = re.fullmatch(r"\s*(?:\((?P<dims>[\d,\s]+)\)|(?P<dim>\d+))?\s*[<>=|]?(?P<base>[a-zA-Z]+\d*)\s*", dtype)
    if not m:
        raise ValueError(f"not a column type: {dtype!r}")
    base = m["base"]
    if base in SCALARS:
        kind: T.DataType = SCALARS[base]
    elif re.fullmatch(r"[aS]\d*", base):
        kind = T.StringType()
    elif re.fullmatch(r"O\d*", base):
        kind = T.BinaryType()
    else:
        raise ValueError(f"not a column type: {dtype!r}")
    dims = [int(x) for x in (m["dims"] or m["dim"] or "").replace(" ", "").split(",") if x]
    for _ in dims:
        kind = T.ArrayType(kind)
    return kind


def string_width(dtype: str) -> int | None:
    """N of 'aN'."""
    m = re.fullmatch(r"[aS](\d+)", dtype.strip())
    return int(m[1]) if m else None


def dtype_of(kind: T.DataType) -> str:
    """The dtype string of a Spark type (as used for tables made from a query)."""
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    name = NAMES.get(kind.simpleString(), "O8")
    return name if not depth else f"[{depth}]{name}"


def zero(kind: T.DataType) -> Column:
    """The value that stands for a missing one: 0, '', false, or an empty array."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def zero_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls become zeros of their type."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.coalesce(F.col(f"`{c}`"), zero(k)).alias(c) if columns is None or c in columns else F.col(f"`{c}`") for c, k in kinds.items()])


def u64_text(c: Column) -> Column:
    """A bit pattern as the unsigned number it stands for."""
    return F.conv(F.hex(c), 16, 10)


def u64_order(c: Column) -> Column:
    """Signed key that sorts bit patterns as unsigned numbers."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def mjd(ts: Column) -> Column:
    """Modified Julian date, in days, of a timestamp; one without a zone is taken in the session's zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400e6) + F.lit(40587)
