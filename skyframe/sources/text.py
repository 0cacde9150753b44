"""Text tables: import by column name and position with converters, and the fixed-format text sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.registry import dms, hms
from skyframe.types import spark_type


def truth(text: Column) -> Column:
    """TRUE/FALSE in any case, else whether the number is not zero."""
    return F.when(F.upper(F.trim(text)) == "TRUE", True).when(F.upper(F.trim(text)) == "FALSE", False).otherwise(F.trim(text).try_cast("double") != 0)


def parse_columns(text: str) -> list[tuple[str, int]]:
    """'ra:2,dec:3' or 'ra,dec': names with 1-based positions; a name without one comes after the last."""
    out, last = [], 0
    for part in filter(None, re.split(r"[,\s]+", text.strip())):
        name, _, at = part.partition(":")
        last = int(at) if at else last + 1
        out.append((name, last))
    return out


def read_text(spark: SparkSession, paths: str | list[str], columns: list[tuple[str, int]] | str, dtypes: dict[str, str] | None = None, delimiter: str | None = None, skip_header: int = 0, dms_columns: tuple = (), hms_columns: tuple = (), constants: dict | None = None, strict: bool = True) -> DataFrame:
    """Lines of text files (also .gz, .bz2) as a table.

    ``columns``: [(name, 1-based position)] or such a text. Fields are split at white space, or at ``delimiter``. Text
    from # or ; on and empty lines are left out, as are the first ``skip_header`` lines of every file. Types by ``dtypes``
    (f8 if absent); d:m:s and h:m:s columns become degrees. ``constants`` are added to every row. A field that cannot be
    read is an error if ``strict``, else its line is left out.
    """
    columns = parse_columns(columns) if isinstance(columns, str) else list(columns)
    lines = spark.read.text(paths)
    if skip_header:
        lines = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        first = lines.where("b = 0").groupBy("f").agg(F.min("i").alias("i0"))
        lines = lines.join(first, "f").where(F.col("i") >= F.col("i0") + skip_header).select("value")
    body = F.trim(F.regexp_replace("value", r"[#;].*$", ""))
    lines = lines.select(body.alias("line")).where("line <> ''")
    parts = F.split("line", re.escape(delimiter) if delimiter else r"\s+")
    kinds = {n: (dtypes or {}).get(n, "f8") for n, _ in columns}
    out, bad = [], F.lit(False)
    for name, at in columns:
        raw = F.trim(F.get(F.col("parts"), at - 1))
        kind = spark_type(kinds[name])
        if name in dms_columns or name in hms_columns:
            value = hms(raw) if name in hms_columns else dms(raw)
        elif isinstance(kind, T.BooleanType):
            value = truth(raw)
        elif isinstance(kind, T.StringType):
            value = raw
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            value = raw.try_cast(kind)
        else:  # unsigned numbers beyond the signed range keep their bits
            value = raw.try_cast("decimal(20,0)")
            value = F.when(value >= F.lit(str(1 << 63)).cast("decimal(20,0)"), value - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(value).try_cast(kind)
        bad = bad | value.isNull()
        out.append(value.alias(name))
    rows = lines.select(parts.alias("parts"))
    if strict:
        out = [F.when(c.isNull(), F.raise_error(F.concat(F.lit(f"cannot read {n} in: "), F.array_join("parts", " ")))).otherwise(c).alias(n) for c, (n, _) in zip(out, columns)]
        rows = rows.select(*out)
    else:
        rows = rows.where(~bad).select(*out)
    for name, value in (constants or {}).items():
        rows = rows.withColumn(name, F.lit(value))
    return rows


#: Printf formats per type.
FORMATS = {"tinyint": "%4d", "smallint": "%6d", "int": "%11d", "bigint": "%21d", "float": "%7.3f", "double": "%12.8f"}


def formatted(df: DataFrame) -> DataFrame:
    """One string column ``line`` with every column in its type's fixed format; null is written as nan or -."""
    parts = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in FORMATS:
            text = F.format_string(FORMATS[kind], c)
            width = int(re.match(r"%(\d+)", FORMATS[kind])[1])
            special = F.when(F.isnan(c), F.lpad(F.lit("nan"), width, " ")).when(F.abs(c) == float("inf"), F.lpad(F.when(c > 0, "inf").otherwise("-inf"), width, " ")) if kind in ("float", "double") else None
            text = special.otherwise(text) if special is not None else text
            text = F.when(c.isNull(), F.lpad(F.lit("nan" if kind in ("float", "double") else "-"), width, " ")).otherwise(text)
        elif kind == "boolean":
            text = F.coalesce(c.cast("int").cast("string"), F.lit("-"))
        elif kind == "string":
            text = F.coalesce(c, F.lit("-"))
        else:
            text = F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("-"))
        parts.append(text)
    return df.select(F.concat_ws(" ", *parts).alias("line"))


def write_text(df: DataFrame, path: str, compression: str = "none", single: bool = False) -> None:
    """Write formatted lines; each file begins with '# ' and the column names (as lines of a comment do)."""
    header = "# " + " ".join(df.columns)
    rows = formatted(df)

    def with_header(blocks):
        import pandas as pd

        first = True
        for b in blocks:
            if first:
                yield pd.DataFrame({"line": [header]})
                first = False
            yield b
        if first:
            yield pd.DataFrame({"line": [header]})

    out = rows.coalesce(1) if single else rows
    out.mapInPandas(with_header, "line string").write.mode("overwrite").option("compression", compression).text(path)


def write_null(df: DataFrame) -> int:
    """Run the query and count its rows, writing nothing."""
    return df.count()
