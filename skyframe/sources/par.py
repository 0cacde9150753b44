"""Yanny parameter files (.par): typedef'd tables of values, arrays and quoted text; and YAML table definitions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KINDS = {"int": T.IntegerType(), "short": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "char": T.StringType()}
TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|(\{)|(\})|([^\s"{}]+)')


def parse_par(text: str) -> dict[str, tuple[list[tuple[str, str, int]], list[list]]]:
    """Struct name (upper case) → (fields (name, type, array length or 0), rows). A char's length is no array length."""
    text = re.sub(r"\\\s*\n", " ", text)
    tables: dict[str, tuple[list, list]] = {}
    for m in re.finditer(r"typedef\s+struct\s*\{(.*?)\}\s*(\w+)\s*;", text, re.S):
        fields = []
        for kind, name, sizes in re.findall(r"(\w+)\s+(\w+)((?:\s*\[\s*\d*\s*\])*)\s*;", re.sub(r"#.*", "", m[1])):
            dims = [int(x or 0) for x in re.findall(r"\[\s*(\d*)\s*\]", sizes)]
            dims = dims[:-1] if kind == "char" else dims
            fields.append((name, kind, dims[0] if dims else 0))
        tables[m[2].upper()] = (fields, [])
    body = re.sub(r"typedef\s+(?:struct|enum)\s*\{.*?\}\s*\w+\s*;", "", text, flags=re.S)
    for line in body.splitlines():
        line = re.sub(r'#(?=(?:[^"]*"[^"]*")*[^"]*$).*', "", line).strip()
        name = line.split(None, 1)[0].upper() if line else ""
        if name not in tables:
            continue
        tokens = [(q if w == "" and not o and not c else w, o, c) for q, o, c, w in TOKEN.findall(line.split(None, 1)[1] if " " in line or "\t" in line else "")]
        row, at = [], 0
        for _, kind, n in tables[name][0]:
            conv = {"char": str, "float": float, "double": float}.get(kind, int)
            if n:
                braced = at < len(tokens) and bool(tokens[at][1])
                at += braced
                values = []
                while at < len(tokens) and not tokens[at][2] and (braced or len(values) < n):
                    values.append(conv(tokens[at][0]))
                    at += 1
                at += braced
                row.append(values)
            else:
                braced = at < len(tokens) and bool(tokens[at][1])  # {} stands for an empty text
                if braced:
                    inner = []
                    at += 1
                    while at < len(tokens) and not tokens[at][2]:
                        inner.append(tokens[at][0])
                        at += 1
                    at += 1
                    row.append(conv(" ".join(inner)) if inner or kind == "char" else None)
                else:
                    row.append(conv(tokens[at][0]))
                    at += 1
        tables[name][1].append(row)
    return tables


def read_par(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A table of a parameter file (the first if not named)."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    tables = parse_par(text)
    if not tables:
        raise ValueError(f"no table in {path}")
    fields, rows = tables[(table or next(iter(tables))).upper()]
    schema = T.StructType([T.StructField(n, T.ArrayType(KINDS[k]) if a else KINDS[k]) for n, k, a in fields])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def read_definition(text: str) -> dict:
    """Table definition from YAML, the order of columns kept; only plain data is read (safe loader)."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!!omap", lambda loader, node: [list(p) for d in loader.construct_sequence(node, deep=True) for p in d.items()])
    definition = yaml.load(text, Loader)  # noqa: S506  a subclass of SafeLoader
    for group in definition.get("schema", {}).values():
        columns = group["columns"]
        if isinstance(columns, dict):
            columns = list(columns.items())
        group["columns"] = [tuple(c.items())[0] if isinstance(c, dict) else tuple(c[:2]) for c in columns]
    return definition


def file_table(spark: SparkSession, source: str, key: str | None = None, values: tuple[str, ...] = ()):
    """Lookup from a file: 'file.par', '.fits', '.yaml' or text with a '# names' first line; 'file:key:v1,v2' for short."""
    from skyframe.plans.expr import Lookup

    if key is None and source.count(":") >= 2 and "://" not in source:
        source, key, rest = source.rsplit(":", 2)
        values = tuple(rest.split(","))
    if source.endswith(".pkl"):
        raise ValueError("pickled tables are not read")
    if source.endswith(".par"):
        df = read_par(spark, source)
    elif re.search(r"\.fits?(\.gz)?$", source):
        from skyframe.sources.fits import read_fits

        df = read_fits(spark, source)
    elif source.endswith(".parquet"):
        df = spark.read.parquet(source)
    else:
        from skyframe.sources.text import read_text

        first = spark.read.text(source).first()
        if first is None or not first[0].startswith("#"):
            raise ValueError(f"{source} names no columns")
        names = first[0].lstrip("# ").split()
        df = read_text(spark, source, [(n, i + 1) for i, n in enumerate(names)])
    return Lookup(df, key or df.columns[0], values or tuple(c for c in df.columns if c != (key or df.columns[0])))
