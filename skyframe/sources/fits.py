"""FITS: headers, binary tables and images, read in the cluster from whole files; a table writer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, CARD = 2880, 80
#: Type codes of binary tables → big-endian numpy types.
CODES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}
SPARK = {"L": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType(), "A": T.StringType()}
IMAGE = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


class FitsError(ValueError):
    """A file that is not what it should be."""


def card_value(card: str):
    """Value of a header card, None if it has none."""
    body = card[10:] if card[8:10] == "= " else card.split("=", 1)[1] if "=" in card else ""
    body = body.strip()
    if body.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", body)
        return m[1].replace("''", "'").rstrip() if m else None
    raw = body.split("/", 1)[0].strip()
    if raw in ("T", "F"):
        return raw == "T"
    try:
        return int(raw)
    except ValueError:
        try:
            return float(raw.replace("D", "E").replace("d", "e"))
        except ValueError:
            return raw or None


def headers(data: bytes) -> Iterator[tuple[dict, str, int, int]]:
    """(keywords, header text, start of data, its padded size) of every unit of a file."""
    at = 0
    while at + BLOCK <= len(data):
        cards, done = [], False
        while not done:
            block = data[at : at + BLOCK]
            if len(block) < BLOCK:
                raise FitsError("the header has no end")
            at += BLOCK
            for k in range(0, BLOCK, CARD):
                card = block[k : k + CARD].decode("latin-1")
                if card.rstrip() == "END":
                    done = True
                    break
                cards.append(card)
        keys = {}
        for card in cards:
            if "=" in card[:9]:
                keys.setdefault(card.split("=", 1)[0].strip(), card_value(card))
        size = 0
        if keys.get("NAXIS", 0):
            size = abs(keys["BITPIX"]) // 8 * int(np.prod([keys[f"NAXIS{i + 1}"] for i in range(keys["NAXIS"])], dtype=np.int64)) * keys.get("GCOUNT", 1) + keys.get("PCOUNT", 0)
        yield keys, "\n".join(c.rstrip() for c in cards), at, size
        at += -(-size // BLOCK) * BLOCK


def table_columns(keys: dict) -> list[tuple[str, int, str]]:
    """(name, repeat, code) of a binary table's columns."""
    out = []
    for i in range(1, keys.get("TFIELDS", 0) + 1):
        m = re.fullmatch(r"(\d*)([A-Z])(.*)", str(keys[f"TFORM{i}"]).strip())
        if not m or m[2] not in CODES:
            raise FitsError(f"column format {keys[f'TFORM{i}']} is not supported")
        out.append((str(keys.get(f"TTYPE{i}", f"col{i}")).strip(), int(m[1] or 1), m[2]))
    return out


def table_data(keys: dict, data: bytes, start: int) -> pd.DataFrame:
    """A binary table's rows; scaled integers (TSCAL, TZERO) are scaled, texts stripped."""
    spec = table_columns(keys)
    kind = np.dtype([(f"f{i}", f"S{n}" if c == "A" else CODES[c], () if c == "A" or n == 1 else (n,)) for i, (_, n, c) in enumerate(spec)])
    if kind.itemsize != keys["NAXIS1"]:
        raise FitsError("the columns do not fill a row")
    rows = np.frombuffer(data, kind, keys["NAXIS2"], start)
    out = {}
    for i, (name, n, c) in enumerate(spec):
        v = rows[f"f{i}"]
        if c == "A":
            v = np.array([x.decode("latin-1").rstrip() for x in v], object)
        elif c == "L":
            v = v == b"T"
        else:
            v = v.astype(v.dtype.newbyteorder("="))
            scale, zero = keys.get(f"TSCAL{i + 1}", 1), keys.get(f"TZERO{i + 1}", 0)
            if scale != 1 or zero:
                v = (v * scale + zero) if scale != 1 or isinstance(zero, float) and zero % 1 else v.astype(np.int64) + np.int64(zero if zero < 1 << 63 else zero - (1 << 64))
        out[name] = list(v) if v.ndim > 1 else v
    return pd.DataFrame(out)


def image_data(keys: dict, data: bytes, start: int) -> np.ndarray:
    shape = [keys[f"NAXIS{i + 1}"] for i in range(keys["NAXIS"])][::-1]
    v = np.frombuffer(data, IMAGE[keys["BITPIX"]], int(np.prod(shape)), start).reshape(shape)
    return v.astype(v.dtype.newbyteorder("=")) * keys.get("BSCALE", 1) + keys.get("BZERO", 0)


def keep_nan(df: DataFrame) -> DataFrame:
    """Floats that came through pandas: null, which these files do not have, is NaN again."""
    nan = F.lit(float("nan"))
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = F.coalesce(c, nan.cast(kind)).alias(f.name)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            c = F.transform(c, lambda v: F.coalesce(v, nan.cast(kind.elementType))  # noqa: B023
            ).alias(f.name)
        out.append(c)
    return df.select(*out)


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, unit (number), name, header (text) of every unit of every file."""

    def units(blocks):
        for b in blocks:
            rows = [(p, i, str(k.get("EXTNAME", "")), text) for p, c in zip(b["path"], b["content"]) for i, (k, text, _, _) in enumerate(headers(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "unit", "name", "header"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(units, "path string, unit int, name string, header string")


def read_fits(spark: SparkSession, paths: str | list[str], schema: str | T.StructType | None = None, columns: dict[str, str] | None = None, units: list[int] | None = None, constants: dict | None = None) -> DataFrame:
    """Rows of binary tables: of the units numbered in ``units`` (default 1) of all files.

    ``columns``: result name → column of the file (default all). A column that a file lacks is NaN for floats, else zero,
    and its name is listed in ``notfound`` (array), which is added if ``columns`` is given. ``schema``: result types
    without notfound; default: those of the first file. Files are split over the cluster one by one, so no single file
    should be larger than an executor's share of memory.
    """
    units = units or [1]
    files = spark.read.format("binaryFile").load(paths)
    if schema is None:
        head = files.select("content").first()
        if head is None:
            raise FitsError("no files")
        found = {n: T.ArrayType(SPARK[c]) if r > 1 and c != "A" else SPARK[c] for i, (k, _, _, _) in enumerate(headers(bytes(head[0]))) if i in units for n, r, c in table_columns(k)}
        names = columns or {n: n for n in found}
        schema = T.StructType([T.StructField(n, found.get(src, T.DoubleType())) for n, src in names.items()])
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = columns or {f.name: f.name for f in schema.fields}
    full = T.StructType([*schema.fields, *([T.StructField("notfound", T.ArrayType(T.StringType()))] if columns else [])])
    kinds = {f.name: f.dataType for f in schema.fields}

    def rows(blocks):
        for b in blocks:
            for content in b["content"]:
                content = bytes(content)
                for i, (keys, _, start, _) in enumerate(headers(content)):
                    if i not in units or not keys.get("TFIELDS"):
                        continue
                    t = table_data(keys, content, start)
                    lost = [src for src in names.values() if src not in t.columns]
                    out = pd.DataFrame(index=t.index)
                    for n, src in names.items():
                        gap = float("nan") if isinstance(kinds[n], (T.FloatType, T.DoubleType)) else "" if isinstance(kinds[n], T.StringType) else 0
                        out[n] = t[src] if src in t.columns else gap
                    if columns:
                        out["notfound"] = [lost] * len(out)
                    for a in range(0, len(out), 50_000):
                        yield out.iloc[a : a + 50_000]

    df = keep_nan(files.select("content").mapInPandas(rows, full))
    for n, v in (constants or {}).items():
        df = df.withColumn(n, F.lit(v))
    return df


def _card(key: str, value, note: str = "") -> bytes:
    text = f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"{value:>20}" if isinstance(value, (int, float)) else f"'{value:<8}'"
    return f"{key:<8}= {text}{' / ' + note if note else ''}"[:CARD].ljust(CARD).encode("ascii")


def _padded(b: bytes, fill: bytes) -> bytes:
    return b + fill * (-len(b) % BLOCK)


def fits_bytes(pdf: pd.DataFrame, schema: T.StructType) -> bytes:
    """A file with an empty primary unit and one binary table. Booleans become L, text is as wide as the longest value."""
    code = {T.BooleanType: ("L", "S1"), T.ByteType: ("I", ">i2"), T.ShortType: ("I", ">i2"), T.IntegerType: ("J", ">i4"), T.LongType: ("K", ">i8"), T.FloatType: ("E", ">f4"), T.DoubleType: ("D", ">f8")}
    spec, arrays = [], []
    for f in schema.fields:
        v, kind, n = pdf[f.name], f.dataType, 1
        if isinstance(kind, T.ArrayType):
            n, kind = max([1, *(len(x) for x in v if x is not None)]), kind.elementType
            v = np.array([list(x) + [0] * (n - len(x)) if x is not None else [0] * n for x in v]).reshape(len(v), n)
        if isinstance(kind, T.StringType):
            v = np.array([str(x).encode("latin-1", "replace") if x is not None else b"" for x in v], dtype="S")
            spec.append((f.name, f"{max(1, v.dtype.itemsize)}A", f"S{max(1, v.dtype.itemsize)}", ()))
        else:
            c, t = code.get(type(kind), ("D", ">f8"))
            if c == "L":
                v = np.where(np.asarray(v, bool), b"T", b"F")
            else:
                v = np.asarray(pd.Series(list(v)).fillna(0) if c not in "ED" and n == 1 else v, dtype=t)
            spec.append((f.name, f"{n}{c}", t, (n,) if n > 1 else ()))
        arrays.append(v)
    rows = np.zeros(len(pdf), [(f"f{i}", t, s) for i, (_, _, t, s) in enumerate(spec)])
    for i, v in enumerate(arrays):
        rows[f"f{i}"] = v
    primary = [_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True)]
    table = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", rows.dtype.itemsize), _card("NAXIS2", len(rows)), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(spec))]
    for i, (name, form, _, _) in enumerate(spec, 1):
        table += [_card(f"TTYPE{i}", name), _card(f"TFORM{i}", form)]
    end = b"END".ljust(CARD)
    return _padded(b"".join([*primary, end]), b" ") + _padded(b"".join([*table, end]), b" ") + _padded(rows.tobytes(), b"\0")


def write_fits(df: DataFrame, path: str, max_rows: int = 10_000_000) -> None:
    """One FITS file on the driver; a result of more than ``max_rows`` rows is refused (a file format for small results)."""
    pdf = df.limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write Parquet instead")
    with open(path, "wb") as f:
        f.write(fits_bytes(pdf, df.schema))


def write_fits_parts(df: DataFrame, folder: str, max_rows: int = 1_000_000) -> DataFrame:
    """FITS files in a shared folder, one or more per partition (path, rows): each holds at most ``max_rows`` rows.

    The tasks write them, under a name that is replaced when the file is whole, so a task that is run again leaves no
    half file. Text columns are as wide as their longest value in the file.
    """
    base = folder if "://" in folder else f"file://{folder}"
    schema = df.schema

    def write(batches):
        from pyarrow import fs as arrow_fs
        from pyspark import TaskContext

        system, path = arrow_fs.FileSystem.from_uri(base)
        system.create_dir(path, recursive=True)
        held, size, number = [], 0, 0

        def flush():
            nonlocal held, size, number
            name = f"{path}/part-{TaskContext.get().partitionId():05d}-{number:03d}.fits"
            pdf = pd.concat(held, ignore_index=True)
            with system.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}.writing") as out:
                out.write(fits_bytes(pdf, schema))
            system.move(f"{name}.{TaskContext.get().taskAttemptId()}.writing", name)
            held, size, number = [], 0, number + 1
            return pd.DataFrame({"path": [name], "rows": [len(pdf)]})

        for b in batches:
            while len(b):
                take = b.iloc[: max_rows - size]
                held.append(take)
                size += len(take)
                b = b.iloc[len(take) :]
                if size >= max_rows:
                    yield flush()
        if size:
            yield flush()

    from skyframe.session import cut

    return cut(df.mapInPandas(write, "path string, rows long"))
