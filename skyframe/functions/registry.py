"""Functions of the query language: name → Column builder. Order of precedence: built in, then the user's, then numeric.

Every builder takes and returns Values (a Column with its Spark type where it is known); see plans.expr.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe.functions import sky

NAN, INF = float("nan"), float("inf")


def _domain(f: Callable[[Column], Column], bad: Callable[[Column], Column], at: float = NAN) -> Callable:
    """f, with ``at`` instead of null outside its domain (null itself stays null)."""
    return lambda x: F.when(bad(x), F.lit(at)).otherwise(f(x))


def log_of(base: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(base(x))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a - b * F.floor(a / F.when(b != 0, b)))


def true_divide(a: Column, b: Column) -> Column:
    """Division of floats: inf or nan for a divisor of zero."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def _strict(f: Callable) -> Callable:
    """f, but null if any argument is null (least and greatest skip nulls)."""

    def g(*args: Column) -> Column:
        known = args[0].isNotNull()
        for a in args[1:]:
            known = known & a.isNotNull()
        return F.when(known, f(*args))

    return g


def isfinite(x: Column) -> Column:
    return ~F.isnan(x.cast("double")) & (F.abs(x) != F.lit(INF))


def bin_text(x: Column, bits: int = 64) -> Column:
    """Zero-padded bits in groups of eight, split by commas."""
    padded = F.substring(F.lpad(F.bin(x.cast("long")), 64, "0"), 65 - bits, bits)
    return F.regexp_replace(padded, r"(\d{8})(?=\d)", "$1,")


def header_value(header: Column, keyword: str, kind: str, default=None) -> Column:
    """Value of ``keyword`` in a header text of 'KEY = value / comment' lines: kind string, boolean, long or double.

    A missing keyword, an empty or unreadable value and a null header give ``default``.
    """
    key = keyword.replace("\\", "").replace(".", r"\.")
    body = rf"(?m)^\s*{key}\s*="
    there = header.rlike(body)
    text = F.regexp_extract(header, rf"{body}[ \t]*'((?:[^'\n]|'')*)'", 1)
    raw = F.trim(F.regexp_extract(header, rf"{body}([^'/\n]*)", 1))
    quoted = header.rlike(rf"{body}[ \t]*'")
    if kind == "string":
        value = F.when(quoted, F.replace(text, F.lit("''"), F.lit("'"))).otherwise(F.nullif(raw, F.lit("")))
    elif kind == "boolean":
        value = F.when(F.lower(raw) == "t", True).when(F.lower(raw) == "f", False)
    else:
        number = F.nullif(raw, F.lit("")).try_cast("double")
        value = number if kind == "double" else number.try_cast("long")
    out = F.when(there, value)
    return out if default is None else F.coalesce(out, F.lit(default).cast(kind))


def dms(text: Column) -> Column:
    """d:m:s to degrees; the sign of the first part counts for all."""
    parts = F.split(F.trim(text), ":")
    size = sum((F.abs(F.coalesce(F.get(parts, k).try_cast("double"), F.lit(0.0))) / 60**k for k in (1, 2)), F.abs(F.get(parts, 0).try_cast("double")))
    return F.when(F.startswith(F.trim(F.get(parts, 0)), F.lit("-")), -size).otherwise(size)


def hms(text: Column) -> Column:
    """h:m:s to degrees."""
    return dms(text) * 15


def flux_to_mag(flux: Column, zero_point: float = 22.5) -> Column:
    """-2.5 log10(flux) + zero point; a flux that is not positive counts as 0.001."""
    return F.lit(-2.5) * F.log10(F.when(flux <= 0, F.lit(0.001)).otherwise(flux.cast("double"))) + zero_point


def flux_to_mag_err(flux: Column, ivar: Column) -> Column:
    f = F.when(flux <= 0, F.lit(0.001)).otherwise(flux.cast("double"))
    return true_divide(F.lit(1.08574) / f, F.sqrt(ivar.cast("double")))


def chip_cell(x: Column, y: Column, chip: Column | None = None) -> Column:
    """Cell (0-63) of a chip pixel: cells of 600 pixels behind gaps of 8 (x) and 10 (y). Chips of columns 0-3 are turned by half."""
    cell = (F.floor((x + 8) / 608) + 8 * F.floor((y + 10) / 610)).cast("int")
    return cell if chip is None else F.when(chip % 8 <= 3, F.lit(63) - cell).otherwise(cell)


def flat_index(chip: Column, cell: Column, nx: int = 64, ny: int = 64) -> Column:
    """struct(i, j): place of a chip's cell in the flat-field table."""
    cx, cy = nx // 8, ny // 8
    return F.struct(((chip % 8) * cx + cell % cx).cast("int").alias("i"), (F.floor(chip / 8) * cy + F.floor(cell / cx)).cast("int").alias("j"))


def run_mjd(mjd_ref: Column, field_ref: Column, field: Column, rowc: Column) -> Column:
    """Mid-exposure MJD of a drift-scan object. 0.396 arcsec pixels at the sidereal rate, 36 s a field, 53.907456 s exposures."""
    return mjd_ref + rowc * 0.396 / (360.985647 * 3600.0) + 36 * (field - field_ref) / 86400.0 - 53.907456 / 2 / 86400.0


#: name → (builder, number of arguments or None). Arguments are Columns.
NUMERIC: dict[str, tuple[Callable, int | None]] = {
    "abs": (F.abs, 1), "absolute": (F.abs, 1), "fabs": (lambda x: F.abs(x.cast("double")), 1),
    "sqrt": (_domain(F.sqrt, lambda x: x < 0), 1), "square": (lambda x: x * x, 1), "exp": (F.exp, 1), "expm1": (F.expm1, 1),
    "log": (log_of(F.log), 1), "log10": (log_of(F.log10), 1), "log2": (log_of(F.log2), 1), "log1p": (lambda x: log_of(F.log)(x + 1), 1),
    "sin": (F.sin, 1), "cos": (F.cos, 1), "tan": (F.tan, 1), "arcsin": (F.asin, 1), "arccos": (F.acos, 1), "arctan": (F.atan, 1),
    "sinh": (F.sinh, 1), "cosh": (F.cosh, 1), "tanh": (F.tanh, 1), "arcsinh": (F.asinh, 1), "arccosh": (F.acosh, 1), "arctanh": (F.atanh, 1),
    "arctan2": (F.atan2, 2), "hypot": (F.hypot, 2), "floor": (lambda x: F.floor(x).cast("double"), 1), "ceil": (lambda x: F.ceil(x).cast("double"), 1),
    "rint": (F.rint, 1), "trunc": (lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), 1), "fix": (lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), 1),
    "fmod": (lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b)), 2), "mod": (floor_mod, 2), "remainder": (floor_mod, 2),
    "power": (lambda a, b: F.pow(a, b), 2), "sign": (lambda x: F.signum(x), 1),
    "minimum": (_strict(lambda a, b: F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(NAN)).otherwise(F.least(a, b))), 2),
    "maximum": (_strict(F.greatest), 2), "fmin": (_strict(F.least), 2),
    "fmax": (_strict(lambda a, b: F.when(F.isnan(a.cast("double")), b).when(F.isnan(b.cast("double")), a).otherwise(F.greatest(a, b))), 2),
    "where": (lambda c, a, b: F.when(c, a).otherwise(b), 3), "clip": (_strict(lambda x, a, b: F.least(F.greatest(x, a), b)), 3),
    "isnan": (lambda x: F.isnan(x.cast("double")), 1), "isfinite": (isfinite, 1), "isinf": (lambda x: F.abs(x) == F.lit(INF), 1), "isnull": (F.isnull, 1),
    "radians": (F.radians, 1), "degrees": (F.degrees, 1), "deg2rad": (F.radians, 1), "rad2deg": (F.degrees, 1),
    "logical_and": (lambda a, b: a.cast("boolean") & b.cast("boolean"), 2), "logical_or": (lambda a, b: a.cast("boolean") | b.cast("boolean"), 2),
    "logical_not": (lambda a: ~a.cast("boolean"), 1), "logical_xor": (lambda a, b: a.cast("boolean") != b.cast("boolean"), 2),
    "bitwise_and": (lambda a, b: a.bitwiseAND(b), 2), "bitwise_or": (lambda a, b: a.bitwiseOR(b), 2), "bitwise_xor": (lambda a, b: a.bitwiseXOR(b), 2),
    "bitwise_not": (F.bitwise_not, 1), "invert": (F.bitwise_not, 1),
    "add": (lambda a, b: a + b, 2), "subtract": (lambda a, b: a - b, 2), "multiply": (lambda a, b: a * b, 2), "divide": (true_divide, 2), "true_divide": (true_divide, 2),
    "negative": (lambda a: -a, 1), "reciprocal": (lambda a: true_divide(F.lit(1.0), a), 1), "floor_divide": (lambda a, b: F.floor(a / b), 2),
    "equal": (lambda a, b: a == b, 2), "not_equal": (lambda a, b: a != b, 2), "less": (lambda a, b: a < b, 2), "less_equal": (lambda a, b: a <= b, 2),
    "greater": (lambda a, b: a > b, 2), "greater_equal": (lambda a, b: a >= b, 2),
    "zeros_like": (lambda a: (a * 0), 1), "ones_like": (lambda a: (a * 0 + 1), 1),
    "float": (lambda a: a.cast("double"), 1), "float64": (lambda a: a.cast("double"), 1), "float32": (lambda a: a.cast("float"), 1),
    "int": (lambda a: a.try_cast("long"), 1), "int64": (lambda a: a.try_cast("long"), 1), "int32": (lambda a: a.try_cast("int"), 1), "int16": (lambda a: a.try_cast("smallint"), 1),
    "str": (lambda a: a.cast("string"), 1), "bool": (lambda a: a.cast("boolean"), 1),
}

SKY: dict[str, tuple[Callable, int | None]] = {
    "equgal": (sky.equgal, 2), "galequ": (sky.galequ, 2), "gc_dist": (sky.gc_dist, 4),
    "gnomonic": (lambda *a: F.struct(*[c.alias(n) for c, n in zip(sky.gnomonic(*a), "xy")]), 4),
    "bhpix": (lambda *a: F.struct(*[c.alias(n) for c, n in zip(sky.butterfly(*a), "xy")]), 2),
    "bin": (bin_text, 1), "dms": (dms, 1), "hms": (hms, 1), "flux_to_mag": (flux_to_mag, 1), "flux_to_mag_err": (flux_to_mag_err, 2),
    "ps_xy2cell": (chip_cell, None), "u64": (lambda c: F.conv(F.hex(c), 16, 10), 1),
}

#: Bits of the detections' flag words; queries name them det_flags.NAME and det_flags2.NAME.
DETECTION_FLAGS = {
    "DEFAULT": 0x00000000, "PSFMODEL": 0x00000001, "EXTMODEL": 0x00000002, "FITTED": 0x00000004, "FITFAIL": 0x00000008, "POORFIT": 0x00000010, "PAIR": 0x00000020,
    "PSFSTAR": 0x00000040, "SATSTAR": 0x00000080, "BLEND": 0x00000100, "EXTERNALPOS": 0x00000200, "BADPSF": 0x00000400, "DEFECT": 0x00000800, "SATURATED": 0x00001000,
    "CR_LIMIT": 0x00002000, "EXT_LIMIT": 0x00004000, "MOMENTS_FAILURE": 0x00008000, "SKY_FAILURE": 0x00010000, "SKYVAR_FAILURE": 0x00020000, "MOMENTS_SN": 0x00040000,
    "BIG_RADIUS": 0x00080000, "AP_MAGS": 0x00100000, "BLEND_FIT": 0x00200000, "EXTENDED_FIT": 0x00400000, "EXTENDED_STATS": 0x00800000, "LINEAR_FIT": 0x01000000,
    "NONLINEAR_FIT": 0x02000000, "RADIAL_FLUX": 0x04000000, "SIZE_SKIPPED": 0x08000000, "ON_SPIKE": 0x10000000, "ON_GHOST": 0x20000000, "OFF_CHIP": 0x40000000,
}
DETECTION_FLAGS2 = {"DIFF_WITH_SINGLE": 0x00000001, "DIFF_WITH_DOUBLE": 0x00000002, "MATCHED": 0x00000004}
FLAGS = {"det_flags": DETECTION_FLAGS, "det_flags2": DETECTION_FLAGS2}

CONSTANTS = {"pi": math.pi, "e": math.e, "inf": INF, "Inf": INF, "nan": NAN, "NaN": NAN, "True": True, "False": False}

#: Reducing functions work on one cell at a time in a cell-wise engine and have no meaning for a whole column.
REDUCING = set("sum mean average median std var min max amin amax cumsum cumprod prod sort argsort unique size len argmin argmax ptp histogram percentile any all".split())


class Registry:
    """Functions known to a query. ``register`` adds a user's: a Column builder, or a pandas UDF (called with Columns)."""

    def __init__(self):
        self.user: dict[str, Callable] = {}

    def register(self, f: Callable, name: str | None = None) -> None:
        name = name or getattr(f, "__sky_name__", None) or f.__name__
        if not all(part.isidentifier() for part in name.split(".")):
            raise ValueError(f"not a function name: {name!r}")
        self.user[name] = f

    def register_module(self, module, prefix: str = "") -> None:
        """All public callables of a module (``__all__`` if it has one)."""
        names = getattr(module, "__all__", None) or [n for n in vars(module) if not n.startswith("_") and callable(getattr(module, n))]
        for n in names:
            if callable(getattr(module, n)):
                self.register(getattr(module, n), f"{prefix}.{n}" if prefix else n)

    def find(self, name: str) -> tuple[Callable, int | None] | None:
        if name in SKY:
            return SKY[name]
        if name in self.user:
            return self.user[name], None
        plain = name.removeprefix("np.").removeprefix("numpy.")
        return NUMERIC.get(plain)
