"""Sky geometry as Column expressions: distances, projections, coordinate systems, pixel and row ids.

Angles are degrees. Null in any argument gives null; NaN gives NaN (and null for the integer results).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------------ fixed values
#: North galactic pole (ra, dec) and galactic longitude of the ascending node, J2000.
POLE_RA, POLE_DEC, NODE_L = 192.859508333, 27.128336111, 32.932
#: Row id: 10 bits x, 10 bits y, 12 bits time, 32 bits index. Time slices start at T0 and last DT days.
LEVEL, T0, DT = 6, 54335, 1.0
OBJECT_BITS = 0xFFFFFFFF


def _r(c) -> Column:
    return F.radians(c if isinstance(c, Column) else F.lit(float(c)))


def _clip(c: Column) -> Column:
    """Into [-1, 1]; null and NaN stay (least and greatest would skip null)."""
    return F.when((c > 1) & ~F.isnan(c), F.lit(1.0)).when(c < -1, F.lit(-1.0)).otherwise(c)


def gc_dist(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance by the haversine formula."""
    half = lambda a, b: F.pow(F.sin((_r(a) - _r(b)) * 0.5), F.lit(2))
    return F.degrees(2 * F.asin(F.sqrt(_clip(half(lat1, lat2) + F.cos(_r(lat1)) * F.cos(_r(lat2)) * half(lon1, lon2)))))


def gnomonic(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    """Tangent-plane coordinates around (lon0, lat0)."""
    turn = _r(lon) - _r(lon0)
    s, c, s0, c0 = F.sin(_r(lat)), F.cos(_r(lat)), F.sin(_r(lat0)), F.cos(_r(lat0))
    depth = s0 * s + c0 * c * F.cos(turn)
    return F.degrees(c * F.sin(turn) / depth), F.degrees((c0 * s - s0 * c * F.cos(turn)) / depth)


def lambert(lon, lat, lon0=0.0, lat0=90.0) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area projection, unit sphere."""
    turn = _r(lon) - _r(lon0)
    s, c, s0, c0 = F.sin(_r(lat)), F.cos(_r(lat)), F.sin(_r(lat0)), F.cos(_r(lat0))
    k = F.sqrt(2 / (1 + s0 * s + c0 * c * F.cos(turn)))
    return k * c * F.sin(turn), k * (c0 * s - s0 * c * F.cos(turn))


def lambert_inverse(x: Column, y: Column, lon0=0.0, lat0=90.0) -> tuple[Column, Column]:
    rho = F.sqrt(x * x + y * y)
    angle = 2 * F.asin(_clip(rho / 2))
    s0, c0 = F.sin(_r(lat0)), F.cos(_r(lat0))
    there = F.degrees(F.atan2(x * F.sin(angle), rho * c0 * F.cos(angle) - y * s0 * F.sin(angle)))
    lat = F.degrees(F.asin(_clip(F.cos(angle) * s0 + y * F.sin(angle) * c0 / F.when(rho == 0, 1.0).otherwise(rho))))
    at = F.lit(float(lon0)) if not isinstance(lon0, Column) else lon0
    lat_c = F.lit(float(lat0)) if not isinstance(lat0, Column) else lat0
    return F.when(rho == 0, at).otherwise(at + there), F.when(rho == 0, lat_c).otherwise(lat)


def _product(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[sum(x * y for x, y in zip(row, column)) for column in zip(*b)] for row in a]


def _galactic_axes() -> list[list[float]]:
    """Rows: the axes of the galactic system in the equatorial one: turns about z (to the node), x (to the pole) and z."""

    def about(axis: int, degrees: float) -> list[list[float]]:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return [[c, s, 0], [-s, c, 0], [0, 0, 1]] if axis == 2 else [[1, 0, 0], [0, c, s], [0, -s, c]]

    return _product(about(2, -NODE_L), _product(about(0, 90 - POLE_DEC), about(2, POLE_RA + 90)))


GALACTIC_AXES = _galactic_axes()


def _rotated(axes: list[list[float]], lon, lat, names: tuple[str, str]) -> Column:
    """struct of the angles of a position in other axes: its unit vector's products with them."""
    flat = F.cos(_r(lat))
    vector = flat * F.cos(_r(lon)), flat * F.sin(_r(lon)), F.sin(_r(lat))
    x, y, z = (sum((v * F.lit(a) for v, a in zip(vector[1:], axis[1:])), vector[0] * F.lit(axis[0])) for axis in axes)
    return F.struct(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)).alias(names[0]), F.degrees(F.asin(_clip(z))).alias(names[1]))


def equgal(ra, dec) -> Column:
    """struct(l, b): galactic coordinates of equatorial ones."""
    return _rotated(GALACTIC_AXES, ra, dec, ("l", "b"))


def galequ(lon, lat) -> Column:
    """struct(ra, dec): equatorial coordinates of galactic ones."""
    return _rotated([list(c) for c in zip(*GALACTIC_AXES)], lon, lat, ("ra", "dec"))


def repair(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude modulo 360, latitude clamped to the poles."""
    return F.pmod(lon, F.lit(360.0)), _clip(lat / 90) * 90


# ------------------------------------------------------------------ equal-area pixel plane
def healpix(lon, lat) -> tuple[Column, Column]:
    """HEALPix plane: x in [0, 2 pi) (radians), y in [-pi/2, pi/2]."""
    quarter, across, up = _facet(lon, lat)
    return (quarter + 0.5) * (math.pi / 2) + across, up


def _facet(lon, lat) -> tuple[Column, Column, Column]:
    """Quarter of the sky, offset from its central meridian in the plane, and height in the plane."""
    phi = F.pmod(lon if isinstance(lon, Column) else F.lit(float(lon)), F.lit(360.0))
    quarter = F.least(F.floor(phi / 90), F.lit(3))
    along = F.radians(phi - 90 * quarter - 45)
    z = F.sin(_r(lat))
    cap = 2 - F.sqrt(3 * (1 - F.abs(z)))
    polar = F.abs(z) >= 2.0 / 3
    return quarter, F.when(polar, along * (2 - cap)).otherwise(along), F.when(polar, F.signum(z) * cap * (math.pi / 4)).otherwise(z * (3 * math.pi / 8))


def butterfly(lon, lat) -> tuple[Column, Column]:
    """The plane of the pixels, [-1, 1] squared: the four quarters of the HEALPix plane turned around the north pole."""
    quarter, u, v = _facet(lon, lat)
    v = v - math.pi / 2
    east, north = F.when(quarter < 2, -1.0).otherwise(1.0), F.when(quarter.isin(0, 3), 1.0).otherwise(-1.0)
    return (u * east - v * north) / math.pi, (u * north + v * east) / math.pi


def healpix_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """lon, lat of a point of the HEALPix plane."""
    polar = F.abs(y) > math.pi / 4
    cap = 2 - F.abs(y) * (4 / math.pi)
    middle = (F.floor(x / (math.pi / 2)) + 0.5) * (math.pi / 2)
    lon = F.when(polar, F.when(cap > 0, middle + (x - middle) / F.when(cap > 0, cap)).otherwise(middle)).otherwise(x)
    z = F.when(polar, F.signum(y) * (1 - cap * cap / 3)).otherwise(y * (8 / (3 * math.pi)))
    return F.degrees(lon), F.degrees(F.asin(_clip(z)))


def butterfly_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """lon, lat of a point of the pixel plane."""
    turn = F.atan2(y, x)
    quarter = F.least(F.floor(F.when(turn > 0, turn).otherwise(turn + 2 * math.pi) / (math.pi / 2)), F.lit(3))
    east, north = F.when(quarter < 2, -1.0).otherwise(1.0), F.when(quarter.isin(0, 3), 1.0).otherwise(-1.0)
    u, v = (math.pi / 2) * (east * x + north * y), (math.pi / 2) * (east * y - north * x)
    return healpix_inverse(u + (quarter + 0.5) * (math.pi / 2), v + math.pi / 2)


def width(level: int) -> int:
    return 1 << level


def pix_size(level: int) -> float:
    return 2.0 ** (1 - level)


def nside(level: int) -> int:
    return width(level) // 4


def pix_area(level: int) -> float:
    """Square degrees: three quarters of the square's pixels cover the sphere."""
    return 129600 / math.pi / (0.75 * width(level) ** 2)


def xy_to_ij(x: Column, y: Column, level: int) -> tuple[Column, Column]:
    """Pixel numbers from -2**level / 2 on."""
    return F.floor(x / pix_size(level)), F.floor(y / pix_size(level))


def ij_center(i: Column, j: Column, level: int) -> tuple[Column, Column]:
    return (i + 0.5) * pix_size(level), (j + 0.5) * pix_size(level)


def xy_center(x: Column, y: Column, level: int) -> tuple[Column, Column]:
    return ij_center(*xy_to_ij(x, y, level), level)


def pix_idx(x: Column, y: Column, level: int) -> Column:
    """Number of the pixel, row by row from (-1, -1)."""
    i, j = xy_to_ij(x, y, level)
    half = width(level) // 2
    return (j + half) * width(level) + i + half


# ------------------------------------------------------------------ row and cell ids
def _bits(c: Column, at: int, size: int) -> Column:
    return F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << size) - 1))


def position_id(lon, lat, t: Column | None = None, index: Column | None = None, t0: float = T0, dt: float = DT) -> Column:
    """64-bit id of a position (as a signed long with the same bits). Corners at +1 are clamped to the last pixel.

    Times before t0 or beyond 4096 slices have no id (null).
    """
    x, y = butterfly(lon, lat)
    part = lambda v: F.when(~F.isnan(v), F.when(v >= 1, F.lit(1023)).otherwise(F.floor((1 + v) * 512))).cast("long")
    out = F.shiftleft(part(x), 54).bitwiseOR(F.shiftleft(part(y), 44))
    if t is not None:
        slice_ = F.floor((t - t0) / dt).cast("long")
        out = F.when((slice_ >= 0) & (slice_ < 4096), out.bitwiseOR(F.shiftleft(slice_, 32)))
    return out if index is None else out.bitwiseOR(index.cast("long").bitwiseAND(F.lit(OBJECT_BITS)))


def cells_around(lon, lat, offsets: list[tuple[float, float]], level: int = LEVEL) -> Column:
    """Array of the static cells of points at ``offsets`` (Lambert plane) around a position, in steps of array transforms, so
    that the expressions stay small."""
    spots = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in offsets])

    def on_sky(p: Column) -> Column:
        x, y = lambert_inverse(p["a"], p["b"], lon, lat)
        return F.struct(x.alias("lon"), y.alias("lat"))

    def on_plane(p: Column) -> Column:
        x, y = butterfly(p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))

    def cell(p: Column) -> Column:
        part = lambda v: F.when(~F.isnan(v), F.when(v >= 1, F.lit(1023)).otherwise(F.floor((1 + v) * 512))).cast("long")
        return static_cell(cell_of_id(F.shiftleft(part(p["x"]), 54).bitwiseOR(F.shiftleft(part(p["y"]), 44)), level))

    return F.transform(F.transform(F.transform(spots, on_sky), on_plane), cell)


def near_border(lon: Column, lat: Column, level: int, margin: float) -> Column:
    """False only where a position's cell has no border within ``margin`` degrees.

    A radian on the sky is at most about half a unit of the pixel plane, so twice that is on the safe side; where the plane
    ends between two quarters, the other quarter's cell is across the edge.
    """
    size, reach = pix_size(level), math.radians(margin)
    x, y = butterfly(lon, lat)
    part = lambda v: (v + 1) / size - F.floor((v + 1) / size)
    close = lambda f: F.least(f, 1 - f) * size <= reach
    return close(part(x)) | close(part(y)) | (F.abs(F.abs(F.abs(x) - F.abs(y)) - 0.5) <= 2 * reach)


def circle(margin: float, points: int = 8) -> list[tuple[float, float]]:
    """Offsets in the Lambert plane of points on a circle of ``margin`` degrees."""
    r = 2 * math.sin(math.radians(margin) / 2)
    return [(r * math.cos(2 * math.pi * k / points), r * math.sin(2 * math.pi * k / points)) for k in range(points)]


def _cell_mask(level: int) -> int:
    keep = ((1 << level) - 1) << (10 - level)
    mask = (keep << 54) | (keep << 44) | (0xFFF << 32)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def cell_of_id(row_id: Column, level: int = LEVEL) -> Column:
    """Cell (pixel and time slice) of a row id: index bits all one, position bits below the level zero."""
    return row_id.bitwiseAND(F.lit(_cell_mask(level))).bitwiseOR(F.lit(OBJECT_BITS))


def static_cell(cell: Column) -> Column:
    """The cell without its time."""
    return cell.bitwiseAND(F.lit(~(0xFFF << 32)))


def is_cell(row_id: Column) -> Column:
    return row_id.bitwiseAND(F.lit(OBJECT_BITS)) == OBJECT_BITS


def is_temporal(cell: Column) -> Column:
    return _bits(cell, 32, 12) != 0


def id_in_cell(cell: Column, index: Column) -> Column:
    """Id of the index-th row of a cell."""
    return cell.bitwiseAND(F.lit(~OBJECT_BITS)).bitwiseOR(index.cast("long"))


def unpack_id(row_id: Column, level: int = LEVEL, t0: float = T0, dt: float = DT) -> Column:
    """struct(x, y, t, i): centre of the id's finest pixel (of its cell's pixel for a cell id), start of its slice, index."""
    coarse = 1 << (10 - level)

    def centre(at: int) -> Column:
        raw = _bits(row_id, at, 10)
        return F.when(is_cell(row_id), (F.floor(raw / coarse) + 0.5) * coarse).otherwise(raw + 0.5) / 512 - 1

    return F.struct(centre(54).alias("x"), centre(44).alias("y"), (_bits(row_id, 32, 12) * dt + t0).alias("t"), row_id.bitwiseAND(F.lit(OBJECT_BITS)).alias("i"))


def _short(c: Column) -> Column:
    """Signed decimal with six significant digits, without trailing zeros."""
    text = F.lit(None).cast("string")
    for low, digits in ((0.0, 10), (0.001, 8), (0.01, 7), (0.1, 6)):
        text = F.when(F.abs(c) >= low, F.format_string(f"%+.{digits}f", c)).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def cell_path(cell: Column, level: int = LEVEL, t0: float = T0, dt: float = DT) -> Column:
    """Text of a cell: the centres of its pixels from level 1 down, then 'static' or 'T<mjd>'."""
    parts = []
    for step in range(1, level + 1):
        size = 1 << (10 - step)
        centre = lambda at: (F.floor(_bits(cell, at, 10) / size) + 0.5) * (size / 512) - 1  # noqa: E731, B023
        parts.append(F.concat(_short(centre(54)), _short(centre(44))))
    slice_ = _bits(cell, 32, 12)
    last = F.when(slice_ == 0, F.lit("static")).otherwise(F.concat(F.lit("T"), F.format_string("%05d", F.round(slice_ * dt + t0).cast("long"))))
    return F.concat_ws("/", *parts, last)
