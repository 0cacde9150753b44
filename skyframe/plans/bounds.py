"""Regions of the sky and of time: exact row tests as Columns, and the pixels a region can touch for pruning."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe.functions import pixels, sky


class Region:
    """Part of the sky. ``test``: exact Column; ``contains``: exact numpy; ``near``: numpy, true wherever a point of the
    region can lie within ``margin`` degrees."""

    def test(self, lon: Column, lat: Column) -> Column:
        raise NotImplementedError

    def contains(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def near(self, lon: np.ndarray, lat: np.ndarray, margin: float) -> np.ndarray:
        raise NotImplementedError

    def covers(self, lon: np.ndarray, lat: np.ndarray, margin: float) -> np.ndarray:
        """True only where the disc of ``margin`` degrees lies wholly inside."""
        return np.zeros(np.shape(lon), bool)


class AllSky(Region):
    def test(self, lon, lat):
        return F.lit(True)

    def contains(self, lon, lat):
        return np.ones(np.shape(lon), bool)

    def near(self, lon, lat, margin):
        return np.ones(np.shape(lon), bool)

    def covers(self, lon, lat, margin):
        return np.ones(np.shape(lon), bool)


ALLSKY = AllSky()


class Beam(Region):
    """Points closer than ``radius`` degrees to (lon, lat)."""

    def __init__(self, lon: float, lat: float, radius: float = 1.0, coordsys: str = "equ"):
        if coordsys == "gal":
            lon, lat = pixels.galequ(lon, lat)
        elif coordsys != "equ":
            raise ValueError(f"unknown coordinate system {coordsys!r}")
        self.lon, self.lat, self.radius = float(lon), float(lat), float(radius)

    def test(self, lon, lat):
        return F.coalesce(sky.gc_dist(lon, lat, self.lon, self.lat) < self.radius, F.lit(False)) & ~F.isnan(lon) & ~F.isnan(lat)

    def contains(self, lon, lat):
        return pixels.gc_dist(lon, lat, self.lon, self.lat) < self.radius

    def near(self, lon, lat, margin):
        return pixels.gc_dist(lon, lat, self.lon, self.lat) < self.radius + margin

    def covers(self, lon, lat, margin):
        return pixels.gc_dist(lon, lat, self.lon, self.lat) + margin < self.radius


class Rectangle(Region):
    """lon0 <= lon <= lon1 (through 360 if lon0 > lon1) and lat0 <= lat <= lat1; in galactic coordinates with 'gal'."""

    def __init__(self, lon0: float, lat0: float, lon1: float, lat1: float, coordsys: str = "equ"):
        if coordsys not in ("equ", "gal"):
            raise ValueError(f"unknown coordinate system {coordsys!r}")
        self.full = lon1 - lon0 >= 360
        self.lon0, self.lat0, self.lon1, self.lat1, self.coordsys = lon0 % 360, lat0, lon1 % 360, lat1, coordsys

    def test(self, lon, lat):
        usable = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
        if self.coordsys == "gal":
            c = sky.equgal(lon, lat)
            lon, lat = c["l"], c["b"]
        x = F.pmod(lon, F.lit(360.0))
        wide = F.lit(True) if self.full else x.between(self.lon0, self.lon1) if self.lon0 <= self.lon1 else (x >= self.lon0) | (x <= self.lon1)
        return usable & wide & lat.between(self.lat0, self.lat1)

    def _inside(self, lon, lat, grow):
        if self.coordsys == "gal":
            lon, lat = pixels.equgal(lon, lat)
        lon, lat = np.asarray(lon) % 360, np.asarray(lat)
        high = np.minimum(np.abs(lat) + abs(grow), 90)
        side = np.where(high < 89.9, grow / np.maximum(np.cos(np.radians(high)), 1e-9), 360.0 * np.sign(grow))
        span = 360.0 if self.full else (self.lon1 - self.lon0) % 360
        off = (lon - (self.lon0 - side)) % 360
        wide = (span + 2 * side >= 360) | ((off <= span + 2 * side) & (span + 2 * side >= 0))
        return wide & (lat >= self.lat0 - grow) & (lat <= self.lat1 + grow)

    def contains(self, lon, lat):
        return self._inside(lon, lat, 0.0)

    def near(self, lon, lat, margin):
        return self._inside(lon, lat, margin)

    def covers(self, lon, lat, margin):
        return self._inside(lon, lat, -margin)


class SkyPolygon(Region):
    """Polygon through vertices (lon, lat), tested in the pixel plane; one that runs clockwise there is its outside."""

    def __init__(self, lon: Iterable[float], lat: Iterable[float], coordsys: str = "equ"):
        lon, lat = np.asarray(list(lon), float), np.asarray(list(lat), float)
        if len(lon) < 3 or len(lon) != len(lat):
            raise ValueError("a polygon needs three vertices or more")
        if coordsys == "gal":
            lon, lat = pixels.galequ(lon, lat)
        self.lon, self.lat = lon, lat
        self.x, self.y = pixels.butterfly(lon, lat)
        nx, ny = np.roll(self.x, -1), np.roll(self.y, -1)
        self.inverted = float((self.x * ny - nx * self.y).sum()) < 0

    def test(self, lon, lat):
        px, py = sky.butterfly(lon, lat)
        ends = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("c"), F.lit(float(d)).alias("d")) for a, b, c, d in zip(self.x, self.y, np.roll(self.x, -1), np.roll(self.y, -1)) if b != d])
        hit = lambda e: ((e["b"] <= py) != (e["d"] <= py)) & (px < e["a"] + (e["c"] - e["a"]) * (py - e["b"]) / (e["d"] - e["b"]))
        odd = F.size(F.filter(ends, hit)) % 2 == 1
        return px.isNotNull() & ~F.isnan(px) & (~odd if self.inverted else odd)

    def contains(self, lon, lat):
        px, py = pixels.butterfly(np.asarray(lon, float), np.asarray(lat, float))
        odd = np.zeros(np.shape(px), bool)
        for a, b, c, d in zip(self.x, self.y, np.roll(self.x, -1), np.roll(self.y, -1)):
            if b != d:
                odd ^= ((b <= py) != (d <= py)) & (px < a + (c - a) * (py - b) / (d - b))
        return ~odd if self.inverted else odd

    def near(self, lon, lat, margin):
        if self.inverted:
            return np.ones(np.shape(lon), bool)
        close = self.contains(lon, lat)
        step = max(margin / 4, 0.05)
        for k in range(len(self.lon)):  # the border, sampled along the straight lines of the plane
            x1, y1 = self.x[(k + 1) % len(self.x)], self.y[(k + 1) % len(self.y)]
            n = max(2, int(math.hypot(x1 - self.x[k], y1 - self.y[k]) * 120 / step))
            t = np.linspace(0, 1, n)
            blon, blat = pixels.butterfly_inverse(self.x[k] + (x1 - self.x[k]) * t, self.y[k] + (y1 - self.y[k]) * t)
            for a, b in zip(blon, blat):
                close |= pixels.gc_dist(lon, lat, a, b) < margin + step
        return close


class IntervalSet:
    """Disjoint closed intervals of numbers."""

    def __init__(self, *intervals: tuple[float, float]):
        self.parts: list[tuple[float, float]] = []
        for i in intervals:
            self.add(i)

    def add(self, interval: tuple[float, float]) -> None:
        low, high = map(float, interval)
        if low > high:
            raise ValueError("an interval's start is after its end")
        apart = [p for p in self.parts if p[1] < low or p[0] > high]
        joined = [p for p in self.parts if not (p[1] < low or p[0] > high)]
        self.parts = sorted([*apart, (min([low, *(p[0] for p in joined)]), max([high, *(p[1] for p in joined)]))])

    def __or__(self, other: IntervalSet) -> IntervalSet:
        return IntervalSet(*self.parts, *other.parts)

    def __and__(self, other: IntervalSet) -> IntervalSet:
        out = [(max(a, c), min(b, d)) for a, b in self.parts for c, d in other.parts if max(a, c) <= min(b, d)]
        return IntervalSet(*out)

    intersect = __and__

    def is_inside(self, x) -> np.ndarray | bool:
        starts = [p[0] for p in self.parts]
        one = lambda v: bool(starts) and (k := bisect_right(starts, v)) > 0 and v <= self.parts[k - 1][1]
        return np.array([one(v) for v in x]) if np.ndim(x) else one(x)

    def distance(self, x: float, to_outside: bool = False) -> float:
        """0 inside; else to the nearest end. ``to_outside``: inside, the distance to the nearest end as a negative number."""
        if not self.parts:
            return math.inf
        ends = min(abs(x - e) for p in self.parts for e in p)
        return (-ends if to_outside else 0.0) if self.is_inside(x) else ends

    def test(self, t: Column) -> Column:
        """Column test; null and NaN are outside."""
        out = F.lit(False)
        for a, b in self.parts:
            out = out | F.coalesce(t.between(F.lit(a), F.lit(b)) & ~F.isnan(t), F.lit(False))
        return out

    def overlaps(self, low: float, high: float) -> bool:
        """Whether any part meets the half-open [low, high)."""
        return any(a < high and b >= low for a, b in self.parts)

    def __iter__(self):
        return iter(self.parts)

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, k):
        return self.parts[k]

    def __eq__(self, other) -> bool:
        return isinstance(other, IntervalSet) and self.parts == other.parts

    def __repr__(self) -> str:
        return f"IntervalSet({', '.join(map(str, self.parts))})"


def beam(lon: float, lat: float, radius: float = 1.0, coordsys: str = "equ") -> Beam:
    return Beam(lon, lat, radius, coordsys)


def rectangle(lon0: float, lat0: float, lon1: float, lat1: float, coordsys: str = "equ") -> Rectangle:
    return Rectangle(lon0, lat0, lon1, lat1, coordsys)


def polygon(lon, lat, coordsys: str = "equ") -> SkyPolygon:
    return SkyPolygon(lon, lat, coordsys)


def T(*args) -> IntervalSet:  # noqa: N802  the name users type
    """Times: T(t0, t1) is one interval, T((a, b), (c, d)) several, T(t) a single moment."""
    if len(args) == 2 and not any(np.ndim(a) for a in args):
        return IntervalSet(args)
    return IntervalSet(*[tuple(a) if np.ndim(a) else (a, a) for a in args])


class Padded(Region):
    """Where a point within ``margin`` degrees of the region can lie; for pruning only."""

    def __init__(self, region: Region, margin: float):
        self.region, self.margin = region, margin

    def near(self, lon, lat, margin):
        return self.region.near(lon, lat, margin + self.margin)


class Bounds:
    """Alternatives (regions, times) and whole cells; a row is in if any alternative holds it, or its cell is listed."""

    def __init__(self, parts: list[tuple[list[Region], IntervalSet | None]], cells: list[int]):
        self.parts, self.cells = parts, cells

    def test(self, lon: Column | None, lat: Column | None, times: list[Column], cell: Column | None = None) -> Column:
        """Each alternative: (in any of its regions) and every time that is not null within its intervals."""
        out = F.lit(False)
        for regions, interval in self.parts:
            here = F.lit(True)
            if lon is not None and not any(isinstance(r, AllSky) for r in regions):
                here = F.lit(False)
                for r in regions:
                    here = here | r.test(lon, lat)
            if interval is not None:
                for t in times:
                    here = here & (t.isNull() | interval.test(t))
            out = out | here
        if self.cells and cell is not None:
            out = out | cell.isin(self.cells)
        return out

    def static_pixels(self, level: int = sky.LEVEL) -> tuple[list[int], list[int]] | None:
        """Static cells that can hold rows, and those of them that lie wholly inside; None: no restriction."""
        if any(any(isinstance(r, AllSky) for r in regions) for regions, _ in self.parts):
            return None
        touched, whole = set(), set()
        for regions, interval in self.parts:
            for r in regions:
                near, inside = pixels.cells_in(r, level)
                touched |= set(near)
                if interval is None:
                    whole |= set(inside)
        mask = ~(0xFFF << 32)
        for c in self.cells:
            touched.add(c & mask)
        return sorted(touched), sorted(whole)

    def padded(self, margin: float | None, times: bool) -> Bounds | None:
        """What a joined table can be pruned by: its rows lie within ``margin`` degrees of a row in bounds (None: anywhere),
        and, with ``times``, within the intervals. None: no restriction."""
        if self.cells:
            return None
        wide = lambda r: r if isinstance(r, AllSky) else Padded(r, margin)
        return Bounds([([ALLSKY] if margin is None else [wide(r) for r in regions], i if times else None) for regions, i in self.parts], [])

    def time_overlaps(self, low: float, high: float) -> bool:
        return any(i is None or i.overlaps(low, high) for _, i in self.parts) or bool(self.cells)


def make_canonical(bounds) -> Bounds | None:
    """Bounds of a region, an IntervalSet, a (t0, t1) pair, a cell id, a tuple of regions and times, or a list of these.

    Regions and times that stand alone in a list form one alternative together; each tuple is one of its own. None and []
    are the whole sky at all times (None).
    """
    if bounds is None or (isinstance(bounds, list) and not bounds):
        return None
    entries = bounds if isinstance(bounds, list) else [bounds]
    loose, groups, cells = [], [], []
    for e in entries:
        if isinstance(e, (Region, IntervalSet)):
            loose.append(e)
        elif isinstance(e, (tuple, list)):
            groups.append([IntervalSet(tuple(e))] if len(e) == 2 and all(isinstance(v, (int, float)) for v in e) else list(e))
        elif isinstance(e, (int, np.integer)):
            v = int(e) & ((1 << 64) - 1)
            cells.append(v - (1 << 64) if v >= 1 << 63 else v)
        else:
            raise ValueError(f"not a bound: {e!r}")
    parts = []
    for group in ([loose] if loose else []) + groups:
        regions = [g for g in group if isinstance(g, Region)]
        times = None
        for g in group:
            if isinstance(g, (tuple, list)):
                g = IntervalSet(tuple(g))
            if isinstance(g, IntervalSet):
                times = g if times is None else times | g
            elif not isinstance(g, Region):
                raise ValueError(f"not a bound: {g!r}")
        parts.append((regions or [ALLSKY], times))
    return Bounds(parts, cells)
