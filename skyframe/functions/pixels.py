"""The pixel plane on the driver (numpy): for bounds, neighbour tables and tests. Same geometry as functions.sky."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from skyframe.functions.sky import DT, GALACTIC_AXES, LEVEL, OBJECT_BITS, T0, pix_size

EAST, NORTH = np.array([-1, -1, 1, 1]), np.array([1, -1, -1, 1])


def gc_dist(lon1, lat1, lon2, lat2):
    a = np.sin(np.radians(np.subtract(lat1, lat2)) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(np.subtract(lon1, lon2)) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(a, 0, 1))))


def _turn(matrix, lon, lat):
    a, d = np.radians(lon), np.radians(lat)
    x, y, z = matrix @ np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)]).reshape(3, -1)
    out = np.degrees(np.arctan2(y, x)) % 360, np.degrees(np.arcsin(np.clip(z, -1, 1)))
    return tuple(o.reshape(np.shape(lon)) if np.ndim(lon) else float(o[0]) for o in out)


_TO_GAL = np.array(GALACTIC_AXES)


def equgal(ra, dec):
    return _turn(_TO_GAL, ra, dec)


def galequ(lon, lat):
    return _turn(_TO_GAL.T, lon, lat)


def butterfly(lon, lat):
    phi = np.mod(lon, 360.0)
    quarter = np.minimum((phi // 90).astype(int) if np.ndim(phi) else int(phi // 90), 3)
    along = np.radians(phi - 90 * quarter - 45)
    z = np.sin(np.radians(lat))
    cap = 2 - np.sqrt(3 * (1 - np.abs(z)))
    polar = np.abs(z) >= 2 / 3
    u = np.where(polar, along * (2 - cap), along)
    v = np.where(polar, np.sign(z) * cap * math.pi / 4, z * 3 * math.pi / 8) - math.pi / 2
    return (u * EAST[quarter] - v * NORTH[quarter]) / math.pi, (u * NORTH[quarter] + v * EAST[quarter]) / math.pi


def butterfly_inverse(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    turn = np.arctan2(y, x)
    quarter = np.minimum((np.where(turn > 0, turn, turn + 2 * math.pi) // (math.pi / 2)).astype(int), 3)
    u = math.pi / 2 * (EAST[quarter] * x + NORTH[quarter] * y)
    v = math.pi / 2 * (EAST[quarter] * y - NORTH[quarter] * x) + math.pi / 2
    polar = np.abs(v) > math.pi / 4
    cap = 2 - np.abs(v) * 4 / math.pi
    u = np.where(polar, np.where(cap > 1e-12, u / np.where(cap > 1e-12, cap, 1), 0), u)
    z = np.where(polar, np.sign(v) * (1 - cap * cap / 3), v * 8 / (3 * math.pi))
    return np.degrees(u + (quarter + 0.5) * math.pi / 2), np.degrees(np.arcsin(np.clip(z, -1, 1)))


def valid(x, y) -> np.ndarray:
    """Whether a point of the square lies on the sphere's part of it (its border included)."""
    x, y = np.abs(x), np.abs(y)
    return (np.abs(x - y) <= 0.5) & (x <= 1) & (y <= 1)


@lru_cache(maxsize=16)
def pixel_centres(level: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of all pixels that lie on the sphere, half pixels included."""
    size = pix_size(level)
    c = -1 + size * (np.arange(1 << level) + 0.5)
    x, y = np.meshgrid(c, c, indexing="ij")
    ok = np.abs(np.abs(x) - np.abs(y)) <= 0.5
    return x[ok], y[ok]


def static_cell_ids(x, y, level: int = LEVEL) -> np.ndarray:
    """Cell ids (signed) of pixels by their centres."""
    drop = (1 << (10 - level)) - 1
    ix = ((np.asarray(x) + 1) * 512).astype(np.uint64) & np.uint64(1023 ^ drop)
    iy = ((np.asarray(y) + 1) * 512).astype(np.uint64) & np.uint64(1023 ^ drop)
    return ((ix << np.uint64(54)) | (iy << np.uint64(44)) | np.uint64(OBJECT_BITS)).astype(np.int64)


def pixel_radius(level: int) -> float:
    """Degrees: no point of a pixel is farther from the pixel's centre. A side is at most 1.3 times the root of the area."""
    return 1.6 * math.sqrt(129600 / math.pi / 0.75) / (1 << level)


def cells_in(region, level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Cells that can hold points of the region, and those wholly inside it; pixels are sifted from coarse to fine."""
    coarse = min(level, 3)
    x, y = pixel_centres(coarse)
    for step in range(coarse, level + 1):
        size = pix_size(step)
        # a half pixel's centre can lie off the sphere's part: move it onto it
        cx, cy = _onto(x, y)
        lon, lat = butterfly_inverse(cx, cy)
        keep = region.near(lon, lat, pixel_radius(step))
        x, y, lon, lat = x[keep], y[keep], lon[keep], lat[keep]
        if step < level:
            q = size / 4
            x, y = np.concatenate([x - q, x - q, x + q, x + q]), np.concatenate([y - q, y + q, y - q, y + q])
            ok = np.abs(np.abs(x) - np.abs(y)) <= 0.5
            x, y = x[ok], y[ok]
    ids = static_cell_ids(x, y, level)
    return ids, ids[region.covers(lon, lat, pixel_radius(level))]


def _onto(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    over = np.abs(np.abs(x) - np.abs(y)) - 0.5
    pull = np.where(over >= 0, over + 1e-9, 0.0)
    wide = np.abs(x) > np.abs(y)
    return np.where(wide, x - np.sign(x) * pull, x), np.where(~wide, y - np.sign(y) * pull, y)


@lru_cache(maxsize=8)
def adjacency(level: int = LEVEL) -> dict[int, frozenset[int]]:
    """Static cell → the cells that share an edge or corner with it on the sphere (itself not among them).

    Found geometrically: points just outside a pixel's border are projected to the sphere and back, which crosses the
    borders between the quarters and the poles correctly. A half pixel's two pieces count as neighbours.
    """
    x, y = pixel_centres(level)
    size = pix_size(level)
    ids = static_cell_ids(x, y, level)
    found: dict[int, set[int]] = {int(i): set() for i in ids}
    t = np.linspace(-0.999, 0.999, 9) * size / 2
    edge = [(d, e) for e in (-size / 2 * 0.999, size / 2 * 0.999) for d in t] + [(e, d) for e in (-size / 2 * 0.999, size / 2 * 0.999) for d in t]
    for dx, dy in edge:
        px, py = x + dx, y + dy
        inside = np.abs(np.abs(px) - np.abs(py)) < 0.5
        lon, lat = butterfly_inverse(px[inside], py[inside])
        far = size * 90 * 0.02
        for k in range(8):
            a = 2 * math.pi * k / 8
            lat2 = lat + far * math.sin(a)
            over = np.abs(lat2) > 90
            lat2 = np.where(over, np.sign(lat2) * 180 - lat2, lat2)
            lon2 = lon + far * math.cos(a) / np.maximum(np.cos(np.radians(lat)), 1e-3) + np.where(over, 180, 0)
            qx, qy = butterfly(lon2, lat2)
            other = static_cell_ids(np.clip(qx, -1, 1 - 1e-9), np.clip(qy, -1, 1 - 1e-9), level)
            for c, o in zip(ids[inside], other):
                if c != o and int(o) in found:
                    found[int(c)].add(int(o))
                    found[int(o)].add(int(c))
    return {c: frozenset(o) for c, o in found.items()}


def pixel_level(size: float) -> int:
    """Level of the pixels with this side in the pixel plane."""
    level = round(1 - math.log2(size))
    if level < 0 or not math.isclose(pix_size(level), size, rel_tol=1e-9):
        raise ValueError(f"no level has pixels of {size}")
    return level


def cell_polygon(cell: int, level: int = LEVEL, t0: float = T0, dt: float = DT) -> tuple[list[tuple[float, float]], tuple[float, float] | None]:
    """Corners of a cell in the pixel plane (counterclockwise; three where it is a half pixel), and its time interval."""
    bits = int(cell) & ((1 << 64) - 1)
    size = pix_size(level)
    x, y = (((bits >> at) & 1023) // (1 << (10 - level)) * size - 1 for at in (54, 44))
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    inside = [c for c in corners if valid(*c)]
    slice_ = (bits >> 32) & 0xFFF
    return inside, (t0 + slice_ * dt, t0 + (slice_ + 1) * dt) if slice_ else None
