"""Exact distance of a position to a cell of the pixel plane."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _vectors(x: np.ndarray, y: np.ndarray, quarter: np.ndarray) -> np.ndarray:
    """Unit vectors of points of the pixel plane that belong to the given quarter, its borders included."""
    east, north = np.where(quarter < 2, -1.0, 1.0), np.where((quarter == 0) | (quarter == 3), 1.0, -1.0)
    u, v = (math.pi / 2) * (east * x + north * y), (math.pi / 2) * (east * y - north * x) + math.pi / 2
    polar, cap = np.abs(v) > math.pi / 4, np.maximum(2 - np.abs(v) * (4 / math.pi), 0)
    turn = np.clip(np.where(polar, u / np.maximum(cap, 1e-300), u), -math.pi / 4, math.pi / 4)
    z = np.where(polar, np.sign(v) * (1 - cap * cap / 3), v * (8 / (3 * math.pi)))
    rho = np.sqrt(np.where(polar, cap * cap / 3 * (2 - cap * cap / 3), np.maximum(1 - z * z, 0)))
    lon = (quarter + 0.5) * (math.pi / 2) + turn
    return np.stack([rho * np.cos(lon), rho * np.sin(lon), z], -1)


def border_distance(lon: np.ndarray, lat: np.ndarray, x: np.ndarray, y: np.ndarray, size: float) -> np.ndarray:
    """Degrees from positions to the borders of the cells whose low corners are (x, y): each side is searched by ever finer grids."""
    a, d = np.radians(lon), np.radians(lat)
    here = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], -1)[:, None, :]
    quarter = np.floor(np.mod(np.arctan2(y + size / 2, x + size / 2), 2 * math.pi) / (math.pi / 2)).clip(0, 3)[:, None]
    grid, best = np.linspace(-1, 1, 33), np.full(len(lon), np.inf)
    for along_x, far in ((True, 0), (True, 1), (False, 0), (False, 1)):
        middle, half = np.full(len(lon), 0.5), 0.5
        for _ in range(7):
            s = np.clip(middle[:, None] + half * grid, 0, 1)
            px, py = (s, far) if along_x else (far, s)
            gap = np.linalg.norm(_vectors(x[:, None] + size * px, y[:, None] + size * py, quarter) - here, axis=-1)
            k = gap.argmin(1)
            best, middle, half = np.minimum(best, gap.min(1)), s[np.arange(len(s)), k], half / 16
    return np.degrees(2 * np.arcsin(best / 2))


def within(lon: Column, lat: Column, cell: Column, level: int, margin: float) -> Column:
    """Whether the border of a static cell is at most ``margin`` degrees away."""
    size = 2.0 ** (1 - level)

    def near(lon: pd.Series, lat: pd.Series, cell: pd.Series) -> pd.Series:
        bits = cell.to_numpy(np.int64).view(np.uint64)
        low = [((bits >> np.uint64(at)) & np.uint64(1023)).astype(float) / 512 - 1 for at in (54, 44)]
        return pd.Series(border_distance(lon.to_numpy(float), lat.to_numpy(float), *low, size) <= margin)

    return F.pandas_udf(near, "boolean")(lon.cast("double"), lat.cast("double"), cell)
