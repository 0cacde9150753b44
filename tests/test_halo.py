"""Copies of rows in neighbouring cells against a dense sampling of the disc around each row."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skyframe.catalog.database import Database
from skyframe.functions import sky


def cells(lon, lat, level=6):
    """Static cells, as (x, y) numbers, by the forward formula of the pixel plane."""
    phi, z = np.mod(lon, 360), np.sin(np.radians(lat))
    quarter = np.minimum(np.floor(phi / 90), 3)
    along, polar = np.radians(phi - 90 * quarter - 45), np.abs(z) >= 2 / 3
    cap = 2 - np.sqrt(3 * (1 - np.abs(z)))
    u, v = np.where(polar, along * (2 - cap), along), np.where(polar, np.sign(z) * cap * math.pi / 4, z * 3 * math.pi / 8) - math.pi / 2
    e, n = np.where(quarter < 2, -1, 1), np.where((quarter == 0) | (quarter == 3), 1, -1)
    part = lambda w: np.minimum(np.floor((1 + w) * 512), 1023).astype(int) >> (10 - level)
    return part((u * e - v * n) / math.pi), part((u * n + v * e) / math.pi)


def disc(lon, lat, radius):
    """Cells of 720 directions on 4 circles within ``radius`` degrees."""
    t, r = (g.ravel() for g in np.meshgrid(np.arange(720) * math.pi / 360, math.radians(radius) * np.array([0.25, 0.5, 0.75, 1])))
    d, a = math.radians(lat), math.radians(lon)
    s = np.sin(d) * np.cos(r) + np.cos(d) * np.sin(r) * np.cos(t)
    b = a + np.arctan2(np.sin(t) * np.sin(r) * np.cos(d), np.cos(r) - np.sin(d) * s)
    return set(zip(*(c.tolist() for c in cells(np.degrees(b), np.degrees(np.arcsin(s))))))


def test_every_cell_within_the_margin_has_a_copy(spark, tmp_path):
    rng = np.random.default_rng(3)
    i, j = rng.integers(-31, 32, (2, 900))
    x, y = i / 32, j / 32
    keep = np.abs(np.abs(x) - np.abs(y)) <= 0.5
    x, y = x[keep], np.where(rng.random(900) < 0.5, y, y + rng.random(900) / 32)[keep]
    near = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).select(*[c.alias(n) for n, c in zip(("ra", "dec"), sky.butterfly_inverse(F.col("x"), F.col("y")))]).toPandas().dropna()
    step = rng.uniform(20, 34, len(near)) / 3600
    turn = rng.uniform(0, 2 * math.pi, len(near))
    dec = near["dec"] + step * np.sin(turn)
    rows = pd.DataFrame({"k": np.arange(len(near)), "ra": (near["ra"] + step * np.cos(turn) / np.cos(np.radians(dec))) % 360, "dec": dec})[np.abs(dec) < 89]
    db = Database(spark, [str(tmp_path / "db")])
    db.register("points", spark.createDataFrame(rows), primary_key="k", spatial_keys=["ra", "dec"])
    got = {k: set() for k in rows["k"]}
    for r in db.query("k, _CELLID AS cell, _CACHED AS cached FROM points").dataframe(include_cached=True).where("cached").collect():
        got[r["k"]].add((((r["cell"] >> 54) & 1023) >> 4, ((r["cell"] >> 44) & 1023) >> 4))
    for k, ra, dec in rows.itertuples(index=False):
        own = set(zip(*(c.tolist() for c in cells(np.array([ra]), np.array([dec])))))
        assert disc(ra, dec, 29.999 / 3600) - own <= got[k] <= disc(ra, dec, 30.3 / 3600) - own, (k, ra, dec)
    assert sum(map(len, got.values())) > 300
