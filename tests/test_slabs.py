"""Neighbours and regions against brute force."""

import numpy as np
import pandas as pd
import pytest

from skyframe.operators import slabs
from skyframe.plans import joins


def unit(ra, dec):
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)


def brute(ids, ra, dec, radius):
    p = unit(ra, dec)
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    i, j = np.where(d2 < (2 * np.sin(np.radians(radius) / 2)) ** 2)
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(i, j) if ids[a] != ids[b]}


def cloud(seed, n=500, spread=0.01):
    """Clusters on poles, face borders and the wrap of right ascension."""
    rng = np.random.default_rng(seed)
    at = [(0, 90), (10, -90), (0, 0), (45, 0), (45, 35.2643897), (135, -35.2643897), (359.999, 45), (90, 45), (200, 10), (225, 0)]
    c = np.array([at[k % len(at)] for k in range(n)], float)
    dec = np.clip(c[:, 1] + rng.normal(0, spread, n), -90, 90)
    ra = (c[:, 0] + rng.normal(0, spread, n) / np.maximum(np.cos(np.radians(np.minimum(np.abs(dec), 89.9))), 1e-3)) % 360
    ids = rng.permutation(np.arange(n) * 7 - n * 3)
    return ids, ra, dec


@pytest.mark.parametrize("radius", [0.002, 0.02, 3.0])
def test_pairs_match_brute_force(spark, radius):
    ids, ra, dec = cloud(1, spread=radius * 2)
    turned = ra + np.where(np.arange(len(ra)) % 5 == 0, 360, np.where(np.arange(len(ra)) % 7 == 0, -360, 0))
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "ra": turned, "dec": dec, "a": 1, "tile": "x", "x": 0.0}))
    got = [tuple(r) for r in slabs.near_pairs(df.union(df), "id", "ra", "dec", radius * 3600).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(ids, ra, dec, radius)


def test_unusable_rows_and_empty(spark):
    rows = [(1, 10.0, 10.0), (2, 10.0, 10.0), (3, None, 10.0), (4, float("nan"), 10.0), (5, 10.0, 95.0), (6, 10.0, None), (7, float("inf"), 10.0), (None, 10.0, 10.0), (1, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double")
    assert [tuple(r) for r in slabs.near_pairs(df, "id", "ra", "dec", 1.0).collect()] == [(1, 2)]
    assert slabs.near_pairs(df.limit(0), "id", "ra", "dec", 1.0).count() == 0
    with pytest.raises(ValueError):
        slabs.near_pairs(df, "id", "ra", "dec", 0)


def test_nearest_neighbours(spark):
    ids, ra, dec = cloud(2, 200, 1.0)
    ids2, ra2, dec2 = cloud(3, 200, 1.0)
    one = spark.createDataFrame(pd.DataFrame({"i": ids, "ra": ra, "dec": dec}))
    two = spark.createDataFrame(pd.DataFrame({"j": ids2, "ra": ra2, "dec": dec2}))
    got = {(r["a"], r["nr"]): r["b"] for r in joins.nearest(one, "i", ("ra", "dec"), two, "j", ("ra", "dec"), 3, 1.5).collect()}
    d = 2 * np.degrees(np.arcsin(np.sqrt(((unit(ra, dec)[:, None] - unit(ra2, dec2)[None]) ** 2).sum(axis=2)) / 2))
    want = {}
    for i in range(len(ids)):
        order = sorted((d[i, j], ids2[j]) for j in range(len(ids2)) if d[i, j] < 1.5)[:3]
        want |= {(ids[i], k): b for k, (_, b) in enumerate(order)}
    assert got == want


def test_regions_match_ray_casting(spark):
    rng = np.random.default_rng(4)
    pts = pd.DataFrame({"k": np.arange(400), "x": rng.uniform(0, 30, 400), "y": rng.uniform(0, 30, 400), "region": "taken"})
    polys, rows = {}, []
    for r in range(12):
        n, cx, cy = rng.integers(3, 9), *rng.uniform(3, 27, 2)
        t = np.sort(rng.uniform(0, 2 * np.pi, n))
        rad = rng.uniform(1, 6, n)
        polys[r] = np.stack([cx + rad * np.cos(t), cy + rad * np.sin(t)], axis=1)
        rows.append((r, [(float(a), float(b)) for a, b in polys[r]]))
    rows += [(100, [(1.0, 1.0), (2.0, 2.0)]), (101, None), (102, [(1.0, 1.0), (None, 2.0), (3.0, 1.0)])]
    regions = spark.createDataFrame(rows, "rid int, v array<struct<x: double, y: double>>")
    df = spark.createDataFrame(pts).drop("region")
    got = {(r["k"], r["region"]) for r in slabs.locate(df, "x", "y", regions, "rid", "v", 2.5).collect()}

    def inside(px, py, poly):
        odd = False
        for (a, b), (c, d) in zip(poly, np.roll(poly, -1, axis=0)):
            if (a <= px) != (c <= px) and b + (d - b) / (c - a) * (px - a) <= py:
                odd = not odd
        return odd

    want = {(k, r) for k, px, py in pts[["k", "x", "y"]].itertuples(index=False) for r, poly in polys.items() if inside(px, py, poly)}
    assert got == want
    assert slabs.locate(df.limit(0), "x", "y", regions, "rid", "v", 2.5).count() == 0
