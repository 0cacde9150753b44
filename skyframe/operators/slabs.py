"""Points near other points, and points in regions, by trapezoidal decomposition.

Method: the borders of the regions are cut at vertical lines into slabs, in which their edges are ordered; slabs are
distributed over the cluster and a point is located by binary search among the edges of its own slab.

``near_pairs`` gives every point a region (a box around its disc, on one of six faces of a cube around the sphere, so that
poles and the wrap of right ascension are nothing special). A face is divided into tiles, which are the unit of
distribution; inside a tile the slabs are as wide as one region, so a region's lower and upper edge lie in at most two
slabs. ``locate`` does the same for polygons in the plane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.session import small

ARCSEC = math.pi / 180 / 3600
#: (main axis, sign, axis of u, axis of v)
FACES = [("x", 1, "y", "z"), ("x", -1, "y", "z"), ("y", 1, "z", "x"), ("y", -1, "z", "x"), ("z", 1, "x", "y"), ("z", -1, "x", "y")]
#: Regions along a tile's side, and the side in radians beyond which there are fewer: wide regions must not make a few huge
#: tiles. A region goes to (1 + 1 / regions)^2 tiles on average.
TILE_REGIONS, TILE_SIDE = 16, 0.15


def tile_regions(half: float) -> int:
    return max(1, min(TILE_REGIONS, int(TILE_SIDE / (2 * half))))


def sky_points(df: DataFrame, id_col: str, ra: str, dec: str) -> DataFrame:
    """Distinct (id, x, y, z) unit vectors. ra counts modulo 360; null, NaN or infinite coordinates, |dec| > 90 and null ids
    take no part. Redelivered rows are combined before the shuffle (positions equal to 1e-9 degrees are one)."""
    own, lon, lat = F.col(f"`{id_col}`"), F.col(f"`{ra}`").cast("double"), F.col(f"`{dec}`").cast("double")
    good = df.where(own.isNotNull() & lon.isNotNull() & ~F.isnan(lon) & (F.abs(lon) < F.lit(float("inf"))) & lat.between(-90.0, 90.0))
    once = good.select(own.alias("id"), F.round(F.pmod(lon, F.lit(360.0)), 9).alias("lon"), F.round(lat, 9).alias("lat")).distinct()
    a, d = F.radians("lon"), F.radians("lat")
    return once.select("id", (F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z"))


def half_width(radius: float) -> float:
    """Half the side of a box on a face that holds a disc of ``radius`` (radians). An angle seen along a face's coordinate is
    1 / cos(latitude) times as long, and the disc of a point on the face reaches latitude 45 degrees + radius."""
    if not 0 < radius < 0.12:
        raise ValueError("the radius must be above 0 and below seven degrees")
    return radius * 1.0001 / math.cos(math.pi / 4 + radius)


def _tiles(points: DataFrame, half: float) -> DataFrame:
    """One row per point and tile that its region touches: tile, v, id, home, x, y, z. home: the point itself is there."""
    width = 2 * half * tile_regions(half)
    limit = math.pi / 4 + half
    biggest = F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))
    home: Column = F.lit(-1)
    for k, (axis, sign, _, _) in reversed(list(enumerate(FACES))):
        home = F.when(F.col(axis) * sign == biggest, k).otherwise(home)
    spots = []
    for k, (axis, sign, b, c) in enumerate(FACES):
        main = F.col(axis) * sign
        u, v = F.atan2(F.col(b), main), F.atan2(F.col(c), main)
        near = (main > 0.3) & (F.abs(F.col(b)) <= main * math.tan(limit)) & (F.abs(F.col(c)) <= main * math.tan(limit))
        spots.append(F.when(near, F.struct(F.lit(k).alias("face"), u.alias("u"), v.alias("v"))))
    faced = points.withColumn("_home", home).withColumn("_spot", F.explode(F.array_compact(F.array(*spots)))).select(*points.columns, "_home", "_spot.*")
    cell = lambda e: F.floor((e + 2) / width).cast("long")  # noqa: E731  u and v lie within (-1.5, 1.5)
    span = lambda c: F.sequence(cell(F.col(c) - half), cell(F.col(c) + half))
    tiled = faced.withColumn("_i", F.explode(span("u"))).withColumn("_j", F.explode(span("v")))
    at_home = (F.col("face") == F.col("_home")) & (F.col("_i") == cell(F.col("u"))) & (F.col("_j") == cell(F.col("v")))
    side = int(4 / width) + 2
    tile = (F.col("face").cast("long") * side + F.col("_i")) * side + F.col("_j")
    return tiled.select(tile.alias("tile"), "v", at_home.alias("home"), F.col("face").cast("int").alias("face"), *points.columns)


def _locate_in_slabs(half: float, chord2: float, two_sided: bool = False, most: int = 4_000_000):
    """Kernel over rows sorted by (tile, v). Rows that later regions can still reach are carried from batch to batch.

    One-sided: pairs of different ids. Two-sided: pairs of a row with side 0 and one with side 1, with their chord.
    """
    axes = {"x": 0, "y": 1, "z": 2}
    face_u = np.array([axes[b] for _, _, b, _ in FACES])
    face_m = np.array([axes[a] for a, _, _, _ in FACES])
    face_s = np.array([s for _, s, _, _ in FACES], dtype=float)
    slabs = 2 * TILE_REGIONS * 2  # more than a tile and its border have
    unit = 2.0**-36

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            fresh = 0 if kept is None else len(kept)
            tile, v, ids, home = (rows[c].to_numpy() for c in ("tile", "v", "id", "home"))
            xyz = rows[["x", "y", "z"]].to_numpy()
            face = rows["face"].to_numpy()
            side = rows["side"].to_numpy() if two_sided else None
            at = np.arange(len(rows))
            u = np.arctan2(xyz[at, face_u[face]], xyz[at, face_m[face]] * face_s[face])
            number = np.cumsum(np.r_[0, tile[1:] != tile[:-1]]).astype(np.int64)
            # slab borders every 2 * half; a region [u - half, u + half] is cut at the border it crosses
            slab = np.floor((u + 2) / (2 * half)).astype(np.int64)
            low = np.floor((u - half + 2) / (2 * half)).astype(np.int64)
            first = np.full(number[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, number, low)
            key = lambda s, h: ((number * slabs + (s - first[number])) << 37) | ((h + 2) / 4 / unit).astype(np.int64)
            edges = np.concatenate([key(low, v), key(low + 1, v)])
            owner = np.concatenate([at, at])
            order = np.argsort(edges, kind="stable")
            edges, owner = edges[order], owner[order]
            start = np.searchsorted(edges, key(slab, v - half) - 1, "left")[fresh:]
            stop = np.searchsorted(edges, key(slab, v), "right")[fresh:]
            ends = np.cumsum(stop - start)
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
                count = (stop - start)[a:b]
                point = np.repeat(np.arange(a, b) + fresh, count)
                offset = np.arange(len(point)) - np.repeat(np.cumsum(count) - count, count)
                region = owner[np.repeat(start[a:b], count) + offset]
                ok = (region < point) & (np.abs(u[region] - u[point]) <= half)
                ok &= (side[region] != side[point]) if two_sided else (ids[region] != ids[point])
                region, point = region[ok], point[ok]
                # a pair is found in every tile that both touch; it counts in the home tile of its first member
                first_is_region = side[region] < side[point] if two_sided else ids[region] < ids[point]
                a_row, b_row = np.where(first_is_region, region, point), np.where(first_is_region, point, region)
                d = xyz[region] - xyz[point]
                d2 = (d * d).sum(axis=1)
                ok = home[a_row] & (d2 < chord2)
                if ok.any():
                    out = {"a": ids[a_row[ok]], "b": ids[b_row[ok]]}
                    yield pd.DataFrame({**out, "d2": d2[ok]} if two_sided else out)
                a = b
            kept = rows[(tile == tile[-1]) & (v >= v[-1] - half * 1.001)]

    return kernel


def near_pairs(df: DataFrame, id_col: str, ra: str, dec: str, radius_arcsec: float) -> DataFrame:
    """All pairs of different ids closer than ``radius_arcsec`` on the sphere: a < b (as signed longs), each pair once.

    Points with unusable coordinates take no part (see sky_points). A tile is 32 region half-widths wide (45" for 1"), so
    even one that held a third of all rows is only as much work as the pairs in it; it is swept in order of v and only the
    rows within reach are kept in memory. Radius: below seven degrees.
    """
    radius = radius_arcsec * ARCSEC
    half = half_width(radius)
    rows = _tiles(sky_points(df, id_col, ra, dec), half).repartition("tile").sortWithinPartitions("tile", "v")
    chord2 = (2 * math.sin(radius / 2)) ** 2
    return rows.mapInPandas(_locate_in_slabs(half, chord2), "a long, b long").distinct()


def neighbours(left: DataFrame, left_id: str, left_ra: str, left_dec: str, right: DataFrame, right_id: str, right_ra: str, right_dec: str, radius: float) -> DataFrame:
    """All pairs of a left and a right row closer than ``radius`` degrees: a (left id), b (right id), dist (degrees).

    Same tiles and slabs as near_pairs; ids are longs, and rows with the same id and position count once. Left rows are
    points of their own tile only in the sense that a pair counts there; right rows go to every tile their region touches.
    """
    angle = math.radians(radius)
    half = half_width(angle)
    points = sky_points(left, left_id, left_ra, left_dec).withColumn("side", F.lit(0)).unionByName(sky_points(right, right_id, right_ra, right_dec).withColumn("side", F.lit(1)))
    rows = _tiles(points, half).where("side = 1 OR home").repartition("tile").sortWithinPartitions("tile", "v")
    chord2 = (2 * math.sin(angle / 2)) ** 2
    found = rows.mapInPandas(_locate_in_slabs(half, chord2, True), "a long, b long, d2 double")
    return found.select("a", "b", F.degrees(2 * F.asin(F.least(F.sqrt("d2") / 2, F.lit(1.0)))).alias("dist"))


def _search_polygon(xs: np.ndarray, ys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Inside test of points against one simple polygon's edges (x0, y0, x1, y1; x0 < x1) by sub-slabs and binary search."""
    cuts = np.unique(edges[:, [0, 2]])
    sub = np.searchsorted(cuts, xs, "right") - 1
    inside = np.zeros(len(xs), bool)
    order = np.argsort(sub, kind="stable")
    begin = np.searchsorted(sub[order], np.arange(len(cuts)))
    stop = np.r_[begin[1:], len(order)]
    for s in range(len(cuts) - 1):
        who = order[begin[s] : stop[s]]
        if not len(who):
            continue
        crossing = edges[(edges[:, 0] <= cuts[s]) & (edges[:, 2] >= cuts[s + 1])]
        slope = (crossing[:, 3] - crossing[:, 1]) / (crossing[:, 2] - crossing[:, 0])
        middle = crossing[:, 1] + slope * ((cuts[s] + cuts[s + 1]) / 2 - crossing[:, 0])
        rank = np.argsort(middle, kind="stable")
        crossing, slope = crossing[rank], slope[rank]
        left, right = np.zeros(len(who), int), np.full(len(who), len(crossing))
        while (open_ := left < right).any():  # all points' binary searches at once
            mid = (left + right) // 2
            e = np.minimum(mid, len(crossing) - 1)
            below = crossing[e, 1] + slope[e] * (xs[who] - crossing[e, 0]) <= ys[who]
            left, right = np.where(open_ & below, mid + 1, left), np.where(open_ & ~below, mid, right)
        inside[who] = left % 2 == 1
    return inside


def locate(points: DataFrame, x: str, y: str, regions: DataFrame, region_id: str, vertices: str, slab: float, salts: int = 4, salt_rows: int = 200_000) -> DataFrame:
    """The regions that contain each point: all columns of ``points`` plus ``region``; a point in none has no row.

    ``regions``: simple polygons in the plane, ``vertices`` an array of struct<x, y> without the closing point; they may
    overlap each other. A point counts as inside on a lower and left border, not on an upper and right one. Points or
    vertices with null or NaN take no part; polygons with fewer than three vertices or no area contain nothing. Edges
    are cut at multiples of ``slab``; a slab's points are spread over ``salts`` tasks, or as many more as leave each
    ``salt_rows`` points, and its edges go to each of them.
    """
    schema_names = points.columns
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    p = p.select("*", F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.floor(F.col(x) / slab).cast("long").alias("__slab"))
    several = F.greatest(F.lit(salts), F.ceil(F.count(F.lit(1)) / salt_rows)).cast("int")
    counts = small(p.groupBy(F.col("__slab").alias("__of")).agg(several.alias("__salts")))
    # by row number: any rows of a slab can be apart, those of one position too
    p = p.join(counts, F.col("__slab") == F.col("__of")).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.col("__salts")).cast("int")).drop("__of", "__salts")
    v = F.transform(vertices, lambda s: F.struct(s["x"].cast("double").alias("x"), s["y"].cast("double").alias("y")))
    good = regions.select(F.col(region_id).alias("region"), v.alias("v")).where(
        (F.size("v") >= 3) & F.forall("v", lambda s: s["x"].isNotNull() & s["y"].isNotNull() & ~F.isnan(s["x"]) & ~F.isnan(s["y"]))
    )
    ends = good.select("region", "v", F.posexplode("v").alias("i", "p")).select("region", "p", F.get("v", (F.col("i") + 1) % F.size("v")).alias("q"))
    e = ends.where("p.x != q.x").select(
        "region", F.least("p", "q").alias("l"), F.greatest("p", "q").alias("r")
    ).select("region", "l", "r", F.explode(F.sequence(F.floor(F.col("l.x") / slab), F.floor(F.col("r.x") / slab))).alias("__slab"))
    slope = (F.col("r.y") - F.col("l.y")) / (F.col("r.x") - F.col("l.x"))
    x0, x1 = F.greatest(F.col("l.x"), F.col("__slab") * slab), F.least(F.col("r.x"), (F.col("__slab") + 1) * slab)
    e = e.select("region", "__slab", x0.alias("x0"), (F.col("l.y") + slope * (x0 - F.col("l.x"))).alias("y0"), x1.alias("x1"), (F.col("l.y") + slope * (x1 - F.col("l.x"))).alias("y1")).where("x0 < x1")
    e = e.join(counts, F.col("__slab") == F.col("__of")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__of", "__salts")
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema] + [f"region {good.schema['region'].dataType.simpleString()}"])

    def search(_key, pts: pd.DataFrame, eds: pd.DataFrame) -> pd.DataFrame:
        found = []
        pts = pts.sort_values("__y", kind="stable")
        py = pts["__y"].to_numpy()
        for rid, own in eds.groupby("region", sort=False):
            edges = own[["x0", "y0", "x1", "y1"]].to_numpy()
            a, b = np.searchsorted(py, edges[:, [1, 3]].min(), "left"), np.searchsorted(py, edges[:, [1, 3]].max(), "right")
            near = pts.iloc[a:b]
            if len(near):
                hit = near[_search_polygon(near["__x"].to_numpy(), near["__y"].to_numpy(), edges)]
                found.append(hit[schema_names].assign(region=rid))
        return pd.concat(found) if found else pts[schema_names].iloc[:0].assign(region=pd.Series(dtype="object"))

    return p.groupBy("__slab", "__salt").cogroup(e.groupBy("__slab", "__salt")).applyInPandas(search, out_schema)
