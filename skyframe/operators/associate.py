"""Objects from detections: each detection belongs to the nearest object within a radius, or starts a new one.

Exposures are gone through in order of time within a sky cell; detections of one exposure never match each other's new
objects. Cells overlap by a halo, and an object belongs to the cell its first detection lies in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions import borders, pixels, sky
from skyframe.session import cut

LINK_SCHEMA = "det_id long, obj long, dist double, owner boolean, obj_ra double, obj_dec double, new boolean"


#: Grid cells are numbered by one integer; a coordinate takes 21 bits of it.
BITS = 21
AROUND = [((i << BITS) + j << BITS) + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


class _Sky:
    """Growing set of positions with a nearest-neighbour search: each is entered in the 27 grid cells around it, so that a
    search looks into one. The grid numbers of all positions are computed at once."""

    def __init__(self, xyz: np.ndarray, radius: float):
        chord = 2 * math.sin(math.radians(radius) / 2)
        side = max(chord * (1 + 1e-9), 2.0 ** (2 - BITS))
        g = np.floor((xyz + 1) / side).astype(np.int64) + 1
        self.key = ((((g[:, 0] << BITS) + g[:, 1]) << BITS) + g[:, 2]).tolist()
        self.xyz, self.limit2 = xyz.tolist(), chord * chord
        self.cells: dict[int, list[int]] = {}

    def add(self, i: int) -> None:
        for step in AROUND:
            self.cells.setdefault(self.key[i] + step, []).append(i)

    def nearest(self, i: int) -> tuple[int, float]:
        """(position, squared chord) of the nearest within the radius, the first one added on a tie; (-1, inf) if none."""
        best, near = -1, math.inf
        x, y, z = self.xyz[i]
        for o in self.cells.get(self.key[i], ()):
            a, b, c = self.xyz[o]
            d2 = (a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z)
            if d2 < self.limit2 and d2 < near:
                best, near = o, d2
        return best, near


def _unit(ra, dec) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=-1)


def associate(detections: DataFrame, radius: float, objects: DataFrame | None = None, level: int = 10, halo: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, links) of detections (det_id, exp_id, mjd, ra, dec) and existing objects (obj_id, ra, dec).

    objects: obj_id, ra, dec, of new ones only; obj_id is the det_id of the object's first detection. links: det_id, obj_id,
    dist (degrees). Each usable detection gets exactly one link. Repeated det_ids count once; detections without id,
    exposure, time or position (or NaN) get none. ``radius`` in degrees.

    A cell is worked through in order, so it is one task: ``level`` (10: pixels of 0.18 degrees) bounds how much of a
    survey that is. Detections near a cell's border are repeated in its neighbours up to ``halo`` degrees (by default three
    radii); in fields so crowded that chains of objects reach farther, two cells can disagree, and the cell that owns a
    detection decides; a link to an object of another cell counts only if that cell made the object too.
    """
    new_objects, links = association(detections, radius, objects, level, halo)
    return new_objects, links.select("det_id", F.col("obj").alias("obj_id"), "dist")


def association(detections: DataFrame, radius: float, objects: DataFrame | None = None, level: int = 10, halo: float | None = None) -> tuple[DataFrame, DataFrame]:
    """As associate; the links as LINK_SCHEMA has them, with the object's position and whether it is new."""
    halo = halo or 3 * radius
    usable = " AND ".join(f"{c} IS NOT NULL" for c in ("det_id", "exp_id", "mjd", "ra", "dec")) + " AND NOT isnan(ra) AND NOT isnan(dec) AND NOT isnan(mjd) AND dec BETWEEN -90 AND 90"
    rows = detections.where(usable).dropDuplicates(["det_id"]).select("det_id", "exp_id", F.col("mjd").cast("double").alias("mjd"), F.pmod("ra", F.lit(360.0)).alias("ra"), "dec", F.lit(False).alias("is_object"))
    if objects is not None:
        old = objects.where("ra IS NOT NULL AND NOT isnan(ra) AND dec BETWEEN -90 AND 90").dropDuplicates(["obj_id"])
        rows = rows.unionByName(old.select(F.col("obj_id").alias("det_id"), F.lit(0).cast("long").alias("exp_id"), F.lit(float("-inf")).alias("mjd"), F.pmod("ra", F.lit(360.0)).alias("ra"), "dec", F.lit(True).alias("is_object")))
    place = lambda lon, lat: sky.static_cell(sky.cell_of_id(sky.position_id(lon, lat), level))
    own = place(F.col("ra"), F.col("dec"))
    around = F.array_distinct(F.concat(F.array(F.col("own")), sky.cells_around(F.col("ra"), F.col("dec"), sky.circle(halo), level)))
    spots = F.when(sky.near_border(F.col("ra"), F.col("dec"), level, halo), around).otherwise(F.array("own"))
    spread = rows.withColumn("own", own).withColumn("cell", F.explode(spots)).withColumn("is_own", F.col("own") == F.col("cell"))

    def walk(df: pd.DataFrame) -> list[tuple]:
        """One cell, sorted by time, exposure and id."""
        xyz = _unit(df["ra"].to_numpy(), df["dec"].to_numpy())
        known, out = _Sky(xyz, radius), []
        ids, exps, mjds = df["det_id"].tolist(), df["exp_id"].tolist(), df["mjd"].tolist()
        mine, is_object = df["is_own"].tolist(), df["is_object"].tolist()
        ra, dec = df["ra"].tolist(), df["dec"].tolist()
        start, n = 0, len(df)
        while start < n:
            stop = start
            waiting = []
            while stop < n and exps[stop] == exps[start] and mjds[stop] == mjds[start]:
                i = stop
                stop += 1
                if is_object[i]:
                    known.add(i)
                    continue
                o, d2 = known.nearest(i)
                if o < 0:
                    waiting.append(i)
                elif mine[i]:
                    out.append((ids[i], ids[o], math.degrees(2 * math.asin(min(1.0, math.sqrt(d2) / 2))), True, ra[o], dec[o], not is_object[o]))
            for i in waiting:  # visible to later exposures only
                known.add(i)
                if mine[i]:
                    out.append((ids[i], ids[i], 0.0, True, ra[i], dec[i], True))
            start = stop
        return out

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Partitions hold whole cells one after the other; the one that is being read is in memory."""
        columns = ["det_id", "obj", "dist", "owner", "obj_ra", "obj_dec", "new"]
        held: list[pd.DataFrame] = []
        for batch in batches:
            cell = batch["cell"].to_numpy()
            starts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1] if len(cell) else np.empty(0, int)
            out: list[tuple] = []
            for a, b in zip(starts, np.r_[starts[1:], len(cell)]):
                part = batch.iloc[a:b]
                if held and held[-1]["cell"].iloc[0] != cell[a]:
                    out += walk(pd.concat(held) if len(held) > 1 else held[0])
                    held = []
                held.append(part)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held and (out := walk(pd.concat(held) if len(held) > 1 else held[0])):
            yield pd.DataFrame(out, columns=columns)

    order = ["cell", "mjd", "exp_id", "det_id"]
    # as many partitions as the session has for shuffles: the work in a cell, not its bytes, is what takes time
    partitions = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = cut(spread.repartition(partitions, "cell").sortWithinPartitions(*order).mapInPandas(cells, LINK_SCHEMA))
    made = links.where("det_id = obj AND new").select(F.col("obj").alias("obj_id"), F.col("obj_ra").alias("ra"), F.col("obj_dec").alias("dec"))
    # a link to a new object that its own cell did not make: the detection that would have started it joined another there
    claimed = links.where("new").select(F.col("obj").alias("obj_id"), F.col("obj_ra").alias("ra"), F.col("obj_dec").alias("dec")).distinct()
    new_objects = made.unionByName(claimed.join(made.select("obj_id"), "obj_id", "left_anti")).dropDuplicates(["obj_id"])
    return new_objects, links


OBJECT_COLUMNS = [("obj_id", "u8"), ("ra", "f8"), ("dec", "f8"), ("cached", "bool"), ("first_det", "u8")]
LINK_COLUMNS = [("o2d_id", "u8"), ("obj_id", "u8"), ("det_id", "u8"), ("dist", "f4"), ("ra", "f8"), ("dec", "f8")]


def create_object_tables(db, det: str, obj: str, o2d: str) -> None:
    """The object and link tables of a detection table where they are not there yet, and the joins that queries use:
    objects with detections and back by the links, links with either by key."""
    level = db.table(det).schema.level
    db.create_table(obj, {"level": level, "schema": {"main": {"columns": OBJECT_COLUMNS, "primary_key": "obj_id", "spatial_keys": ["ra", "dec"]}}}, ignore_if_exists=True)
    links = {"columns": LINK_COLUMNS, "primary_key": "o2d_id", "spatial_keys": ["ra", "dec"]}
    db.create_table(o2d, {"level": level, "schema": {"main": links}, "aliases": {"_M1": "obj_id", "_M2": "det_id", "_DIST": "dist"}}, ignore_if_exists=True)
    key = db.table(det).schema.primary_key
    wanted = {
        (obj, det): {"type": "indirect", "m1": (o2d, "obj_id"), "m2": (o2d, "det_id")}, (det, obj): {"type": "indirect", "m1": (o2d, "det_id"), "m2": (o2d, "obj_id")},
        (o2d, obj): {"type": "equi", "left": (o2d, "obj_id"), "right": (obj, "obj_id")}, (o2d, det): {"type": "equi", "left": (o2d, "det_id"), "right": (det, key)},
    }
    for (a, b), definition in wanted.items():
        if db.default_join(a, b) is None:
            db.define_default_join(a, b, **definition)


def make_objects(db, det: str, obj: str, o2d: str, radius: float) -> tuple[int, int]:
    """Bring the object catalogue up to date: detections without a link are associated with the objects there are, or make
    new ones. ``radius`` in degrees. Returns the numbers of new objects and links.

    A detection that is linked already is left alone, so an import can be followed by this at any time. Only objects in or
    beside the cells of the new detections are opened, where these cells are few enough to be named.
    """
    create_object_tables(db, det, obj, o2d)
    s = db.table(det).schema
    names = {"det_id": s.primary_key, "exp_id": s.exposure_key, "mjd": s.temporal_key, "ra": s.spatial_keys[0], "dec": s.spatial_keys[1]}
    rows = db.read(det).select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])
    fresh = cut(rows.join(db.read(o2d).select("det_id"), "det_id", "left_anti"))
    objects = db.read(obj, cells=_cells_beside(fresh, db.table(obj).schema.level)).select("obj_id", "ra", "dec")
    made, links = association(fresh, radius, objects)
    made, links = cut(made), cut(links)
    with db.transaction():
        db.write(obj, made.select(F.lit(0).cast("long").alias("obj_id"), "ra", "dec", F.lit(False).alias("cached"), F.col("obj_id").alias("first_det")))
        stored = db.read(obj, cells=_cells_beside(made, db.table(obj).schema.level)).select(F.col("obj_id").alias("_stored"), F.col("first_det").alias("_first"))
        named = links.join(stored, (F.col("obj") == F.col("_first")) & F.col("new"), "left")
        obj_id = F.when(F.col("new"), F.col("_stored")).otherwise(F.col("obj"))
        db.write(o2d, named.select(obj_id.alias("obj_id"), "det_id", F.col("dist").cast("float").alias("dist"), F.col("obj_ra").alias("ra"), F.col("obj_dec").alias("dec")))
    return made.count(), links.count()


def _cells_beside(rows: DataFrame, level: int, most: int = 512) -> list[tuple[int, int]] | None:
    """The static cells of positions and those around them as (pixel, 0); None where they are too many to name."""
    cell = sky.static_cell(sky.cell_of_id(sky.position_id(F.col("ra"), F.col("dec")), level))
    found = [r[0] for r in rows.select(cell.alias("c")).where("c IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        return None
    beside = pixels.adjacency(level)
    return sorted({(o, 0) for c in found for o in (c, *beside.get(c, ()))})


def sanity(detections: DataFrame, objects: DataFrame, links: DataFrame, radius: float) -> DataFrame:
    """check, n: rows that break each rule (0 everywhere if all is well). ``objects``: all objects, old and new.

    once: detections with more than one link; linked: usable detections without a link; used: objects without a detection;
    near: links not shorter than the radius; known: links to an object that does not exist.
    """
    usable = detections.where("det_id IS NOT NULL AND exp_id IS NOT NULL AND mjd IS NOT NULL AND ra IS NOT NULL AND NOT isnan(ra) AND dec BETWEEN -90 AND 90 AND NOT isnan(mjd)")
    counts = {
        "once": links.groupBy("det_id").count().where("count > 1").select(F.lit("once").alias("check")),
        "linked": usable.join(links.select("det_id"), "det_id", "left_anti").select(F.lit("linked").alias("check")),
        "used": objects.join(links.select("obj_id"), "obj_id", "left_anti").select(F.lit("used").alias("check")),
        "near": links.where(F.col("dist") >= radius).select(F.lit("near").alias("check")),
        "known": links.join(objects.select("obj_id"), "obj_id", "left_anti").select(F.lit("known").alias("check")),
    }
    rows = None
    for df in counts.values():
        rows = df if rows is None else rows.unionByName(df)
    zero = detections.sparkSession.createDataFrame([(k, 0) for k in counts], "check string, n long")
    return zero.unionByName(rows.groupBy("check").agg(F.count(F.lit(1)).alias("n"))).groupBy("check").agg(F.sum("n").alias("n"))


def cells_near_exposures(exposures: DataFrame, ra: str, dec: str, fov_radius: float, level: int = sky.LEVEL) -> DataFrame:
    """cell: static cells that the fields of view of the exposures touch (distinct), without collecting the exposures.

    Candidates are the cells of the centre and of rings of points reaching a ring beyond the field, close enough together
    to meet every cell the field meets; then the exact distance of the centre to the cell's border decides. Positions that
    are null, NaN or off the sphere have no field.
    """
    step = min(fov_radius, 0.25 * 90 * sky.pix_size(level))
    rings = math.ceil(fov_radius / step) + 1
    offsets = [(0.0, 0.0)] + [o for ring in range(1, rings + 1) for o in sky.circle(step * ring, 8 * ring)]
    good = exposures.where(F.col(ra).isNotNull() & ~F.isnan(ra) & F.col(dec).between(-90, 90)).select(F.col(ra).cast("double").alias("_lon"), F.col(dec).cast("double").alias("_lat")).distinct()
    own = sky.static_cell(sky.cell_of_id(sky.position_id(F.col("_lon"), F.col("_lat")), level))
    near = good.withColumn("_own", own).withColumn("cell", F.explode(F.array_distinct(sky.cells_around(F.col("_lon"), F.col("_lat"), offsets, level)))).where("cell IS NOT NULL")
    return near.where((F.col("cell") == F.col("_own")) | borders.within(F.col("_lon"), F.col("_lat"), F.col("cell"), level, fov_radius)).select("cell").distinct()


def match_catalogues(left: DataFrame, left_id: str, left_pos: tuple[str, str], right: DataFrame, right_id: str, right_pos: tuple[str, str], radius: float, neighbors: int = 1) -> DataFrame:
    """Link table of two catalogues: xm_id, m1, m2, dist (degrees), nr, ra, dec (of the right row). ``radius`` in degrees.

    xm_id is a hash of (m1, m2), the same in every run.
    """
    from skyframe.plans.joins import nearest

    links = nearest(left, left_id, left_pos, right, right_id, right_pos, neighbors, radius)
    there = right.dropDuplicates([right_id]).select(F.col(right_id).alias("b"), F.col(right_pos[0]).alias("ra"), F.col(right_pos[1]).alias("dec"))
    return links.join(there, "b").select(F.xxhash64("a", "b").alias("xm_id"), F.col("a").alias("m1"), F.col("b").alias("m2"), F.col("dist").cast("float").alias("dist"), F.col("nr").cast("smallint").alias("nr"), "ra", "dec")
