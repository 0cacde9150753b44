"""Values read from images: dust maps in polar projection, and nightly flat-field corrections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.registry import chip_cell, flat_index


class DustMap:
    """A pair of polar equal-area images (north, south) with their headers, looked up at galactic coordinates.

    Images have a fixed size whatever the data (two of 4096 x 4096 pixels take 134 MB), and are broadcast once; larger ones
    than LIMIT bytes are refused.
    """

    LIMIT = 1 << 30

    def __init__(self, spark, images: dict[str, tuple[dict, np.ndarray]], order: int = 0):
        if order not in (0, 1):
            raise ValueError("order is 0 (nearest) or 1 (linear)")
        size = sum(image.nbytes for _, image in images.values())
        if size > self.LIMIT:
            raise ValueError(f"maps of {size} bytes are too large to send to every task")
        self.order, self.shared = order, spark.sparkContext.broadcast(images)

    @classmethod
    def load(cls, spark, pattern: str, order: int = 0) -> DustMap:
        """``pattern`` with {pole} for ngp and sgp, e.g. 'maps/SFD_dust_4096_{pole}.fits'."""
        from skyframe.sources.fits import headers, image_data

        images = {}
        for pole in ("ngp", "sgp"):
            data = bytes(spark.read.format("binaryFile").load(pattern.format(pole=pole)).select("content").first()[0])
            keys, _, start, _ = next(headers(data))
            images[pole] = keys, image_data(keys, data, start)
        return cls(spark, images, order)

    def column(self, lon: Column, lat: Column) -> Column:
        """Map value (double) at galactic (lon, lat); null where either is null or NaN."""
        shared, order = self.shared, self.order

        @F.pandas_udf("double")
        def look(lon_: pd.Series, lat_: pd.Series) -> pd.Series:
            out = np.full(len(lon_), np.nan)
            lo, la = lon_.to_numpy(float), lat_.to_numpy(float)
            for pole, sign in (("ngp", 1), ("sgp", -1)):
                m = np.flatnonzero(np.isfinite(lo) & ((la >= 0) if sign > 0 else (la < 0)))
                if len(m):
                    keys, image = shared.value[pole]
                    out[m] = sample(image, *polar_pixel(keys, lo[m], la[m], sign), order)
            return pd.Series(out).where(~np.isnan(out), None)

        return look(lon.cast("double"), lat.cast("double"))


def polar_pixel(keys: dict, lon, lat, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """0-based pixel coordinates (x, y) of the zenithal equal-area projection around a pole."""
    step = abs(keys.get("CDELT1", keys.get("CD1_1", 0)) or 0)
    scale = keys["LAM_SCAL"] if "LAM_SCAL" in keys else math.degrees(math.sqrt(2)) / step
    r = scale * np.sqrt(np.maximum(0, 1 - sign * np.sin(np.radians(lat))))
    return r * np.cos(np.radians(lon)) + keys["CRPIX1"] - 1, -sign * r * np.sin(np.radians(lon)) + keys["CRPIX2"] - 1


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """Nearest or linearly interpolated pixels, the border's beyond the image."""
    top, right = image.shape[0] - 1, image.shape[1] - 1
    if order == 0:
        return image[np.clip(np.rint(y), 0, top).astype(int), np.clip(np.rint(x), 0, right).astype(int)].astype(float)
    x, y = np.clip(x, 0, right), np.clip(y, 0, top)
    i, j = np.minimum(y.astype(int), top - (top > 0)), np.minimum(x.astype(int), right - (right > 0))
    a, b = y - i, x - j
    i2, j2 = np.minimum(i + 1, top), np.minimum(j + 1, right)
    return (1 - a) * (1 - b) * image[i, j] + (1 - a) * b * image[i, j2] + a * (1 - b) * image[i2, j] + a * b * image[i2, j2]


def flat_table(spark, bands: dict[str, dict]) -> DataFrame:
    """Long table (band, i, j, night, offs) of flat fields: per band stacks weighted by night, times a mask.

    ``bands[b]``: mjd (nights), stack (nx, ny, nstack), mask (nx, ny), weights (nstack, nights). nx and ny are fixed by the
    instrument; the table grows by nx * ny rows a night. night = floor(mjd).
    """
    frames = []
    for band, f in bands.items():
        cube = np.einsum("xys,sn->xyn", f["stack"], f["weights"]) * f["mask"][:, :, None]
        nx, ny, n = cube.shape
        i, j, k = np.meshgrid(np.arange(nx), np.arange(ny), np.arange(n), indexing="ij")
        frames.append(pd.DataFrame({"band": band, "i": i.ravel(), "j": j.ravel(), "night": np.floor(np.asarray(f["mjd"])).astype(int)[k.ravel()], "offs": cube.ravel()}))
    # later entries for a night replace earlier ones
    rows = pd.concat(frames).drop_duplicates(["band", "i", "j", "night"], keep="last")
    return spark.createDataFrame(rows, "band string, i int, j int, night int, offs double")


def flat_offsets(df: DataFrame, flats: DataFrame, chip: str, x: str, y: str, mjd: str, filterid: str, out: str = "offs", nx: int = 64, ny: int = 64) -> DataFrame:
    """Add the flat-field correction of each detection; 0 where there is none for its night, place or filter."""
    place = flat_index(F.col(chip), chip_cell(F.col(x), F.col(y), F.col(chip)), nx, ny)
    keyed = df.withColumn("__p", place).withColumn("__n", F.floor(mjd).cast("int")).withColumn("__b", F.substring(filterid, 1, 1))
    f = flats.select(F.col("band").alias("__fb"), F.col("i").alias("__fi"), F.col("j").alias("__fj"), F.col("night").alias("__fn"), F.col("offs").alias("__fo"))
    on = (F.col("__b") == F.col("__fb")) & (F.col("__p.i") == F.col("__fi")) & (F.col("__p.j") == F.col("__fj")) & (F.col("__n") == F.col("__fn"))
    joined = keyed.join(f, on, "left").withColumn(out, F.coalesce("__fo", F.lit(0.0)))
    return joined.drop(*[c for c in joined.columns if c.startswith("__")])
