"""Aggregations: histograms, sky coverage, frequencies, per-key lists, weighted statistics and light curves.

All are partial aggregates; only what asks for exact quantiles or lists holds a group's values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions import sky


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """bin, n over [low, high] in equal bins; the last one is closed. Values outside, null and NaN are left out."""
    if bins < 1 or not low < high:
        raise ValueError("a histogram needs bins and low < high")
    v = value.cast("double")
    inside = df.where(v.between(low, high) & ~F.isnan(v))
    k = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return inside.groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_edges(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """bin, n: bin 0 below the first edge, bin k from edge k-1 to below edge k, the last from the last edge on."""
    if sorted(edges) != list(edges) or not edges:
        raise ValueError("edges must ascend")
    v = value.cast("double")
    k = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= v))
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, lon: Column, lat: Column, dx: float = 0.5) -> DataFrame:
    """i, j, n: rows per dx-degree pixel; i = floor(lon / dx) with lon modulo 360, j = floor((90 - lat) / dx), latitude clamped.

    Rows with a null or NaN position are left out.
    """
    x = F.pmod(lon.cast("double"), F.lit(360.0))
    y = F.greatest(F.least(lat.cast("double"), F.lit(90.0)), F.lit(-90.0))
    rows = df.where(x.isNotNull() & ~F.isnan(x) & lat.isNotNull() & ~F.isnan(lat.cast("double")))
    return rows.groupBy(F.floor(x / dx).cast("int").alias("i"), F.floor((90 - y) / dx).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n; null is a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def new_values(df: DataFrame, column: str, seen: DataFrame, seen_column: str) -> DataFrame:
    """Distinct non-null values of ``column`` that ``seen`` does not hold."""
    return df.select(column).dropna().distinct().join(seen.select(F.col(seen_column).alias(column)), column, "left_anti")


def lists_by_key(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """key, out: array of the key's non-null values, ascending. A list holds all values of its key."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(out))


def accumulate_lists(df: DataFrame, key: str, band: str, value: str, bands: list) -> DataFrame:
    """key and one ascending array per band: what accumulating band by band comes to."""
    return df.groupBy(key).agg(*[F.sort_array(F.collect_list(F.when(F.col(band) == b, F.col(value)))).alias(f"{value}_{b}") for b in bands])


def weight(err: Column, floor: float = 0.01) -> Column:
    """1 / (err^2 + floor^2)."""
    return 1 / (err * err + floor * floor)


def weighted_statistics(df: DataFrame, keys: list[str], value: Column, err: Column, ok: Column, first: int = 10, time: Column | None = None) -> DataFrame:
    """Per key: n, n_ok, mean, stdev, err, q25, median, q75 and the first ``first`` values in order of time.

    Only rows that are ``ok`` with a finite value count, but for n. Weights are 1 / (err^2 + 0.01^2); stdev is the weighted
    one, sqrt(W / (W^2 - sum w^2) * sum w (x - mean)^2), null for fewer than two rows; err = 1 / sqrt(W). Quantiles are exact
    with linear interpolation. Keys without an ok row have null statistics.
    """
    x = value.cast("double")
    good = F.coalesce(ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    rows = df.select(*keys, F.when(good, x).alias("_x"), F.when(good, weight(err.cast("double"))).alias("_w"), F.when(good, time if time is not None else F.lit(0)).alias("_t"))
    light = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_t", "_x")))), lambda s: s["_x"]), 1, first)
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("_x").alias("n_ok"), F.sum("_w").alias("_W"), F.sum(F.col("_w") * F.col("_x")).alias("_S"),
        F.sum(F.col("_w") * F.col("_w")).alias("_W2"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("_Q"),
        F.percentile("_x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"), light.alias("light_curve"),
    )
    mean = F.col("_S") / F.col("_W")
    var = F.col("_W") / F.when(F.col("n_ok") > 1, F.col("_W") * F.col("_W") - F.col("_W2")) * F.greatest(F.col("_Q") - mean * F.col("_S"), F.lit(0.0))
    return agg.select(*keys, "n", "n_ok", mean.alias("mean"), F.sqrt(var).alias("stdev"), (1 / F.sqrt("_W")).alias("err"),
                      F.get("_p", F.lit(0)).alias("q25"), F.get("_p", F.lit(1)).alias("median"), F.get("_p", F.lit(2)).alias("q75"), "light_curve")


def band_arrays(stats: DataFrame, key: str, band: str, bands: list, columns: list[str]) -> DataFrame:
    """One row per key: for each column an array with one element per band (null where the band has no rows)."""
    return stats.groupBy(key).agg(*[F.array(*[F.max(F.when(F.col(band) == b, F.col(c))) for b in bands]).alias(c) for c in columns])


def median_and_rms(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median, rms = 0.741 * interquartile range, n."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(p.alias("_p"), F.count(value).alias("n")).select(*keys, F.get("_p", F.lit(1)).alias("median"), (0.741 * (F.get("_p", F.lit(2)) - F.get("_p", F.lit(0)))).alias("rms"), "n")


def zero_points(exposures: DataFrame, zps: DataFrame, mjd: str) -> DataFrame:
    """Add zp: zero point of the exposure with exactly this mjd, corrected from nominal to true exposure time; NaN if there is
    none, or it turned bad within ten minutes and does not overlap the reference survey.

    ``zps``: mjd, ZP, filterid, exptime, time_to_bad (days), overlaps. Fixed values: nominal seconds per filter.
    """
    nominal = {"g.0000": 43, "r.0000": 40, "i.0000": 45, "z.0000": 30, "y.0000": 30}
    z = zps.dropDuplicates(["mjd"]).select(*[F.col(c).alias(f"_z_{c}") for c in ("mjd", "ZP", "filterid", "exptime", "time_to_bad", "overlaps")])
    usual = F.lit(None).cast("double")
    for name, seconds in nominal.items():
        usual = F.when(F.col("_z_filterid") == name, F.lit(float(seconds))).otherwise(usual)
    good = F.col("_z_ZP").isNotNull() & ((F.col("_z_time_to_bad") >= 10 / 1440) | F.col("_z_overlaps"))
    zp = F.when(good, F.col("_z_ZP") + 2.5 * F.coalesce(F.log10(F.col("_z_exptime") / usual), F.lit(0.0))).otherwise(F.lit(float("nan")))
    joined = exposures.join(z, exposures[mjd] == F.col("_z_mjd"), "left")
    return joined.withColumn("zp", zp).drop(*[c for c in joined.columns if c.startswith("_z_")])


def latest_version(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, all columns; a partial aggregate, so hot keys are combined first."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def pixel_histogram(df: DataFrame, lon: Column, lat: Column, value: Column, level: int, low: float, high: float, bins: int) -> DataFrame:
    """pix, bin, n: histogram of a value (such as a difference of magnitudes) in every pixel of a level. Rows without a
    position, and values outside [low, high], null or NaN, are left out; the last bin is closed."""
    v = value.cast("double")
    x, y = sky.butterfly(lon, lat)
    here = df.where(lon.isNotNull() & lat.between(-90, 90) & ~F.isnan(lon) & v.between(low, high) & ~F.isnan(v))
    k = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return here.groupBy(sky.pix_idx(x, y, level).alias("pix"), k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def blocks_by_key(df: DataFrame, key: str, max_rows: int, name: str = "block") -> DataFrame:
    """Add the number of a block: all rows of a key are in one, and a block has at most ``max_rows`` rows unless it is one
    key's. Keys go to blocks in their order; null is a key.

    Only the keys' row counts are laid out: by range partitions of the keys, each cut into blocks on its own (so a block
    ends where a partition does). The rows themselves are not sorted, and a key with most of them is no hot task here.
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = sizes.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_part", F.spark_partition_id())

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, size = 0, 0
        for b in batches:
            out = []
            for n in b["_n"].tolist():
                if size and size + n > max_rows:
                    at, size = at + 1, 0
                size += n
                out.append(at)
            yield b[["_key", "_part"]].assign(_at=out)

    kind = dict(sizes.dtypes)["_key"]
    placed = ranged.mapInPandas(cut_up, f"_key {kind}, _part int, _at long").withColumn(name, F.shiftleft(F.col("_part").cast("long"), 40) + F.col("_at")).drop("_part", "_at")
    return df.join(placed, df[key].eqNullSafe(F.col("_key"))).drop("_key")


def partition_by_key(df: DataFrame, key: str, max_rows: int) -> Iterator[pd.DataFrame]:
    """Blocks in which all rows of a key are together; at most ``max_rows`` rows unless one key alone has more.

    For a program on the driver, which sees all rows one after the other; ``blocks_by_key`` numbers such blocks in place.
    """
    held, size, last = [], 0, object()
    group: list = []
    names = df.columns
    at = names.index(key)

    def frame(rows):
        return pd.DataFrame(rows, columns=names)

    for row in df.orderBy(key).toLocalIterator():
        row = tuple(row)
        if row[at] != last and group:
            if size and size + len(group) > max_rows:
                yield frame(held)
                held, size = [], 0
            held += group
            size += len(group)
            group = []
        last = row[at]
        group.append(row)
    if group:
        if size and size + len(group) > max_rows:
            yield frame(held)
            held = []
        held += group
    if held:
        yield frame(held)
