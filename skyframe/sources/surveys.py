"""Importers of sky surveys: exposure files with detections per chip, flux catalogues, and source-extractor catalogues."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions import sky
from skyframe.functions.registry import flux_to_mag, flux_to_mag_err
from skyframe.sources.fits import headers, keep_nan, read_fits, table_data
from skyframe.session import cut
from skyframe.types import spark_type

# ------------------------------------------------------------------ fixed values: columns of the survey tables and their types
EXPOSURE = {
    "exp_id": "u8", "filterid": "a6", "survey": "a4", "equinox": "f4", "ra": "f8", "dec": "f8", "l": "f8", "b": "f8",
    "mjd_obs": "f8", "exptime": "f4", "airmass": "f4", "cached": "bool", "m2z": "f4", "obstype": "a20",
    "object": "a20", "expreq": "f4", "dettem": "f4", "filename": "a20", "nghosts": "u4", "mag_zp": "f4",
    "zpt_obs": "f4", "zpt_ref": "f4", "zpt_err": "f4", "zpt_off": "f4", "posangle": "f4", "rot": "f4", "alt": "f8",
    "az": "f8", "ast_r0": "f8", "ast_d0": "f8", "ast_t0": "f8", "ast_s0": "f8", "ast_rs": "f8", "ast_ds": "f8",
    "dt_astr": "f8",
}
DETECTION = {
    "det_id": "u8", "exp_id": "u8", "chip_id": "u1", "survey": "a4", "ra": "f8", "dec": "f8", "mjd_obs": "f8",
    "l": "f8", "b": "f8", "flags": "u4", "flags2": "u4", "n_frames": "i2", "cached": "bool", "ipp_idet": "i4",
    "x_psf": "f4", "y_psf": "f4", "x_psf_sig": "f4", "y_psf_sig": "f4", "posangle": "f4", "pltscale": "f4",
    "filterid": "a6", "psf_inst_mag": "f4", "psf_inst_mag_sig": "f4", "psf_inst_flux": "f4",
    "psf_inst_flux_sig": "f4", "ap_mag": "f4", "ap_mag_raw": "f4", "ap_mag_radius": "f4", "peak_flux_as_mag": "f4",
    "cal_psf_mag": "f4", "cal_psf_mag_sig": "f4", "sky": "f4", "sky_sigma": "f4", "psf_chisq": "f4",
    "cr_nsigma": "f4", "ext_nsigma": "f4", "psf_major": "f4", "psf_minor": "f4", "psf_theta": "f4", "psf_qf": "f4",
    "psf_qf_perfect": "f4", "psf_ndof": "u4", "psf_npix": "u4", "moments_xx": "f4", "moments_xy": "f4",
    "moments_yy": "f4", "moments_m3c": "f4", "moments_m3s": "f4", "moments_m4c": "f4", "moments_m4s": "f4",
    "moments_r1": "f4", "moments_rh": "f4", "kron_flux": "f4", "kron_flux_err": "f4", "kron_flux_inner": "f4",
    "kron_flux_outer": "f4",
}
CATALOGUE = {
    "sdss_id": "u8", "ra": "f8", "dec": "f8", "l": "f8", "b": "f8", "type": "i4", "flags": "i4", "flags2": "i4",
    "resolve_status": "i2", "run": "i4", "camcol": "i4", "field": "i4", "objid": "i4",
}
#: Columns whose name in the file is not the upper-case name.
RENAMED = {"mjd_obs": "MJD-OBS", "ra": "RA_PSF", "dec": "DEC_PSF"}
SWEEP = {"ra": "RA", "dec": "DEC", "type": "OBJC_TYPE", "flags": "OBJC_FLAGS", "flags2": "OBJC_FLAGS2", "resolve_status": "RESOLVE_STATUS", "run": "RUN", "camcol": "CAMCOL", "field": "FIELD", "objid": "ID"}
#: Bits that must not be set (flags, flags2) and the one that must be (resolve_status).
F1_BRIGHT, F1_EDGE, F1_NODEBLEND, F1_SATURATED, F2_DEBLENDED_AS_MOVING, RS_SURVEY_PRIMARY = 1 << 1, 1 << 2, 1 << 6, 1 << 18, 1 << 0, 1 << 8


def chips() -> Iterator[tuple[int, str]]:
    """(number, name) of the 60 chips of the 8 x 8 grid without its corners."""
    for y, x in product(range(8), range(8)):
        if not (x in (0, 7) and y in (0, 7)):
            yield x + 8 * y, f"XY{x}{y}"


def mend_positions(df: DataFrame) -> DataFrame:
    """ra modulo 360, dec clamped to the poles, rows with NaN or null positions left out; l and b added."""
    lon, lat = sky.repair(F.col("ra"), F.col("dec"))
    good = df.where("ra IS NOT NULL AND dec IS NOT NULL AND NOT isnan(ra) AND NOT isnan(dec)").withColumn("ra", lon).withColumn("dec", lat)
    gal = sky.equgal(F.col("ra"), F.col("dec"))
    return good.withColumn("l", gal["l"]).withColumn("b", gal["b"])


def _value(v, kind: str):
    if kind.startswith("a"):
        return "" if v is None else str(v).strip()
    try:
        return float(v) if kind.startswith("f") else int(v)
    except (TypeError, ValueError):
        return float("nan") if kind.startswith("f") else 0


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {spark_type(k).simpleString()}" for c, k in columns.items())


def read_exposures(spark: SparkSession, paths: str | list[str], survey: str) -> DataFrame:
    """One row per exposure file, from its primary header: EXPOSURE columns, smf_fn, hdr (header text), chip_hdr (64 texts),
    notfound_keys and notfound_cols (64 lists of columns that a chip's table lacks; null where complete or absent)."""
    columns = EXPOSURE
    wanted = {c: ("RA" if c == "ra" else "DEC" if c == "dec" else RENAMED.get(c, c.upper())) for c in columns if c not in ("exp_id", "survey", "l", "b", "cached")}
    table = [c for c in DETECTION if c not in ("det_id", "exp_id", "chip_id", "survey", "mjd_obs", "l", "b", "cached", "filterid")]
    need = [RENAMED.get(c, c.upper()) for c in table]

    def rows(blocks):
        number = {name: k for k, name in chips()}
        for b in blocks:
            out = []
            for path, content in zip(b["path"], b["content"]):
                units = list(headers(bytes(content)))
                keys, text = units[0][0], units[0][1]
                row = {c: _value(keys.get(k), columns[c]) for c, k in wanted.items()}
                row |= {"exp_id": 0, "survey": survey, "l": 0.0, "b": 0.0, "cached": False, "hdr": text}
                lost = [k for k in wanted.values() if k not in keys]
                row["notfound_keys"] = lost or None
                row["smf_fn"] = re.sub(r"\.[^.]*$", "", path.split("/")[-1])
                heads: list = [None] * 64
                cols: list = [None] * 64
                for i, (k, t, _, _) in enumerate(units):
                    m = re.fullmatch(r"(XY\d\d)\.psf", str(k.get("EXTNAME", "")))
                    if m and m[1] in number:
                        there = {str(k.get(f"TTYPE{j}", "")).upper() for j in range(1, k.get("TFIELDS", 0) + 1)}
                        cols[number[m[1]]] = [n for n in need if n not in there] or None
                        heads[number[m[1]]] = units[i - 1][1]
                row["chip_hdr"], row["notfound_cols"] = heads, cols
                out.append(row)
            yield pd.DataFrame(out)[order]

    order = [*columns, "smf_fn", "hdr", "chip_hdr", "notfound_keys", "notfound_cols"]
    schema = _ddl(columns) + ", smf_fn string, hdr string, chip_hdr array<string>, notfound_keys array<string>, notfound_cols array<array<string>>"
    return mend_positions(keep_nan(spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(rows, schema))).select(*order)


def read_detections(spark: SparkSession, paths: str | list[str], survey: str) -> DataFrame:
    """Rows of all chips' tables of exposure files: DETECTION columns and smf_fn. Missing columns are NaN or zero."""
    columns = DETECTION
    own = [c for c in columns if c not in ("det_id", "exp_id", "chip_id", "survey", "mjd_obs", "l", "b", "cached", "filterid")]

    def rows(blocks):
        number = {f"{name}.psf": k for k, name in chips()}
        for b in blocks:
            for path, content in zip(b["path"], b["content"]):
                content = bytes(content)
                units = list(headers(content))
                primary = units[0][0]
                for keys, _, start, _ in units[1:]:
                    chip = number.get(str(keys.get("EXTNAME", "")))
                    if chip is None or not keys.get("TFIELDS") or not keys.get("NAXIS2"):
                        continue
                    t = table_data(keys, content, start)
                    t.columns = [c.upper() for c in t.columns]
                    out = pd.DataFrame(index=t.index)
                    for c in columns:
                        src = RENAMED.get(c, c.upper())
                        gap = float("nan") if columns[c].startswith("f") else "" if columns[c].startswith("a") else 0
                        out[c] = t[src] if c in own and src in t.columns else gap
                    out["chip_id"], out["survey"], out["cached"] = chip, survey, False
                    out["filterid"], out["mjd_obs"] = _value(primary.get("FILTERID"), "a6"), _value(primary.get("MJD-OBS"), "f8")
                    out["smf_fn"] = re.sub(r"\.[^.]*$", "", path.split("/")[-1])
                    yield out

    found = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(rows, _ddl(columns) + ", smf_fn string")
    return mend_positions(keep_nan(found)).select(*columns, "smf_fn")


def import_exposures(db, det_table: str, exp_table: str, paths: str | list[str], survey: str, create: bool = False) -> DataFrame:
    """Import exposure files into both tables, joined by exp_id; returns smf_fn, exp_id of the new exposures."""
    exposures = cut(read_exposures(db.spark, paths, survey))
    if create:
        more = {"smf_fn": "a40", "hdr": "a", "chip_hdr": "[1]a", "notfound_keys": "[1]a", "notfound_cols": "[2]a"}
        db.create_table(exp_table, _definition(EXPOSURE | {"smf_fn": "a40"}, "exp_id", "mjd_obs", exposure="exp_id"), ignore_if_exists=True)
        db.create_table(det_table, _definition(DETECTION, "det_id", "mjd_obs", exposure="exp_id"), ignore_if_exists=True)
        t = db.table(exp_table)
        for c, k in more.items():
            if c not in t.schema.columns():
                t.schema.groups.setdefault("header", {})[c] = k
        t.save_schema()
        if db.default_join(det_table, exp_table) is None:
            db.define_default_join(det_table, exp_table, "equi", left=(det_table, "exp_id"), right=(exp_table, "exp_id"))
    with db.transaction():
        db.write(exp_table, exposures)
        ids = db.read(exp_table).select("smf_fn", "exp_id").join(exposures.select("smf_fn"), "smf_fn", "left_semi")
        rows = read_detections(db.spark, paths, survey).drop("exp_id").join(ids, "smf_fn").drop("smf_fn")
        db.write(det_table, rows)
    return ids


def _definition(columns: dict, key: str, time: str | None, exposure: str | None = None) -> dict:
    return {"schema": {"main": {"columns": list(columns.items()), "primary_key": key, "spatial_keys": ["ra", "dec"], "temporal_key": time, "exposure_key": exposure}}}


def survey_quality(flags: Column, flags2: Column, resolve_status: Column) -> Column:
    """Primary, and none of: bright, saturated, not deblended, at an edge, deblended as moving."""
    none_of = F1_BRIGHT | F1_SATURATED | F1_NODEBLEND | F1_EDGE
    return (resolve_status.bitwiseAND(F.lit(RS_SURVEY_PRIMARY)) != 0) & (flags.bitwiseAND(F.lit(none_of)) == 0) & (flags2.bitwiseAND(F.lit(F2_DEBLENDED_AS_MOVING)) == 0)


def read_sweeps(spark: SparkSession, paths: str | list[str], all: bool = False) -> DataFrame:  # noqa: A002
    """Flux catalogues: CATALOGUE columns, and for each band x of ugriz x, xErr, xExt, xCalib; only good rows unless ``all``."""
    columns = CATALOGUE
    schema = ", ".join([f"{c} {spark_type(columns[c]).simpleString()}" for c in SWEEP] + [f"{c} array<{k}>" for c, k in (("extinction", "float"), ("modelflux", "float"), ("modelflux_ivar", "float"), ("calib_status", "int"))])
    raw = read_fits(spark, paths, schema, {**SWEEP, "extinction": "EXTINCTION", "modelflux": "MODELFLUX", "modelflux_ivar": "MODELFLUX_IVAR", "calib_status": "CALIB_STATUS"}).drop("notfound")
    if not all:
        raw = raw.where(survey_quality(F.col("flags"), F.col("flags2"), F.col("resolve_status")))
    bands = []
    for i, band in enumerate("ugriz"):
        flux = F.get("modelflux", F.lit(i))
        bands += [flux_to_mag(flux).cast("float").alias(band), flux_to_mag_err(flux, F.get("modelflux_ivar", F.lit(i))).cast("float").alias(f"{band}Err"), F.get("extinction", F.lit(i)).alias(f"{band}Ext"), F.get("calib_status", F.lit(i)).cast("smallint").alias(f"{band}Calib")]
    named = raw.select(F.lit(0).cast("long").alias("sdss_id"), *SWEEP, *bands)
    return mend_positions(named).select(*columns, *[f"{b}{s}" for b in "ugriz" for s in ("", "Err", "Ext", "Calib")])


# ------------------------------------------------------------------ fixed values: columns of source-extractor catalogues
EXTRACTED = {
    "det_id": "u8", "exp_id": "u8", "ra": "f8", "dec": "f8", "mjd": "f8", "fid": "u1", "mag_abs": "u2", "magerr_abs": "u2", "mu_max": "i2", "mag_auto": "i2",
    "mag_aper": "5i2", "magerr_aper": "5u2", "flags": "u2", "imaflags_iso": "u2", "nimaflags_iso": "u2", "cached": "bool",
}
EXTRACTED_EXPOSURE = {
    "exp_id": "u8", "ra": "f8", "dec": "f8", "mjd": "f8", "pid": "i8", "ptf_field": "i8", "ccdid": "i2", "nid": "i8", "fid": "i2", "mjd_import": "i4", "medfwhm": "f4",
    "limitmag": "f4", "n_bright": "i8", "mumax_med": "f4", "mumax_rms": "f4", "cached": "bool",
}


def absolute_magnitude(mag: np.ndarray, x_image: np.ndarray, y_image: np.ndarray, header: dict) -> np.ndarray:
    """Calibrated magnitude x 1000, clipped to 5000..32000: a polynomial of airmass, time and place on the chip.

    ``header``: AEXPTIME, AIRMASS, OBSJD, APMEDJD, APPAR01..APPAR11.
    """
    h = lambda k: float(header[k])
    x, y, t = (x_image - 1024.0) / 2048.0, (y_image - 2048.0) / 4096.0, h("OBSJD") - h("APMEDJD")
    fixed = 2.5 * np.log10(h("AEXPTIME")) + h("APPAR01") + h("APPAR03") * h("AIRMASS") + h("APPAR05") * t + h("APPAR06") * t * t
    value = mag + fixed + h("APPAR07") * x + h("APPAR08") * y + h("APPAR09") * y**2 + h("APPAR10") * y**3 + h("APPAR11") * x * y
    return np.clip(fixed_point(value), 5000, 32000)


def fixed_point(v: np.ndarray, factor: int = 1000) -> np.ndarray:
    """Rounded multiple, half to even; NaN is 0."""
    return np.nan_to_num(np.rint(np.asarray(v, float) * factor)).astype(np.int64)


def extracted(content: bytes, mjd_import: int = 0) -> tuple[pd.DataFrame, dict]:
    """(detections, exposure) of one source-extractor catalogue: unit 1 the table, unit 2 the exposure's header.

    Magnitudes become thousandths. mag_abs is 32000 where the exposure has no absolute photometry (APBSRMS not above 0);
    of the bright stars (14000 < mag_abs < 17000) mumax_med and mumax_rms = 0.741 * interquartile range are taken, -99.99
    where there are none.
    """
    units = list(headers(content))
    header = units[min(2, len(units) - 1)][0]
    raw = table_data(units[1][0], content, units[1][2])
    n = len(raw)
    number = lambda k, otherwise=0.0: float(header.get(k) or otherwise)
    col = lambda c: np.asarray(raw[c], float) if c in raw.columns else np.zeros(n)
    vectors = lambda c: [fixed_point(v).tolist() for v in raw[c]] if c in raw.columns else [[]] * n
    mag_abs = absolute_magnitude(col("MAG_AUTO"), col("X_IMAGE"), col("Y_IMAGE"), header) if number("APBSRMS") > 0 else np.full(n, 32000)
    det = pd.DataFrame({
        "det_id": 0, "exp_id": 0, "ra": col("ALPHAWIN_J2000"), "dec": col("DELTAWIN_J2000"), "mjd": number("OBSMJD"), "fid": int(number("DBFID")), "mag_abs": mag_abs,
        "magerr_abs": fixed_point(col("MAGERR_AUTO")), "mu_max": fixed_point(col("MU_MAX")), "mag_auto": fixed_point(col("MAG_AUTO")), "mag_aper": vectors("MAG_APER"),
        "magerr_aper": vectors("MAGERR_APER"), "flags": col("FLAGS").astype(int), "imaflags_iso": col("IMAFLAGS_ISO").astype(int), "nimaflags_iso": col("NIMAFLAGS_ISO").astype(int), "cached": False,
    })
    bright = (mag_abs > 14000) & (mag_abs < 17000) & ("MU_MAX" in raw.columns)
    spread = (col("MU_MAX") - col("MAG_AUTO"))[bright]
    q25, q50, q75 = np.percentile(spread, [25, 50, 75]) if len(spread) else (0.0, -99.99, -99.99 / 0.741)
    exposure = {
        "exp_id": 0, "ra": number("RA", np.mean(det["ra"]) if n else 0.0), "dec": number("DEC", np.mean(det["dec"]) if n else 0.0), "mjd": number("OBSMJD"), "pid": int(number("DBPID")),
        "ptf_field": int(number("PTFFIELD")), "ccdid": int(number("CCDID")), "nid": int(number("DBNID")), "fid": int(number("FILTERID", number("DBFID"))), "mjd_import": mjd_import,
        "medfwhm": number("MEDFWHM", float("nan")), "limitmag": number("LIMITMAG", float("nan")), "n_bright": len(spread), "mumax_med": q50, "mumax_rms": 0.741 * (q75 - q25), "cached": False,
    }
    return det, exposure


def read_extracted(spark: SparkSession, paths: str | list[str], mjd_import: int = 0) -> tuple[DataFrame, DataFrame]:
    """(detections, exposures) of any number of source-extractor catalogues, each with the file's name (``name``).

    The files are read in the cluster, each once, whole: a file must fit a task's memory. Detections without a usable
    position are left out.
    """
    det_columns, exp_columns = [f"det_{c}" for c in EXTRACTED], [f"exp_{c}" for c in EXTRACTED_EXPOSURE]

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        lost = [c for c in (*exp_columns, *det_columns) if c not in part]
        return part.assign(**dict.fromkeys(lost, pd.Series([None] * len(part), part.index, object)))[["name", "is_exposure", *exp_columns, *det_columns]]

    def rows(blocks):
        for b in blocks:
            for path, content in zip(b["path"], b["content"]):
                det, exposure = extracted(bytes(content), mjd_import)
                name = path.split("/")[-1]
                one = pd.DataFrame([{f"exp_{k}": v for k, v in exposure.items()}]).assign(name=name, is_exposure=True)
                yield whole(one)
                for a in range(0, len(det), 50_000):
                    yield whole(det.iloc[a : a + 50_000].add_prefix("det_").assign(name=name, is_exposure=False))

    types_ = [f"`{n}` {spark_type(k).simpleString()}" for n, k in zip([*exp_columns, *det_columns], [*EXTRACTED_EXPOSURE.values(), *EXTRACTED.values()])]
    found = cut(spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(rows, ", ".join(["name string", "is_exposure boolean", *types_])))
    det = found.where("NOT is_exposure").select("name", *[F.col(f"det_{c}").alias(c) for c in EXTRACTED]).where("ra IS NOT NULL AND NOT isnan(ra) AND dec BETWEEN -90 AND 90")
    return det, found.where("is_exposure").select("name", *[F.col(f"exp_{c}").alias(c) for c in EXTRACTED_EXPOSURE])


def import_extracted(db, det_table: str, exp_table: str, paths: str | list[str], mjd_import: int = 0) -> int:
    """Import source-extractor catalogues into both tables (made where they are not there), joined by exp_id; returns the
    number of exposures. Files whose name is loaded already are passed over."""
    if not db.table_exists(exp_table):
        db.create_table(exp_table, _definition(EXTRACTED_EXPOSURE | {"name": "a80"}, "exp_id", "mjd", exposure="exp_id"))
        db.create_table(det_table, _definition(EXTRACTED, "det_id", "mjd", exposure="exp_id"))
        db.define_default_join(det_table, exp_table, "equi", left=(det_table, "exp_id"), right=(exp_table, "exp_id"))
    det, exposures = read_extracted(db.spark, paths, mjd_import)
    fresh = cut(exposures.join(db.read(exp_table).select("name"), "name", "left_anti"))
    with db.transaction():
        db.write(exp_table, fresh)
        ids = db.read(exp_table).select("name", "exp_id").join(fresh.select("name"), "name", "left_semi")
        db.write(det_table, det.drop("exp_id").join(ids, "name").drop("name"))
    return fresh.count()


def new_files(listed: DataFrame, name: str, loaded: DataFrame, loaded_name: str, version: str | None = None, key: str | None = None) -> DataFrame:
    """Files to ingest: of each ``key`` only the newest ``version``, and none whose name is loaded already."""
    from skyframe.operators.aggregate import latest_version

    rows = latest_version(listed, [key], [version, name]) if key and version else listed
    return rows.join(loaded.select(F.col(loaded_name).alias(name)), name, "left_anti")


def exposure_files(spark: SparkSession, folder: str, pattern: str = "*.smf") -> DataFrame:
    """path, name, key, version of the exposure files under a folder: 'o5432g0123o.99.smf' is version 99 of o5432g0123o."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    number = F.regexp_extract(name, r"\.(\d+)$", 1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.\d+$", "").alias("key"), F.coalesce(F.nullif(number, F.lit("")).try_cast("long"), F.lit(0)).alias("version"))


def ingest(db, det_table: str, exp_table: str, folder: str, survey: str, objects: tuple[str, str] | None = None, radius: float = 1 / 3600, pattern: str = "*.smf", batch: int = 1000) -> int:
    """Import what is new under a folder, then bring the object catalogue (object and link table) up to date.

    Of each exposure only the newest version counts, and nothing that is loaded already, this version or another. Files go
    in batches of ``batch``, each in a transaction of its own, so an ingest that was broken off goes on where it stopped.
    Returns the number of files imported.
    """
    from skyframe.operators.associate import make_objects

    listed = exposure_files(db.spark, folder, pattern)
    fresh = new_files(listed, "name", db.spark.createDataFrame([], "name string"), "name", "version", "key")
    if db.table_exists(exp_table):
        loaded = db.read(exp_table).select(F.regexp_replace("smf_fn", r"\.\d+$", "").alias("key"))
        fresh = fresh.join(loaded, "key", "left_anti")
    paths, done = [], 0
    for row in cut(fresh.select("path", "key")).orderBy("key").toLocalIterator():  # names only; the files are read in the cluster
        paths.append(row["path"])
        if len(paths) == batch:
            done, paths = done + _import_batch(db, det_table, exp_table, paths, survey), []
    if paths:
        done += _import_batch(db, det_table, exp_table, paths, survey)
    if done and objects:
        make_objects(db, det_table, *objects, radius)
    return done


def _import_batch(db, det_table: str, exp_table: str, paths: list[str], survey: str) -> int:
    import_exposures(db, det_table, exp_table, paths, survey, create=True)
    return len(paths)


def exposure_listing(exposures: DataFrame) -> DataFrame:
    """One row per exposure: exp_id, mjd_obs, filterid, smf_fn of its newest delivery; to see what is loaded without headers."""
    from skyframe.operators.aggregate import latest_version

    return latest_version(exposures.where("exp_id IS NOT NULL").select("exp_id", "loaded_at", "smf_fn", "mjd_obs", "filterid"), ["exp_id"], ["loaded_at", "smf_fn", "mjd_obs", "filterid"]).select("exp_id", "mjd_obs", "filterid", "smf_fn")
