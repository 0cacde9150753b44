"""From files to objects: ingest, association, and queries by the joins that these define."""

import numpy as np
import pytest

from skyframe import cli
from skyframe.catalog.database import Database
from skyframe.operators import associate
from skyframe.sources import fits


def exposure_file(path, mjd, ra, dec):
    def unit(cards, table=None):
        body = b"".join(fits._card(k, v) for k, v in cards) + b"END".ljust(80)
        return fits._padded(body, b" ") + (fits._padded(table, b"\0") if table is not None else b"")

    chip = np.zeros(len(ra), [("ra", ">f8"), ("dec", ">f8"), ("mag", ">f4")])
    chip["ra"], chip["dec"], chip["mag"] = ra, dec, 20 + np.arange(len(ra))
    data = unit([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("FILTERID", "r.0000"), ("RA", 10.0), ("DEC", 5.0), ("MJD-OBS", mjd)])
    data += unit([("XTENSION", "IMAGE"), ("BITPIX", 8), ("NAXIS", 0), ("EXTNAME", "XY33.hdr")])
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 20), ("NAXIS2", len(ra)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 3)]
    cards += [("TTYPE1", "RA_PSF"), ("TFORM1", "D"), ("TTYPE2", "DEC_PSF"), ("TFORM2", "D"), ("TTYPE3", "PSF_INST_MAG"), ("TFORM3", "E"), ("EXTNAME", "XY33.psf")]
    path.write_bytes(data + unit(cards, chip.tobytes()))


def test_ingest_associate_query(spark, tmp_path, capsys):
    folder, root = tmp_path / "files", str(tmp_path / "db")
    folder.mkdir()
    ra, dec = 10 + np.arange(6) * 0.01, np.full(6, 5.0)
    exposure_file(folder / "o1.1.smf", 55000.5, ra, dec)
    exposure_file(folder / "o1.2.smf", 55000.5, ra[:5], dec[:5])  # the newer version
    exposure_file(folder / "o2.1.smf", 55001.5, ra[:4] + 1e-5, dec[:4])
    run = lambda *a: cli.main(["--db", root, *a], spark)
    assert run("ingest", "det", "exp", str(folder), "--objects", "obj", "o2d") == 0 and "2 files" in capsys.readouterr().out
    db = Database(spark, root)
    assert db.read("obj").count() == 5 and db.read("o2d").count() == 9
    text = "obj.obj_id AS o, det.psf_inst_mag AS m, exp.smf_fn AS f FROM obj, det, exp"
    got = sorted((r["m"], r["f"]) for r in db.query(text).dataframe().collect())
    assert got == sorted([(20.0 + k, "o1.2") for k in range(5)] + [(20.0 + k, "o2.1") for k in range(4)])
    # an old version of a loaded exposure and what is loaded are passed over; a new one joins the objects there are
    exposure_file(folder / "o2.0.smf", 55001.5, ra, dec)
    exposure_file(folder / "o3.1.smf", 55002.5, np.r_[ra[:3] - 1e-5, 12.0], np.r_[dec[:3], 5.0])
    assert run("ingest", "det", "exp", str(folder), "--objects", "obj", "o2d") == 0 and "1 files" in capsys.readouterr().out
    assert db.read("obj").count() == 6 and db.read("o2d").count() == 13
    assert run("associate", "det", "obj", "o2d") == 0 and "0 new objects, 0 links" in capsys.readouterr().out
    per = db.query("obj_id AS o, det.det_id AS d FROM obj, det").dataframe().groupBy("o").count()
    assert sorted(r["count"] for r in per.collect()) == [1, 1, 2, 3, 3, 3]
    assert db.query("det.det_id AS d FROM o2d, det").count() == 13
    checks = associate.sanity(db.read("det").withColumnRenamed("mjd_obs", "mjd"), db.read("obj"), db.read("o2d"), 1 / 3600)
    assert {r["n"] for r in checks.collect()} == {0}


def test_admin_of_columns_and_joins(spark, tmp_path):
    root = str(tmp_path / "db")
    run = lambda *a: cli.main(["--db", root, *a], spark)
    for t in ("a", "b"):
        assert run("admin", "create", t, "id:u8", "ra", "dec", "n:i4", "--primary-key", "id", "--spatial-keys", "ra,dec") == 0
    db = Database(spark, root)
    db.write("a", spark.createDataFrame([(1.0, 1.0, 5), (2.0, 1.0, 6)], "ra double, dec double, n int"))
    db.write("b", spark.createDataFrame([(1.0, 1.0, 5), (2.0, 1.0, 5)], "ra double, dec double, n int"))
    assert run("admin", "alias", "a", "number", "n") == 0 and run("admin", "group", "a", "more", "x", "y:i4") == 0
    assert run("admin", "join", "a", "b", "--on", "n", "n") == 0
    assert db.query("number, x, y, b.ra AS r FROM a, b").count() == 2
    with pytest.raises(Exception):
        run("admin", "alias", "a", "n", "ra")


def test_cells_near_exposures_against_brute_force(spark):
    from skyframe.functions import pixels

    rng = np.random.default_rng(4)
    lon, lat = rng.uniform(0, 360, 40), np.degrees(np.arcsin(rng.uniform(-1, 1, 40)))
    lat[:3] = [89.9, -89.5, 0.0]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)] + [(None, 1.0), (float("nan"), 1.0), (5.0, 95.0)], "ra double, dec double")
    got = {r["cell"] for r in associate.cells_near_exposures(df, "ra", "dec", 1.6, 5).collect()}
    r, a = 1.6 * np.sqrt(rng.uniform(0, 1, 4000)), rng.uniform(0, 2 * np.pi, 4000)
    touched = set()
    for x, y in zip(lon, lat):
        d = np.radians(r)
        z = np.sin(np.radians(y)) * np.cos(d) + np.cos(np.radians(y)) * np.sin(d) * np.cos(a)
        turn = np.degrees(np.arctan2(np.sin(a) * np.sin(d) * np.cos(np.radians(y)), np.cos(d) - np.sin(np.radians(y)) * z))
        touched |= set(pixels.static_cell_ids(*pixels.butterfly((x + turn) % 360, np.degrees(np.arcsin(z))), 5).tolist())
    assert touched <= got and len(got - touched) <= 0.1 * len(got)


def test_near_border_misses_no_cell(spark):
    """Wherever a circle around a position meets another cell, the position counts as near a border."""
    from pyspark.sql import functions as F

    from skyframe.functions import sky

    rng = np.random.default_rng(9)
    n = 6000
    lon, lat = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    lat[:500] = 90 - rng.uniform(0, 2, 500)
    lon[500:1500] = rng.integers(0, 5, 1000) * 90 + rng.normal(0, 0.05, 1000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "a double, b double").repartition(4)
    for level, margin in ((6, 0.3), (10, 0.01)):
        own = sky.static_cell(sky.cell_of_id(sky.position_id(F.col("a"), F.col("b")), level))
        others = F.size(F.filter(sky.cells_around(F.col("a"), F.col("b"), sky.circle(margin, 24), level), lambda c: c != F.col("own")))
        seen = df.withColumn("own", own).select((others > 0).alias("meets"), sky.near_border(F.col("a"), F.col("b"), level, margin).alias("near")).groupBy("meets", "near").count().collect()
        counts = {(r["meets"], r["near"]): r["count"] for r in seen}
        assert counts.get((True, False), 0) == 0 and counts[(True, True)] > 50 and counts[(False, False)] > 500


def test_files_written_by_tasks_and_other_importers(spark, tmp_path, capsys, monkeypatch):
    import sys
    import types

    root = str(tmp_path / "db")
    run = lambda *a: cli.main(["--db", root, *a], spark)
    assert run("admin", "create", "t", "id:u8", "ra", "dec", "n:i4", "--primary-key", "id", "--spatial-keys", "ra,dec") == 0
    module = types.ModuleType("own_importer")
    module.rows = lambda db, a: db.spark.createDataFrame([(float(k), 1.0, k) for k in range(25)], "ra double, dec double, n int")
    monkeypatch.setitem(sys.modules, "own_importer", module)
    assert run("import", "own_importer:rows", "t", "-") == 0 and "25 rows" in capsys.readouterr().out
    with pytest.raises(ValueError):
        run("import", "unknown", "t", "-")
    assert run("query", "n, ra FROM t", "--format", "fits", "--output", f"{tmp_path}/out/") == 0
    back = fits.read_fits(spark, f"{tmp_path}/out/*.fits", "n int, ra double")
    assert sorted(tuple(r) for r in back.collect()) == [(k, float(k)) for k in range(25)]
    files = fits.write_fits_parts(db_rows(spark, 25).coalesce(1), str(tmp_path / "small"), 10).collect()
    assert sorted(r["rows"] for r in files) == [5, 10, 10] and fits.write_fits_parts(db_rows(spark, 0), str(tmp_path / "none")).count() == 0


def db_rows(spark, n):
    return spark.range(n).selectExpr("id", "cast(id as string) AS s")


def test_blocks_of_keys(spark):
    from skyframe.operators import aggregate

    df = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 4), (None, 2), (4, 9)) for i in range(n)], "k int, block_no int")
    got = aggregate.blocks_by_key(df, "k", 10).groupBy("block").agg({"*": "count", "k": "collect_set"}).collect()
    assert sum(r["count(1)"] for r in got) == 68
    assert all(r["count(1)"] <= 10 or r["collect_set(k)"] == [1] for r in got)
    per_key = aggregate.blocks_by_key(df, "k", 10).select("k", "block").distinct().count()
    assert per_key == 5 and aggregate.blocks_by_key(df.limit(0), "k", 10).count() == 0


def test_reduce_with_combiner(spark):
    from pyspark.sql import functions as F

    from skyframe.operators import mapreduce

    def _pairs(rows):
        yield from zip(rows["k"].tolist(), rows["v"].tolist())

    def _add(key, values):
        yield key, sum(values)

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.lit(0).cast("long").alias("_CELLID")).repartition(5)
    first = mapreduce.pairs(df, _pairs)
    plain, combined = (mapreduce.unpacked(mapreduce.reduce_by_key(first, _add, combiner=c), "k long, v long") for c in (None, _add))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, combined.collect())) == [(k, sum(range(k, 1000, 3))) for k in range(3)]


def test_source_extractor_catalogues(spark, tmp_path, capsys):
    def unit(cards, table=None):
        body = b"".join(fits._card(k, v) for k, v in cards) + b"END".ljust(80)
        return fits._padded(body, b" ") + (fits._padded(table, b"\0") if table is not None else b"")

    names = ["ALPHAWIN_J2000", "DELTAWIN_J2000", "MAG_AUTO", "MAGERR_AUTO", "MU_MAX", "X_IMAGE", "Y_IMAGE"]
    for f in range(3):
        rows = np.zeros(4, [(n, ">f8") for n in names])
        rows["ALPHAWIN_J2000"], rows["DELTAWIN_J2000"] = [10, 10.1, 10.2, np.nan], [5, 5, 5, 5]
        rows["MAG_AUTO"], rows["MAGERR_AUTO"], rows["MU_MAX"] = [-6.0, -7.0, -8.0, -6.5], 0.0125, [-5.0, -6.5, -6.0, -6.0]
        rows["X_IMAGE"], rows["Y_IMAGE"] = 1024 + 2048, 2048 + 4096
        table = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 56), ("NAXIS2", 4), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 7)]
        for i, n in enumerate(names, 1):
            table += [(f"TTYPE{i}", n), (f"TFORM{i}", "D")]
        head = [("XTENSION", "IMAGE"), ("BITPIX", 8), ("NAXIS", 0), ("OBSMJD", 55000.5 + f), ("DBFID", 2), ("PTFFIELD", 100 + f), ("MEDFWHM", 2.5), ("APBSRMS", 0.1 if f else 0.0)]
        head += [("AEXPTIME", 100.0), ("AIRMASS", 1.5), ("OBSJD", 7.0), ("APMEDJD", 5.0)] + [(f"APPAR{k:02d}", {1: 18.0, 3: 0.1, 5: 0.01, 6: 0.001, 7: 0.2, 8: 0.3}.get(k, 0.0)) for k in range(1, 12)]
        (tmp_path / f"c{f}.fits").write_bytes(unit([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + unit(table, rows.tobytes()) + unit(head))
    root = str(tmp_path / "db")
    run = lambda: cli.main(["--db", root, "import", "catalogs", "det", *[str(tmp_path / f"c{f}.fits") for f in range(3)], "--exposures", "exp"], spark)
    assert run() == 0 and "3 exposures" in capsys.readouterr().out
    db = Database(spark, root)
    got = [tuple(r) for r in db.query("exp.ptf_field AS f, mag_auto, mag_abs, magerr_abs FROM det, exp").dataframe().collect()]
    shift = 5.0 + 18.0 + 0.15 + 0.02 + 0.004 + 0.2 + 0.3
    want = [(100, int(m * 1000), 32000, 12) for m in (-6, -7, -8)] + [(100 + f, int(m * 1000), round((m + shift) * 1000), 12) for f in (1, 2) for m in (-6, -7, -8)]
    assert sorted(got) == sorted(want)
    stars = {r["ptf_field"]: (r["n_bright"], round(r["mumax_med"], 3), round(r["mumax_rms"], 4)) for r in db.read("exp").collect()}
    spread = [1.0, 0.5, 2.0]  # bright: mag_abs below 17000
    bright = [s for s, m in zip(spread, (-6, -7, -8)) if 14 < m + shift < 17]
    q = np.percentile(bright + ([0.5] if 14 < -6.5 + shift < 17 else []), [25, 50, 75])
    assert stars[100][0] == 0 and stars[101] == (len(bright) + (14 < -6.5 + shift < 17), round(float(q[1]), 3), round(0.741 * (q[2] - q[0]), 4))
    assert run() == 0 and "0 exposures" in capsys.readouterr().out and db.read("det").count() == 9


def test_copies_are_deleted_when_nothing_refers_to_them(spark):
    import gc
    import time
    from pathlib import Path

    from skyframe.session import cut

    df = cut(spark.range(1000))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    del df
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)
        if len({p.name for p in folder.iterdir()} & before) < len(before):
            return
    raise AssertionError("the copy is still there")


def test_stored_hooks_and_dead_writers(spark, tmp_path, monkeypatch, capsys):
    import sys
    import types

    from skyframe.catalog.table import CatalogError

    called = []
    module = types.ModuleType("own_hooks")
    module.note = lambda db, table, *more: called.append((table, *more))
    monkeypatch.setitem(sys.modules, "own_hooks", module)
    root = str(tmp_path / "db")
    db = Database(spark, root)
    definition = {"schema": {"main": {"columns": [("id", "u8"), ("ra", "f8"), ("dec", "f8")], "primary_key": "id", "spatial_keys": ["ra", "dec"]}}, "commit_hooks": [["Note it", 1, "own_hooks", "note", ["x"]], ["Plain", 0, "own_hooks", "note"]]}
    db.create_table("t", definition)
    rows = spark.createDataFrame([(1.0, 2.0)], "ra double, dec double")
    Database(spark, root).write("t", rows)
    assert called == [("t",), ("t", "x")]
    Database(spark, root).begin_transaction()  # and its writer dies
    with pytest.raises(CatalogError):
        Database(spark, root).write("t", rows)
    assert cli.main(["--db", root, "admin", "unlock"], spark) == 0 and "no lock" in capsys.readouterr().out
    assert cli.main(["--db", root, "admin", "unlock", "--older-than", "0"], spark) == 0 and "unlocked" in capsys.readouterr().out
    Database(spark, root).write("t", rows)
    assert db.read("t").count() == 2


def test_streams(spark, tmp_path):
    from datetime import datetime

    from skyframe.streaming import windows

    source, out = str(tmp_path / "in"), []
    schema = "k long, kind string, t timestamp"
    at = lambda h, m: datetime(2030, 1, 1, h, m)
    first = [(1, "a", at(0, 5)), (2, "a", at(0, 50)), (2, "a", at(0, 50)), (3, "b", at(1, 10))]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    counts = windows.windowed_counts(stream(), "t", ["kind"], "1 hour")
    windows.ingest(counts, lambda df, n: out.append([(r["kind"], r["start"].hour, r["n"]) for r in df.collect()]), str(tmp_path / "s1"), "complete").awaitTermination()
    assert sorted(out[-1]) == [("a", 0, 3), ("b", 1, 1)]
    seen = []
    once = lambda: windows.ingest(windows.once_each(stream(), "k", "t"), lambda df, n: seen.extend(r["k"] for r in df.collect()), str(tmp_path / "s2")).awaitTermination()
    once()
    spark.createDataFrame([(3, "b", at(1, 10)), (4, "b", at(2, 0))], schema).write.mode("append").parquet(source)
    once()  # goes on where it stopped; what came before does not come again
    assert sorted(seen) == [1, 2, 3, 4]
