"""Stored tables: keys, cells, snapshots, upserts, transactions, pruning; files in and out; association."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe import cli
from skyframe.catalog.database import Database
from skyframe.catalog.table import CatalogError
from skyframe.operators import aggregate, associate, rows
from skyframe.plans.bounds import beam
from skyframe.sources import fits, par, surveys, text

DEFINITION = {"level": 2, "schema": {"main": {"columns": [("id", "u8"), ("ra", "f8"), ("dec", "f8"), ("t", "f8"), ("n", "i4"), ("s", "a3")], "primary_key": "id", "spatial_keys": ["ra", "dec"], "temporal_key": "t"}}}


@pytest.fixture()
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def stars(spark, n, start=0):
    k = np.arange(start, start + n)
    return spark.createDataFrame(pd.DataFrame({"ra": (k * 77.7) % 360, "dec": ((k * 31.3) % 160) - 80, "t": 54336.0 + k % 3, "n": k, "s": "abcdef"}))


def test_append_upsert_snapshots(db, spark):
    db.create_table("stars", DEFINITION)
    with pytest.raises(CatalogError):
        db.create_table("stars", DEFINITION)
    ids = [r[0] for r in db.write("stars", stars(spark, 40)).collect()]
    assert len(set(ids)) == 40
    t = db.table("stars")
    assert t.nrows() == 40 == db.read("stars").count() and t.check_catalog().count() == 0
    assert {r["s"] for r in db.read("stars").collect()} == {"abc"}
    first = t.current()
    more = [r[0] for r in db.write("stars", stars(spark, 5, 100)).collect()]
    assert not set(more) & set(ids)
    assert db.query("id, n * 10 AS n FROM stars WHERE n < 30 INTO stars WHERE id == id").write().count() == 3
    got = {r["n"]: r["s"] for r in db.read("stars").collect()}
    assert {0, 10, 20} <= set(got) and not {1, 2} & set(got) and got[20] == "abc"
    assert Database(spark, db.roots, snapid=first).read("stars").count() == 40
    with pytest.raises(CatalogError):
        db.write("stars", db.read("stars").limit(1))  # the key is there
    with pytest.raises(CatalogError):
        db.write("stars", stars(spark, 1).withColumn("unknown", F.lit(1)))
    with pytest.raises(CatalogError):
        db.write("stars", stars(spark, 1).withColumn("t", F.lit(1.0)))  # before the first time slice
    assert db.read("stars").count() == 45 and not db.in_transaction()
    assert t.check_catalog().count() == 0
    t.rebuild_catalog()
    assert t.nrows() == 45


def test_transactions_hooks_and_vacuum(db, spark):
    db.create_table("stars", DEFINITION)
    called = []
    db.on_commit("stars", lambda d, t: called.append("late"), 10)
    db.on_commit("stars", lambda d, t: called.append("early"), -1)
    with db.transaction():
        db.write("stars", stars(spark, 3))
        db.write("stars", stars(spark, 2, 50))
        assert db.read("stars").count() == 5
        assert Database(spark, db.roots).read("stars").count() == 0
        with pytest.raises(CatalogError):
            Database(spark, db.roots).begin_transaction()
    assert called == ["early", "late"] and Database(spark, db.roots).read("stars").count() == 5
    with pytest.raises(RuntimeError):
        with db.transaction():
            db.write("stars", stars(spark, 4, 70))
            raise RuntimeError
    assert db.read("stars").count() == 5 and db.table("stars").vacuum() == []


def test_into_new_table_columns_and_empty(db, spark):
    db.create_table("stars", DEFINITION)
    assert db.read("stars").count() == 0 and db.write("stars", stars(spark, 3).limit(0)).count() == 0
    db.write("stars", stars(spark, 6))
    db.query("ra, dec, n FROM stars INTO copy(spatial_keys=(ra, dec))").write()
    assert db.read("copy").columns == ["id", "ra", "dec", "n"] and db.read("copy").count() == 6
    db.query("n, n * 0.5 AS half FROM stars WHERE n > 3 INTO copy WHERE n == n").write()
    assert sorted(r["half"] for r in db.read("copy").collect()) == [0.0, 0.0, 0.0, 0.0, 2.0, 2.5]
    db.define_alias("copy", "number", "n")
    assert db.query("number FROM copy WHERE _LAT > -100").count() == 6
    with pytest.raises(CatalogError):
        db.define_alias("copy", "n", "ra")


def test_cells_bounds_and_halo(db, spark):
    db.create_table("stars", DEFINITION)
    db.write("stars", stars(spark, 60))
    q = db.query("n, _CELLID AS c FROM stars")
    every = q.fetch()
    some = int(every["c"].iloc[0])
    assert set(q.fetch(cells=[some])["n"]) == set(every[every["c"] == some]["n"]) == set(q.fetch_cell(some)["n"])
    near = q.fetch(bounds=[beam(10, 10, 40)])
    loose = q.fetch(bounds=[beam(10, 10, 40)], testbounds=False)
    assert 0 < len(near) < len(loose) < 60
    plan = db.query("n FROM stars").dataframe(bounds=[beam(10, 10, 5)])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_CELL" in plan
    assert len(db.query("n, _CACHED AS c FROM stars").fetch(include_cached=True)) >= 60
    rows_ = list(db.query("n FROM stars").iterate())
    blocks = list(db.query("n FROM stars").iterate(return_blocks=True, filter=lambda b: b[b["n"] > 50]))
    assert len(rows_) == 60 and sum(len(b) for b in blocks) == 9


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("head\n# comment\n1 10:30:0 TRUE abc ; note\n\n2 -1:0:0 0 d#x\n")
    df = text.read_text(spark, str(tmp_path / "in.txt"), "k:1,pos:2,ok:3,name:4", {"k": "i4", "ok": "bool", "name": "a5"}, skip_header=1, dms_columns=("pos",), constants={"src": 7})
    assert sorted(tuple(r) for r in df.collect()) == [(1, 10.5, True, "abc", 7), (2, -1.0, False, "d", 7)]
    (tmp_path / "bad.csv").write_text("1,2\nx,3\n18446744073709551615,4\n")
    loose = text.read_text(spark, str(tmp_path / "bad.csv"), "a,b", {"a": "u8"}, ",", strict=False)
    assert sorted(tuple(r) for r in loose.collect()) == [(-1, 4.0), (1, 2.0)]
    with pytest.raises(Exception):
        text.read_text(spark, str(tmp_path / "bad.csv"), "a,b", {"a": "u8"}, ",").collect()
    text.write_text(df, str(tmp_path / "out"), single=True)
    back = text.read_text(spark, str(tmp_path / "out"), "k,pos,ok,name,src", {"k": "i4", "ok": "bool", "name": "a5"})
    assert sorted(r["pos"] for r in back.collect()) == [-1.0, 10.5] and text.write_null(df) == 2


def test_fits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, True, "abc", [1.0, 2.0], 1 << 40), (2, float("nan"), False, "", [3.0, 4.0], -5)], "i int, x double, p boolean, s string, v array<float>, k long")
    path = str(tmp_path / "t.fits")
    fits.write_fits(df, path)
    back = sorted(tuple(r) for r in fits.read_fits(spark, path).collect())
    assert back[0] == (1, 2.5, True, "abc", [1.0, 2.0], 1 << 40) and back[1][1] != back[1][1] and back[1][3:] == ("", [3.0, 4.0], -5)
    part = fits.read_fits(spark, path, "a int, b double", {"a": "i", "b": "absent"}).collect()
    assert part[0]["notfound"] == ["absent"] and part[0]["b"] != part[0]["b"]
    heads = fits.read_headers(spark, path).collect()
    assert [h["unit"] for h in heads] == [0, 1] and "TTYPE1" in heads[1]["header"]
    with pytest.raises(fits.FitsError):
        list(fits.headers(b"SIMPLE".ljust(2880)))


def test_exposure_import(db, spark, tmp_path):
    def unit(cards, table=None):
        body = b"".join(fits._card(k, v) for k, v in cards) + b"END".ljust(80)
        return fits._padded(body, b" ") + (fits._padded(table, b"\0") if table is not None else b"")

    chip = np.zeros(3, [("ra", ">f8"), ("dec", ">f8"), ("mag", ">f4")])
    chip["ra"], chip["dec"], chip["mag"] = [10.0, 370.5, np.nan], [5.0, 95.0, 1.0], [20, 21, 22]
    data = unit([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("FILTERID", "r.0000"), ("RA", 10.0), ("DEC", 5.0), ("MJD-OBS", 55000.5)])
    data += unit([("XTENSION", "IMAGE"), ("BITPIX", 8), ("NAXIS", 0), ("EXTNAME", "XY33.hdr")])
    data += unit([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 20), ("NAXIS2", 3), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 3), ("TTYPE1", "RA_PSF"), ("TFORM1", "D"), ("TTYPE2", "DEC_PSF"), ("TFORM2", "D"), ("TTYPE3", "PSF_INST_MAG"), ("TFORM3", "E"), ("EXTNAME", "XY33.psf")], chip.tobytes())
    (tmp_path / "o1.smf").write_bytes(data)
    assert surveys.import_exposures(db, "det", "exp", str(tmp_path / "o1.smf"), "3pi", create=True).count() == 1
    e = db.read("exp").first()
    assert e["filterid"] == "r.0000" and e["smf_fn"] == "o1" and "AIRMASS" in e["notfound_keys"] and "AP_MAG" in e["notfound_cols"][27] and e["airmass"] != e["airmass"]
    got = sorted((r["ra"], r["dec"], r["mag"], r["f"]) for r in db.query("ra, dec, psf_inst_mag AS mag, exp.filterid AS f FROM det, exp").dataframe().collect())
    assert [g[:2] for g in got] == [(10.0, 5.0), (10.5, 90.0)] and {g[3] for g in got} == {"r.0000"}
    assert len(list(surveys.chips())) == 60


def test_file_uris(db, spark, tmp_path):
    db.create_table("stars", DEFINITION)
    folder = tmp_path / "db" / "stars" / "files" / "hdr"
    folder.mkdir(parents=True)
    (folder / "one.txt").write_bytes(b"A = 1")
    df = spark.createDataFrame([(1, "sky:stars:hdr:one.txt"), (2, "sky:stars:hdr:none.txt"), (3, None), (4, "sky:stars:hdr:one.txt")], "k int, uri string")
    got = {r["k"]: r["content"] for r in db.fetch_uris(df, "uri").collect()}
    assert got == {1: b"A = 1", 2: None, 3: None, 4: b"A = 1"}
    db.register("h", db.fetch_uris(df, "uri").withColumn("hdr", F.decode("content", "utf-8")), primary_key="k")
    assert sorted(r["a"] for r in db.query("fitskw(hdr, 'A', -1) AS a FROM h").dataframe().collect()) == [-1.0, -1.0, 1.0, 1.0]


def test_followed_tables(db, spark, tmp_path):
    db.create_table("stars", DEFINITION)
    db.write("stars", stars(spark, 3))
    other = Database(spark, str(tmp_path / "other"))
    with pytest.raises(CatalogError):
        other.follow("stars", str(tmp_path / "nowhere"))
    other.follow("stars", db.roots[0])
    assert other.read("stars").count() == 3 and other.table_exists("stars")
    other.unfollow("stars")
    assert not other.table_exists("stars") and Database(spark, str(tmp_path / "other")).table_exists("db.stars")


def test_par_and_yaml(spark, tmp_path):
    (tmp_path / "x.par").write_text('typedef struct {\n int run;\n double v[2];\n char name[20];\n} RUNS;\n# c\nRUNS 94 {1.5 2} "two \\\nwords"\nRUNS 5 {3 4} {}\n')
    got = [tuple(r) for r in par.read_par(spark, str(tmp_path / "x.par")).collect()]
    assert got == [(94, [1.5, 2.0], "two  words"), (5, [3.0, 4.0], "")]
    d = par.read_definition("schema:\n  main:\n    columns:\n      - [id, u8]\n      - [ra, f8]\n    primary_key: id\n")
    assert d["schema"]["main"]["columns"] == [("id", "u8"), ("ra", "f8")]
    table = par.file_table(spark, f"{tmp_path / 'x.par'}:run:name")
    db = Database(spark)
    db.register("r", spark.createDataFrame([(94,), (1,)], "run int"), primary_key="run")
    assert [r["n"] for r in db.query("look(run) AS n FROM r", {"look": table}).dataframe().collect()] == ["two  words", ""]


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    run = lambda *a: cli.main(["--db", root, *a], spark)
    assert run("admin", "create", "t", "id:u8", "ra", "dec", "n:i4", "--primary-key", "id", "--spatial-keys", "ra,dec") == 0
    (tmp_path / "in.txt").write_text("10 20 1\n10.0001 20 2\n200 -5 3\n")
    assert run("import", "text", "t", str(tmp_path / "in.txt")) == 0
    assert run("query", "n FROM t WHERE n > 1", "--bounds", "beam(10, 20, 1)") == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["# n", "          2"]
    assert run("admin", "create", "u", "id:u8", "ra", "dec", "--primary-key", "id", "--spatial-keys", "ra,dec") == 0
    assert run("query", "ra, dec FROM t INTO u") == 0
    assert run("xmatch", "t", "u", "--radius", "2", "--neighbors", "5") == 0 and "5 links" in capsys.readouterr().out
    assert run("footprint", "ra, dec FROM t", "--dx", "10") == 0 and capsys.readouterr().out.split() == ["1", "7", "2", "20", "9", "1"]
    assert run("query", "u.ra AS r FROM t, u(nmax=9) WHERE t.n == 3") == 0 and capsys.readouterr().out.split()[-1] == "200.00000000"
    for words in (("check", "nrows", "t"), ("check", "catalog", "t"), ("admin", "desc", "t"), ("admin", "snapshots", "t"), ("admin", "vacuum", "t"), ("query", "n FROM t", "--format", "null")):
        assert run(*words) == 0
    with pytest.raises(ValueError):
        cli.bounds_of("__import__('os')")


def test_association(spark):
    rng = np.random.default_rng(8)
    n, visits = 120, 4
    ra, dec = rng.uniform(44.9, 45.1, n), rng.uniform(-0.1, 0.1, n)
    frames = [pd.DataFrame({"det_id": np.arange(n) + 1000 * v, "exp_id": v + 1, "mjd": 55000.0 + v, "ra": ra + rng.normal(0, 2e-5, n), "dec": dec + rng.normal(0, 2e-5, n)}) for v in range(visits)]
    det = spark.createDataFrame(pd.concat(frames))
    det = det.unionByName(det.limit(5)).unionByName(spark.createDataFrame([(99999, None, 1.0, 1.0, 1.0), (99998, 1, 1.0, float("nan"), 1.0)], det.schema))
    radius = 1 / 3600
    objects, links = associate.associate(det, radius)
    objects, links = objects.cache(), links.cache()
    assert objects.count() == n and links.count() == n * visits
    assert {r["n"] for r in associate.sanity(det.where("exp_id IS NOT NULL AND NOT isnan(ra)").dropDuplicates(["det_id"]), objects, links, radius).collect()} == {0}
    again, more = associate.associate(det, radius, objects)
    assert again.count() == 0 and more.count() == n * visits
    # detections of one exposure never match each other's new objects
    pair = spark.createDataFrame([(1, 1, 1.0, 10.0, 0.0), (2, 1, 1.0, 10.0, 0.0), (3, 2, 2.0, 10.0, 0.0)], "det_id long, exp_id long, mjd double, ra double, dec double")
    assert sorted((r["det_id"], r["obj_id"]) for r in associate.associate(pair, radius)[1].collect()) == [(1, 1), (2, 2), (3, 1)]
    assert associate.associate(pair.limit(0), radius)[1].count() == 0


def test_blocks_keep_groups_together(spark):
    pdf = pd.DataFrame({"k": np.random.default_rng(99).integers(0, 30, 500), "v": np.arange(500)})
    for most in (1000, 100, 10, 1):
        blocks = list(aggregate.partition_by_key(spark.createDataFrame(pdf), "k", most))
        assert all(len(b) <= most or b["k"].nunique() == 1 for b in blocks)
        seen = [k for b in blocks for k in b["k"].unique()]
        assert len(seen) == len(set(seen)) and sum(len(b) for b in blocks) == 500
    assert list(aggregate.partition_by_key(spark.createDataFrame(pdf).limit(0), "k", 10)) == []


def test_row_algebra(spark):
    df = spark.createDataFrame([(i, float(i % 3), [i]) for i in range(10)], "k int, v double, a array<int>")
    assert sorted(r["k"] for r in rows.row_slice(df, ["k"], -4, None, 2).collect()) == [6, 8]
    assert [r["k"] for r in rows.take_rows(df, ["k"], [3, 3, 0]).collect()] == [3, 3, 0]
    assert [r["equal"] for r in rows.rows_equal(df, rows.set_where(df, F.col("k") == 2, v=9.0), "k").orderBy("k").collect()].count(False) == 1
    assert rows.stack([df, df]).count() == 20 and rows.stack([], df).columns == df.columns
    assert rows.semi(df, "k", df.where("k < 3"), "k", True).count() == 7


def test_maps_and_flats(spark):
    from skyframe.functions import maps

    image = np.arange(9.0).reshape(3, 3)
    keys = {"CRPIX1": 2, "CRPIX2": 2, "LAM_SCAL": 1.0}
    m = maps.DustMap(spark, {"ngp": (keys, image), "sgp": (keys, image + 100)})
    df = spark.createDataFrame([(0.0, 90.0), (0.0, 0.0), (90.0, 0.0), (0.0, -90.0), (None, 1.0)], "l double, b double")
    assert [r[0] for r in df.select(m.column(F.col("l"), F.col("b"))).collect()] == [4.0, 5.0, 1.0, 104.0, None]
    flats = maps.flat_table(spark, {"r": {"mjd": [55000.2], "stack": np.ones((64, 64, 1)), "mask": np.eye(64), "weights": np.array([[0.25]])}})
    det = spark.createDataFrame([(33, 10, 10, 55000.7, "r.0000"), (33, 10, 10, 55001.7, "r.0000"), (33, 10, 10, 55000.7, "g.0000")], "chip int, x int, y int, mjd double, filterid string")
    assert sorted(r["offs"] for r in maps.flat_offsets(det, flats, "chip", "x", "y", "mjd", "filterid").collect())[:2] == [0.0, 0.0]
