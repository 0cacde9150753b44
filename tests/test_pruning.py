"""What scans take over, and which cells reads, joins and writes open; asserted on plans and on the files opened."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.catalog import table as stored
from skyframe.catalog.database import Database
from skyframe.plans.bounds import T, beam


def plan(df):
    return df._jdf.queryExecution().toString()


def pushed(df):
    return " ".join(re.findall(r"PushedFilters: \[[^\]]*\]", plan(df)))


@pytest.fixture()
def files(spark, tmp_path):
    db = Database(spark)
    k = np.arange(200)
    orders = pd.DataFrame({"k": k, "c": k % 20, "status": np.where(k % 2, "F", "O"), "price": k * 10.0, "mag": np.where(k % 7 == 0, np.nan, k / 10)})
    spark.createDataFrame(orders).write.parquet(str(tmp_path / "orders"))
    spark.createDataFrame(pd.DataFrame({"id": np.arange(20)})).write.parquet(str(tmp_path / "people"))
    db.register("orders", spark.read.parquet(str(tmp_path / "orders")), primary_key="k")
    db.register("people", spark.read.parquet(str(tmp_path / "people")), primary_key="id")
    db.define_default_join("people", "orders", "equi", left=("people", "id"), right=("orders", "c"))
    return db


def test_predicates_reach_the_scan(files):
    one = files.query("k, price / 10 AS tenth FROM orders WHERE (tenth > 100) & (status == 'F')").dataframe()
    assert "EqualTo(status,F)" in pushed(one) and one.count() == 50
    some = files.query("k FROM orders WHERE np.in1d(status, ['F', 'P']) & ~np.in1d(c, [1, 4, 7])").dataframe()
    assert "In(status, [F,P]" in pushed(some) and some.count() == 80
    joined = files.query("id, orders.price AS p FROM people, orders WHERE p > 1500 and id < 5").dataframe()
    assert "GreaterThan(price,1500" in pushed(joined) and "LessThan(id,5)" in pushed(joined) and joined.count() == 10
    below = files.query("k FROM orders WHERE mag < 3 and mag == mag").dataframe()
    assert "LessThan(mag,3.0)" in pushed(below) and below.count() == 30 - 5
    above = files.query("k FROM orders WHERE mag > 3").dataframe()
    assert "GreaterThan(mag,3.0)" in pushed(above) and above.count() == len([i for i in range(31, 200) if i % 7])
    assert files.query("k FROM orders WHERE not mag > 3").count() == 200 - above.count()


def stars(spark, n, start=0):
    k = np.arange(start, start + n)
    return spark.createDataFrame(pd.DataFrame({"ra": (k * 77.7) % 360, "dec": ((k * 31.3) % 160) - 80, "n": k}))


@pytest.fixture()
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    for name in ("a", "b"):
        db.create_table(name, {"level": 4, "schema": {"main": {"columns": [("id", "u8"), ("ra", "f8"), ("dec", "f8"), ("n", "i4")], "primary_key": "id", "spatial_keys": ["ra", "dec"]}}})
        db.write(name, stars(spark, 300))
    return db


def cells_opened(df):
    return {m for p in df.inputFiles() for m in re.findall(r"_CELL=(-?\d+)", p)}


def test_joined_tables_are_pruned(db, spark):
    text = "a.n AS n, b.n AS m FROM a, b(matchedto=a, nmax=1, dmax=3600)"
    every = db.query(text).dataframe()
    near = db.query(text).dataframe(bounds=[beam(100, 20, 12)])
    filters = re.findall(r"PartitionFilters: \[([^\]]*)", plan(near))
    assert filters and all("_CELL" in f for f in filters)
    assert len(cells_opened(near)) < 0.25 * len(cells_opened(every))
    inside = {r["n"] for r in db.query("n FROM a").dataframe(bounds=[beam(100, 20, 12)]).collect()}
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in every.collect() if r["n"] in inside} != set()
    loose = {tuple(r) for r in db.query(text).dataframe(bounds=[beam(100, 20, 12)], testbounds=False).collect()}
    assert {tuple(r) for r in near.collect()} <= loose <= {tuple(r) for r in every.collect()}


def test_key_joins_run_on_cells(db, spark):
    ids = {r["n"]: r["id"] for r in db.read("b").collect()}
    own = {r["n"]: r["id"] for r in db.read("a").collect()}
    rows = [(own[n], ids[(n * 3) % 300]) for n in range(0, 300, 2)] + [(own[1], 12345), (own[3], None)]
    db.register("links", spark.createDataFrame(rows, "m1 long, m2 long"))
    db.define_default_join("a", "b", "indirect", m1=("links", "m1"), m2=("links", "m2"))
    got = db.query("a.n AS n, b.n AS m FROM a, b WHERE n < 40").dataframe()
    assert sorted(tuple(r) for r in got.collect()) == [(n, (n * 3) % 300) for n in range(0, 40, 2)]
    assert "b._CELL" in plan(got)
    outer = db.query("a.n AS n, b.n AS m, b._ISNULL AS gone FROM a, b(outer) WHERE n < 4").dataframe()
    assert sorted(tuple(r) for r in outer.collect()) == [(0, 0, False), (1, 0, True), (2, 6, False), (3, 0, True)]


def test_times_prune_inner_tables(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_table("s", {"level": 2, "schema": {"main": {"columns": [("id", "u8"), ("ra", "f8"), ("dec", "f8")], "primary_key": "id", "spatial_keys": ["ra", "dec"]}}})
    db.create_table("d", {"level": 2, "schema": {"main": {"columns": [("id", "u8"), ("ra", "f8"), ("dec", "f8"), ("t", "f8")], "primary_key": "id", "spatial_keys": ["ra", "dec"], "temporal_key": "t"}}})
    db.write("s", spark.createDataFrame([(10.0 * i, 5.0) for i in range(10)], "ra double, dec double"))
    db.write("d", spark.createDataFrame([(10.0 * i, 5.0, 54400.0 + j) for i in range(10) for j in range(6)], "ra double, dec double, t double"))
    df = db.query("s.ra AS ra, d.t AS t FROM s, d(matchedto=s, nmax=9, dmax=5)").dataframe(bounds=[T(54401, 54402.5)])
    assert df.count() == 20
    slices = {m for p in df.inputFiles() for m in re.findall(r"_T=(\d+)", p)}
    assert len(slices - {"0"}) == 2


def test_writes_open_touched_cells(db, spark, monkeypatch):
    opened = []
    original = stored.Table._stored

    def watched(self, *args, **options):
        df = original(self, *args, **options)
        opened.append(cells_opened(df))
        return df

    monkeypatch.setattr(stored.Table, "_stored", watched)
    some = db.read("a").where("n = 7").first()
    assert len(opened.pop()) > 100
    db.write("a", spark.createDataFrame([(some["id"], 700)], "id long, n int"), "upsert", "id")
    assert opened and all(len(c) <= 1 for c in opened)
    opened.clear()
    db.write("a", spark.createDataFrame([(some["ra"], some["dec"], 701)], "ra double, dec double, n int"))
    assert opened and all(len(c) <= 1 for c in opened)
    opened.clear()
    db.write("a", spark.createDataFrame([(700, 9.0)], "n int, dec double"), "update", "n")
    assert sum(len(c) > 1 for c in opened) == 1  # the one column that is looked for
    opened.clear()
    db.remove("a", spark.createDataFrame([(some["id"],), (5,), (None,)], "id long"))
    assert [len(c) for c in opened] == [2, 1]  # the cell that id 5 would be in, too
    left = {r["n"] for r in db.read("a").collect()}
    assert left == set(range(300)) - {7} | {701} and db.table("a").check_catalog().count() == 0


def test_history_does_not_grow_the_plan(db, spark, monkeypatch):
    for k in range(4):
        db.write("a", stars(spark, 3, 1000 + 3 * k))
    few = db.read("a", bounds=[beam(100, 20, 12)])
    assert plan(few).count("Union") == 0
    wide = {r["n"] for r in db.read("a").collect()}
    monkeypatch.setattr(stored, "NAMED_CELLS", 3)
    many = db.read("a")
    assert plan(many).count("Union") == 0 and {r["n"] for r in many.collect()} == wide == set(range(300)) | set(range(1000, 1012))
    assert {r["n"] for r in db.read("a", bounds=[beam(100, 20, 12)]).collect()} == {r["n"] for r in few.collect()}


def test_one_cell_opens_one_cell(db):
    cell = db.query("_CELLID AS c FROM a WHERE n == 11").fetch()["c"].iloc[0]
    df = db.query("n FROM a").dataframe(cells=[int(cell)])
    assert len(cells_opened(df)) == 1 and 11 in set(db.query("n FROM a").fetch_cell(int(cell))["n"])
    halo = db.query("n, _CELLID AS c FROM a").dataframe(cells=[int(cell)], include_cached=True)
    assert 1 < len(cells_opened(halo)) <= 12 and set(halo.toPandas()["c"]) == {cell}
    assert db.query("n FROM a").dataframe(cells=[int(cell)]).where(F.col("n") == 12).count() == 0
