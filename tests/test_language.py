"""Parser, expressions, joins, bounds: values worked out by hand or in plain Python."""

import math

import numpy as np
import pandas as pd
import pytest

from skyframe.catalog.database import Database
from skyframe.functions import pixels, registry, sky
from skyframe.operators import mapreduce
from skyframe.plans import joins
from skyframe.plans.bounds import IntervalSet, T, beam, make_canonical, rectangle
from skyframe.plans.expr import Lookup
from skyframe.plans.parser import QueryError, parse
from pyspark.sql import functions as F


def test_parse():
    q = parse("select a, b+c as d, f(x, (1, 2)) as (u, v), t.* from 'my t' as t, s(matchedto=t, nmax=5, dmax=15) where (a > 1) & b in (1, 2) into out(spatial_keys=(ra, dec)) where id |= t._ID")
    assert [i.text for i in q.items] == ["a", "b+c", "f(x, (1, 2))", "t.*"] and q.items[2].names == ["u", "v"]
    assert (q.sources[0].table, q.sources[0].name) == ("my t", "t") and q.sources[1].args == {"matchedto": "t", "nmax": 5, "dmax": 15}
    assert (q.into.table, q.into.mode, q.into.column, q.into.args["spatial_keys"]) == ("out", "upsert", "id", ("ra", "dec"))
    assert parse("_ from _ into exp2 where aa == bb").into.mode == "update" and parse("x from t into u at x").into.mode == "at"
    for bad in ("select from t", "a b from t", "a from t, t", "a from t(inner, outer)", "a from t(zmax=1)", "a from t where", "a from t into u(dtype=1)", "a, from t", "a from t where (a", "a from t junk junk"):
        with pytest.raises(QueryError):
            parse(bad)


@pytest.fixture(scope="module")
def db(spark):
    db = Database(spark)
    rows = [(1, 7, -7, 2.0, True, [1, 2, 3, 4], "x"), (2, 0, 3, float("nan"), False, [5, 6], "y"), (3, -4, 0, -1.0, None, None, None), (4, None, 1, None, True, [], "z")]
    db.register("t", spark.createDataFrame(rows, "id long, a int, b int, f double, p boolean, v array<int>, s string"), primary_key="id")
    return db


def value(db, text, **names):
    return [None if x is None or (isinstance(x, float) and math.isnan(x) and False) else x for x in [r["r"] for r in sorted(db.query(f"id, {text} AS r FROM t", names).dataframe().collect(), key=lambda r: r["id"])]]


def test_expression_semantics(db):
    assert value(db, "a / 2") == [3, 0, -2, None] and value(db, "b / 2") == [-4, 1, 0, 0]
    assert value(db, "b % 4") == [1, 3, 0, 1] and value(db, "a // b") == [-1, 0, 0, None]
    assert value(db, "a & 5") == [5, 0, 4, None] and value(db, "~a") == [-8, -1, 3, None] and value(db, "p & (id > 0)") == [True, False, None, True]
    inf = value(db, "1.0 / b")
    assert inf[2] == math.inf and value(db, "f == f") == [True, False, True, None] and value(db, "f > 1") == [True, False, False, None] and value(db, "f != f")[1] is True
    assert value(db, "np.log10(b)")[0] != value(db, "np.log10(b)")[0] and value(db, "np.log10(b)")[2] == -math.inf
    assert value(db, "v(0)") == [1, 5, None, None] and value(db, "v(-1)") == [4, 6, None, None] and value(db, "v((1, 3))") == [[2, 3], [6], None, []]
    assert value(db, "v((0, 4, 2))") == [[1, 3], [5], None, []] and value(db, "v(id)") == [2, None, None, None]
    assert value(db, "np.minimum(a, b)")[3] is None and value(db, "0 < a <= 7") == [True, False, False, None]
    assert value(db, "m(a)", m=Lookup({7: 70, 0: 1})) == [70, 1, 0, 0] and value(db, "k + id", k=10) == [11, 12, 13, 14]
    assert value(db, "id if p else 0") == [1, 0, 0, 4] and value(db, "s in ('x', 'z')") == [True, False, False, True]
    for bad in ("np.sum(a)", "nothing", "a.b", "__import__('os')", "v[0]", "s * 2", "f & 1"):
        with pytest.raises(QueryError):
            value(db, bad)


def test_names_and_aliases(db):
    df = db.query("a AS b, b + 1 AS c FROM t WHERE b == 7").dataframe()
    assert [tuple(r) for r in df.collect()] == [(7, 8)]
    assert db.query("id, (a, b) AS (x, y), (a, f) FROM t").dataframe().columns == ["id", "x", "y", "(a,f)[0]", "(a,f)[1]"]
    assert db.query("*, t.* FROM t").dataframe().columns == ["id", "a", "b", "f", "p", "v", "s", "t.id", "t.a", "t.b", "t.f", "t.p", "t.v", "t.s"]
    assert db.query("_ID AS i, equgal(10.0, 20.0) FROM t").dataframe().columns == ["i", "l", "b"]
    db.define("twice = lambda x: x * 2")
    assert [r["r"] for r in db.query("twice(id) AS r FROM t WHERE id == 3").dataframe().collect()] == [6]
    with pytest.raises(TypeError):
        db.query("id FROM t").fetch(unknown=1)


#: The link-join example.
ID1, M1, M2, ID2 = [3, 11, 4, 2, 7, 4], [2, 4, 11, 4, 8, 422, 0, 4], [7, 1, 2, 3, 2, 321, 6, 42], [2, 7, 1, 3, 1, 578, 422]


def test_link_join(spark):
    left = spark.createDataFrame([(i,) for i in ID1], "id1 long")
    links = spark.createDataFrame(list(zip(M1, M2)), "m1 long, m2 long")
    right = spark.createDataFrame([(i,) for i in ID2], "id2 long")
    out = sorted((r["id1"], r["id2"] or 0, r["_ISNULL"]) for r in joins.link_join(left, "id1", links, "m1", "m2", right, "id2", True).collect())
    four = [(4, 0, True), (4, 1, False), (4, 1, False), (4, 3, False)]
    assert out == sorted([(3, 0, True), (11, 2, False), (2, 7, False), (7, 0, True), *four, *four])
    assert joins.link_join(left, "id1", links, "m1", "m2", right, "id2").count() == 8
    assert joins.link_join(left.limit(0), "id1", links, "m1", "m2", right, "id2", True).count() == 0


def test_geometry_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"lon": np.r_[rng.uniform(0, 360, 300), 10, 80, 0, 0, 359.999], "lat": np.r_[np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), 10, 80, 90, -90, 0]})
    x, y = sky.butterfly(F.col("lon"), F.col("lat"))
    df = spark.createDataFrame(pdf).withColumn("x", x).withColumn("y", y)
    a, b = sky.butterfly_inverse(F.col("x"), F.col("y"))
    got = df.withColumn("d", sky.gc_dist(F.col("lon"), F.col("lat"), a, b)).withColumn("id", sky.position_id(F.col("lon"), F.col("lat"))).toPandas()
    px, py = pixels.butterfly(pdf["lon"].to_numpy(), pdf["lat"].to_numpy())
    assert np.allclose(got["x"], px, atol=1e-12) and np.allclose(got["y"], py, atol=1e-12)
    assert got["d"].max() < 1e-6
    assert abs(got["x"][302]) < 1e-12 and abs(got["y"][302]) < 1e-12 and abs(abs(got["x"][303]) - 1) < 1e-12
    cell = spark.createDataFrame(got[["id"]]).select(sky.static_cell(sky.cell_of_id(F.col("id"))).alias("c")).toPandas()["c"].to_numpy()
    assert (cell == pixels.static_cell_ids(np.minimum(px, 1 - 1e-9), np.minimum(py, 1 - 1e-9))).all()
    nulls = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, None)], "lon double, lat double")
    assert [r[0] for r in nulls.select(sky.position_id(F.col("lon"), F.col("lat"))).collect()] == [None] * 3
    assert nulls.select(sky.gc_dist(F.col("lon"), F.col("lat"), 0.0, 0.0)).collect()[0][0] is None


def test_neighbours_are_symmetric_and_near():
    near = pixels.adjacency(4)
    assert all(a in near[b] for a in near for b in near[a]) and all(5 <= len(v) <= 10 for v in near.values())


def test_intervals():
    s = IntervalSet((1, 2), (3, 4), (-2, 0), (0.5, 1.5), (6, 6), (0.25, 0.25))
    assert s.parts == [(-2, 0), (0.25, 0.25), (0.5, 2), (3, 4), (6, 6)]
    assert list(s.is_inside([-3, -2, -1, 0.5, 5, 2.5, 3.5, 0.25])) == [False, True, True, True, False, False, True, True]
    assert s.distance(5) == 1 and s.distance(3.5) == 0 and s.distance(3.5, True) == -0.5 and (s & IntervalSet((1.8, 3.2))).parts == [(1.8, 2), (3, 3.2)]
    assert make_canonical([]) is None and make_canonical(None) is None
    b = make_canonical([beam(1, 2, 3), T(5, 6), (rectangle(0, 0, 1, 1), (7, 8)), -1])
    assert len(b.parts) == 2 and b.parts[0][1].parts == [(5, 6)] and b.parts[1][1].parts == [(7, 8)] and b.cells == [-1]


@pytest.mark.parametrize("n", [1, 2, 7, 50, 600])
def test_three_kernels(spark, n):
    # inside, so that they travel to the workers by value
    def _mod(rows, m):
        yield from ((int(k % m), int(k)) for k in rows["k"])

    def _add_up(key, values):
        yield key % 2, sum(values)

    def _parity(key, values):
        yield key, sum(values)

    db = Database(spark)
    db.register("n", spark.range(n).withColumnRenamed("id", "k"), primary_key="k")
    out = sorted(db.query("k FROM n").execute([(_mod, 10), _add_up, _parity]))
    want: dict = {}
    for k in range(10):
        own = [i for i in range(n) if i % 10 == k]
        if own:
            want[k % 2] = want.get(k % 2, 0) + sum(own)
    assert out == sorted(want.items())
    assert mapreduce.pairs(spark.createDataFrame([], "k long, _CELLID long"), (_mod, 10)).count() == 0


def test_scalar_functions(spark):
    row = spark.range(1).select(
        registry.dms(F.lit("-1:30:36")).alias("d"), registry.hms(F.lit("2:0:0")).alias("h"), registry.bin_text(F.lit(5), 16).alias("b"),
        registry.header_value(F.lit("AB = 'it''s' / x\nN = 3 / y\nT1 = T"), "AB", "string").alias("s"), registry.header_value(F.lit("N = 3 / y"), "M", "long", 9).alias("m"),
        registry.header_value(F.lit("T1 = T"), "T1", "boolean").alias("t"), registry.flux_to_mag(F.lit(100.0)).alias("mag"),
    ).first()
    assert tuple(row) == (-1.51, 30.0, "00000000,00000101", "it's", 9, True, 17.5)
