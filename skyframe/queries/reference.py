"""Queries of the catalogue engine's own operators, over the driver's tables, and their SQL.

The driver's star-schema tables have no positions: those of ``sky`` are a two-dimensional low-discrepancy sequence by key,
the same text in both engines. The survey tables (sdss, obj, xm, exposure, detection) have their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.catalog.database import Database
from skyframe.functions import registry, sky
from skyframe.operators import aggregate, associate, rows
from skyframe.plans import joins
from skyframe.plans.bounds import T, beam, polygon, rectangle
from skyframe.plans.expr import Lookup
from skyframe.session import cut, shared_folder, table
from skyframe.sources import surveys
from skyframe.types import mjd, u64_order, u64_text


def lon_sql(k: str, shift: str = "0") -> str:
    return f"360 * ((CAST(0.5 AS DOUBLE) + {k} * CAST(0.7548776662466927 AS DOUBLE) + {shift}) % 1)"


def lat_sql(k: str) -> str:
    return f"degrees(asin(2 * ((CAST(0.5 AS DOUBLE) + {k} * CAST(0.5698402909980532 AS DOUBLE)) % 1) - 1))"


def _sky(df: DataFrame, key: str, shift: float = 0) -> DataFrame:
    return df.withColumn("lon", F.expr(lon_sql(key, f"CAST({shift} AS DOUBLE)"))).withColumn("lat", F.expr(lat_sql(key)))


def database(spark: SparkSession, d: str) -> Database:
    """The driver's tables, with keys, positions and joins declared."""
    db = Database(spark)
    t = lambda name: table(spark, d, name)
    db.register("customer", _sky(t("customer"), "c_custkey"), primary_key="c_custkey", spatial_keys=["lon", "lat"])
    db.register("part", _sky(t("part"), "p_partkey", 0.0007), primary_key="p_partkey", spatial_keys=["lon", "lat"])
    db.register("supplier", _sky(t("supplier"), "s_suppkey", 0.1), primary_key="s_suppkey", spatial_keys=["lon", "lat"])
    orders = t("orders").withColumn("lon", F.expr(lon_sql("o_custkey"))).withColumn("lat", F.expr(lat_sql("o_custkey"))).withColumn("mjd", F.datediff("o_orderdate", F.lit("1970-01-01")).cast("double") + 40587)
    db.register("orders", orders, primary_key="o_orderkey", spatial_keys=["lon", "lat"], temporal_key="mjd", aliases={"price": "o_totalprice"})
    db.register("lineitem", t("lineitem"), primary_key="l_orderkey")
    db.register("nation", t("nation"), primary_key="n_nationkey")
    db.register("region", t("region"), primary_key="r_regionkey")
    db.register("vectors", t("embeddings"), primary_key="vec_id")
    one = t("sdss").where("dec BETWEEN -90 AND 90 AND ra IS NOT NULL AND NOT isnan(ra)").withColumn("ra", F.pmod("ra", F.lit(360.0)))
    db.register("sdss", aggregate.latest_version(one.select("sdss_id", "ra", "dec", "type", "run", "g", "r"), ["sdss_id"], ["ra", "dec", "g", "r"]), primary_key="sdss_id", spatial_keys=["ra", "dec"], exposure_key="run")
    good = t("obj").where("ra IS NOT NULL AND NOT isnan(ra) AND dec BETWEEN -90 AND 90").select("obj_id", F.pmod("ra", F.lit(360.0)).alias("ra"), "dec")
    one_obj = good.groupBy("obj_id").agg(F.min(F.struct("ra", "dec")).alias("p")).select("obj_id", "p.*")
    db.register("obj", one_obj, primary_key="obj_id", spatial_keys=["ra", "dec"])
    db.register("xm", t("xm").select("m1", "m2", "dist", "nr").distinct(), aliases={"_M1": "m1", "_M2": "m2", "_DIST": "dist", "_NR": "nr"})
    db.define_default_join("nation", "region", "equi", left=("nation", "n_regionkey"), right=("region", "r_regionkey"))
    db.define_default_join("supplier", "nation", "equi", left=("supplier", "s_nationkey"), right=("nation", "n_nationkey"))
    db.define_default_join("customer", "lineitem", "indirect", m1=("orders", "o_custkey"), m2=("orders", "o_orderkey"))
    db.define_default_join("customer", "orders", "equi", left=("customer", "c_custkey"), right=("orders", "o_custkey"))
    db.define_default_join("obj", "sdss", "indirect", m1=("xm", "_M1"), m2=("xm", "_M2"))
    return db


def _ask(text: str, variables=None, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        names = variables(spark, d) if callable(variables) else variables
        return database(spark, d).query(text, names).dataframe(**options)

    return run


SKY = {
    "customer": f"(SELECT *, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat FROM customer)",
    "part": f"(SELECT *, {lon_sql('p_partkey', 'CAST(0.0007 AS DOUBLE)')} AS lon, {lat_sql('p_partkey')} AS lat FROM part)",
    "supplier": f"(SELECT *, {lon_sql('s_suppkey', 'CAST(0.1 AS DOUBLE)')} AS lon, {lat_sql('s_suppkey')} AS lat FROM supplier)",
    "orders": f"(SELECT *, {lon_sql('o_custkey')} AS lon, {lat_sql('o_custkey')} AS lat, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 40587 AS mjd FROM orders)",
    "sdss": "(SELECT sdss_id, m.ra AS ra, m.dec AS dec, m.type AS type, m.run AS run, m.g AS g, m.r AS r FROM (SELECT sdss_id, arg_max({'ra': x, 'dec': dec, 'type': type, 'run': run, 'g': g, 'r': r}, (x, dec, g, r)) AS m"
    " FROM (SELECT *, ((ra % 360) + 360) % 360 AS x FROM sdss WHERE dec BETWEEN -90 AND 90 AND ra IS NOT NULL AND NOT isnan(ra)) GROUP BY sdss_id))",
    "obj": "(SELECT obj_id, min(((ra % 360) + 360) % 360) AS ra, min(dec) AS dec FROM obj WHERE ra IS NOT NULL AND NOT isnan(ra) AND dec BETWEEN -90 AND 90 GROUP BY obj_id)",
}


def dist_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"degrees(2 * asin(sqrt(least(1.0, pow(sin((radians({lat1}) - radians({lat2})) * 0.5), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon1}) - radians({lon2})) * 0.5), 2)))))"


def plane_sql(source: str) -> str:
    """CTE steps that add x and y (pixel plane) to rows of ``source`` with lon and lat."""
    return f"""
f0 AS (SELECT *, least(floor(lon / 90), 3) AS quarter, sin(radians(lat)) AS zz FROM {source} s),
f1 AS (SELECT *, radians(lon - 90 * quarter - 45) AS along, 2 - sqrt(3 * (1 - abs(zz))) AS cap FROM f0),
f2 AS (SELECT *, CASE WHEN abs(zz) >= 2.0 / 3 THEN along * (2 - cap) ELSE along END AS uu, CASE WHEN abs(zz) >= 2.0 / 3 THEN sign(zz) * cap * (pi() / 4) ELSE zz * (3 * pi() / 8) END - pi() / 2 AS vv,
  CASE WHEN quarter < 2 THEN -1 ELSE 1 END AS ee, CASE WHEN quarter IN (0, 3) THEN 1 ELSE -1 END AS nn FROM f1),
plane AS (SELECT *, (uu * ee - vv * nn) / pi() AS px, (uu * nn + vv * ee) / pi() AS py FROM f2)"""


#: Static cell at level 6 of px, py.
CELL_SQL = "(((CAST(least(floor((1 + px) * 512), 1023) AS BIGINT) & 1008) << 54) | ((CAST(least(floor((1 + py) * 512), 1023) AS BIGINT) & 1008) << 44) | 4294967295)"
CELL_SIGNED = "CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT)"


def cell_sql(time: str = "0") -> str:
    """Signed cell id as HUGEINT arithmetic, so that the top bit cannot overflow."""
    h = f"(CAST(CAST(least(floor((1 + px) * 512), 1023) AS BIGINT) & 1008 AS HUGEINT) * 18014398509481984 + CAST(CAST(least(floor((1 + py) * 512), 1023) AS BIGINT) & 1008 AS HUGEINT) * 17592186044416 + CAST({time} AS HUGEINT) * 4294967296 + 4294967295)"
    return CELL_SIGNED.replace("h ", f"{h} ").replace("THEN h", f"THEN {h}").replace("ELSE h", f"ELSE {h}")


Q: dict = {}
SQL: dict = {}


def _add(name: str, run, sql: str | None = None) -> None:
    Q[name] = run
    if sql is not None:
        SQL[name] = sql


# ------------------------------------------------------------------ select, where, names
_add("q01_select_where_alias", _ask("SELECT o_orderkey, o_totalprice/1000 AS k FROM orders WHERE (k > 100) & (o_orderstatus == 'F')"),
     "SELECT o_orderkey, o_totalprice / 1000 AS k FROM orders WHERE o_totalprice / 1000 > 100 AND o_orderstatus = 'F'")
_add("q02_wildcard_join", _ask("*, region.* FROM nation, region"),
     'SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name, r_regionkey AS "region.r_regionkey", r_name AS "region.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey')
_add("q03_rownum_cell", _ask("c_custkey, _ROWNUM AS n, _CELLID AS cell FROM customer"),
     f"WITH {plane_sql(SKY['customer'])}, c AS (SELECT c_custkey, {cell_sql()} AS cell FROM plane) SELECT c_custkey, row_number() OVER (PARTITION BY cell ORDER BY c_custkey) - 1 AS n, cell FROM c")
_add("q04_bitflags", _ask("p_partkey, p_size & 12 AS f, bin(p_size) AS bits FROM part WHERE (p_size & 1) == 0 and not (p_size & 2 == 2)"),
     "SELECT p_partkey, p_size & 12 AS f, array_to_string(list_transform(range(0, 8), lambda i: substr(lpad(bin(p_size), 64, '0'), CAST(i * 8 + 1 AS BIGINT), 8)), ',') AS bits FROM part WHERE p_size & 1 = 0 AND p_size & 2 <> 2")
_add("q05_lookup_map", _ask("c_custkey, nat(c_nationkey * 2) AS name, reg(c_nationkey * 2) AS region FROM customer", lambda s, d: {
    "nat": Lookup(table(s, d, "nation"), "n_nationkey", ("n_name",), "none"), "reg": Lookup(table(s, d, "nation"), "n_nationkey", ("n_regionkey",))}),
     "SELECT c_custkey, coalesce(n_name, 'none') AS name, coalesce(n_regionkey, 0) AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey * 2")
_add("q08_in1d", _ask("o_orderkey FROM orders WHERE np.in1d(o_orderstatus, codes) & ~np.in1d(o_custkey, [1, 4, 7])", {"codes": ["F", "P"]}),
     "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 4, 7)")
_add("q09_expressions", _ask(
    "o_orderkey, o_custkey / 7 AS quotient, o_custkey // -7 AS floored, -o_custkey % 7 AS rest, np.where(o_totalprice > 1e5, 1, 0) AS big, np.sqrt(o_totalprice - 1e5) AS root, "
    "np.log10(np.minimum(o_totalprice, 1000.0)) AS lg, (o_custkey << 2) ^ 5 AS bits, o_custkey ** 2 AS sq, np.clip(o_totalprice, 1e4, 2e5) AS clipped FROM orders WHERE 10 < o_custkey <= 500 and price > 0"),
     """SELECT o_orderkey, o_custkey // 7 AS quotient, CAST(-ceil(o_custkey / 7.0) AS BIGINT) AS floored, ((-o_custkey % 7) + 7) % 7 AS rest, CASE WHEN o_totalprice > 1e5 THEN 1 ELSE 0 END AS big,
     CASE WHEN o_totalprice < 1e5 THEN CAST('nan' AS DOUBLE) ELSE sqrt(o_totalprice - 1e5) END AS root, log10(least(o_totalprice, 1000.0)) AS lg, xor(o_custkey << 2, 5) AS bits, o_custkey * o_custkey AS sq,
     least(greatest(o_totalprice, 1e4), 2e5) AS clipped FROM orders WHERE o_custkey > 10 AND o_custkey <= 500""")
_add("q06_array_index", _ask("vec_id, embedding(0) AS first, embedding(-1) AS last, embedding(vec_id % 3) AS some FROM vectors"),
     "SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, embedding[vec_id % 3 + 1] AS some FROM embeddings")
_add("q07_array_slice", lambda s, d: database(s, d).query("vec_id, embedding((1, 4)) AS a, embedding((-2,)) AS b, embedding((0, 9, 4)) AS c FROM vectors").dataframe().select("vec_id", *[F.aggregate(c, F.lit(0.0), lambda t, v: t + F.round(v.cast("double"), 6)).alias(c) for c in "abc"]),
     "SELECT vec_id, list_sum(list_transform(embedding[2:4], lambda v: round(CAST(v AS DOUBLE), 6))) AS a, list_sum(list_transform(embedding[-2:], lambda v: round(CAST(v AS DOUBLE), 6))) AS b, list_sum(list_transform([embedding[1], embedding[5], embedding[9]], lambda v: round(CAST(v AS DOUBLE), 6))) AS c FROM embeddings")
_add("q46_mjd", lambda s, d: table(s, d, "events").select("event_id", F.round(mjd(F.col("ts")), 6).alias("mjd")),
     "SELECT event_id, round(epoch_us(ts) / 86400e6 + 40587, 6) AS mjd FROM events")
_add("q47_dms_hms", lambda s, d: table(s, d, "customer").select("c_custkey", F.concat_ws(":", F.concat(F.when(F.col("c_custkey") % 2 == 1, "-").otherwise(""), (F.col("c_custkey") % 24).cast("string")), (F.col("c_custkey") % 60).cast("string"), (F.col("c_custkey") % 59).cast("string")).alias("t")).select("c_custkey", F.round(registry.dms(F.col("t")), 9).alias("deg"), F.round(registry.hms(F.col("t")), 9).alias("hour")),
     "SELECT c_custkey, round(s * v, 9) AS deg, round(15 * s * v, 9) AS hour FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN -1 ELSE 1 END AS s, c_custkey % 24 + (c_custkey % 60) / 60.0 + (c_custkey % 59) / 3600.0 AS v FROM customer)")
_add("q50_unsigned_ids", lambda s, d: table(s, d, "sdss").select("sdss_id").distinct().select("sdss_id", u64_text(F.col("sdss_id")).alias("text"), (u64_order(F.col("sdss_id")) > u64_order(F.lit(1 << 62))).alias("later")),
     "SELECT sdss_id, CAST(CASE WHEN sdss_id < 0 THEN CAST(sdss_id AS HUGEINT) + 18446744073709551616 ELSE sdss_id END AS VARCHAR) AS text, sdss_id < 0 OR sdss_id > 4611686018427387904 AS later FROM (SELECT DISTINCT sdss_id FROM sdss)")

# ------------------------------------------------------------------ joins
LINKS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS nr FROM orders)"


def _ranked_orders(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("nr"), (F.col("o_totalprice") / 1e8).alias("dist"))


_add("q10_indirect_inner", _ask("c_custkey, lineitem.l_linenumber AS line, lineitem.l_quantity AS qty FROM customer, lineitem WHERE qty > 45"),
     "SELECT c_custkey, l_linenumber AS line, l_quantity AS qty FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")


def _outer(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    db.register("thin", table(spark, d, "lineitem").where("l_linenumber = 1 AND l_quantity < 20"), primary_key="l_orderkey")
    db.define_default_join("customer", "thin", "indirect", m1=("orders", "o_custkey"), m2=("orders", "o_orderkey"))
    return db.query("c_custkey, thin.l_orderkey AS k, thin._ISNULL AS gone, thin.l_quantity AS qty FROM customer, thin(outer)").dataframe()


_add("q11_indirect_outer_null_zero", _outer,
     "SELECT c_custkey, coalesce(l_orderkey, 0) AS k, l_orderkey IS NULL AS gone, coalesce(l_quantity, 0) AS qty FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 20) ON l_orderkey = o_orderkey")
_add("q12_link_cuts", lambda s, d: joins.link_join(table(s, d, "customer").select("c_custkey"), "c_custkey", joins.link_cuts(_ranked_orders(s, d), "nr", "dist", 2, 5.0), "o_custkey", "o_orderkey", table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", True, "nr", "dist", "l.").select("c_custkey", "l_linenumber", F.col("`l._NR`").alias("nr"), F.col("`l._ISNULL`").alias("gone")),
     f"SELECT c_custkey, l_linenumber, CASE WHEN l_orderkey IS NULL THEN 0 ELSE nr END AS nr, l_orderkey IS NULL AS gone FROM customer LEFT JOIN (SELECT * FROM {LINKS} WHERE nr < 2 AND o_totalprice / 1e8 < 5.0 / 3600) ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey")
_add("q13_equi_fk", _ask("s_suppkey, nation.n_name AS nation, region.r_name AS region FROM supplier, nation, region WHERE region.r_name == 'ASIA'"),
     "SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_add("q14_static_temporal", _ask("c_custkey, orders._TIME AS t FROM customer, orders", bounds=[T(50000, 50200)]),
     f"SELECT c_custkey, mjd AS t FROM customer JOIN {SKY['orders']} ON o_custkey = c_custkey WHERE mjd BETWEEN 50000 AND 50200")
XM = f"""WITH p AS (SELECT a.c_custkey, b.p_partkey, {dist_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM {SKY['customer']} a JOIN {SKY['part']} b ON abs(a.lat - b.lat) < 3.001),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, p_partkey) - 1 AS nr FROM p WHERE d < 3)"""
_add("q15_xmatch_knn", _ask("c_custkey, part.p_partkey AS p, part._NR AS nr, np.rint(part._DIST * 1e6) AS microdeg FROM customer, part(matchedto=customer, nmax=3, dmax=10800)"),
     f"{XM} SELECT c_custkey, p_partkey AS p, nr, round_even(d * 1e6, 0) AS microdeg FROM r WHERE nr < 3")
_add("q16_xmatch_outer", _ask("c_custkey, supplier.s_suppkey AS s, supplier._ISNULL AS gone FROM customer, supplier(matchedto=customer, nmax=1, dmax=10800, outer)"),
     f"""WITH p AS (SELECT a.c_custkey, b.s_suppkey, {dist_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM {SKY['customer']} a JOIN {SKY['supplier']} b ON abs(a.lat - b.lat) < 3.001),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS nr FROM p WHERE d < 3)
SELECT customer.c_custkey, coalesce(s_suppkey, 0) AS s, s_suppkey IS NULL AS gone FROM customer LEFT JOIN r ON r.c_custkey = customer.c_custkey AND nr = 1""")
_add("q17_survey_links", _ask("obj.obj_id AS o, sdss.sdss_id AS s, sdss._NR AS nr FROM obj, sdss(nmax=2, dmax=2)"),
     f"SELECT obj_id AS o, sdss_id AS s, CAST(nr AS BIGINT) AS nr FROM {SKY['obj']} JOIN (SELECT DISTINCT m1, m2, dist, nr FROM xm WHERE nr < 2 AND dist < 2 / 3600.0) ON m1 = obj_id JOIN {SKY['sdss']} ON m2 = sdss_id")
_add("q18_match_catalogues", lambda s, d: associate.match_catalogues(database(s, d).read("obj"), "obj_id", ("ra", "dec"), database(s, d).read("sdss"), "sdss_id", ("ra", "dec"), 2 / 3600, 3).select("m1", "m2", F.col("nr").cast("bigint").alias("nr")),
     f"""WITH p AS (SELECT a.obj_id AS m1, b.sdss_id AS m2, {dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS d FROM {SKY['obj']} a JOIN {SKY['sdss']} b ON b.dec BETWEEN a.dec - 0.0006 AND a.dec + 0.0006)
SELECT m1, m2, nr FROM (SELECT *, row_number() OVER (PARTITION BY m1 ORDER BY d, m2) - 1 AS nr FROM p WHERE d < 2 / 3600.0) WHERE nr < 3""")

# ------------------------------------------------------------------ geometry, ids, bounds
_add("q20_bhpix_cell", _ask("c_custkey, np.floor((bhpix(lon, lat).x + 1) * 32) AS i, np.floor((bhpix(lon, lat).y + 1) * 32) AS j FROM customer"),
     f"WITH {plane_sql(SKY['customer'])} SELECT c_custkey, floor((px + 1) * 32) AS i, floor((py + 1) * 32) AS j FROM plane")
_add("q21_static_cell", lambda s, d: database(s, d).read("customer").select("c_custkey", sky.static_cell(sky.cell_of_id(sky.position_id(F.col("lon"), F.col("lat")))).alias("cell")),
     f"WITH {plane_sql(SKY['customer'])} SELECT c_custkey, {cell_sql()} AS cell FROM plane")
_add("q22_id_pack_unpack", lambda s, d: table(s, d, "sdss").select("sdss_id").where("sdss_id IS NOT NULL").distinct().withColumn("p", sky.unpack_id(F.col("sdss_id"))).select("sdss_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.t").alias("t"), F.col("p.i").alias("i"), sky.is_temporal(F.col("sdss_id")).alias("temporal")),
     "SELECT sdss_id, (((sdss_id >> 54) & 1023) + 0.5) / 512 - 1 AS x, (((sdss_id >> 44) & 1023) + 0.5) / 512 - 1 AS y, ((sdss_id >> 32) & 4095) + 54335.0 AS t, sdss_id & 4294967295 AS i, (sdss_id >> 32) & 4095 <> 0 AS temporal FROM (SELECT DISTINCT sdss_id FROM sdss WHERE sdss_id IS NOT NULL)")
_add("q23_beam", _ask("sdss_id FROM sdss", bounds=[beam(185.0, 15.0, 25.0)]),
     f"SELECT sdss_id FROM {SKY['sdss']} WHERE {dist_sql('ra', 'dec', '185.0', '15.0')} < 25")
_add("q24_rectangle_wrap", _ask("sdss_id FROM sdss", bounds=[rectangle(350, -20, 30, 20)]),
     f"SELECT sdss_id FROM {SKY['sdss']} WHERE (ra >= 350 OR ra <= 30) AND dec BETWEEN -20 AND 20")


def gal_sql(ra: str, dec: str) -> tuple[str, str]:
    """Galactic longitude and latitude: products of the unit vector with the galactic axes."""
    unit = (f"cos(radians({dec})) * cos(radians({ra}))", f"cos(radians({dec})) * sin(radians({ra}))", f"sin(radians({dec}))")
    x, y, z = ("(" + " + ".join(f"{u} * CAST({a!r} AS DOUBLE)" for u, a in zip(unit, axis)) + ")" for axis in sky.GALACTIC_AXES)
    return f"((degrees(atan2({y}, {x})) + 360) % 360)", f"degrees(asin(least(1.0, greatest(-1.0, {z}))))"


L, B = gal_sql("ra", "dec")
_add("q25_rect_gal", _ask("sdss_id FROM sdss", bounds=[rectangle(60, -30, 160, 30, "gal")]), f"SELECT sdss_id FROM (SELECT sdss_id, {L} AS l, {B} AS b FROM {SKY['sdss']}) WHERE l BETWEEN 60 AND 160 AND b BETWEEN -30 AND 30")
_add("q26_multi_bounds_time", _ask("o_orderkey FROM orders", bounds=[(beam(40, 10, 30), T(50000, 50500)), (rectangle(200, -40, 260, 0), T((49900, 50100), (51000, 51500)))]),
     f"SELECT o_orderkey FROM {SKY['orders']} WHERE ({dist_sql('lon', 'lat', '40.0', '10.0')} < 30 AND mjd BETWEEN 50000 AND 50500) OR (lon BETWEEN 200 AND 260 AND lat BETWEEN -40 AND 0 AND (mjd BETWEEN 49900 AND 50100 OR mjd BETWEEN 51000 AND 51500))")
_add("q27_equgal", _ask("sdss_id, np.rint(gal.l * 1e6) AS l, np.rint(gal.b * 1e6) AS b, equgal(ra, dec) AS (gl, gb) FROM sdss".replace("gal.l", "equgal(ra, dec).l").replace("gal.b", "equgal(ra, dec).b").replace(", equgal(ra, dec) AS (gl, gb)", "")),
     f"SELECT sdss_id, round_even({L} * 1e6, 0) AS l, round_even({B} * 1e6, 0) AS b FROM {SKY['sdss']}")
_add("q28_galequ_roundtrip", lambda s, d: database(s, d).read("sdss").withColumn("g", sky.equgal(F.col("ra"), F.col("dec"))).withColumn("e", sky.galequ(F.col("g.l"), F.col("g.b"))).select("sdss_id", (sky.gc_dist(F.col("ra"), F.col("dec"), F.col("e.ra"), F.col("e.dec")) < 1e-9).alias("back")),
     f"SELECT sdss_id, true AS back FROM {SKY['sdss']}")
_add("q29_gnomonic_gcdist", _ask("sdss_id, np.rint(gnomonic(ra, dec, 180.0, 20.0).x * 1e4) AS x, np.rint(gc_dist(ra, dec, 180.0, 20.0) * 1e6) AS d FROM sdss WHERE gc_dist(ra, dec, 180.0, 20.0) < 60"),
     f"SELECT sdss_id, round_even(degrees(cos(radians(dec)) * sin(radians(ra) - radians(180.0)) / (sin(radians(20.0)) * sin(radians(dec)) + cos(radians(20.0)) * cos(radians(dec)) * cos(radians(ra) - radians(180.0)))) * 1e4, 0) AS x, round_even({dist_sql('ra', 'dec', '180.0', '20.0')} * 1e6, 0) AS d FROM {SKY['sdss']} WHERE {dist_sql('ra', 'dec', '180.0', '20.0')} < 60")
_add("q51_polygon", _ask("sdss_id FROM sdss", bounds=[polygon([10.0, 80.0, 70.0, 20.0], [-20.0, -10.0, 30.0, 25.0])]))
_add("q52_pix_idx", lambda s, d: database(s, d).read("sdss").withColumn("p", F.struct(*[c.alias(n) for c, n in zip(sky.butterfly(F.col("ra"), F.col("dec")), "xy")])).groupBy(sky.pix_idx(F.col("p.x"), F.col("p.y"), 5).alias("pix")).agg(F.count(F.lit(1)).alias("n")),
     f"WITH src AS (SELECT ra AS lon, dec AS lat FROM {SKY['sdss']}), {plane_sql('src')} SELECT CAST((floor(py * 16) + 16) * 32 + floor(px * 16) + 16 AS BIGINT) AS pix, count(*) AS n FROM plane GROUP BY 1")
_add("q53_cell_path", lambda s, d: database(s, d).query("c_custkey, _CELLPATH AS path FROM customer").dataframe())
_add("q54_neighbour_halo", lambda s, d: database(s, d).query("sdss_id, _CELLID AS cell, _CACHED AS cached FROM sdss").dataframe(include_cached=True).groupBy("cached").agg(F.count(F.lit(1)).alias("n")))
_add("q55_lambert_roundtrip", lambda s, d: database(s, d).read("sdss").withColumn("p", F.struct(*[c.alias(n) for c, n in zip(sky.lambert(F.col("ra"), F.col("dec"), 100.0, 30.0), "xy")])).withColumn("q", F.struct(*[c.alias(n) for c, n in zip(sky.lambert_inverse(F.col("p.x"), F.col("p.y"), 100.0, 30.0), "ab")])).select("sdss_id", (sky.gc_dist(F.col("ra"), F.col("dec"), F.col("q.a"), F.col("q.b")) < 1e-6).alias("back")),
     f"SELECT sdss_id, true AS back FROM {SKY['sdss']}")

# ------------------------------------------------------------------ aggregation
_add("q30_count", lambda s, d: database(s, d).query("o_orderkey FROM orders WHERE o_totalprice > 1000").dataframe().agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000")
_add("q31_hist1d", lambda s, d: aggregate.histogram(database(s, d).read("sdss"), F.col("dec"), -90.0, 90.0, 36), f"SELECT CAST(least(floor((dec + 90) / 5), 35) AS INTEGER) AS bin, count(*) AS n FROM {SKY['sdss']} GROUP BY 1")
_add("q32_xhist_overflow", lambda s, d: aggregate.histogram_edges(table(s, d, "lineitem"), F.col("l_quantity"), [5.0, 10.0, 20.0, 40.0]),
     "SELECT CAST(l_quantity >= 5 AS INTEGER) + CAST(l_quantity >= 10 AS INTEGER) + CAST(l_quantity >= 20 AS INTEGER) + CAST(l_quantity >= 40 AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
_add("q33_coverage2d", lambda s, d: aggregate.coverage(table(s, d, "sdss"), F.col("ra"), F.col("dec"), 2.0),
     "SELECT CAST(floor((((ra % 360) + 360) % 360) / 2) AS INTEGER) AS i, CAST(floor((90 - greatest(-90, least(90, dec))) / 2) AS INTEGER) AS j, count(*) AS n FROM sdss WHERE NOT isnan(ra) AND NOT isnan(dec) GROUP BY 1, 2")
_add("q34_value_counts", lambda s, d: aggregate.value_counts(table(s, d, "sdss"), "type"), "SELECT type AS value, count(*) AS n FROM sdss GROUP BY 1")
_add("q35_distinct_diff", lambda s, d: aggregate.new_values(table(s, d, "orders"), "o_orderkey", table(s, d, "lineitem"), "l_orderkey"), "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
_add("q36_collect_list", lambda s, d: aggregate.lists_by_key(table(s, d, "lineitem").where("l_suppkey % 2 = 1"), "l_orderkey", "l_linenumber", "lines").select("l_orderkey", F.array_join("lines", ",").alias("lines")),
     "SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS lines FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1")
_add("q36_collect_all", lambda s, d: aggregate.lists_by_key(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "lines").select("l_orderkey", F.array_join("lines", ",").alias("lines")),
     "SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS lines FROM lineitem GROUP BY 1")


def _photometry(s: SparkSession, d: str) -> DataFrame:
    return aggregate.weighted_statistics(table(s, d, "lineitem"), ["l_suppkey", "l_returnflag"], F.col("l_quantity"), F.col("l_tax"), F.col("l_discount") < 0.09, time=F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"))


_add("q37_weighted_stats", lambda s, d: _photometry(s, d).select("l_suppkey", "l_returnflag", "n", "n_ok", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "err")]),
     """WITH w AS (SELECT *, CAST(l_quantity AS DOUBLE) AS x, 1 / (CAST(l_tax AS DOUBLE) * l_tax + 0.0001) AS w FROM lineitem), s AS (
SELECT l_suppkey, l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount < 0.09) AS n_ok, sum(w) FILTER (WHERE l_discount < 0.09) AS sw, sum(w * x) FILTER (WHERE l_discount < 0.09) AS s1, sum(w * w) FILTER (WHERE l_discount < 0.09) AS s2, sum(w * x * x) FILTER (WHERE l_discount < 0.09) AS sx FROM w GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, n, n_ok, round(s1 / sw, 6) AS mean, round(CASE WHEN n_ok > 1 THEN sqrt(sw / (sw * sw - s2) * greatest(sx - s1 * s1 / sw, 0)) END, 6) AS stdev, round(1 / sqrt(sw), 6) AS err FROM s""")
_add("q38_quantiles", lambda s, d: _photometry(s, d).select("l_suppkey", "l_returnflag", "q25", "median", "q75"),
     "SELECT l_suppkey, l_returnflag, quantile_cont(CAST(l_quantity AS DOUBLE), 0.25) FILTER (WHERE l_discount < 0.09) AS q25, quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) FILTER (WHERE l_discount < 0.09) AS median, quantile_cont(CAST(l_quantity AS DOUBLE), 0.75) FILTER (WHERE l_discount < 0.09) AS q75 FROM lineitem GROUP BY 1, 2")
_add("q39_lightcurve_top10", lambda s, d: _photometry(s, d).select("l_suppkey", "l_returnflag", F.array_join(F.transform("light_curve", lambda v: v.cast("int").cast("string")), ",").alias("curve")),
     """WITH r AS (SELECT l_suppkey, l_returnflag, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k FROM lineitem WHERE l_discount < 0.09),
g AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)
SELECT g.l_suppkey, g.l_returnflag, coalesce(string_agg(CAST(q AS VARCHAR), ',' ORDER BY k), '') AS curve FROM g LEFT JOIN r ON r.l_suppkey = g.l_suppkey AND r.l_returnflag = g.l_returnflag AND k <= 10 GROUP BY 1, 2""")
_add("q40_latest_version", lambda s, d: aggregate.latest_version(table(s, d, "exposure").select("exp_id", "loaded_at", "smf_fn"), ["exp_id"], ["loaded_at", "smf_fn"]).select("exp_id", F.unix_micros("loaded_at").alias("loaded"), "smf_fn"),
     "SELECT exp_id, epoch_us(loaded_at) AS loaded, smf_fn FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY loaded_at DESC, smf_fn DESC) AS k FROM exposure) WHERE k = 1")


def _three_kernels(spark: SparkSession, d: str) -> DataFrame:
    from skyframe.operators import mapreduce

    df = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.lit(0).cast("long").alias("_CELLID"))
    first = mapreduce.pairs(df, _to_pairs)
    second = mapreduce.reduce_by_key(first, _sum_by_parity)
    third = mapreduce.reduce_by_key(second, _total)
    return mapreduce.unpacked(third, "parity long, total long")


def _to_pairs(rows_):
    counts = rows_.groupby("l_suppkey")["l_linenumber"].sum()
    yield from ((int(k), int(v)) for k, v in counts.items())


def _sum_by_parity(key, values):
    yield key % 2, sum(values)


def _total(key, values):
    yield key, sum(values)


_add("q41_mapreduce3", _three_kernels, "SELECT l_suppkey % 2 AS parity, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
_add("q56_band_arrays", lambda s, d: aggregate.band_arrays(_photometry(s, d), "l_suppkey", "l_returnflag", ["A", "N", "R"], ["n_ok", "median"]).select("l_suppkey", F.concat_ws("|", F.array_join("n_ok", ",", "-"), F.array_join(F.transform("median", lambda v: v.cast("int").cast("string")), ",", "-")).alias("arrays")),
     """WITH s AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (WHERE l_discount < 0.09) AS n, CAST(trunc(quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) FILTER (WHERE l_discount < 0.09)) AS INTEGER) AS m FROM lineitem GROUP BY 1, 2),
k AS (SELECT DISTINCT l_suppkey FROM lineitem), b AS (SELECT * FROM k, (VALUES ('A'), ('N'), ('R')) t(f))
SELECT b.l_suppkey, string_agg(coalesce(CAST(n AS VARCHAR), '-'), ',' ORDER BY f) || '|' || string_agg(coalesce(CAST(m AS VARCHAR), '-'), ',' ORDER BY f) AS arrays FROM b LEFT JOIN s ON s.l_suppkey = b.l_suppkey AND s.l_returnflag = b.f GROUP BY 1""")
_add("q57_median_rms", lambda s, d: aggregate.median_and_rms(table(s, d, "exposure").where("NOT isnan(airmass)").withColumn("airmass", F.col("airmass").cast("double")), ["survey", "filterid"], "airmass").select("survey", "filterid", F.round("median", 6).alias("median"), F.round("rms", 6).alias("rms"), "n"),
     "SELECT survey, filterid, round(quantile_cont(CAST(airmass AS DOUBLE), 0.5), 6) AS median, round(0.741 * (quantile_cont(CAST(airmass AS DOUBLE), 0.75) - quantile_cont(CAST(airmass AS DOUBLE), 0.25)), 6) AS rms, count(airmass) AS n FROM exposure WHERE NOT isnan(airmass) GROUP BY 1, 2")
_add("q58_magnitudes", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(registry.flux_to_mag(F.col("l_quantity") - 3), 9).alias("mag"), registry.chip_cell(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")).alias("cell")),
     "SELECT l_orderkey, l_linenumber, round(-2.5 * log10(CASE WHEN l_quantity - 3 <= 0 THEN 0.001 ELSE CAST(l_quantity - 3 AS DOUBLE) END) + 22.5, 9) AS mag, CAST(CASE WHEN l_linenumber % 8 <= 3 THEN 63 - (((l_partkey + 8) // 608) + 8 * ((l_suppkey + 10) // 610)) ELSE ((l_partkey + 8) // 608) + 8 * ((l_suppkey + 10) // 610) END AS INTEGER) AS cell FROM lineitem")
_add("q59_header_keyword", lambda s, d: table(s, d, "smf_raw").where("hdu = 'primary'").select("stream", "file_no", F.unix_micros("loaded_at").alias("loaded"), registry.header_value(F.col("body"), "AIRMASS", "double", -1.0).alias("airmass"), registry.header_value(F.col("body"), "NGHOSTS", "long", 0).alias("ghosts")),
     r"""SELECT stream, file_no, epoch_us(loaded_at) AS loaded, coalesce(TRY_CAST(nullif(trim(regexp_extract(body, '(?m)^\s*AIRMASS\s*=([^''/\n]*)', 1)), '') AS DOUBLE), -1) AS airmass,
coalesce(TRY_CAST(nullif(trim(regexp_extract(body, '(?m)^\s*NGHOSTS\s*=([^''/\n]*)', 1)), '') AS BIGINT), 0) AS ghosts FROM smf_raw WHERE hdu = 'primary'""")
_add("q60_row_slice", lambda s, d: rows.row_slice(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, -100, 7),
     "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) WHERE k >= 100 AND k < n - 100 AND (k - 100) % 7 = 0")
_add("q61_rows_equal", lambda s, d: rows.rows_equal(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), rows.set_where(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), F.col("c_acctbal") < 0, c_acctbal=0.0), "c_custkey"),
     "SELECT c_custkey, c_acctbal >= 0 AS equal FROM customer")


def _zero_points(spark: SparkSession, d: str) -> DataFrame:
    """Zero points looked up by exact time: every second filter letter's exposures are their own calibration."""
    e = table(spark, d, "exposure").where("mjd_obs > 54000 AND exptime > 0")
    zps = e.where("filterid < 'i'").groupBy(F.col("mjd_obs").alias("mjd")).agg(
        F.min(F.col("zpt_ref").cast("double")).alias("ZP"), F.min("filterid").alias("filterid"), F.min(F.col("exptime").cast("double")).alias("exptime"),
        F.min(F.col("airmass").cast("double") / 200).alias("time_to_bad"), (F.min("m2z") > 0).alias("overlaps"))
    once = e.groupBy("exp_id").agg(F.min("mjd_obs").alias("mjd_obs"))
    return aggregate.zero_points(once, zps, "mjd_obs").select("exp_id", F.round("zp", 6).alias("zp"))


_add("q64_zero_points", _zero_points,
     """WITH e AS (SELECT * FROM exposure WHERE mjd_obs > 54000 AND NOT isnan(mjd_obs) AND exptime > 0),
z AS (SELECT mjd_obs AS mjd, min(CAST(zpt_ref AS DOUBLE)) AS zp, min(filterid) AS f, min(CAST(exptime AS DOUBLE)) AS t, min(CAST(airmass AS DOUBLE) / 200) AS bad, min(m2z) > 0 AS o FROM e WHERE filterid < 'i' GROUP BY 1),
x AS (SELECT exp_id, min(mjd_obs) AS mjd FROM e GROUP BY 1)
SELECT exp_id, round(CASE WHEN zp IS NOT NULL AND (bad >= 10 / 1440.0 OR o) THEN zp + 2.5 * coalesce(log10(t / CASE f WHEN 'g.0000' THEN 43 WHEN 'r.0000' THEN 40 END), 0) ELSE CAST('nan' AS DOUBLE) END, 6) AS zp
FROM x LEFT JOIN z ON z.mjd = x.mjd""")
_add("q65_run_mjd", lambda s, d: table(s, d, "sdss").select("run", "field", "objid").distinct().select("run", "field", "objid", F.round(registry.run_mjd(F.lit(52000.0) + F.col("run") % 100, F.lit(11), F.col("field"), F.col("objid")), 6).alias("mjd")),
     "SELECT run, field, objid, round(52000.0 + run % 100 + objid * 0.396 / (360.985647 * 3600.0) + 36 * (field - 11) / 86400.0 - 53.907456 / 2 / 86400.0, 6) AS mjd FROM (SELECT DISTINCT run, field, objid FROM sdss)")
_add("q66_cells_near_exposures", lambda s, d: associate.cells_near_exposures(table(s, d, "exposure"), "ra", "dec", 1.6))
_add("q67_survey_quality", lambda s, d: table(s, d, "sdss").groupBy(surveys.survey_quality(F.col("flags"), F.col("flags2"), F.col("resolve_status").cast("int")).alias("good")).agg(F.count(F.lit(1)).alias("n")),
     "SELECT resolve_status & 256 <> 0 AND flags & 262214 = 0 AND flags2 & 1 = 0 AS good, count(*) AS n FROM sdss GROUP BY 1")


# ------------------------------------------------------------------ writes
def _stored(spark: SparkSession, d: str) -> Database:
    """Customers 1..n in a stored table of a fresh folder beside the checkpoints."""
    base = spark.sparkContext.getCheckpointDir() or shared_folder(spark)
    root = f"{base}/db-{uuid.uuid4().hex}"
    db = Database(spark, [root])
    columns = [("id", "u8"), ("lon", "f8"), ("lat", "f8"), ("custkey", "i8"), ("balance", "f8"), ("segment", "a20")]
    db.create_table("stars", {"level": 3, "schema": {"main": {"columns": columns, "primary_key": "id", "spatial_keys": ["lon", "lat"]}}})
    base_rows = _sky(table(spark, d, "customer"), "c_custkey")
    db.write("stars", base_rows.where("c_custkey % 3 <> 0").select("lon", "lat", F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))
    db.register("customer", base_rows, primary_key="c_custkey", spatial_keys=["lon", "lat"])
    return db


def _upsert(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        db = _stored(spark, d)
        db.query(f"c_custkey AS custkey, lon, lat, c_acctbal * 2 AS balance FROM customer WHERE c_custkey % 2 == 0 INTO stars WHERE custkey {mode} c_custkey").write()
        return db.read("stars").select("custkey", "balance", "segment")

    return run


_add("q42_upsert", _upsert("|="),
     "SELECT c_custkey AS custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS DOUBLE) AS balance, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
_add("q43_update_ignore", _upsert("=="),
     "SELECT c_custkey AS custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS DOUBLE) AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0")


def _insert_at(spark: SparkSession, d: str) -> DataFrame:
    db = _stored(spark, d)
    db.query("lon, lat, c_custkey + 0 AS custkey INTO marks".replace("INTO", "FROM customer WHERE c_custkey < 50 INTO") + " AT c_custkey * 4294967296 + 7").write()
    return db.read("marks").select("custkey", F.col("id").alias("id"))


def _insert_all_at(spark: SparkSession, d: str) -> DataFrame:
    """Every customer at a given id."""
    db = _stored(spark, d)
    db.query("lon, lat, c_custkey + 0 AS custkey FROM customer INTO marks AT c_custkey * 4294967296 + 7").write()
    return db.read("marks").select("custkey", "id")


_add("q44_insert_at", _insert_at, "SELECT c_custkey AS custkey, c_custkey * 4294967296 + 7 AS id FROM customer WHERE c_custkey < 50")
_add("q44_insert_all_at", _insert_all_at, "SELECT c_custkey AS custkey, c_custkey * 4294967296 + 7 AS id FROM customer")


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    db = _stored(spark, d)
    first = db.table("stars").current()
    db.query("c_custkey AS custkey, lon, lat, c_acctbal AS balance FROM customer WHERE c_custkey % 3 == 0 INTO stars").write()
    then = Database(spark, db.roots, snapid=first)
    old = then.read("stars").select("custkey", F.lit("old").alias("version"))
    return old.unionByName(db.read("stars").select("custkey", F.lit("new").alias("version")))


_add("q45_asof_snapshot", _as_of, "SELECT c_custkey AS custkey, 'old' AS version FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer")


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    """A stored table read under bounds: cells outside are never opened."""
    db = _stored(spark, d)
    return db.query("custkey FROM stars").dataframe(bounds=[beam(120, 30, 20)])


_add("q62_pruned_read", _pruned, f"SELECT c_custkey AS custkey FROM {SKY['customer']} WHERE c_custkey % 3 <> 0 AND {dist_sql('lon', 'lat', '120.0', '30.0')} < 20")


# ------------------------------------------------------------------ association
def _detections(spark: SparkSession, d: str) -> DataFrame:
    """Usable detections of exposures, once each."""
    rows_ = table(spark, d, "detection").where("exp_id <> 0").select("det_id", "exp_id", F.col("mjd_obs").alias("mjd"), "ra", "dec")
    return cut(aggregate.latest_version(rows_, ["det_id"], ["exp_id", "mjd", "ra", "dec"]))


def _associate(spark: SparkSession, d: str) -> DataFrame:
    return associate.associate(_detections(spark, d), 1 / 3600)[1].select("det_id", "obj_id")


def _sanity(spark: SparkSession, d: str) -> DataFrame:
    det = _detections(spark, d)
    objects, links = associate.associate(det, 1 / 3600)
    return associate.sanity(det, cut(objects), cut(links), 1 / 3600)


_add("q48_associate", _associate)
_add("q49_sanity", _sanity, "SELECT * FROM (VALUES ('once', CAST(0 AS BIGINT)), ('linked', 0), ('used', 0), ('near', 0), ('known', 0)) t(\"check\", n)")
def _streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files: counts per day and type, kept up to date by micro-batches, then read."""
    from skyframe.streaming import windows

    folder = f"{spark.sparkContext.getCheckpointDir() or shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windows.windowed_counts(events, "ts", ["event_type"], "1 day", late="36500 days")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts")
    windows.ingest(counts, keep, f"{folder}/state", "complete").awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_add("q63_streaming_windows", _streaming_windows, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")


def queries() -> dict:
    return Q


def sql() -> dict:
    return SQL
