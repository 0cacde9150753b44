"""Queries of sources, sinks, stored tables, user functions and language corners, over the driver's whole tables, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.catalog.database import Database
from skyframe.catalog.storage import Folder
from skyframe.functions import maps, pixels, sky
from skyframe.operators import aggregate, associate, mapreduce, rows
from skyframe.plans import joins
from skyframe.plans.bounds import IntervalSet, beam, polygon
from skyframe.queries.reference import B, L, SKY, _detections, _photometry, _sky, _stored, database, cell_sql, dist_sql, plane_sql
from skyframe.session import cut, shared_folder, table
from skyframe.sources import fits, par, surveys, text

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    base = spark.sparkContext.getCheckpointDir() or shared_folder(spark)
    return f"{base}/scratch-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources and sinks
@query("c01_text_round_trip", "SELECT c_custkey AS k, round(c_acctbal, 6) AS bal, CAST(c_nationkey AS INTEGER) AS nation, c_mktsegment AS seg FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The text sink, compressed, and the text importer."""
    folder = scratch(spark)
    text.write_text(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double"), "c_nationkey", "c_mktsegment"), folder, "gzip")
    back = text.read_text(spark, folder, "k,bal,nation,seg", {"k": "i8", "nation": "i4", "seg": "a20"})
    return back.select("k", F.round("bal", 6).alias("bal"), "nation", "seg")


@query("c02_fits_round_trip", "SELECT o_orderkey AS k, o_custkey AS c, CAST(o_totalprice AS DOUBLE) AS price, o_orderstatus AS status FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    """FITS files written by the tasks, and read back by the importer."""
    folder = scratch(spark)
    sent = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"))
    fits.write_fits_parts(sent, folder.removeprefix("file:"), 100_000)
    return fits.read_fits(spark, f"{folder}/*.fits", "k long, c long, price double, status string")


@query("c03_parameter_file", "SELECT c_custkey, n_name AS nation, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A parameter file of the nations, read as an in-query lookup."""
    folder = scratch(spark)
    lines = [f'NATIONS {r["n_nationkey"]} "{r["n_name"]}" {r["n_regionkey"]}' for r in table(spark, d, "nation").collect()]  # 25 rows
    Folder(spark, folder).write("nations.par", "typedef struct {\n long key;\n char name[40];\n long region;\n} NATIONS;\n" + "\n".join(lines) + "\n")
    names = par.file_table(spark, f"{folder}/nations.par", "key", ("name", "region"))
    return database(spark, d).query("c_custkey, look(c_nationkey).name AS nation, look(c_nationkey).region AS region FROM customer", {"look": names}).dataframe()


@query("c04_definition_and_follow", "SELECT c_custkey AS custkey, CAST(c_acctbal AS DOUBLE) AS balance FROM customer WHERE c_acctbal > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A table defined in YAML, filled by INTO, followed from another database and queried there."""
    folder = scratch(spark)
    one, two = Database(spark, [f"{folder}/one"]), Database(spark, [f"{folder}/two"])
    words = "level: 3\nschema:\n  main:\n    columns:\n      - [id, u8]\n      - [lon, f8]\n      - [lat, f8]\n      - [custkey, i8]\n      - [balance, f8]\n    primary_key: id\n    spatial_keys: [lon, lat]\naliases: {money: balance}\n"
    one.create_table("people", par.read_definition(words))
    one.register("customer", _sky(table(spark, d, "customer"), "c_custkey"), primary_key="c_custkey", spatial_keys=["lon", "lat"])
    one.query("lon, lat, c_custkey AS custkey, c_acctbal AS balance FROM customer INTO people").write()
    Folder(spark, f"{folder}/two").make()
    two.follow("people", f"{folder}/one")
    return two.query("custkey, money AS balance FROM people WHERE money > 0").dataframe()


@query("c05_files_and_headers", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN -1 ELSE n_regionkey END AS region, n_nationkey <> 3 AS there FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Contents of files that a column names, and keywords of their headers; one file is missing."""
    folder = scratch(spark)
    db = Database(spark, [folder])
    db.create_table("files", {"schema": {"main": {"columns": [("id", "u8")], "primary_key": "id"}}})
    nations = table(spark, d, "nation")
    for r in nations.collect():  # 25 rows
        if r["n_nationkey"] != 3:
            Folder(spark, f"{folder}/files/files/hdr").write(f"n{r['n_nationkey']}.hdr", f"REGION  = {r['n_regionkey']} / of the nation\n")
    named = nations.withColumn("uri", F.concat(F.lit("sky:files:hdr:n"), F.col("n_nationkey").cast("string"), F.lit(".hdr")))
    there = db.fetch_uris(named, "uri").select("n_nationkey", F.col("content").isNotNull().alias("there"))
    db.register("nation", named, primary_key="n_nationkey")
    heads = db.query("n_nationkey AS k, np.int64(ffitskw(uri, 'REGION', -1)) AS region FROM nation").dataframe()
    return heads.join(there, F.col("k") == F.col("n_nationkey")).select("k", "region", "there")


@query("c06_new_files", """
WITH f AS (SELECT DISTINCT stream, file_no, smf_fn FROM smf_raw WHERE hdu = 'primary' AND smf_fn IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY file_no DESC, smf_fn DESC) AS k FROM f)
SELECT stream, file_no, smf_fn FROM n WHERE k = 1 AND smf_fn NOT IN (SELECT smf_fn FROM exposure WHERE smf_fn IS NOT NULL AND airmass > 2)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of each stream the newest file, unless it is loaded: here, an exposure of high airmass."""
    listed = table(spark, d, "smf_raw").where("hdu = 'primary' AND smf_fn IS NOT NULL").select("stream", "file_no", "smf_fn").distinct()
    return surveys.new_files(listed, "smf_fn", table(spark, d, "exposure").where("airmass > 2 AND NOT isnan(airmass)"), "smf_fn", "file_no", "stream").select("stream", "file_no", "smf_fn")


@query("c07_exposure_listing", "SELECT exp_id, mjd_obs, filterid, smf_fn FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY loaded_at DESC, smf_fn DESC, mjd_obs DESC, filterid DESC) AS k FROM exposure WHERE exp_id IS NOT NULL) WHERE k = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return surveys.exposure_listing(table(spark, d, "exposure"))


# ------------------------------------------------------------------ language
@query("c10_tuple_names", 'SELECT c_custkey, c_nationkey AS "(c_nationkey,c_acctbal+1)[0]", CAST(c_acctbal AS DOUBLE) + 1 AS "(c_nationkey,c_acctbal+1)[1]" FROM customer')
def _(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).query("c_custkey, (c_nationkey, c_acctbal + 1) FROM customer").dataframe()


@query("c11_name_order", "SELECT c_custkey AS k, CAST(c_acctbal AS DOUBLE) AS c_nationkey, CAST(c_acctbal AS DOUBLE) * 2 AS twice, CAST(o_totalprice AS DOUBLE) + 5 AS sum FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    """An alias comes before a column, the root's column before another table's, columns before the caller's names."""
    names = {"add": 5, "limit": 100, "c_acctbal": -1}
    return database(spark, d).query("c_custkey AS k, c_acctbal AS c_nationkey, c_nationkey * 2 AS twice, orders.o_totalprice + add AS sum FROM customer, orders WHERE c_nationkey > limit", names).dataframe()


@query("c12_two_dimensions", "SELECT vec_id, CAST(embedding[7] AS DOUBLE) AS a, CAST(embedding[8] AS DOUBLE) AS b, CAST(embedding[5] AS DOUBLE) + CAST(embedding[6] AS DOUBLE) AS c FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = Database(spark)
    db.register("v", table(spark, d, "embeddings").select("vec_id", F.array(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4)).alias("m")), primary_key="vec_id")
    got = db.query("vec_id, m(1, 2) AS a, m(-1, -1) AS b, m(1, (0, 2)) AS c FROM v").dataframe()
    return got.select("vec_id", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), (F.get("c", F.lit(0)).cast("double") + F.get("c", F.lit(1)).cast("double")).alias("c"))


@query("c13_self_match", f"SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {SKY['supplier']} a JOIN {SKY['supplier']} b ON abs(a.lat - b.lat) < 5.001 WHERE {dist_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} < 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).query("a.s_suppkey AS a, b.s_suppkey AS b FROM supplier AS a, supplier(matchedto=a, nmax=100000, dmax=18000) AS b").dataframe()


@query("c14_user_functions", "SELECT c_custkey AS k, CAST(c_acctbal AS DOUBLE) * 2 AS a, c_nationkey * c_nationkey + 1 AS b, CAST(c_acctbal AS DOUBLE) / 10 AS c FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A registered function, one defined by text, and one of a module."""
    from types import SimpleNamespace

    db = database(spark, d)
    db.register_udf(lambda x: x.cast("double") * 2, "twice")
    db.define("square = lambda x: x * x + 1")
    db.functions.register_module(SimpleNamespace(__all__=["tenth"], tenth=lambda x: x.cast("double") / 10), "mine")
    return db.query("c_custkey AS k, twice(c_acctbal) AS a, square(c_nationkey) AS b, mine.tenth(c_acctbal) AS c FROM customer").dataframe().withColumn("b", F.col("b").cast("bigint"))


@query("c17_flag_names", "SELECT DISTINCT det_id, flags & 4096 <> 0 AS saturated, flags & 393216 <> 0 AS poor_sky FROM detection WHERE det_id IS NOT NULL AND flags & 256 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Bits of the flag word by their names."""
    db = Database(spark)
    db.register("det", table(spark, d, "detection").where("det_id IS NOT NULL").select("det_id", "flags").distinct(), primary_key="det_id")
    return db.query("det_id, (flags & det_flags.SATURATED) != 0 AS saturated, (flags & (det_flags.SKYVAR_FAILURE | det_flags.MOMENTS_SN)) != 0 AS poor_sky FROM det WHERE (flags & det_flags.BLEND) == 0").dataframe().distinct()


@query("c15_filter_kernel", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_name > 'NATION_15'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A kernel on blocks of the result, which come to the caller one by one (25 rows)."""
    blocks = database(spark, d).query("n_nationkey AS k, n_name AS name FROM nation").iterate(return_blocks=True, filter=lambda b: b[b["name"] > "NATION_15"])
    return rows.stack([spark.createDataFrame(b, "k int, name string") for b in blocks], spark.createDataFrame([], "k int, name string"))


@query("c16_link_columns_in_two_tables", "SELECT c.c_custkey AS k, s.s_suppkey AS s FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) c JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) s USING (i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The k-th customer with the k-th supplier: m1 in one table, m2 in another."""
    links = joins.side_by_side((table(spark, d, "customer"), "c_custkey", "c_custkey"), (table(spark, d, "supplier"), "s_suppkey", "s_suppkey"))
    left, right = table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier").select("s_suppkey")
    return joins.link_join(left, "c_custkey", links, "m1", "m2", right, "s_suppkey").select(F.col("c_custkey").alias("k"), F.col("s_suppkey").alias("s"))


# ------------------------------------------------------------------ geometry
@query("c20_healpix_plane", f"WITH {plane_sql(SKY['customer'])} SELECT c_custkey, round_even(((quarter + 0.5) * pi() / 2 + uu) * 1e6, 0) AS x, round_even((vv + pi() / 2) * 1e6, 0) AS y, true AS back FROM plane")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The plane's coordinates, and the way back."""
    x, y = sky.healpix(F.col("lon"), F.col("lat"))
    lon, lat = sky.healpix_inverse(F.col("p.x"), F.col("p.y"))
    placed = _sky(table(spark, d, "customer"), "c_custkey").withColumn("p", F.struct(x.alias("x"), y.alias("y")))
    return placed.select("c_custkey", F.rint(F.col("p.x") * 1e6).alias("x"), F.rint(F.col("p.y") * 1e6).alias("y"), (sky.gc_dist(F.col("lon"), F.col("lat"), lon, lat) < 1e-9).alias("back"))


@query("c21_pixel_plane_back", f"SELECT sdss_id, true AS back FROM {SKY['sdss']}")
def _(spark: SparkSession, d: str) -> DataFrame:
    x, y = sky.butterfly(F.col("ra"), F.col("dec"))
    lon, lat = sky.butterfly_inverse(F.col("p.x"), F.col("p.y"))
    placed = database(spark, d).read("sdss").withColumn("p", F.struct(x.alias("x"), y.alias("y")))
    return placed.select("sdss_id", (sky.gc_dist(F.col("ra"), F.col("dec"), lon, lat) < 1e-9).alias("back"))


@query("c22_mended_positions", f"""
WITH g AS (SELECT sdss_id, ((ra % 360) + 360) % 360 AS ra, greatest(-90.0, least(90.0, dec)) AS dec FROM sdss WHERE ra IS NOT NULL AND dec IS NOT NULL AND NOT isnan(ra) AND NOT isnan(dec))
SELECT DISTINCT sdss_id, round_even(ra * 8191.3, 0) AS ra, round_even(dec * 8191.3, 0) AS dec, round_even({L} * 1e4, 0) AS gal_l, round_even({B} * 1e4, 0) AS gal_b FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    mended = surveys.mend_positions(table(spark, d, "sdss").select("sdss_id", "ra", "dec"))
    return mended.select("sdss_id", F.rint(F.col("ra") * 8191.3).alias("ra"), F.rint(F.col("dec") * 8191.3).alias("dec"), F.rint(F.col("l") * 1e4).alias("gal_l"), F.rint(F.col("b") * 1e4).alias("gal_b")).distinct()


@query("c23_intervals", "SELECT event_id, v BETWEEN -1 AND 2 OR v BETWEEN 3 AND 5 OR v = 9 AS inside FROM (SELECT event_id, CAST(event_id % 127 AS DOUBLE) / 10 - 1.5 AS v FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Membership in merged closed intervals."""
    v = F.col("event_id") % 127 / F.lit(10.0) - 1.5
    return table(spark, d, "events").select("event_id", IntervalSet((1, 2), (3, 4), (-1, 0), (0, 1.5), (9, 9), (3.5, 5)).test(v).alias("inside"))


POLYGON = [10.0, 80.0, 70.0, 20.0], [-20.0, -10.0, 30.0, 25.0]


def _polygon_sql() -> str:
    """Crossings of the edges, straight lines of the pixel plane, to the right of a point; odd: inside."""
    x, y = pixels.butterfly(*map(np.array, POLYGON))
    edges = zip(x.tolist(), y.tolist(), np.roll(x, -1).tolist(), np.roll(y, -1).tolist())
    hits = [f"CASE WHEN (({b!r} <= py) <> ({q!r} <= py)) AND px < {a!r} + ({p!r} - ({a!r})) * (py - ({b!r})) / ({q!r} - ({b!r})) THEN 1 ELSE 0 END" for a, b, p, q in edges]
    return f"WITH src AS (SELECT sdss_id, ra AS lon, dec AS lat FROM {SKY['sdss']}), {plane_sql('src')} SELECT sdss_id FROM plane WHERE ({' + '.join(hits)}) % 2 = 1"


@query("c24_polygon", _polygon_sql())
def _(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).query("sdss_id FROM sdss").dataframe(bounds=[polygon(*POLYGON)])


@query("c25_cell_paths", f"""
WITH {plane_sql(SKY['customer'])}, steps AS (SELECT c_custkey, k, floor((1 + px) * (1 << (k - 1))) AS i, floor((1 + py) * (1 << (k - 1))) AS j, 2.0 / (1 << k) AS size FROM plane, range(1, 7) t(k))
SELECT c_custkey, CAST(sum((i + 0.5) * size - 1) AS DOUBLE) AS x, CAST(sum((j + 0.5) * size - 1) AS DOUBLE) AS y, 'static' AS last FROM steps GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The path's numbers: the sums of the centres of the pixels a cell lies in, from the coarsest down."""
    path = F.split("path", "/")
    numbers = lambda i: F.aggregate(F.slice(path, 1, 6), F.lit(0.0), lambda t, p: t + F.regexp_extract(p, r"^([+-][\d.]+)([+-][\d.]+)$", i).cast("double"))
    got = database(spark, d).query("c_custkey, _CELLPATH AS path FROM customer").dataframe()
    return got.select("c_custkey", numbers(1).alias("x"), numbers(2).alias("y"), F.element_at(path, -1).alias("last"))


@query("c26_neighbour_cells", "SELECT CAST(0 AS BIGINT) AS one_sided, CAST(0 AS BIGINT) AS alone, CAST(0 AS BIGINT) AS more_than_eight")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhood of the cells of level 4: mutual, and of at most eight others (ten where half pixels meet)."""
    near = pixels.adjacency(4)
    pairs = spark.createDataFrame([(a, b) for a, n in near.items() for b in n], "a long, b long")
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return pairs.subtract(back).agg(F.count(F.lit(1)).alias("one_sided")).crossJoin(counts.agg(F.count_if(F.col("n") == 0).alias("alone"), F.count_if(F.col("n") > 10).alias("more_than_eight")))


@query("c27_loose_bounds", f"SELECT c_custkey AS custkey FROM {SKY['customer']} WHERE c_custkey % 3 <> 0 AND {dist_sql('lon', 'lat', '200.0', '-30.0')} < 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Untested bounds: whole cells, which hold all rows in bounds (and lie within a pixel of them)."""
    loose = _stored(spark, d).query("custkey, lon, lat FROM stars").dataframe(bounds=[beam(200, -30, 25)], testbounds=False)
    dist = sky.gc_dist(F.col("lon"), F.col("lat"), 200.0, -30.0)
    far = F.when(dist > 25 + 2 * pixels.pixel_radius(3), F.raise_error(F.lit("a row far out of bounds")))
    return loose.where(far.isNull() & (dist < 25)).select("custkey")


@query("c28_dust_map", f"""
WITH p AS (SELECT c_custkey, CASE WHEN lat >= 0 THEN 1 ELSE -1 END AS s, radians(lon) AS l, radians(lat) AS b FROM {SKY['customer']}),
r AS (SELECT c_custkey, s, l, 20 * sqrt(greatest(0, 1 - s * sin(b))) AS r FROM p),
i AS (SELECT c_custkey, s, greatest(0, least(47, round_even(r * cos(l) + 23, 0))) AS x, greatest(0, least(47, round_even(-s * r * sin(l) + 23, 0))) AS y FROM r)
SELECT c_custkey, y * 100 + x + CASE WHEN s < 0 THEN 10000 ELSE 0 END AS dust FROM i""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Nearest pixels of a pair of polar images whose values tell their place."""
    image = np.arange(48)[:, None] * 100.0 + np.arange(48)[None, :]
    keys = {"CRPIX1": 24, "CRPIX2": 24, "LAM_SCAL": 20.0}
    dust = maps.DustMap(spark, {"ngp": (keys, image), "sgp": (keys, image + 10000)})
    return _sky(table(spark, d, "customer"), "c_custkey").select("c_custkey", dust.column(F.col("lon"), F.col("lat")).alias("dust"))


@query("c29_flat_fields", """
WITH x AS (SELECT det_id, chip_id, filterid, det_id & 4095 AS px, (det_id >> 12) & 4095 AS py FROM detection WHERE det_id IS NOT NULL),
c AS (SELECT *, ((px + 8) // 608) + 8 * ((py + 10) // 610) AS raw FROM x),
k AS (SELECT *, CASE WHEN chip_id % 8 <= 3 THEN 63 - raw ELSE raw END AS cell FROM c)
SELECT DISTINCT det_id, CASE WHEN filterid LIKE 'g%' THEN (((chip_id % 8) * 8 + cell % 8) * 100 + (chip_id // 8) * 8 + cell // 8) * 0.5 ELSE 0 END AS offs FROM k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Corrections by chip cell in one band; the table's values tell their place."""
    grid = np.arange(64)[:, None, None] * 100.0 + np.arange(64)[None, :, None]
    flats = maps.flat_table(spark, {"g": {"mjd": [55000.2], "stack": grid, "mask": np.ones((64, 64)), "weights": np.array([[0.5]])}})
    x = F.col("det_id").bitwiseAND(F.lit(4095))
    y = F.shiftright("det_id", 12).bitwiseAND(F.lit(4095))
    det = table(spark, d, "detection").where("det_id IS NOT NULL").select("det_id", "chip_id", "filterid", x.alias("px"), y.alias("py"), F.lit(55000.7).alias("mjd"))
    return maps.flat_offsets(det, flats, "chip_id", "px", "py", "mjd", "filterid").select("det_id", "offs").distinct()


@query("c2a_border_zone", f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS own FROM {SKY['sdss']}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Copies of border rows: every other cell that a circle of 29.9 arc seconds around a row meets has one, its own has none."""
    db = database(spark, d)
    halo = db.query("sdss_id, _CELLID AS cell, _CACHED AS cached FROM sdss").dataframe(include_cached=True)
    placed = db.read("sdss").withColumn("own", sky.static_cell(sky.cell_of_id(sky.position_id(F.col("ra"), F.col("dec")))))
    met = placed.select("sdss_id", "own", F.explode(F.array_distinct(sky.cells_around(F.col("ra"), F.col("dec"), sky.circle(29.9 / 3600, 64)))).alias("cell")).where("cell <> own")
    copies = halo.where("cached").select("sdss_id", "cell")
    missing = met.join(copies, ["sdss_id", "cell"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    own = copies.join(placed.select("sdss_id", F.col("own").alias("cell")), ["sdss_id", "cell"], "left_semi").agg(F.count(F.lit(1)).alias("own"))
    return halo.where("NOT cached").agg(F.count(F.lit(1)).alias("rows")).crossJoin(missing).crossJoin(own)  # three single rows


@query("c2b_fields_of_view", "SELECT CAST(0 AS BIGINT) AS missing")
def _(spark: SparkSession, d: str) -> DataFrame:
    """No point of an exposure's field lies in a cell that cells_near_exposures leaves out."""
    exposures = table(spark, d, "exposure").where("ra IS NOT NULL AND NOT isnan(ra) AND dec BETWEEN -90 AND 90").select("ra", "dec").distinct()
    cells = associate.cells_near_exposures(exposures, "ra", "dec", 1.6)
    points = [(0.0, 0.0)] + [o for ring in range(1, 9) for o in sky.circle(1.5999 * ring / 8, 6 * ring)]
    met = exposures.select(F.explode(F.array_distinct(sky.cells_around(F.col("ra"), F.col("dec"), points))).alias("cell")).distinct()
    return met.join(cells, "cell", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@query("c2c_association", "SELECT count(DISTINCT det_id) AS linked, CAST(0 AS BIGINT) AS far, CAST(0 AS BIGINT) AS unknown FROM detection WHERE det_id IS NOT NULL AND exp_id <> 0 AND mjd_obs IS NOT NULL AND NOT isnan(mjd_obs) AND ra IS NOT NULL AND NOT isnan(ra) AND NOT isnan(dec) AND dec BETWEEN -90 AND 90")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each usable detection has one link, to an object that there is, and by the positions themselves no farther than allowed."""
    det = _detections(spark, d)
    objects, links = associate.associate(det, 1 / 3600)
    objects, links = cut(objects), cut(links)
    placed = links.join(det.select("det_id", "ra", "dec"), "det_id").join(objects.select("obj_id", F.col("ra").alias("x"), F.col("dec").alias("y")), "obj_id", "left")
    far = F.count_if(sky.gc_dist(F.col("ra"), F.col("dec"), F.col("x"), F.col("y")) > 1.000001 / 3600)
    return placed.agg(F.count(F.lit(1)).alias("linked"), far.alias("far"), F.count_if(F.col("x").isNull()).alias("unknown"))


# ------------------------------------------------------------------ aggregation, rows, kernels
@query("c30_colour_maps", f"""
WITH src AS (SELECT ra AS lon, dec AS lat, CAST(g AS DOUBLE) - r AS v FROM {SKY['sdss']} WHERE NOT isnan(g) AND NOT isnan(r)), {plane_sql('src')}
SELECT CAST((floor(py * 8) + 8) * 16 + floor(px * 8) + 8 AS BIGINT) AS pix, CAST(least(floor((v + 2) / 0.5), 15) AS INTEGER) AS bin, count(*) AS n FROM plane WHERE v BETWEEN -2 AND 6 GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of a difference of magnitudes in every pixel."""
    return aggregate.pixel_histogram(database(spark, d).read("sdss"), F.col("ra"), F.col("dec"), F.col("g").cast("double") - F.col("r"), 4, -2.0, 6.0, 16)


@query("c31_blocks_by_key", "SELECT l_suppkey, count(*) AS n, CAST(1 AS BIGINT) AS blocks, true AS fits FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that keep a key's rows together: each key in one block, and no block of several keys above the limit."""
    b = aggregate.blocks_by_key(table(spark, d, "lineitem"), "l_suppkey", 3000)
    per_key = b.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("blocks"), F.first("block").alias("block"))
    sizes = per_key.groupBy("block").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("keys"))
    return per_key.join(sizes, "block").select("l_suppkey", "n", "blocks", ((F.col("size") <= 3000) | (F.col("keys") == 1)).alias("fits"))


@query("c32_lists_per_band", "SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Lists accumulated band by band, told by their sums."""
    lists = aggregate.accumulate_lists(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_linenumber", ["A", "N"])
    total = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("long"), lambda t, v: t + v))
    return lists.select("l_suppkey", total("l_linenumber_A").alias("a"), total("l_linenumber_N").alias("n"))


@query("c33_sorted_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row, 'x' AS mark FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rows.with_column(rows.numbered(rows.sort_rows(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate"), ["o_orderdate", "o_orderkey"]), "mark", "x").drop("o_orderdate")


@query("c34_kernels_per_pixel", f"WITH {plane_sql(SKY['orders'])}, c AS (SELECT {cell_sql()} AS cell, mjd FROM plane) SELECT cell, count(*) AS n, min(mjd) AS first, max(mjd) AS last, true AS ordered FROM c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A kernel that gets all rows of a pixel at once, in order of time, with the cell's id."""
    db = database(spark, d)
    orders = db.read("orders").select("mjd", "lon", "lat")
    cell = sky.cell_of_id(sky.position_id(F.col("lon"), F.col("lat"), F.col("mjd"), t0=49000, dt=30.0))
    return mapreduce.unpacked(mapreduce.pairs(orders.withColumn("_CELLID", cell), _pixel_kernel, True, True), "cell long, n long, first double, last double, ordered boolean")


def _pixel_kernel(block):
    slices = ((block["_CELLID"].to_numpy("int64") >> 32) & 0xFFF).tolist()
    yield block.attrs["cell_id"], len(block), float(block["mjd"].min()), float(block["mjd"].max()), slices == sorted(slices)


@query("c35_combined_kernels", "SELECT l_suppkey % 2 AS parity, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Three kernels, with a combiner before each shuffle, so that two keys are no two hot tasks."""
    from skyframe.queries.reference import _sum_by_parity, _to_pairs, _total

    df = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.lit(0).cast("long").alias("_CELLID"))
    second = mapreduce.reduce_by_key(mapreduce.pairs(df, _to_pairs), _sum_by_parity, combiner=_total)
    return mapreduce.unpacked(mapreduce.reduce_by_key(second, _total, combiner=_total), "parity long, total long")


@query("c36_execute", "SELECT c_nationkey AS nation, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Kernels over a query's rows; what the last one yields (25 results) comes to the caller."""

    def mapped(block):
        for key, part in block.groupby("nation"):
            yield int(key), (len(part), int(part["k"].max()))

    def reduced(key, values):
        counts, last = zip(*values)
        yield key, sum(counts), max(last)

    found = list(database(spark, d).query("c_nationkey AS nation, c_custkey AS k FROM customer").execute([mapped, reduced]))
    return spark.createDataFrame(found, "nation int, n long, last long")


# ------------------------------------------------------------------ stored tables
@query("c40_catalogue_counts", "SELECT count(*) AS recorded, count(*) AS stored, CAST(0 AS BIGINT) AS wrong_cells, count(*) AS rebuilt FROM customer WHERE c_custkey % 3 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the cell catalogue and by reading; cells that differ; and by a catalogue made anew."""
    t = _stored(spark, d).table("stars")
    recorded, stored, wrong = t.nrows(), t.read().count(), t.check_catalog().count()
    t.rebuild_catalog()
    return spark.createDataFrame([(recorded, stored, wrong, t.nrows())], "recorded long, stored long, wrong_cells long, rebuilt long")


@query("c41_key_rules", "SELECT c_custkey AS custkey, true AS has_key, true AS in_its_cell, true AS alone FROM customer WHERE c_custkey % 3 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Keys given by the table: set, unique, and telling the cell of the position."""
    stars = _stored(spark, d).read("stars")
    place = sky.static_cell(sky.cell_of_id(sky.position_id(F.col("lon"), F.col("lat")), 3))
    n = stars.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return stars.join(n, "id").select("custkey", (F.col("id") != 0).alias("has_key"), (sky.static_cell(sky.cell_of_id(F.col("id"), 3)) == place).alias("in_its_cell"), (F.col("n") == 1).alias("alone"))


@query("c42_transactions", "SELECT 'rolled back' AS step, count(*) AS n, 0 AS hooks FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'inside', count(*), 0 FROM customer UNION ALL SELECT 'outside', count(*), 0 FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'committed', count(*), 1 FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What a transaction writes is seen inside it, by others after its commit, and by nobody after a rollback; hooks run once."""
    db, called = _stored(spark, d), []
    db.on_commit("stars", lambda *_: called.append(1))
    more = db.read("customer").where("c_custkey % 3 = 0").select("lon", "lat", F.col("c_custkey").alias("custkey"))
    steps = []
    db.begin_transaction()
    db.write("stars", more)
    db.rollback()
    steps.append(("rolled back", db.read("stars").count(), len(called)))
    with db.transaction():
        db.write("stars", more)
        steps.append(("inside", db.read("stars").count(), len(called)))
        steps.append(("outside", Database(spark, db.roots).read("stars").count(), len(called)))
    steps.append(("committed", Database(spark, db.roots).read("stars").count(), len(called)))
    return spark.createDataFrame(steps, "step string, n long, hooks int")


@query("c43_removed_rows", "SELECT c_custkey AS custkey, true AS still_in_older FROM customer WHERE c_custkey % 3 <> 0 AND c_acctbal >= 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rows taken out by key; the snapshot before still has them."""
    db = _stored(spark, d)
    before = db.table("stars").current()
    db.remove("stars", db.read("stars").where("balance < 0").select("id"))
    older = Database(spark, db.roots, snapid=before).read("stars").select("custkey", F.lit(True).alias("still_in_older"))
    return db.read("stars").select("custkey").join(older, "custkey", "left")


@query("c44_new_table_by_into", "SELECT c_custkey AS custkey, CAST(c_acctbal AS DOUBLE) * 3 AS tripled, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) ELSE 0 END AS extra, true AS returned FROM customer WHERE c_custkey % 3 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """INTO makes a table, then adds a column to it; it returns the keys written."""
    db = _stored(spark, d)
    keys = db.query("lon, lat, custkey, balance * 3 AS tripled FROM stars INTO copy(spatial_keys=(lon, lat))").write()
    db.query("custkey, balance AS extra FROM stars WHERE balance > 0 INTO copy WHERE custkey == custkey").write()
    return db.read("copy").join(keys.select("id", F.lit(True).alias("returned")), "id", "left").select("custkey", "tripled", "extra", "returned")


@query("c45_one_cell", f"WITH src AS (SELECT * FROM {SKY['customer']} WHERE c_custkey % 3 <> 0), {plane_sql('src')}, c AS (SELECT c_custkey, floor((1 + px) * 4) AS i, floor((1 + py) * 4) AS j FROM plane) SELECT c_custkey AS custkey FROM c WHERE (i, j) = (SELECT (i, j) FROM c WHERE c_custkey = 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the cell in which one row lies; no other cell is opened."""
    db = _stored(spark, d)
    cell = db.query("_CELLID AS c FROM stars WHERE custkey == 1").dataframe().first()["c"]
    return db.query("custkey FROM stars").dataframe(cells=[cell])


@query("c46_stored_join", f"""
WITH c AS (SELECT * FROM {SKY['customer']} WHERE c_custkey % 3 <> 0), p AS (SELECT a.c_custkey AS a, b.p_partkey AS b, {dist_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM c a JOIN {SKY['part']} b ON abs(a.lat - b.lat) < 3.001 WHERE {dist_sql('a.lon', 'a.lat', '120.0', '30.0')} < 40)
SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p WHERE d < 3) WHERE k <= 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A cross-match of two stored tables under bounds: of both only the cells in reach are opened. Ties go by id."""
    db = _stored(spark, d)
    db.create_table("parts", {"level": 3, "schema": {"main": {"columns": [("id", "u8"), ("lon", "f8"), ("lat", "f8"), ("partkey", "i8")], "primary_key": "id", "spatial_keys": ["lon", "lat"]}}})
    db.write("parts", database(spark, d).read("part").select("lon", "lat", F.col("p_partkey").alias("partkey")))
    return db.query("custkey AS a, parts.partkey AS b FROM stars, parts(matchedto=stars, nmax=2, dmax=10800)").dataframe(bounds=[beam(120, 30, 40)])


@query("c47_spectral_bands", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS bands FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """How many bands each object has, from the arrays of one element a band."""
    arrays = aggregate.band_arrays(_photometry(spark, d), "l_suppkey", "l_returnflag", ["A", "N", "R"], ["n"])
    return arrays.select("l_suppkey", F.size(F.filter("n", lambda v: v.isNotNull())).cast("long").alias("bands"))


def queries() -> dict:
    return Q


def sql() -> dict:
    return SQL | {"q51_polygon": SQL["c24_polygon"]}
