"""Queries of the general training-data problems (p1, p2, p3, p5, p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.operators import hotkeys, lifespans, orphans, slabs, spikes
from skyframe.session import cut, table


# ---------------------------------------------------------------- p1
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = lifespans.ranked_files(table(spark, d, "smf_raw"))
    return lifespans.changes(files).select("stream", "file_no", "hdu", "field", "change")


def p1_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return lifespans.lifespans(lifespans.ranked_files(table(spark, d, "smf_raw")))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """All primary headers and .psf units as one table, typed by the alias table."""
    return lifespans.all_units(cut(lifespans.header_files(table(spark, d, "smf_raw"))))


def p1_aliases(spark: SparkSession, d: str) -> DataFrame:
    return lifespans.alias_table(cut(lifespans.header_files(table(spark, d, "smf_raw"))))


def p1_missing(spark: SparkSession, d: str) -> DataFrame:
    """What the exposures' own lists say: per keyword and column of the current schema, exposures and chips that lack it,
    and when such files were first and last loaded."""
    rows = table(spark, d, "exposure").where("exp_id IS NOT NULL").select("exp_id", "loaded_at", "notfound_keys", "notfound_cols")
    keys = rows.select("exp_id", "loaded_at", F.lit("keyword").alias("unit"), F.lit(0).alias("chip"), F.explode("notfound_keys").alias("field"))
    chips = rows.select("exp_id", "loaded_at", F.posexplode("notfound_cols").alias("chip", "cols"))
    columns = chips.select("exp_id", "loaded_at", F.lit("column").alias("unit"), "chip", F.explode("cols").alias("field"))
    # once per exposure and chip first, so that a field which most files lack is combined before the shuffle by field
    once = keys.unionByName(columns).where("field IS NOT NULL").groupBy("unit", "field", "exp_id", "chip").agg(F.min("loaded_at").alias("first"), F.max("loaded_at").alias("last"))
    per = once.groupBy("unit", "field", "exp_id").agg(F.count(F.lit(1)).alias("chips"), F.min("first").alias("first"), F.max("last").alias("last"))
    return per.groupBy("unit", "field").agg(F.count(F.lit(1)).alias("exposures"), F.sum("chips").alias("chips"), F.unix_micros(F.min("first")).alias("first_loaded"), F.unix_micros(F.max("last")).alias("last_loaded"))


P1_MISSING_SQL = """
WITH k AS (SELECT exp_id, loaded_at, 'keyword' AS unit, 0 AS chip, unnest(notfound_keys) AS field FROM exposure WHERE exp_id IS NOT NULL),
g AS (SELECT exp_id, loaded_at, unnest(range(len(notfound_cols))) AS chip, unnest(notfound_cols) AS cols FROM exposure WHERE exp_id IS NOT NULL),
c AS (SELECT exp_id, loaded_at, 'column' AS unit, chip, unnest(cols) AS field FROM g),
a AS (SELECT * FROM k UNION ALL BY NAME SELECT * FROM c)
SELECT unit, field, count(DISTINCT exp_id) AS exposures, count(DISTINCT (exp_id, chip)) AS chips, epoch_us(min(loaded_at)) AS first_loaded, epoch_us(max(loaded_at)) AS last_loaded
FROM a WHERE field IS NOT NULL GROUP BY 1, 2
"""


P1_CARDS = r"""
files AS (
  SELECT stream, hdu, file_no, arg_max(body, (loaded_at, body)) AS body FROM smf_raw
  WHERE stream IS NOT NULL AND hdu IS NOT NULL AND file_no IS NOT NULL AND body IS NOT NULL GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY stream, hdu ORDER BY file_no) - 1 AS pos FROM files),
lines AS (SELECT stream, hdu, file_no, pos, unnest(string_split(body, chr(10))) AS line FROM placed),
cards AS (
  SELECT stream, hdu, file_no, pos, trim(regexp_extract(line, '^([^=]*)=', 1)) AS k,
    CASE WHEN regexp_matches(line, '^[^=]*=\s*''') THEN rtrim(regexp_extract(line, '^[^=]*=\s*''([^'']*)''', 1)) ELSE trim(regexp_extract(line, '^[^=]*=([^/]*)', 1)) END AS raw,
    regexp_matches(line, '^[^=]*=\s*''') AS quoted,
    lower(regexp_replace(CASE WHEN regexp_matches(line, '^[^=]*=\s*''') THEN regexp_extract(line, '^[^=]*=\s*''[^'']*''\s*/(.*)$', 1) ELSE regexp_extract(line, '^[^=]*=[^/]*/(.*)$', 1) END, '\s', '', 'g')) AS note
  FROM lines WHERE line LIKE '%=%'),
fields AS (
  SELECT stream, hdu, file_no, pos, k AS field, raw, note,
    CASE WHEN quoted THEN 'string' WHEN raw = '' THEN '' WHEN raw IN ('T', 'F') THEN 'boolean' WHEN regexp_full_match(raw, '[+-]?\d+') THEN 'integer' ELSE 'real' END AS kind
  FROM cards WHERE hdu = 'primary'
  UNION ALL
  SELECT n.stream, n.hdu, n.file_no, n.pos, n.raw, n.raw, n.note, coalesce(t.raw, '')
  FROM cards n LEFT JOIN cards t ON t.stream = n.stream AND t.hdu = n.hdu AND t.pos = n.pos AND t.k = 'TFORM' || substr(n.k, 6)
  WHERE n.hdu <> 'primary' AND regexp_full_match(n.k, 'TTYPE\d+'))"""

P1_FOUND_SQL = f"""
WITH {P1_CARDS},
gone AS (SELECT a.stream, a.hdu, a.pos + 1 AS pos, a.field, a.note FROM fields a ANTI JOIN fields b ON a.stream = b.stream AND a.hdu = b.hdu AND a.field = b.field AND b.pos = a.pos + 1),
new AS (SELECT a.stream, a.hdu, a.pos, a.field, a.note FROM fields a ANTI JOIN fields b ON a.stream = b.stream AND a.hdu = b.hdu AND a.field = b.field AND b.pos = a.pos - 1 WHERE a.pos > 0),
pairs AS (
  SELECT coalesce(g.stream, n.stream) AS stream, coalesce(g.hdu, n.hdu) AS hdu, coalesce(g.pos, n.pos) AS pos, coalesce(g.field, n.field) AS field,
    CASE WHEN g.field IS NULL THEN 'added' WHEN n.field IS NULL THEN 'removed' ELSE 'renamed' END AS change
  FROM (SELECT *, row_number() OVER (PARTITION BY stream, hdu, pos, note ORDER BY field) AS k FROM gone) g
  FULL JOIN (SELECT *, row_number() OVER (PARTITION BY stream, hdu, pos, note ORDER BY field) AS k FROM new) n
    ON g.stream = n.stream AND g.hdu = n.hdu AND g.pos = n.pos AND g.note = n.note AND g.k = n.k AND g.note <> ''),
retyped AS (SELECT a.stream, a.hdu, a.pos, a.field, 'retyped' AS change FROM fields a JOIN fields b ON a.stream = b.stream AND a.hdu = b.hdu AND a.field = b.field AND b.pos = a.pos - 1 WHERE a.kind <> b.kind)
SELECT c.stream, p.file_no, c.hdu, c.field, c.change
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM retyped) c JOIN placed p ON p.stream = c.stream AND p.hdu = c.hdu AND p.pos = c.pos
"""

#: Names of one description, and the narrowest type for all of them; of a table's columns as a TFORM code.
P1_ALIASES_SQL = rf"""
WITH {P1_CARDS},
typed AS (
  SELECT hdu, field, note, CASE WHEN hdu = 'primary' AND (kind = 'integer' AND TRY_CAST(raw AS BIGINT) IS NULL OR kind = 'real' AND TRY_CAST(raw AS DOUBLE) IS NULL) THEN 'string' ELSE kind END AS kind FROM fields),
named AS (SELECT hdu, CASE WHEN note = '' THEN '=' || field ELSE note END AS family, field, count(*) AS n, list(DISTINCT kind) AS kinds FROM typed GROUP BY 1, 2, 3),
families AS (SELECT hdu, family, arg_min(field, (-n, field)) AS canonical, list_filter(list_distinct(flatten(list(kinds))), lambda k: k <> '') AS kinds FROM named GROUP BY 1, 2),
codes AS (SELECT *, list_distinct(list_transform(kinds, lambda k: regexp_extract(k, '^(\d*)([LXBIJKAEDCM])$', 2))) AS letters,
  list_max(list_transform(kinds, lambda k: coalesce(TRY_CAST(nullif(regexp_extract(k, '^(\d*)([LXBIJKAEDCM])$', 1), '') AS INTEGER), 1))) AS repeat FROM families),
wide AS (SELECT *, CASE WHEN len(letters) = 1 THEN nullif(letters[1], '') WHEN list_has_all(['B', 'I', 'J', 'K'], letters) THEN CASE WHEN list_contains(letters, 'K') THEN 'K' WHEN list_contains(letters, 'J') THEN 'J' ELSE 'I' END
  WHEN list_has_all(['B', 'I', 'J', 'E', 'D'], letters) THEN CASE WHEN list_has_any(letters, ['J', 'D']) THEN 'D' ELSE 'E' END WHEN list_has_all(['C', 'M'], letters) THEN 'M' END AS letter FROM codes)
SELECT hdu, field, canonical, CASE
  WHEN hdu = 'primary' THEN CASE WHEN list_contains(w.kinds, 'string') OR list_contains(w.kinds, 'boolean') AND list_has_any(w.kinds, ['integer', 'real']) THEN 'string'
    WHEN list_contains(w.kinds, 'real') THEN 'real' WHEN list_contains(w.kinds, 'integer') THEN 'integer' WHEN list_contains(w.kinds, 'boolean') THEN 'boolean' ELSE '' END
  WHEN len(w.kinds) = 0 THEN '' WHEN len(w.kinds) = 1 THEN w.kinds[1]
  ELSE coalesce(CASE WHEN repeat <> 1 THEN CAST(repeat AS VARCHAR) ELSE '' END || letter, 'string') END AS kind
FROM named JOIN wide w USING (hdu, family)
"""

P1_LIFESPANS_SQL = f"""
WITH {P1_CARDS},
marked AS (SELECT *, pos - row_number() OVER (PARTITION BY stream, hdu, field, kind ORDER BY pos) AS island FROM fields)
SELECT stream, hdu, field, kind, min(file_no) AS first_file, max(file_no) AS last_file, count(*) AS n_files
FROM marked GROUP BY stream, hdu, field, kind, island
"""


# ---------------------------------------------------------------- p2
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = slabs.near_pairs(table(spark, d, "sdss"), "sdss_id", "ra", "dec", 1.0)
    return pairs.select(F.col("a").alias("sdss_id_a"), F.col("b").alias("sdss_id_b"))


def p2_regions(spark: SparkSession, d: str) -> DataFrame:
    """Sources per region: 72 four-cornered fields that tile the sky with gaps, in the plane of (ra, dec)."""
    points = table(spark, d, "sdss").select("sdss_id", F.pmod("ra", F.lit(360.0)).alias("x"), F.col("dec").alias("y")).where("y BETWEEN -90 AND 90").dropDuplicates(["sdss_id"])
    corners = [(i, j) for i in range(12) for j in range(6)]
    rows = [(i * 100 + j, [(30.0 * i, -90.0 + 30 * j + 3), (30.0 * i + 15, -90.0 + 30 * j), (30.0 * i + 30, -90.0 + 30 * j + 12), (30.0 * i + 21, -90.0 + 30 * j + 27)]) for i, j in corners]
    regions = spark.createDataFrame(rows, "region_id int, corners array<struct<x: double, y: double>>")
    hits = slabs.locate(points, "x", "y", regions, "region_id", "corners", slab=5.0)
    return hits.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


P2_FOUND_SQL = """
WITH p AS (
  SELECT DISTINCT sdss_id AS id, round(((ra % 360) + 360) % 360, 9) AS ra, round(dec, 9) AS dec FROM sdss
  WHERE ra IS NOT NULL AND NOT isnan(ra) AND NOT isinf(ra) AND dec BETWEEN -90 AND 90),
v AS (SELECT id, dec, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM p)
SELECT DISTINCT a.id AS sdss_id_a, b.id AS sdss_id_b
FROM v a JOIN v b ON b.dec BETWEEN a.dec - 0.0003 AND a.dec + 0.0003 AND a.id < b.id
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < pow(2 * sin(radians(1.0 / 3600) / 2), 2)
"""

P2_REGIONS_SQL = """
WITH p AS (SELECT sdss_id, any_value(((ra % 360) + 360) % 360) AS x, any_value(dec) AS y FROM sdss WHERE dec BETWEEN -90 AND 90 GROUP BY 1),
r AS (SELECT i * 100 + j AS region, [[30.0 * i, -90.0 + 30 * j + 3], [30.0 * i + 15, -90.0 + 30 * j], [30.0 * i + 30, -90.0 + 30 * j + 12], [30.0 * i + 21, -90.0 + 30 * j + 27]] AS v
      FROM range(12) a(i), range(6) b(j)),
e AS (SELECT region, v[k] AS a, v[1 + k % 4] AS b FROM r, range(1, 5) t(k)),
hit AS (SELECT p.sdss_id, e.region, count(*) AS n FROM p JOIN e ON (e.a[1] <= p.x) <> (e.b[1] <= p.x)
        AND e.a[2] + (e.b[2] - e.a[2]) / (e.b[1] - e.a[1]) * (p.x - e.a[1]) <= p.y WHERE p.x IS NOT NULL AND NOT isnan(p.x) GROUP BY ALL)
SELECT region, count(*) AS n FROM hit WHERE n % 2 = 1 GROUP BY region
"""


# ---------------------------------------------------------------- p3
def level5(column: str = "sdss_id") -> list[Column]:
    return [F.shiftrightunsigned(column, 59).cast("long").alias("cell_x"), F.shiftrightunsigned(column, 49).bitwiseAND(F.lit(31)).cast("long").alias("cell_y")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    freqs = hotkeys.value_frequencies(table(spark, d, "sdss").select(*level5(), "run"), ["cell_x", "cell_y"], "run")
    return hotkeys.dominant_keys(freqs, ["cell_x", "cell_y"], 0.02).select("cell_x", "cell_y")


def p3_cell_runs(spark: SparkSession, d: str) -> DataFrame:
    """Per cell: rows, distinct runs and the commonest run."""
    freqs = hotkeys.value_frequencies(table(spark, d, "sdss").select(*level5(), "run"), ["cell_x", "cell_y"], "run")
    out = hotkeys.weighted_summary(freqs, ["cell_x", "cell_y"], "run")
    return out.select("cell_x", "cell_y", "n_rows", F.col("n_distinct").alias("n_runs"), F.col("mode").alias("mode_run"), F.col("mode_freq").alias("mode_rows"))


def p3_cell_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the r magnitude per cell, over all rows."""
    rows = table(spark, d, "sdss").where("sdss_id IS NOT NULL").select(*level5(), "r")
    freqs = hotkeys.value_frequencies(rows, ["cell_x", "cell_y"], "r")
    return hotkeys.weighted_percentiles(freqs, ["cell_x", "cell_y"], "r", [0.1, 0.5, 0.9])


CELLS = "((sdss_id >> 59) & 31) AS cell_x, ((sdss_id >> 49) & 31) AS cell_y"
P3_FOUND_SQL = f"""
SELECT cell_x, cell_y FROM (SELECT {CELLS}, count(*) AS n FROM sdss WHERE sdss_id IS NOT NULL GROUP BY 1, 2)
WHERE n >= 0.02 * (SELECT count(*) FROM sdss)
"""
P3_RUNS_SQL = f"""
WITH f AS (SELECT {CELLS}, run, count(*) AS freq FROM sdss GROUP BY 1, 2, 3),
m AS (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY run IS NULL, freq DESC, run) AS k FROM f)
SELECT cell_x, cell_y, CAST(sum(freq) AS BIGINT) AS n_rows, count(run) AS n_runs, max(CASE WHEN k = 1 THEN run END) AS mode_run,
  max(CASE WHEN run IS NOT NULL THEN freq END) AS mode_rows FROM m GROUP BY 1, 2
"""
P3_PERCENTILES_SQL = f"""
WITH v AS (SELECT {CELLS}, CAST(r AS DOUBLE) AS r FROM sdss WHERE sdss_id IS NOT NULL AND r IS NOT NULL AND NOT isnan(r)),
k AS (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY r) AS k, count(*) OVER (PARTITION BY cell_x, cell_y) AS n FROM v)
SELECT cell_x, cell_y, CAST(p AS DOUBLE) AS prob, r AS percentile FROM k, (VALUES (0.1), (0.5), (0.9)) t(p)
WHERE k = greatest(1, CAST(ceil(CAST(p AS DOUBLE) * n) AS BIGINT))
"""


# ---------------------------------------------------------------- p5
def _keys(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    retired = table(spark, d, "retired_id").where(F.col("tab_name") == name)
    return orphans.parent_keys(table(spark, d, name), [key], retired, ["key_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for child, row_id, ref, parent, key in (("xm", "xm_id", "m2", "sdss", "sdss_id"), ("detection", "det_id", "exp_id", "exposure", "exp_id")):
        rows = table(spark, d, child).select(F.col(row_id).alias("row_id"), F.col(ref).alias("reference"))
        lost = orphans.orphans(rows, ["reference"], _keys(spark, d, parent, key), [key], nullish=(0,))
        parts.append(lost.select(F.lit(f"{child}.{ref}").alias("ref"), "row_id").distinct())
    return parts[0].unionByName(parts[1])


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, references and orphans per table and month of the first delivery."""
    xm = orphans.orphan_report(table(spark, d, "xm"), "xm_id", ["m2"], "loaded_at", _keys(spark, d, "sdss", "sdss_id"), ["sdss_id"], "xm.m2", (0,))
    det = orphans.orphan_report(table(spark, d, "detection"), "det_id", ["exp_id"], "loaded_at", _keys(spark, d, "exposure", "exp_id"), ["exp_id"], "detection.exp_id", (0,))
    return xm.unionByName(det)


def p5_composite(spark: SparkSession, d: str) -> DataFrame:
    """Composite reference with partial nulls: (exp_id, filterid) of detection in exposure, match partial, counted per mask."""
    child = table(spark, d, "detection").select("det_id", "exp_id", "filterid").distinct()
    keys = orphans.parent_keys(table(spark, d, "exposure"), ["exp_id", "filterid"])
    lost = orphans.orphans(child, ["exp_id", "filterid"], keys, ["exp_id", "filterid"], "partial", ())
    return lost.groupBy("null_mask").agg(F.count(F.lit(1)).alias("n"))


P5_LOST = """
SELECT DISTINCT 'xm.m2' AS ref, xm_id AS row_id FROM xm WHERE m2 IS NOT NULL AND m2 <> 0
  AND (m2 NOT IN (SELECT sdss_id FROM sdss WHERE sdss_id IS NOT NULL) OR m2 IN (SELECT key_id FROM retired_id WHERE tab_name = 'sdss' AND key_id IS NOT NULL))
UNION ALL
SELECT DISTINCT 'detection.exp_id' AS ref, det_id AS row_id FROM detection WHERE exp_id IS NOT NULL AND exp_id <> 0
  AND (exp_id NOT IN (SELECT exp_id FROM exposure WHERE exp_id IS NOT NULL) OR exp_id IN (SELECT key_id FROM retired_id WHERE tab_name = 'exposure' AND key_id IS NOT NULL))
"""
P5_REPORT_SQL = f"""
WITH lost AS ({P5_LOST}),
r AS (
  SELECT 'xm.m2' AS ref, xm_id AS row_id, min(loaded_at) AS t, arg_min(coalesce(m2, 0), (loaded_at IS NULL, loaded_at)) AS k FROM xm GROUP BY 2
  UNION ALL SELECT 'detection.exp_id', det_id, min(loaded_at), arg_min(coalesce(exp_id, 0), (loaded_at IS NULL, loaded_at)) FROM detection GROUP BY 2)
SELECT r.ref, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n_rows, count(*) FILTER (WHERE k <> 0) AS n_references, count(lost.row_id) AS n_orphans
FROM r LEFT JOIN lost ON lost.ref = r.ref AND lost.row_id = r.row_id GROUP BY 1, 2
"""
P5_COMPOSITE_SQL = """
WITH c AS (SELECT DISTINCT det_id, exp_id, filterid FROM detection),
p AS (SELECT DISTINCT exp_id, filterid FROM exposure WHERE exp_id IS NOT NULL AND filterid IS NOT NULL)
SELECT CASE WHEN exp_id IS NULL THEN '1' ELSE '0' END || CASE WHEN filterid IS NULL THEN '1' ELSE '0' END AS null_mask, count(*) AS n FROM c
WHERE NOT (exp_id IS NULL AND filterid IS NULL)
  AND NOT EXISTS (SELECT 1 FROM p WHERE (c.exp_id IS NULL OR c.exp_id = p.exp_id) AND (c.filterid IS NULL OR c.filterid = p.filterid))
GROUP BY 1
"""


# ---------------------------------------------------------------- p6
SOURCE = ["survey", "filterid"]


def _readings(spark: SparkSession, d: str) -> DataFrame:
    fields = ["zpt_obs", "airmass", "mjd_obs"]
    rows = table(spark, d, "exposure").select("exp_id", *SOURCE, *fields, "loaded_at")
    return spikes.ordered_readings(rows, "exp_id", SOURCE, "mjd_obs", fields)


def _mjd(c: Column) -> Column:
    return F.unix_micros(c) / 86400e6 + 40587


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One pass: each reading with what the screening says of it, then the exact limits."""
    rows = spikes.screen(_readings(spark, d), "exp_id", SOURCE, ["zpt_obs", "airmass"], ["zpt_obs", "airmass", "mjd_obs"])
    # a phase-space spike beyond eight scatters (the ellipsoid holds these for any source under 10^13 readings)
    far = lambda f: F.col(f"round_{f}").isNotNull() & (F.abs(F.col(f) - F.col(f"med_{f}")) > 8 * spikes.SCALE * F.col(f"mad_{f}"))
    mjd = F.col("mjd_obs")
    bad = {
        "zpt_obs": F.col("stuck_zpt_obs") | far("zpt_obs"),
        "airmass": F.col("stuck_airmass") | far("airmass") | (F.col("airmass") < 1) | (F.col("airmass") > 40),
        "mjd_obs": F.col("stuck_mjd_obs") | (mjd < 54000) | (mjd > 58500) | (mjd > _mjd(F.col("loaded_at"))),
    }
    fields = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in bad.items()]))
    return rows.select("exp_id", F.explode(fields).alias("field"))


def p6_phase_flags(spark: SparkSession, d: str) -> DataFrame:
    """What the phase-space ellipsoids flag, before any exact limit: exp_id, field, round."""
    rows = spikes.screen(_readings(spark, d), "exp_id", SOURCE, ["zpt_obs", "airmass"], [])
    flags = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"round_{f}").alias("round")) for f in ("zpt_obs", "airmass")])
    return rows.select("exp_id", F.explode(flags).alias("f")).where("f.round IS NOT NULL").select("exp_id", "f.field", "f.round")


def p6_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Every reading beyond eight scatters of its source, and whether the ellipsoids flag it: exp_id, field, flagged."""
    rows = spikes.screen(_readings(spark, d), "exp_id", SOURCE, ["zpt_obs", "airmass"], [])
    far = lambda f: (F.col(f"mad_{f}") > 0) & (F.abs(F.col(f) - F.col(f"med_{f}")) > 8 * spikes.SCALE * F.col(f"mad_{f}"))
    found = F.array_compact(F.array(*[F.when(far(f), F.struct(F.lit(f).alias("field"), F.col(f"round_{f}").isNotNull().alias("flagged"))) for f in ("zpt_obs", "airmass")]))
    return rows.select("exp_id", F.explode(found).alias("f")).select("exp_id", "f.field", "f.flagged")


P6_READINGS = """
WITH o AS (
  SELECT exp_id, min(loaded_at) AS loaded_at, arg_min({'s': survey, 'f': filterid, 'zpt_obs': zpt_obs, 'airmass': airmass, 'mjd_obs': mjd_obs}, (mjd_obs IS NULL, loaded_at)) AS p
  FROM exposure WHERE exp_id IS NOT NULL GROUP BY 1),
e AS (SELECT exp_id, loaded_at, p.s AS survey, p.f AS filterid, CAST(CASE WHEN isnan(p.zpt_obs) THEN NULL ELSE p.zpt_obs END AS DOUBLE) AS zpt_obs,
        CAST(CASE WHEN isnan(p.airmass) THEN NULL ELSE p.airmass END AS DOUBLE) AS airmass, CASE WHEN isnan(p.mjd_obs) THEN NULL ELSE p.mjd_obs END AS mjd_obs FROM o),
l AS (SELECT exp_id, loaded_at, survey, filterid, mjd_obs, unnest(['zpt_obs', 'airmass', 'mjd_obs']) AS field, unnest([zpt_obs, airmass, mjd_obs]) AS x FROM e),
m AS (SELECT survey, filterid, field, quantile_disc(x, 0.5) AS med FROM l GROUP BY ALL),
s AS (SELECT l.survey, l.filterid, l.field, med, quantile_disc(abs(x - med), 0.5) AS mad FROM l JOIN m USING (survey, filterid, field) GROUP BY ALL),
q AS (SELECT *, row_number() OVER w AS k FROM l WHERE mjd_obs IS NOT NULL WINDOW w AS (PARTITION BY survey, filterid, field ORDER BY mjd_obs, exp_id)),
b AS (SELECT *, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS brk FROM q WINDOW w AS (PARTITION BY survey, filterid, field ORDER BY k)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY survey, filterid, field ORDER BY k) AS run FROM b),
c AS (SELECT *, count(*) OVER (PARTITION BY survey, filterid, field, run) AS size FROM r)
"""
P6_SPIKES_SQL = P6_READINGS + "SELECT exp_id, field, true AS flagged FROM l JOIN s USING (survey, filterid, field) WHERE field <> 'mjd_obs' AND mad > 0 AND abs(x - med) > 8 * 1.4826 * mad"
P6_FOUND_SQL = P6_READINGS + """
SELECT DISTINCT exp_id, field FROM (
  SELECT exp_id, field FROM c WHERE size >= 6 AND x IS NOT NULL
  UNION ALL SELECT exp_id, field FROM l WHERE field = 'airmass' AND (x < 1 OR x > 40)
  UNION ALL SELECT exp_id, field FROM l WHERE field = 'mjd_obs' AND (x < 54000 OR x > 58500 OR x > epoch_us(loaded_at) / 86400e6 + 40587)
  UNION ALL SELECT exp_id, field FROM l JOIN s USING (survey, filterid, field) WHERE field <> 'mjd_obs' AND mad > 0 AND abs(x - med) > 8 * 1.4826 * mad)
"""


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_lifespans": p1_lifespans, "p1_aliases": p1_aliases, "p1_table": p1_table, "p1_missing": p1_missing,
        "p2_found": p2_found, "p2_regions": p2_regions,
        "p3_found": p3_found, "p3_cell_runs": p3_cell_runs, "p3_cell_percentiles": p3_cell_percentiles,
        "p5_found": p5_found, "p5_report": p5_report, "p5_composite": p5_composite,
        "p6_found": p6_found, "p6_phase_flags": p6_phase_flags, "p6_spikes": p6_spikes,
    }


def sql() -> dict:
    return {
        "p1_found": P1_FOUND_SQL, "p1_aliases": P1_ALIASES_SQL, "p1_lifespans": P1_LIFESPANS_SQL, "p2_found": P2_FOUND_SQL, "p2_regions": P2_REGIONS_SQL,
        "p3_found": P3_FOUND_SQL, "p3_cell_runs": P3_RUNS_SQL, "p3_cell_percentiles": P3_PERCENTILES_SQL,
        "p5_found": P5_LOST, "p5_report": P5_REPORT_SQL, "p5_composite": P5_COMPOSITE_SQL, "p6_found": P6_FOUND_SQL, "p6_spikes": P6_SPIKES_SQL, "p1_missing": P1_MISSING_SQL,
    }
