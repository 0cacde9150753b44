"""Queries of the problems on training text (p4, p7, p8, p9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import leaks, packing, privacy, quantiles
from skyframe.session import cut, small, table


# ---------------------------------------------------------------- p4
def _readings(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    """Distinct (keys, exp_id, value) of both metrics; no value: null, NaN, zero or below."""
    rows = table(spark, d, "ptf_exposure").select(*keys, "exp_id", F.explode(F.create_map(F.lit("medfwhm"), F.col("medfwhm"), F.lit("limitmag"), F.col("limitmag"))).alias("metric", "value"))
    return rows.where("value > 0 AND NOT isnan(value)").distinct()


FIELD = ["ptf_field", "fid", "metric"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    sketches = quantiles.sketch(_readings(spark, d, ["ptf_field", "fid"]), FIELD, "value")
    q = quantiles.percentiles(sketches, FIELD, [0.1, 0.5])
    hit = q.where("(metric = 'medfwhm' AND prob = 0.5 AND value > 3.0) OR (metric = 'limitmag' AND prob = 0.1 AND value < 19.0)")
    return hit.select("ptf_field", F.col("fid").cast("long").alias("fid"), F.when(F.col("metric") == "medfwhm", "medfwhm_p50").otherwise("limitmag_p10").alias("metric"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per field and filter, with the rank error each may have."""
    sketches = quantiles.sketch(_readings(spark, d, ["ptf_field", "fid"]), FIELD, "value")
    return quantiles.percentiles(sketches, FIELD, [0.1, 0.5, 0.9])


def p4_days_combined(spark: SparkSession, d: str) -> DataFrame:
    """Sketches per filter and import day, stored, then combined to sketches per filter."""
    day = F.min("mjd_import").alias("day")
    rows = _readings(spark, d, ["fid", "mjd_import"]).groupBy("fid", "exp_id", "metric", "value").agg(day)
    days = cut(quantiles.sketch(rows, ["fid", "metric", "day"], "value"))
    return quantiles.percentiles(quantiles.combine(days, ["fid", "metric"]), ["fid", "metric"], [0.05, 0.5, 0.95])


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each combined percentile is within its stated rank error, by counting the values below and up to it.

    Buffers of 64 values, so that groups of some hundred values already collapse; sketches per import day, combined.
    """
    rows = cut(_readings(spark, d, ["fid", "mjd_import"]).groupBy("fid", "exp_id", "metric", "value").agg(F.min("mjd_import").alias("day")))
    days = quantiles.sketch(rows, ["fid", "metric", "day"], "value", 64)
    q = cut(quantiles.percentiles(quantiles.combine(days, ["fid", "metric"], 64), ["fid", "metric"], [0.05, 0.5, 0.95]))
    # a result row per group and probability: as many as there are filters
    at = rows.join(small(q.select("fid", "metric", "prob", F.col("value").alias("v"), "n", "rank_error")), ["fid", "metric"])
    ranks = at.groupBy("fid", "metric", "prob", "n", "rank_error").agg(F.count_if(F.col("value") < F.col("v")).alias("below"), F.count_if(F.col("value") <= F.col("v")).alias("upto"))
    want = F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n")))
    within = (F.col("below") + 1 - F.col("rank_error") <= want) & (want <= F.col("upto") + F.col("rank_error"))
    bounded = F.col("rank_error") <= F.ceil(F.col("n") * F.greatest(F.log2(F.col("n") / 64), F.lit(1.0)) / 64)
    return ranks.select(F.col("fid").cast("long").alias("fid"), "metric", "prob", "n", within.alias("within"), bounded.alias("bounded"))


P4_RANKED = """
WITH v AS (SELECT DISTINCT ptf_field, fid, exp_id, 'medfwhm' AS metric, medfwhm AS value FROM ptf_exposure WHERE medfwhm > 0 AND NOT isnan(medfwhm)
           UNION ALL SELECT DISTINCT ptf_field, fid, exp_id, 'limitmag', limitmag FROM ptf_exposure WHERE limitmag > 0 AND NOT isnan(limitmag)),
k AS (SELECT *, row_number() OVER (PARTITION BY ptf_field, fid, metric ORDER BY value) AS k, count(*) OVER (PARTITION BY ptf_field, fid, metric) AS n FROM v)
"""
P4_FOUND_SQL = P4_RANKED + """
SELECT ptf_field, CAST(fid AS BIGINT) AS fid, CASE metric WHEN 'medfwhm' THEN 'medfwhm_p50' ELSE 'limitmag_p10' END AS metric FROM k
WHERE metric = 'medfwhm' AND k = ceil(0.5 * n) AND value > 3.0 OR metric = 'limitmag' AND k = greatest(1, ceil(0.1 * n)) AND value < 19.0
"""
P4_PERCENTILES_SQL = P4_RANKED + """
SELECT ptf_field, fid, metric, CAST(p AS DOUBLE) AS prob, CAST(value AS DOUBLE) AS value, n, CAST(0 AS BIGINT) AS rank_error FROM k, (VALUES (0.1), (0.5), (0.9)) t(p)
WHERE k = greatest(1, CAST(ceil(CAST(p AS DOUBLE) * n) AS BIGINT))
"""


P4_BOUNDS_SQL = """
WITH v AS (SELECT DISTINCT fid, exp_id, 'medfwhm' AS metric, medfwhm AS value FROM ptf_exposure WHERE medfwhm > 0 AND NOT isnan(medfwhm)
           UNION ALL SELECT DISTINCT fid, exp_id, 'limitmag', limitmag FROM ptf_exposure WHERE limitmag > 0 AND NOT isnan(limitmag))
SELECT CAST(fid AS BIGINT) AS fid, metric, CAST(p AS DOUBLE) AS prob, count(*) AS n, true AS within, true AS bounded FROM v, (VALUES (0.05), (0.5), (0.95)) t(p) GROUP BY ALL
"""


# ---------------------------------------------------------------- p7
def _packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """pack_size is a small parameter table."""
    rows = table(spark, d, "pack_size").where("capacity > 0").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 container sizes")
    return sorted((r["pack_name"], r["capacity"]) for r in rows)


#: A container takes a document per 64 tokens of room, and four fifths of the attention of one document that fills it.
P7_LIMITS = {"attention": 0.8, "tokens_per_doc": 64}


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return packing.token_counts(table(spark, d, "documents"), "text", ["doc_id"])


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each size."""
    return packing.pack(_lengths(spark, d), "doc_id", _packs(spark, d), **P7_LIMITS)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d), _packs(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed, and what breaks a rule: nothing may."""
    lengths, packs = cut(_lengths(spark, d)), _packs(spark, d)
    return packing.limits_report(packing.pack(lengths, "doc_id", packs, **P7_LIMITS), lengths, "doc_id", packs, **P7_LIMITS)


P7_CHECK_SQL = """
SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS lost_tokens, CAST(0 AS BIGINT) AS divided,
  CAST(0 AS BIGINT) AS over_tokens, CAST(0 AS BIGINT) AS over_documents, CAST(0 AS BIGINT) AS over_attention FROM pack_size WHERE capacity > 0
"""


# ---------------------------------------------------------------- p8
def _items(spark: SparkSession, d: str, most: int = 1_000_000) -> list[tuple[int, str]]:
    """The held-out items: a stated query set."""
    rows = table(spark, d, "eval_item").where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} items")
    return sorted((r["item_id"], r["passage"]) for r in rows)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leaks.leaked_passages(table(spark, d, "documents"), "doc_id", "text", _items(spark, d))
    return hits.where("words >= 13").select("doc_id", "item_id").distinct()


def p8_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Also regions with up to two altered characters in 13 words: doc_id, item_id, edits."""
    hits = leaks.leaked_passages(table(spark, d, "documents"), "doc_id", "text", _items(spark, d), edits=2)
    return hits.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


WORDS = "string_split(trim(regexp_replace(strip_accents(lower(regexp_replace(replace({}, chr(173), ''), '([^\\W_])[-‐][^\\S\\n]*\\n\\s*', '\\1', 'g'))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
P8_FOUND_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format("nfc_normalize(replace(text, 'ß', 'ss'))")} AS w FROM documents WHERE text <> ''),
e AS (SELECT item_id, {WORDS.format("nfc_normalize(replace(passage, 'ß', 'ss'))")} AS w FROM eval_item),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: hash(array_to_string(w[i:i + 12], ' ')))) AS h FROM d),
ew AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: hash(array_to_string(w[i:i + 12], ' ')))) AS h FROM e)
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (h)
"""


# ---------------------------------------------------------------- p9
def _spans(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """The lists are fixed tables of 180 and 37 rows; larger ones are refused rather than sent to every task."""
    members = table(spark, d, "parliament_member").select("given_name", "family_name", "party").limit(100_001).collect()
    given = table(spark, d, "given_name").select("name").limit(100_001).collect()
    if max(len(members), len(given)) > 100_000:
        raise ValueError("the lists of public persons and given names must be small")
    docs = table(spark, d, "documents") if docs is None else docs
    return privacy.personal_spans(docs, "doc_id", "text", [tuple(r) for r in members], [r["name"] for r in given])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "kind", "start_pos").distinct()


def _one_text(spark: SparkSession, d: str) -> DataFrame:
    """Each document once; of different texts under one id the greatest, so that spans and text belong together."""
    return table(spark, d, "documents").groupBy("doc_id").agg(F.max("text").alias("text"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders."""
    docs = _one_text(spark, d)
    return privacy.redact(docs, "doc_id", "text", _spans(spark, d, docs))


def p9_generalised(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders for what discloses eight bits or more, and names, numbers and places below that generalised."""
    docs = _one_text(spark, d)
    return privacy.redact(docs, "doc_id", "text", _spans(spark, d, docs), remove=8.0)


def queries() -> dict:
    return {
        "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p4_days_combined": p4_days_combined, "p4_bounds": p4_bounds,
        "p7_packing": p7_packing, "p7_fill": p7_fill, "p7_check": p7_check,
        "p8_found": p8_found, "p8_fuzzy": p8_fuzzy,
        "p9_found": p9_found, "p9_redacted": p9_redacted, "p9_generalised": p9_generalised,
    }


def sql() -> dict:
    return {"p4_found": P4_FOUND_SQL, "p4_percentiles": P4_PERCENTILES_SQL, "p4_bounds": P4_BOUNDS_SQL, "p7_check": P7_CHECK_SQL, "p8_found": P8_FOUND_SQL}
