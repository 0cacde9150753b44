"""Per-key results where a few keys hold most rows.

Method: value-frequency compression. Rows are first grouped by key AND value, which spreads a hot key over as many groups
as it has values and shrinks it before the shuffle; what is asked per key then comes from the weighted values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.session import cut, small


def value_frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, freq. A null key or value is a key or value of its own."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("freq"))


def weighted_summary(freqs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n_rows, n_values, n_distinct, mode, mode_freq from weighted values.

    n_rows counts all rows, n_values those with a value; n_distinct and mode leave nulls out; of equally frequent values
    the smallest is the mode. All are partial aggregates, so a hot key is combined before its shuffle.
    """
    order = F.struct(F.col(value).isNull(), -F.col("freq"), F.col(value))
    return freqs.groupBy(*keys).agg(
        F.sum("freq").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("freq"))), F.lit(0)).alias("n_values"),
        F.count(value).alias("n_distinct"),
        F.min_by(value, order).alias("mode"),
        F.max(F.when(F.col(value).isNotNull(), F.col("freq"))).alias("mode_freq"),
    )


def weighted_percentiles(freqs: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 4096, rounds: int = 2) -> DataFrame:
    """Exact percentiles per key: keys, prob, percentile (the value at rank ceil(prob * n), at least 1).

    Null and NaN values take no part; a key without other values has no rows. Each round splits the range that still holds
    the wanted rank into ``bins`` parts and counts weights per part, so no task ever sorts all values of a hot key; only
    the values of the last part are sorted. The keys must be free of nulls.
    """
    v = freqs.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"), "freq")
    v = cut(v.groupBy(*keys, "_v").agg(F.sum("freq").alias("freq")))
    totals = v.groupBy(*keys).agg(F.sum("freq").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    want = totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    # _left: rank still to go inside the open range
    want = want.withColumn("_left", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("_n")))).drop("_n")
    spot = [*keys, "prob"]
    # one row per key and probability: sent to all tasks while they are few, so that a hot key's values are not shuffled
    rows = v.join(small(want), keys)
    for _ in range(rounds):
        share = (F.col("_v") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
        binned = rows.withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
        counts = binned.groupBy(*spot, "_bin").agg(F.sum("freq").alias("_w"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"), F.first("_left").alias("_need"))
        upto = F.sum("_w").over(Window.partitionBy(*spot).orderBy("_bin"))
        hit = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_w") < F.col("_need")))
        hit = hit.select(*spot, "_bin", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), (F.col("_need") - F.col("_upto") + F.col("_w")).alias("_left"))
        rows = binned.select(*spot, "_v", "freq", "_bin").join(small(hit), [*spot, "_bin"]).drop("_bin")
    upto = F.sum("freq").over(Window.partitionBy(*spot).orderBy("_v"))
    return rows.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("freq") < F.col("_left"))).select(*spot, F.col("_v").alias("percentile"))


def dominant_keys(freqs: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The keys with at least ``share`` of all rows: keys, n_rows, n_distinct, share.

    Rows with a null key count towards the total, but no key with a null is returned; empty input gives no rows. The total
    is a scalar subquery over the same frequencies, so no task sees all keys.
    """
    value = [c for c in freqs.columns if c not in (*keys, "freq")][0]
    per_key = weighted_summary(freqs, keys, value).select(*keys, "n_rows", "n_distinct")
    total = freqs.agg(F.sum("freq")).scalar()
    out = per_key.withColumn("share", F.col("n_rows") / total).where(F.col("share") >= share)
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out
