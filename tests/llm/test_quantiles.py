"""Sketches: exact for small groups, within their stated error for large ones, and combinable."""

import numpy as np
import pandas as pd
import pytest

from skyframe.llm import quantiles


def rank_gap(values, v, prob):
    """How many ranks ``v`` is from rank ceil(prob * n)."""
    s = np.sort(values)
    want = max(1, int(np.ceil(prob * len(s))))
    low, high = np.searchsorted(s, v, "left") + 1, np.searchsorted(s, v, "right")
    return 0 if low <= want <= high else min(abs(want - low), abs(want - high))


@pytest.mark.parametrize("k", [2, 16, 64])
def test_error_bound_holds(spark, k):
    rng = np.random.default_rng(k)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 20_000, p=[0.9, 0.05, 0.05]), "v": rng.lognormal(size=20_000).round(2), "weight": "clash", "rank": 1})
    df = spark.createDataFrame(pdf).repartition(9)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.percentiles(quantiles.sketch(df, ["g"], "v", k), ["g"], probs).collect()
    assert len(got) == 18
    for r in got:
        own = pdf[pdf["g"].isna()] if r["g"] is None else pdf[pdf["g"] == r["g"]]
        assert r["n"] == len(own)
        assert rank_gap(own["v"].to_numpy(), r["value"], r["prob"]) <= r["rank_error"]
        assert r["rank_error"] <= r["n"] * (np.log2(max(r["n"] / k, 1)) + 4) / (2 * k) + 1


def test_days_combine_to_groups(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(list("ab"), 6000), "day": rng.integers(0, 30, 6000), "v": rng.normal(size=6000)})
    days = quantiles.sketch(spark.createDataFrame(pdf), ["g", "day"], "v", 32)
    for r in quantiles.percentiles(quantiles.combine(days, ["g"], 32), ["g"], [0.1, 0.5]).collect():
        own = pdf[pdf["g"] == r["g"]]["v"].to_numpy()
        assert r["n"] == len(own) and rank_gap(own, r["value"], r["prob"]) <= r["rank_error"] < 0.15 * len(own)


def test_small_null_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", None)], "g string, v double")
    got = {(r["g"], r["prob"]): (r["value"], r["n"], r["rank_error"]) for r in quantiles.percentiles(quantiles.sketch(df, ["g"], "v"), ["g"], [0.5, 1.0]).collect()}
    assert got == {("a", 0.5): (1.0, 3, 0), ("a", 1.0): (3.0, 3, 0)}
    assert quantiles.percentiles(quantiles.sketch(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0
