"""Hot keys, orphan references and implausible readings against brute force, with their special cases."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from skyframe.operators import hotkeys, orphans, spikes
from skyframe.operators.sequence import rank_in_groups


def test_rank_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = {r["i"]: r["rank"] for r in rank_in_groups(df.repartition(7), ["g"], ["v", "i"]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for gg, v, i in rows if gg == g)
        assert [got[i] for _, i in own] == list(range(len(own)))
    assert rank_in_groups(df.limit(0), ["g"], ["v"]).count() == 0


def test_weighted_values(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice([None, float("nan"), *map(float, range(9))]), "x") for _ in range(3000)]
    rows += [("one", 5.0, "x"), ("none", None, "x"), ("wide", 1e300, "x"), ("wide", -1e300, "x"), ("wide", 0.1, "x")]
    df = spark.createDataFrame(rows, "k string, v double, freq string").drop("freq")
    freqs = hotkeys.value_frequencies(df, ["k"], "v")
    got = {r["k"]: r for r in hotkeys.weighted_summary(freqs, ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        every = [r[1] for r in rows if r[0] == k]
        known = Counter("nan" if v != v else v for v in every if v is not None)
        assert got[k]["n_rows"] == len(every) and got[k]["n_distinct"] == len(known) and got[k]["n_values"] == sum(known.values())
        if known:
            top = max(known.values())
            best = min((v for v, n in known.items() if n == top), key=lambda v: (v == "nan", v if v != "nan" else 0))
            assert (got[k]["mode"] == best or best == "nan") and got[k]["mode_freq"] == top
        else:
            assert got[k]["mode"] is None and got[k]["mode_freq"] is None
    for bins, rounds in ((2, 1), (4096, 2), (3, 4)):
        q = {(r["k"], r["prob"]): r["percentile"] for r in hotkeys.weighted_percentiles(freqs, ["k"], "v", [0.0, 0.1, 0.5, 1.0], bins, rounds).collect()}
        want = {}
        for k in {r[0] for r in rows}:
            s = sorted(r[1] for r in rows if r[0] == k and r[1] is not None and r[1] == r[1])
            want |= {(k, p): s[max(1, int(np.ceil(p * len(s)))) - 1] for p in (0.0, 0.1, 0.5, 1.0) if s}
        assert q == want
    empty = hotkeys.value_frequencies(df.limit(0), ["k"], "v")
    assert hotkeys.weighted_summary(empty, ["k"], "v").count() == 0 and hotkeys.dominant_keys(empty, ["k"], 0.02).count() == 0
    assert {r["k"] for r in hotkeys.dominant_keys(freqs, ["k"], 0.5).collect()} == {"hot"}


def test_orphans_by_null_mask(spark):
    child = [(i, a, b, "s") for i, (a, b) in enumerate([(1, "x"), (1, None), (None, "x"), (None, None), (9, "x"), (9, None), (None, "q"), (0, "x"), (1, "y"), (1, "y")])]
    df = spark.createDataFrame(child, "id long, a long, b string, key string")
    parent = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (1, "x")], "a long, b string")
    keys = orphans.parent_keys(parent, ["a", "b"])
    ids = lambda m, n=(): sorted(r["id"] for r in orphans.orphans(df, ["a", "b"], keys, ["a", "b"], m, n).collect())
    assert ids("simple") == [4, 7, 8, 9]
    assert ids("full") == [1, 2, 4, 5, 6, 7, 8, 9]
    assert ids("partial") == [4, 5, 6, 7, 8, 9]
    one = orphans.parent_keys(parent.select("a"), ["a"])
    assert sorted(r["id"] for r in orphans.orphans(df, ["a"], one, ["a"], nullish=(0,)).collect()) == [4, 5]
    assert orphans.orphans(df.limit(0), ["a"], one, ["a"]).count() == 0
    assert sorted(r["id"] for r in orphans.orphans(df, ["a"], one.limit(0), ["a"], nullish=(0,)).collect()) == [0, 1, 4, 5, 8, 9]
    retired = spark.createDataFrame([(1,)], "key_id long")
    assert [r["a"] for r in orphans.parent_keys(parent, ["a"], retired, ["key_id"]).collect()] == [2]
    with pytest.raises(ValueError):
        orphans.orphans(df, ["a"], one, ["a"], "other")


def plain_spikes(rows, field):
    """rows: (id, source, time, value): flags by the exact rules."""
    out = set()
    for s in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == s and r[2] is not None), key=lambda r: (r[2], r[0]))
        run = []
        for r in [*own, (None, None, None, None)]:
            if run and (r[3] is None or r[3] != run[-1][3]):
                out |= {x[0] for x in run} if len(run) >= 6 else set()
                run = []
            if r[3] is not None:
                run.append(r)
    return out


def test_stuck_runs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 8)
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.0, 0.5, 1.0])
        v = rows[-1][3] if rows and rng.random() < 0.8 else rng.choice([1.0, 2.0, 3.0, None])
        rows.append((i, rng.choice(["a", "a", None]), t if rng.random() < 0.95 else None, v))
    df = spark.createDataFrame([(i, s, t, v, "x") for i, s, t, v in rows], "exp_id long, survey string, mjd double, v double, rank string").drop("rank")
    placed = spikes.ordered_readings(df, "exp_id", ["survey"], "mjd", ["v", "mjd"])
    assert {r["exp_id"] for r in spikes.stuck_runs(placed, ["survey"], "v", "exp_id").collect()} == plain_spikes(rows, "v")


def test_phase_space_holds_every_far_spike(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 64)
    rng = np.random.default_rng(6)
    n = 600
    v = rng.normal(25, 0.1, n)
    bad = rng.choice(n, 12, replace=False)
    v[bad] += rng.choice([-1, 1], 12) * rng.uniform(1.2, 9, 12)
    pdf = pd.DataFrame({"exp_id": np.arange(n), "survey": np.where(np.arange(n) % 3, "a", "b"), "mjd": np.arange(n) * 0.1, "v": v})
    pdf.loc[5, "v"] = np.nan
    placed = spikes.ordered_readings(spark.createDataFrame(pdf), "exp_id", ["survey"], "mjd", ["v", "mjd"])
    got = {r["exp_id"]: r for r in spikes.phase_space(placed, ["survey"], "v", "exp_id").collect()}
    for s, g in pdf.dropna().groupby("survey"):
        med = g["v"].median()
        mad = (g["v"] - med).abs().median()
        far = set(g[(g["v"] - med).abs() > 8 * 1.4826 * mad]["exp_id"]) - {5}
        assert far <= set(got)
    assert len(got) < 80
    assert all(abs(got[i]["value"] - v[i]) < 1e-12 for i in got)


def test_readings_special_cases(spark):
    schema = "exp_id long, survey string, mjd double, v double, loaded_at timestamp"
    assert spikes.phase_space(spikes.ordered_readings(spark.createDataFrame([], schema), "exp_id", ["survey"], "mjd", ["v", "mjd"]), ["survey"], "v", "exp_id").count() == 0
    same = [(i, "a", float(i), 2.0, None) for i in range(10)] + [(3, "a", 3.0, 2.0, None), (99, None, None, float("nan"), None), (None, "a", 1.0, 1.0, None)]
    placed = spikes.ordered_readings(spark.createDataFrame(same, schema), "exp_id", ["survey"], "mjd", ["v", "mjd"])
    assert placed.count() == 11
    assert spikes.phase_space(placed, ["survey"], "v", "exp_id").count() == 0  # no scatter, no ellipsoid
    assert spikes.stuck_runs(placed, ["survey"], "v", "exp_id").count() == 10
