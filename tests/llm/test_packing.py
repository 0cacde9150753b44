"""Packing: every token once, no container over any capacity, little room left."""

import numpy as np
import pandas as pd
import pytest

from skyframe.llm import packing

PACKS = [("short", 64), ("long", 700)]


def packed(spark, n, **options):
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(n)), "n_tokens": n, "size": "clash"}))
    return packing.pack(df, "id", PACKS, **options).toPandas()


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("shard", [50, 8192])
def test_whole_and_within_capacity(spark, rule, shard):
    n = np.random.default_rng(1).integers(0, 200, 600)
    n[:4] = [0, 64, 128, 2000]
    out = packed(spark, n, rule=rule, shard_items=shard, max_docs=20, attention=0.8)
    for name, capacity in PACKS:
        own = out[out["pack_name"] == name]
        assert (own.groupby("doc_id")["n_tokens"].sum().reindex(range(600)).to_numpy() == n).all()
        per = own.groupby("container")
        assert per["n_tokens"].sum().max() <= capacity
        many = per.filter(lambda g: (g["n_tokens"] > 0).sum() > 1)
        assert many.groupby("container").size().max() <= 20
        assert (many["n_tokens"] ** 2).groupby(many["container"]).sum().max() <= 0.8 * capacity**2
        split = own.groupby("doc_id").size()
        assert (split[n <= capacity] == 1).all()
        assert (split[n > capacity] == -(-n[n > capacity] // capacity)).all()
        parts = own.sort_values(["doc_id", "part"])
        assert (parts.groupby("doc_id")["n_tokens"].cumsum() - parts["n_tokens"] == parts["first_token"]).all()


def test_little_room_left(spark):
    n = np.random.default_rng(2).integers(1, 60, 6000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(6000), "n_tokens": n}))
    report = {r["pack_name"]: r for r in packing.fill_report(packing.pack(df, "id", PACKS, max_docs=1000), PACKS).collect()}
    assert report["short"]["fill"] > 0.99 and report["long"]["fill"] > 0.99


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 3), (2, None)], "id long, n_tokens long")
    out = packing.pack(df, "id", PACKS).toPandas()
    assert len(out) == 8 and out["n_tokens"].sum() == 26
    assert packing.pack(df.limit(0), "id", PACKS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", [("none", 0)])


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "the paper do lie upon the table"), (2, ""), (3, None), (4, "wort " * 30_000)], "id long, text string")
    got = {r["id"]: r["n_tokens"] for r in packing.token_counts(df, "text", ["id"]).collect()}
    assert got[1] == 7 and got[2] == 0 and got[3] == 0 and got[4] >= 30_000


def test_three_limits_decide(spark):
    """Limits that bind give another packing than tokens alone, and none is broken."""
    n = np.random.default_rng(5).integers(1, 400, 900)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(900), "n_tokens": n}))
    packs = [("one", 512)]
    bound = {"attention": 0.5, "max_docs": 4}
    scalar, vector = (packing.pack(df, "id", packs, **o).toPandas() for o in ({"attention": 1e9, "max_docs": 10**6}, bound))
    broken = {k: v for r in packing.limits_report(packing.pack(df, "id", packs, attention=1e9, max_docs=10**6), df, "id", packs, **bound).collect() for k, v in r.asDict().items()}
    assert broken["over_documents"] > 0 and broken["over_attention"] > 0 and broken["over_tokens"] == 0
    kept = {k: v for r in packing.limits_report(packing.pack(df, "id", packs, **bound), df, "id", packs, **bound).collect() for k, v in r.asDict().items()}
    assert kept == {"pack_name": "one", "documents": 900, "lost_tokens": 0, "divided": 0, "over_tokens": 0, "over_documents": 0, "over_attention": 0}
    assert vector["container"].nunique() > scalar["container"].nunique()


def test_short_items_do_not_wait(monkeypatch):
    """Under a document limit, items of mixed lengths need fewer containers than longest first does."""
    n = np.concatenate([np.random.default_rng(7).integers(20, 300, 900), np.random.default_rng(8).integers(5, 30, 900)])
    assert sorted(packing.arrival(n, 64.0)) == list(range(len(n)))
    mixed = len(set(packing.best_fit(n, 512, 8, 1e18)))
    monkeypatch.setattr(packing, "arrival", lambda size, need: np.argsort(-size, kind="stable"))
    longest = len(set(packing.best_fit(n, 512, 8, 1e18)))
    assert mixed < 0.97 * longest


def test_empty_documents_beside_a_costly_one(spark):
    df = spark.createDataFrame([(1, 500), (2, 0), (3, 0)], "id long, n_tokens long")
    packs, limits = [("one", 512)], {"attention": 0.5, "tokens_per_doc": 64}
    out = packing.pack(df, "id", packs, **limits)
    report = packing.limits_report(out, df, "id", packs, **limits).collect()[0]
    assert out.count() == 3 and report["over_attention"] == 0 and report["documents"] == 3
