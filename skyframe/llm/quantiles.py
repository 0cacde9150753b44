"""Percentiles of very large numeric columns by deterministic buffer collapsing.

Method: values fill sorted buffers of ``k`` elements, each with a weight. Two full buffers of one weight collapse into one
of twice the weight that keeps every second element of their merged order; the schedule is a binary tree, so a collapse
of weight w changes any rank by at most w and the sum of these is the error bound, which travels with the sketch.
Sketches of partitions, days or groups are combined the same way. A sketch is a set of rows: keys, weight, err, vals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 1024


class _Buffers:
    """The buffers of one group: at most one full buffer per weight, and fewer than k loose values of weight 1."""

    def __init__(self, k: int):
        self.k, self.loose, self.size, self.full, self.turn = k, [], 0, {}, {}

    def add(self, weight: int, err: float, vals: np.ndarray) -> None:
        if weight == 1:
            self.loose.append(vals)
            self.size += len(vals)
            if self.size >= self.k:
                self._spill()
        else:
            self._place(weight, err, vals)

    def _spill(self) -> None:
        every = np.concatenate(self.loose)
        whole = len(every) // self.k * self.k
        for a in range(0, whole, self.k):
            self._place(1, 0.0, np.sort(every[a : a + self.k]))
        self.loose, self.size = [every[whole:]], len(every) - whole

    def _place(self, weight: int, err: float, vals: np.ndarray) -> None:
        while weight in self.full:
            other, more = self.full.pop(weight)
            merged = np.sort(np.concatenate([other, vals]), kind="stable")
            # evenly spaced positions; the offset alternates from one collapse of a level to the next, so that errors cancel
            turn = self.turn[weight] = 1 - self.turn.get(weight, weight.bit_length() % 2)
            vals, err = merged[turn::2], err + more + weight
            weight *= 2
        self.full[weight] = (vals, err)

    def rows(self) -> Iterator[tuple[int, float, np.ndarray]]:
        if self.size:
            yield 1, 0.0, np.sort(np.concatenate(self.loose))
        for weight, (vals, err) in sorted(self.full.items()):
            yield weight, err, vals


def _kernel(keys: list[str], k: int, raw: bool):
    """Rows grouped by key within the partition → buffer rows. Only one group's buffers are in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, buffers = None, None

        def rows_of(key, held):
            return [(*key, w, e, v) for w, e, v in held.rows()]

        columns = [*keys, "weight", "err", "vals"]
        for df in batches:
            if not len(df):
                continue
            out = []
            border = np.zeros(len(df), bool)
            for c in keys:
                col, last = df[c], df[c].shift()
                border |= ~((col == last) | (col.isna() & last.isna())).to_numpy(bool)
            border[0] = True
            starts = np.flatnonzero(border)
            stops = np.r_[starts[1:], len(df)]
            heads = [tuple(None if x is pd.NA or x != x else x for x in row) for row in df[keys].iloc[starts].itertuples(index=False, name=None)]
            values = df["value"].to_numpy(float) if raw else None
            for key, a, b in zip(heads, starts, stops):
                if key != at:
                    if buffers is not None:
                        out += rows_of(at, buffers)
                    at, buffers = key, _Buffers(k)
                if raw:
                    buffers.add(1, 0.0, values[a:b])
                else:
                    for w, e, v in df[["weight", "err", "vals"]].iloc[a:b].itertuples(index=False, name=None):
                        if w == 1 or len(v):
                            buffers.add(int(w), float(e), np.asarray(v, float))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if buffers is not None:
            yield pd.DataFrame(rows_of(at, buffers), columns=columns)

    return run


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["weight long", "err double", "vals array<double>"])


def partial_sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """Sketch rows per partition and group, without a shuffle. Null and NaN values take no part; null keys are a group.

    Rows are sorted within the partition, so one group is in memory at a time.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    return rows.sortWithinPartitions(*keys).mapInPandas(_kernel(keys, k, True), _schema(df, keys))


def combine(sketches: DataFrame, keys: list[str], k: int = K, fan: int = 16) -> DataFrame:
    """Merge sketches into one per group of ``keys`` (any columns of the sketch rows).

    First in ``fan`` salted parts per group, then the parts: a hot group's many partial sketches are merged by many tasks.
    Full buffers must all have been made with the same ``k``.
    """
    rows = sketches.select(*keys, "weight", "err", "vals")
    schema = _schema(rows, keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vals", "weight"), F.lit(fan)))
    parts = salted.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt").mapInPandas(_kernel(keys, k, False), schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys, "weight").mapInPandas(_kernel(keys, k, False), schema)


def sketch(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One sketch per group."""
    return combine(partial_sketches(df, keys, value, k), keys, k)


def percentiles(sketches: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """keys, prob, value, n, rank_error: the value at rank ceil(prob * n) (at least 1), off by at most rank_error ranks.

    Groups that never filled two buffers are exact (rank_error 0). A group's window holds its sketch, at most
    k * log2(n / k) rows.
    """
    rows = sketches.select(*keys, "weight", "err", F.explode("vals").alias("value"), F.size("vals").alias("_size"))
    group = Window.partitionBy(*keys)
    w = group.orderBy("value", "weight").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select(
        *keys, "value", "weight", F.sum("weight").over(w).alias("_upto"), F.sum("weight").over(group).alias("n"),
        F.sum(F.col("err") / F.col("_size")).over(group).alias("_err"), F.max("weight").over(group).alias("_top"),
    )
    asked = placed.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n")))
    hit = asked.where((F.col("_upto") >= rank) & (F.col("_upto") - F.col("weight") < rank))
    return hit.select(*keys, "prob", "value", "n", F.ceil(F.col("_err") + F.col("_top") - 1).cast("long").alias("rank_error"))
