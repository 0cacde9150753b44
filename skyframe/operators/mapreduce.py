"""Chains of user kernels over query rows: map per cell block, then reduce by key any number of times."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions import sky

PAIR = "k binary, v binary"


def _call(kernel) -> tuple[Callable, tuple]:
    return (kernel[0], tuple(kernel[1:])) if isinstance(kernel, tuple) else (kernel, ())


def _packed(results: Iterator, last: bool, size: int = 5000) -> Iterator[pd.DataFrame]:
    keys, values = [], []
    for r in results:
        key, value = (None, r) if last else r
        keys.append(pickle.dumps(key, 4))
        values.append(pickle.dumps(value, 4))
        if len(keys) == size:
            yield pd.DataFrame({"k": keys, "v": values})
            keys, values = [], []
    if keys:
        yield pd.DataFrame({"k": keys, "v": values})


def pairs(df: DataFrame, mapper, last: bool = False, group_by_static_cell: bool = False) -> DataFrame:
    """Rows with _CELLID → pickled (k, v)."""
    f, more = _call(mapper)
    if group_by_static_cell:

        def whole(_key, rows: pd.DataFrame) -> pd.DataFrame:
            slice_ = (rows["_CELLID"].to_numpy("int64") >> 32) & 0xFFF
            rows = rows.iloc[np.where(slice_ > 0, slice_, 1 << 12).argsort(kind="stable")].reset_index(drop=True)
            rows.attrs["cell_id"] = int(_key[0])
            out = list(_packed(f(rows, *more), last, 1 << 60))
            return out[0] if out else pd.DataFrame({"k": pd.Series(dtype=object), "v": pd.Series(dtype=object)})

        return df.groupBy(sky.static_cell(F.col("_CELLID")).alias("_static")).applyInPandas(whole, PAIR)

    def results(blocks: Iterator[pd.DataFrame]) -> Iterator:
        for block in blocks:
            for cell, rows in block.groupby("_CELLID", sort=False, dropna=False):
                rows = rows.reset_index(drop=True)
                rows.attrs["cell_id"] = int(cell) if cell == cell else None
                yield from f(rows, *more)

    return df.mapInPandas(lambda blocks: _packed(results(blocks), last), PAIR)


def reduce_by_key(packed: DataFrame, reducer, last: bool = False, combiner=None) -> DataFrame:
    """Group by pickled key; the values of a key stream past the reducer and are never all in memory.

    ``combiner``: a kernel like the reducer whose result for some values of a key can stand for them. It runs within each
    partition before the shuffle, so a key with most of the values reaches the reducer as one value a partition. Without
    one, a key's values all go to one task, as a reducer may ask for.
    """
    f, more = _call(reducer)
    if combiner is not None:
        c, extra = _call(combiner)

        def combined(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = ((bytes(k), v) for b in blocks for k, v in zip(b["k"], b["v"]))
            for key, group in groupby(rows, key=lambda r: r[0]):
                yield from _packed(c(pickle.loads(key), (pickle.loads(v) for _, v in group), *extra), False)

        packed = packed.sortWithinPartitions("k").mapInPandas(combined, PAIR)

    def results(blocks: Iterator[pd.DataFrame]) -> Iterator:
        rows = ((bytes(k), v) for b in blocks for k, v in zip(b["k"], b["v"]))
        for key, group in groupby(rows, key=lambda r: r[0]):
            yield from f(pickle.loads(key), (pickle.loads(v) for _, v in group), *more)
            for _ in group:  # values the reducer left
                pass

    return packed.repartition("k").sortWithinPartitions("k").mapInPandas(lambda b: _packed(results(b), last), PAIR)


def unpacked(packed: DataFrame, schema: str) -> DataFrame:
    """Results as typed columns: each value (of the last kernel), or key with value, is a tuple of the schema's fields."""
    names = [f.name for f in packed.sparkSession.createDataFrame([], schema).schema.fields]

    def rows(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks:
            found = []
            for k, v in zip(b["k"], b["v"]):
                key, value = pickle.loads(bytes(k)), pickle.loads(bytes(v))
                parts = (() if key is None else key if isinstance(key, tuple) else (key,)) + (value if isinstance(value, tuple) else (value,))
                found.append(parts)
            yield pd.DataFrame(found, columns=names)

    return packed.mapInPandas(rows, schema)


def chain(df: DataFrame, kernels: list, group_by_static_cell: bool = False) -> Iterator:
    """Yield the results of the last kernel. Pickles are the program's own, made in this job."""
    if not kernels:
        raise ValueError("a kernel is needed")
    out = pairs(df, kernels[0], len(kernels) == 1, group_by_static_cell)
    for i, kernel in enumerate(kernels[1:], 1):
        out = reduce_by_key(out, kernel, i == len(kernels) - 1)
    for row in out.toLocalIterator():
        yield pickle.loads(bytes(row["v"]))
