"""References to records that do not exist.

Method: references are grouped by their null mask (which key columns are null); each mask is anti-joined to the parent on
its non-null columns only, and the declared match semantics say what a mask means.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parent_keys(parent: DataFrame, columns: list[str], retired: DataFrame | None = None, retired_columns: list[str] | None = None) -> DataFrame:
    """Distinct keys of the parent that are not retired; keys with a null are no keys.

    Everything is hashed on the key columns once: distinct, the anti-join of retired keys and the later anti-join of the
    references share that partitioning. A key redelivered very often is combined before the shuffle.
    """
    keys = parent.select(*columns).dropna().distinct()
    if retired is not None:
        gone = retired.select(*[F.col(r).alias(c) for c, r in zip(columns, retired_columns or columns)]).dropna()
        keys = keys.join(gone, columns, "left_anti")
    return keys


def orphans(child: DataFrame, columns: list[str], keys: DataFrame, key_columns: list[str], match: str = "simple", nullish: tuple = ()) -> DataFrame:
    """Rows of ``child`` whose reference leads nowhere, all columns kept, with ``null_mask`` (e.g. '01', 1 = null).

    match 'simple': a reference with any null is no reference. 'full': all null is no reference, some null is always an
    orphan. 'partial': all null is no reference; otherwise the non-null columns must agree with some key. Values listed in
    ``nullish`` (such as 0) count as null. NaN equals NaN. ``keys`` holds distinct keys without nulls. Duplicate child rows
    stay duplicates. Child columns may have any names: the join works on renamed copies. A hot key on the child side is one
    partition of an anti-join, which adaptive execution splits on that side.
    """
    if match not in ("simple", "full", "partial"):
        raise ValueError(match)
    n = len(columns)
    value = [F.col(f"`{c}`") for c in columns]
    for token in nullish:
        value = [F.when(v == F.lit(token), None).otherwise(v) for v in value]
    tagged = child.select("*", *[v.alias(f"__ref{i}") for i, v in enumerate(value)])
    tagged = tagged.withColumn("null_mask", F.concat(*[F.when(F.col(f"__ref{i}").isNull(), "1").otherwise("0") for i in range(n)]))
    parts = []
    for bits in product("01", repeat=n):
        mask = "".join(bits)
        held = [i for i in range(n) if bits[i] == "0"]
        if not held or (match == "simple" and len(held) < n):
            continue
        rows = tagged.where(F.col("null_mask") == mask)
        if len(held) == n or match == "partial":
            known = keys.select(*[F.col(f"`{key_columns[i]}`").alias(f"__key{i}") for i in held])
            if len(held) < n:
                known = known.distinct()
            on = None
            for i in held:
                same = F.col(f"__ref{i}") == F.col(f"__key{i}")
                on = same if on is None else on & same
            rows = rows.join(known, on, "left_anti")
        parts.append(rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop(*[f"__ref{i}" for i in range(n)])


def orphan_report(child: DataFrame, row_id: str, columns: list[str], loaded_at: str, keys: DataFrame, key_columns: list[str], name: str, nullish: tuple = ()) -> DataFrame:
    """ref, period (month of the first delivery, 'yyyy-MM'), n_rows, n_references, n_orphans; each ``row_id`` counts once.

    Rows without a row id or without a time are left out of no count: a null id is one row, a null time is period null.
    """
    order = F.struct(F.col(loaded_at).isNull(), F.col(loaded_at))
    once = child.groupBy(F.col(row_id).alias("row_id")).agg(
        F.min(loaded_at).alias("first_loaded"), *[F.min_by(F.col(c), order).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    refs = [f"c{i}" for i in range(len(columns))]
    lost = orphans(once, refs, keys, key_columns, "simple", nullish)
    real = [F.col(c).isNotNull() & ~F.col(c).isin(*nullish) if nullish else F.col(c).isNotNull() for c in refs]
    both = real[0]
    for r in real[1:]:
        both = both & r
    rows = once.select("first_loaded", F.lit(1).alias("row"), both.cast("int").alias("reference"), F.lit(0).alias("orphan"))
    rows = rows.unionByName(lost.select("first_loaded", F.lit(0).alias("row"), F.lit(0).alias("reference"), F.lit(1).alias("orphan")))
    return rows.groupBy(F.date_format("first_loaded", "yyyy-MM").alias("period")).agg(
        F.sum("row").alias("n_rows"), F.sum("reference").alias("n_references"), F.sum("orphan").alias("n_orphans")
    ).select(F.lit(name).alias("ref"), "period", "n_rows", "n_references", "n_orphans")
