"""Implausible readings: spikes by phase-space thresholding, stuck values by zero-difference runs, impossible ones by bounds.

Method: per source, a reading's value and its first and second differences along time are a point in phase space. A robust
ellipsoid (centre: medians; scales: 1.4826 * MAD; turned by the correlation of value and second difference) with the
semi-axes lambda = sqrt(2 ln n) holds the plausible points. A reading outside is a spike if its value is, or if it is farther
off than its neighbours; it is taken out, bridged by the readings beside it, and everything is judged again until nothing new
is flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators.sequence import rank_in_groups, with_halo
from skyframe.session import cut, small

BLOCK = 4096
SCALE = 1.4826
#: A missing or flagged reading is bridged by the nearest good ones within so many positions.
BRIDGE = 8
#: Rank error of the medians is n / ACCURACY; the sketches merge, so a source with a third of all rows is no hot task.
ACCURACY = 20000


def _median(c: Column) -> Column:
    return F.percentile_approx(c, 0.5, ACCURACY)


def _with_source(rows: DataFrame, stats: DataFrame, source: list[str]) -> DataFrame:
    """Join statistics per source (``_m0``.. and more columns) to rows; null is a source."""
    on = F.lit(True)
    for i, s in enumerate(source):
        on = on & F.col(s).eqNullSafe(F.col(f"_m{i}"))
    return rows.join(stats, on, "left").drop(*[f"_m{i}" for i in range(len(source))])


def _per_source(rows: DataFrame, source: list[str], aggregates: list[Column]) -> DataFrame:
    return small(rows.groupBy(*[F.col(s).alias(f"_m{i}") for i, s in enumerate(source)]).agg(*aggregates))


def ordered_readings(df: DataFrame, row_id: str, source: list[str], time: str, fields: list[str]) -> DataFrame:
    """Rows once each (a redelivered id counts once: the first delivery that has a time), with their rank in the source.

    NaN counts as no reading. Rows whose time is null or NaN have no place in the order: rank null.
    """
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in fields]
    loaded = F.min("loaded_at").alias("loaded_at") if "loaded_at" in df.columns else F.lit(None).cast("timestamp").alias("loaded_at")
    order = F.struct(F.col(time).isNull(), *([F.col("loaded_at")] if "loaded_at" in df.columns else []), *[F.col(f) for f in fields])
    picked = F.min_by(F.struct(*[F.col(c) for c in (*source, *fields)]), order)
    base = df.where(F.col(row_id).isNotNull()).select(row_id, *source, *clean, *([F.col("loaded_at")] if "loaded_at" in df.columns else []))
    once = base.groupBy(row_id).agg(picked.alias("_p"), loaded).select(row_id, "loaded_at", "_p.*")
    # rows without a time are ranked as a group beside each source's others, then lose their rank
    placed = rank_in_groups(once.withColumn("_none", F.col(time).isNull()), [*source, "_none"], [time, row_id])
    return placed.withColumn("rank", F.when(~F.col("_none"), F.col("rank"))).drop("_none")


def screen(rows: DataFrame, row_id: str, source: list[str], spikes_in: list[str], stuck_in: list[str], least: int = 6) -> DataFrame:
    """Ranked readings (see ordered_readings) with, per field, what is wrong with them.

    stuck_<f>: part of a run of ``least`` or more successive rows of the source with the same value; a row without a reading
    ends a run. round_<f>: the round in which the reading was flagged as a spike, else null; med_<f> and mad_<f>: median and
    median absolute deviation of all readings of the source. A source with fewer than three readings or no scatter has no
    ellipsoid. Rows without a rank are judged by their value alone.

    Each round shuffles the rows once, by blocks of a source with a few neighbours' copies; medians are partial aggregates.
    The rounds end when one flags nothing, at the latest when every reading is flagged.
    """
    state, k = rows, 0
    for f in spikes_in:
        state = state.withColumn(f"round_{f}", F.lit(None).cast("int"))
    if not spikes_in:
        return _points(state, row_id, source, [], stuck_in, least)
    raw = None
    while True:
        k += 1
        points = cut(_points(state, row_id, source, spikes_in, stuck_in if k == 1 else [], least))
        centre = _per_source(points, source, [F.lit(k).alias("_k")] + [a for f in spikes_in for a in (F.count(f"_v_{f}").alias(f"_n_{f}"), *[_median(F.when(F.col(f"_v_{f}").isNotNull(), c)).alias(f"_c{i}_{f}") for i, c in enumerate(_axes(f))])])
        moved = _with_source(points, centre, source)
        scale = _per_source(moved, source, [a for f in spikes_in for a in _scales(f)])
        if raw is None:
            raw = centre.select(*[c for c in centre.columns if c.startswith("_m")], *[F.col(f"_c0_{f}").alias(f"med_{f}") for f in spikes_in]), scale.select(*[c for c in scale.columns if c.startswith("_m")], *[F.col(f"_s0_{f}").alias(f"mad_{f}") for f in spikes_in])
        judged = _with_source(moved, scale, source)
        fresh = F.lit(False)
        for f in spikes_in:
            fresh = fresh | _outside(f)
        last = judged.where(fresh).isEmpty()
        # the round's number is data, so that all rounds run the same compiled code
        judged = judged.withColumns({f"round_{f}": F.coalesce(F.col(f"round_{f}"), F.when(_outside(f), F.col("_k"))) for f in spikes_in})
        state = judged.drop(*[c for c in judged.columns if c.startswith("_")])
        if last:
            break
    return _with_source(_with_source(state, raw[0], source), raw[1], source)


def _points(state: DataFrame, row_id: str, source: list[str], spikes_in: list[str], stuck_in: list[str], least: int) -> DataFrame:
    """Own rows with _v_<f> (a good reading), _y_<f> (bridged where it is not good), _b_<f> and _a_<f> (y before and after),
    and stuck_<f>: all in windows of one partitioning and order."""
    alone = -1 - F.pmod(F.xxhash64(row_id), F.lit(1 << 40))
    df = with_halo(state, "rank", BLOCK, max(BRIDGE + 1, least - 1), alone)
    w = Window.partitionBy(*source, "_block").orderBy("rank")
    for f in spikes_in:
        df = df.withColumn(f"_v_{f}", F.when(F.col(f"round_{f}").isNull(), F.col(f)))
    placed = F.col("rank").isNotNull()
    near = {}
    for f in spikes_in:
        near[f"_p_{f}"] = F.last(f"_v_{f}", True).over(w.rowsBetween(-BRIDGE, -1))
        near[f"_q_{f}"] = F.first(f"_v_{f}", True).over(w.rowsBetween(1, BRIDGE))
    near |= {f"_e_{f}": F.coalesce(F.lag(f).over(w) == F.col(f), F.lit(False)).cast("int") for f in stuck_in}
    df = df.withColumns(near) if near else df
    if spikes_in:
        df = df.withColumns({f"_y_{f}": F.coalesce(F.col(f"_v_{f}"), F.when(placed, F.coalesce((F.col(f"_p_{f}") + F.col(f"_q_{f}")) / 2, F.col(f"_p_{f}"), F.col(f"_q_{f}")))) for f in spikes_in})
    far = {f"_f_{f}": F.sum(f"_e_{f}").over(w.rowsBetween(2 - least, 0)) for f in stuck_in}
    for f in spikes_in:
        far |= {f"_b_{f}": F.when(placed, F.lag(f"_y_{f}").over(w)), f"_a_{f}": F.when(placed, F.lead(f"_y_{f}").over(w))}
    df = df.withColumns(far) if far else df
    if stuck_in:
        df = df.withColumns({f"stuck_{f}": placed & (F.max(f"_f_{f}").over(w.rowsBetween(0, least - 1)) >= least - 1) for f in stuck_in})
    return df.where("_own").drop("_block", "_own", *[f"_{c}_{f}" for f in {*spikes_in, *stuck_in} for c in "pqef"])


def _axes(f: str) -> list[Column]:
    """Value, first and second difference."""
    y, b, a = F.col(f"_y_{f}"), F.col(f"_b_{f}"), F.col(f"_a_{f}")
    return [y, (a - b) / 2, a - 2 * y + b]


def _scales(f: str) -> list[Column]:
    good = F.col(f"_v_{f}").isNotNull()
    off = [c - F.col(f"_c{i}_{f}") for i, c in enumerate(_axes(f))]
    slope = F.when(good & (off[0] != 0), off[2] / F.when(off[0] != 0, off[0]))
    return [*[_median(F.when(good, F.abs(o))).alias(f"_s{i}_{f}") for i, o in enumerate(off)], _median(slope).alias(f"_t_{f}")]


def _outside(f: str) -> Column:
    """Whether a good reading's point lies outside the ellipsoid, by its own value or more than its neighbours."""
    unit = [F.col(f"_s{i}_{f}") * SCALE for i in range(3)]
    s, d, t = ((c - F.col(f"_c{i}_{f}")) / F.when(unit[i] > 0, unit[i]) for i, c in enumerate(_axes(f)))
    slope = F.col(f"_t_{f}") * unit[0] / F.when(unit[2] > 0, unit[2])
    rho = F.least(F.greatest(F.coalesce(slope, F.lit(0.0)), F.lit(-0.95)), F.lit(0.95))
    turned = F.coalesce((s * s - 2 * rho * s * t + t * t) / (1 - rho * rho), s * s)
    lam2 = 2 * F.log(F.greatest(F.col(f"_n_{f}"), F.lit(3)))
    off = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"_c0_{f}")), F.lit(0.0))
    alone = (s * s > lam2) | (off(f"_y_{f}") >= F.greatest(off(f"_b_{f}"), off(f"_a_{f}")))
    return F.col(f"_v_{f}").isNotNull() & (F.col(f"_n_{f}") >= 3) & (turned + F.coalesce(d * d, F.lit(0.0)) > lam2) & alone


def stuck_runs(rows: DataFrame, source: list[str], field: str, row_id: str, least: int = 6) -> DataFrame:
    """Ids of readings in a run of ``least`` or more successive rows of the source with the same value.

    A row without a reading stands between its neighbours and ends a run.
    """
    return screen(rows, row_id, source, [], [field], least).where(f"stuck_{field}").select(row_id)


def phase_space(rows: DataFrame, source: list[str], field: str, row_id: str) -> DataFrame:
    """Spikes of one field: row_id, value, med, mad, round (1 = flagged first)."""
    found = screen(rows, row_id, source, [field], []).where(F.col(f"round_{field}").isNotNull())
    return found.select(row_id, F.col(field).alias("value"), F.col(f"med_{field}").alias("med"), F.col(f"mad_{field}").alias("mad"), F.col(f"round_{field}").alias("round"))
