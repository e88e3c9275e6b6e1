"""Exponentially weighted statistics in closed form.

A moment after an observation in tick T is the sum over earlier ticks t of decay^(T - t) times what the last observation
of t contributes, plus what the observation itself contributes: within a tick the newest replaces the one before. Both
parts are window sums. Powers would overflow on long series, so ticks are cut into blocks that keep them in range; what
a block needs from before is the total of the block before it, since anything older has decayed to nothing.

Without a clock every observation is a tick. A clock is 'i' (rows), 'd', 'b', 'w', 'm', 'q', 'y' (calendar), or a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.axis import FIRST, Axis, col, where_valid
from tidemark.functions.fills import decay
from tidemark.functions.windows import diff

RANGE = 280.0  # powers of e that are kept in one block, also when squared


def calendar(time: str, clock: str) -> Column:
    """Number of the calendar tick: day, business day (weekends belong to the Friday before), week from Monday, month, quarter,
    year."""
    t = col(time)
    days = F.datediff(t, F.lit("1970-01-05"))
    if clock == "d":
        return days.cast("long")
    if clock == "b":
        return (F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))).cast("long")
    if clock == "w":
        return F.floor(days / 7).cast("long")
    if clock == "m":
        return (F.year(t) * 12 + F.month(t)).cast("long")
    if clock == "q":
        return (F.year(t) * 4 + F.quarter(t)).cast("long")
    if clock == "y":
        return F.year(t).cast("long")
    raise ValueError(f"no such calendar: {clock}")


CALENDARS = ("d", "b", "w", "m", "q", "y")


def tick_of(axis: Axis, clock: str) -> Column:
    """The tick of each row: 'i' numbers them, a calendar's letter counts its periods, any other name is a column."""
    if clock == "i":
        return F.row_number().over(axis.rows()).cast("long")
    return calendar(axis.order[0], clock) if clock in CALENDARS else col(clock)


def with_ticks(df: DataFrame, v: str, axis: Axis, clock: str | None = None) -> DataFrame:
    """Adds _tick (number), _seq (1, 2, ... of the ticks that have observations) and _last (of its tick)."""
    if clock is None:
        place = F.row_number().over(axis.valid(v))
        return df.withColumn("_tick", place.cast("long")).withColumn("_seq", F.col("_tick")).withColumn("_last", F.lit(True))
    tick = tick_of(axis, clock)
    w = Window.partitionBy(*axis.by, col(v).isNull())
    df = df.withColumn("_tick", tick)
    df = df.withColumn("_seq", F.dense_rank().over(w.orderBy("_tick")).cast("long"))
    return df.withColumn("_last", ~F.lead("_seq").over(axis.valid(v)).eqNullSafe(F.col("_seq")))


def moments(df: DataFrame, v: str, axis: Axis, n: float, terms: dict[str, Column], clock: str | None = None, wgt: str | None = None, state: DataFrame | None = None) -> DataFrame:
    """Adds a column for each term's weighted sum, t0 (of weights), w2 (of squared weights), n0 (of unit weights) and
    n1 (ticks so far), all for rows that have a value. `state`: one row per series as final_state() gives it, of the rows
    before these."""
    w = decay(n)
    block = max(1, math.floor(RANGE / -math.log(w))) if 0 < w < 1 else 1
    names = df.columns
    own = (1 - w) * (col(wgt) if wgt else F.lit(1.0))
    parts = {name: (own * x, 1) for name, x in terms.items()} | {"_t0": (own, 1), "_w2": (own * own, 2), "_n0": (F.lit(1 - w), 1)}
    x = with_ticks(df, v, axis, clock)
    x = x.withColumn("_block", F.floor(F.col("_tick") / block).cast("long")).withColumn("_at", F.col("_tick") - F.col("_block") * block)
    x = x.withColumns({f"_c_{k}": F.coalesce(c, F.lit(0.0)) for k, (c, _) in parts.items()})
    by = [*axis.by, col(v).isNull()]
    inside = Window.partitionBy(*by, "_block").orderBy("_seq").rangeBetween(FIRST, -1)
    before = Window.partitionBy(*by).orderBy("_block").rangeBetween(-1, -1)
    power = lambda e, k: F.pow(F.lit(w), e * k)
    sums = {}
    for name, (_, k) in parts.items():
        c = F.when(F.col("_last"), F.col(f"_c_{name}") * power(-F.col("_at"), k))
        here = F.coalesce(F.sum(c).over(inside), F.lit(0.0)) * power(F.col("_at"), k)
        there = F.coalesce(F.sum(c).over(before), F.lit(0.0)) * power(F.col("_at") + block, k)
        sums[name] = where_valid(v, here + there + F.col(f"_c_{name}"))
    x = x.withColumns(sums | {"_n1": where_valid(v, F.col("_seq"))})
    if state is not None:
        s = state.select(*axis.by, *(F.col(f"s_{k}") for k in parts), "s__n1", "s_tick")
        x = x.join(s, list(axis.by), "left")
        gone = F.col("_tick") if clock is None else F.col("_tick") - F.col("s_tick")
        x = x.withColumns({k: where_valid(v, F.col(k) + F.coalesce(F.col(f"s_{k}") * power(gone, p), F.lit(0.0))) for k, (_, p) in parts.items()} | {"_n1": F.col("_n1") + F.coalesce("s__n1", F.lit(0))})
        names = [c for c in names]
    return x.select(*names, *parts, "_n1")


def final_state(df: DataFrame, axis: Axis, v: str, clock: str | None = None) -> DataFrame:
    """One row per series: the moments after its last observation, as s_ columns, and its tick. With a clock, go on with
    rows of later ticks; an unfinished tick is best kept back and given again with the new rows. The clock 'i' numbers the
    rows of each run anew: give the numbers as a column to go on with them."""
    tick = F.lit(0) if clock is None else tick_of(axis, clock)
    if clock == "i":
        df = df.withColumn("_tick", tick)
        tick = F.col("_tick")
    held = [c for c in df.columns if c in ("_t0", "_w2", "_n0", "_n1") or c.startswith("_m")]
    rows = df.where(col(v).isNotNull()).groupBy(*axis.by).agg(F.max_by(F.struct(*held, tick.alias("tick")), F.struct(*axis.order)).alias("s"))
    return rows.select(*axis.by, *(F.col(f"s.{c}").alias(f"s_{c}") for c in (*held, "tick")))


def powers(v: str, top: int) -> dict[str, Column]:
    return {f"_m{k}": F.pow(col(v), F.lit(k)) if k > 1 else col(v) for k in range(1, top + 1)}


def _gates(min_sample: float | None, min_periods: int | None, default: int) -> tuple[float, int]:
    """Least weight and count of observations: a given count replaces the default weight."""
    if min_periods is not None:
        return (0.0 if min_sample is None else min_sample), min_periods
    return (0.25 if min_sample is None else min_sample), default


def _stale_zeros(df: DataFrame, v: str, axis: Axis, out: str) -> DataFrame:
    """Zeros repeat the result before them."""
    held = F.last(F.when(col(v) != 0, col(out)), ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0))
    return df.withColumn(out, where_valid(v, held))


def _finish(df: DataFrame, x: DataFrame, v: str, axis: Axis, out: str, value: Column, exc_zero: bool) -> DataFrame:
    x = x.withColumn(out, value).select(*[c for c in df.columns if c != out], out)
    return _stale_zeros(x, v, axis, out) if exc_zero else x


def _base(df: DataFrame, v: str, exc_zero: bool) -> tuple[DataFrame, str]:
    return (df.withColumn("_nz", F.nullif(col(v), F.lit(0.0))), "_nz") if exc_zero else (df, v)


def ewma(df: DataFrame, v: str, axis: Axis, n: float, clock: str | None = None, wgt: str | None = None, min_periods: int = 0, state: DataFrame | None = None, out: str = "out") -> DataFrame:
    x = moments(df, v, axis, n, powers(v, 1), clock, wgt, state)
    return _finish(df, x, v, axis, out, F.when((F.col("_t0") != 0) & (F.col("_n1") >= min_periods), F.col("_m1") / F.col("_t0")), False)


def ewmrms(df: DataFrame, v: str, axis: Axis, n: float, clock: str | None = None, wgt: str | None = None, exc_zero: bool = False, min_periods: int = 0, state: DataFrame | None = None, out: str = "out") -> DataFrame:
    d, u = _base(df, v, exc_zero)
    x = moments(d, u, axis, n, {"_m2": col(u) * col(u)}, clock, wgt, state)
    return _finish(df, x, v, axis, out, F.when((F.col("_t0") != 0) & (F.col("_n1") >= min_periods), F.sqrt(F.col("_m2") / F.col("_t0"))), exc_zero)


def variance(t0: Column, t1: Column, t2: Column, w2: Column, bias: bool) -> Column:
    """Weighted variance, null if negative by rounding; unless biased, over 1 - w2 / t0^2."""
    raw = t2 / t0 - (t1 / t0) * (t1 / t0)
    raw = F.when((t0 > 0) & (raw >= 0), raw)
    r = 1 - w2 / (t0 * t0)
    return raw if bias else F.when(r > 0, raw / r)


def ewmvar(df: DataFrame, v: str, axis: Axis, n: float, clock: str | None = None, wgt: str | None = None, bias: bool = True, exc_zero: bool = False, min_sample: float | None = None, min_periods: int | None = None, state: DataFrame | None = None, out: str = "out") -> DataFrame:
    d, u = _base(df, v, exc_zero)
    x = moments(d, u, axis, n, powers(u, 2), clock, wgt, state)
    least, count = _gates(min_sample, min_periods, 3)
    value = F.when((F.col("_n0") >= least) & (F.col("_n1") >= count), variance(F.col("_t0"), F.col("_m1"), F.col("_m2"), F.col("_w2"), bias))
    return _finish(df, x, v, axis, out, value, exc_zero)


def ewmstd(df: DataFrame, v: str, axis: Axis, n: float, *args, bias: bool = False, out: str = "out", **kwargs) -> DataFrame:
    return ewmvar(df, v, axis, n, *args, bias=bias, out=out, **kwargs).withColumn(out, F.sqrt(out))


def ewmskew(df: DataFrame, v: str, axis: Axis, n: float, clock: str | None = None, wgt: str | None = None, bias: bool = False, min_sample: float | None = None, min_periods: int | None = None, state: DataFrame | None = None, out: str = "out") -> DataFrame:
    x = moments(df, v, axis, n, powers(v, 3), clock, wgt, state)
    w = decay(n)
    d = 1 + (n if n > 1 else w / (1 - w))
    t0, m1, m2, m3 = (F.col(c) * d for c in ("_t0", "_m1", "_m2", "_m3"))
    mean, second = m1 / t0, m2 / t0 - (m1 / t0) * (m1 / t0)
    skew = (m3 / t0 - 3 * mean * m2 / t0 + 2 * mean * mean * mean) / F.pow(second, F.lit(1.5))
    if not bias:
        skew = F.when(t0 > 2, skew * F.sqrt(t0 * (t0 - 1)) / (t0 - 2)).otherwise(skew)
    least, count = _gates(min_sample, min_periods, 4)
    return _finish(df, x, v, axis, out, F.when((F.col("_n0") >= least) & (F.col("_n1") >= count) & (second > 0), skew), False)


def ewmvol(df: DataFrame, v: str, axis: Axis, n: float, clock: str | None = None, wgt: str | None = None, rms: bool = True, exc_zero: bool = False, out: str = "out") -> DataFrame:
    """Volatility of the changes of a price."""
    x = df.withColumn("_change", diff(v, axis))
    return (ewmrms if rms else ewmstd)(x, "_change", axis, n, clock, wgt, exc_zero=exc_zero, out=out).drop("_change")


def ou_factor(fast: float, slow: float) -> float:
    """Standard deviation of a difference of two averages of white noise with these centres of mass."""
    f, s = 1 - 1 / (1 + fast), 1 - 1 / (1 + slow)
    return math.sqrt(f * f / (1 - f * f) + s * s / (1 - s * s) - 2 * f * s / (1 - f * s))


def ewmacd(df: DataFrame, v: str, axis: Axis, fast: float, slow: float, vol: float | str | None = None, clock: str | None = None, wgt: str | None = None, out: str = "out") -> DataFrame:
    """Difference of two averages over its scale: `vol` is a number of days (of the changes' volatility), a column, or
    None for no division by volatility."""
    x = ewma(df, v, axis, fast, clock, wgt, out="_fast")
    x = ewma(x, v, axis, slow, clock, wgt, out="_slow")
    value = (F.col("_fast") - F.col("_slow")) / F.lit(ou_factor(fast, slow))
    if isinstance(vol, str):
        value = value / F.nullif(col(vol), F.lit(0.0))
    elif vol is not None:
        x = ewmvol(x, v, axis, vol, clock, wgt, out="_vol")
        value = value / F.nullif(F.col("_vol"), F.lit(0.0))
    return x.withColumn(out, value).select(*[c for c in df.columns if c != out], out)
