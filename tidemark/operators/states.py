"""Going on from saved state: what an operator gives for new rows, from the state that the old ones left, is the tail of what
it gives for all rows.

There are four kinds of state, each a table with one row, or a few, for each series:

- tail(): the last observations themselves, for operators that look back over a fixed number of them or of ticks. resumed()
  runs any operator over such rows and the new ones.
- moment_state(): counts, sums of powers, product and extremes, for expanding and whole-series statistics; states merge.
- fill_state(): the last value and the rows since.
- ewm.final_state() and sequential.fold_state(): decayed moments, and what a fold ends with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fills
from tidemark.functions.axis import FIRST, Axis, col, where_valid
from tidemark.functions.windows import corrected_skew, diff
from tidemark.operators import ewm

# --- tails ----------------------------------------------------------------------------------------------------------------


def tail(df: DataFrame, v: str, axis: Axis, n: int, clock: str | None = None) -> DataFrame:
    """The rows of the last n observations of each series; with a clock, the last observation of each of the last n ticks.
    One tick more than an operator looks back over lets new rows go on with the last one."""
    names = df.columns
    x = ewm.with_ticks(df.where(col(v).isNotNull()), v, axis, clock).where("_last")
    recent = Window.partitionBy(*axis.by).orderBy(F.desc("_seq"))
    return x.withColumn("_k", F.row_number().over(recent)).where(F.col("_k") <= n).select(*names)


def last_rows(df: DataFrame, axis: Axis, n: int) -> DataFrame:
    """The last n rows of each series, with or without a value."""
    return df.withColumn("_k", F.row_number().over(axis.rows(backward=True))).where(F.col("_k") <= n).drop("_k")


def resumed(state: DataFrame, new: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make() over the state's rows and the new ones, of the new ones. make() keeps the columns that it is given."""
    both = state.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return make(both).where("_new").drop("_new")


# --- moments --------------------------------------------------------------------------------------------------------------

MOMENTS = ("n", "s1", "s2", "s3", "product", "low", "high")


def _neutral(name: str) -> Column:
    return F.lit(None).cast("double") if name in ("low", "high") else F.lit(1.0 if name == "product" else 0.0)


def moment_state(df: DataFrame, by: list[str] | tuple, v: str, state: DataFrame | None = None) -> DataFrame:
    """(by, n, s1, s2, s3, product, low, high) of each series' observations, and those of `state` before them."""
    x = col(v)
    own = df.groupBy(*by).agg(
        F.count(x).cast("double").alias("n"), *(F.coalesce(F.sum(F.pow(x, F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in (1, 2, 3)), F.coalesce(F.product(x), F.lit(1.0)).alias("product"), F.min(x).alias("low"), F.max(x).alias("high")
    )
    if state is None:
        return own
    both = own.unionByName(state.select(*by, *MOMENTS))
    return both.groupBy(*by).agg(*(F.sum(c).alias(c) for c in MOMENTS[:4]), F.product("product").alias("product"), F.min("low").alias("low"), F.max("high").alias("high"))


def of_moments(what: str, n: Column, s1: Column, s2: Column, s3: Column, product: Column, low: Column, high: Column, bias: bool = False) -> Column:
    """A statistic by name: count, sum, mean, rms, std, skew, min, max or cumprod."""
    mean, square = s1 / n, s2 / n
    var = square - mean * mean
    if what == "skew":
        cube = s3 / n - 3 * mean * square + 2 * mean * mean * mean
        return corrected_skew(F.when(var > 1e-12 * square, cube / F.pow(var, F.lit(1.5))), n, bias)
    out = {"count": n, "sum": s1, "mean": mean, "rms": F.sqrt(square), "std": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), var) * n / (n - 1))), "min": low, "max": high, "cumprod": product}[what]
    return out if what in ("count", "sum") else F.when(n > 0, out)


def from_moments(state: DataFrame, by: list[str] | tuple, what: str, bias: bool = False, out: str = "out") -> DataFrame:
    """(by, out): a whole-series statistic, ts_*, from its state."""
    return state.select(*by, of_moments(what, *(F.col(c) for c in MOMENTS), bias=bias).alias(out))


def expanding_resumed(new: DataFrame, state: DataFrame, v: str, axis: Axis, what: str, bias: bool = False, out: str = "out") -> DataFrame:
    """An expanding statistic (or cumprod) of new rows, after those that the state is of."""
    names = [c for c in new.columns if c != out]
    x = new.join(state.select(*axis.by, *(F.col(c).alias(f"_s_{c}") for c in MOMENTS)), list(axis.by), "left")
    w = axis.upto(v)
    before = {c: F.coalesce(F.col(f"_s_{c}"), _neutral(c)) for c in MOMENTS}
    parts = [
        before["n"] + F.count(col(v)).over(w), *(before[f"s{k}"] + F.sum(F.pow(col(v), F.lit(k))).over(w) for k in (1, 2, 3)), before["product"] * F.product(col(v)).over(w), F.least(before["low"], F.min(col(v)).over(w)), F.greatest(before["high"], F.max(col(v)).over(w))
    ]
    x = x.withColumns({f"_{c}": p for c, p in zip(MOMENTS, parts)})
    value = of_moments(what, *(F.col(f"_{c}") for c in MOMENTS), bias=bias)
    least = 3 if what == "skew" else 1
    return x.withColumn(out, where_valid(v, F.when(F.col("_n") >= least, value))).select(*names, out)


PAIR = ("n", "sa", "sb", "saa", "sbb", "sab")


def pair_state(df: DataFrame, by: list[str] | tuple, a: str, b: str, state: DataFrame | None = None) -> DataFrame:
    """Sums over the rows that have both, for ts_cor; states merge."""
    x = df.where(col(a).isNotNull() & col(b).isNotNull())
    own = x.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(col(a) * col(a)).alias("saa"), F.sum(col(b) * col(b)).alias("sbb"), F.sum(col(a) * col(b)).alias("sab"))
    return own if state is None else own.unionByName(state.select(*by, *PAIR)).groupBy(*by).agg(*(F.sum(c).alias(c) for c in PAIR))


def cor_from_state(state: DataFrame, by: list[str] | tuple, min_sample: int = 3, out: str = "out") -> DataFrame:
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in PAIR)
    va, vb = saa / n - (sa / n) * (sa / n), sbb / n - (sb / n) * (sb / n)
    return state.select(*by, F.when((n > min_sample) & (va > 0) & (vb > 0), (sab / n - (sa / n) * (sb / n)) / F.sqrt(va * vb)).alias(out))


# --- fills ----------------------------------------------------------------------------------------------------------------


def fill_state(df: DataFrame, v: str, axis: Axis, state: DataFrame | None = None) -> DataFrame:
    """(by, prev, gap): the last value and the rows since it (since the first row, where there is no value)."""
    x = staleness(df, state, v, axis, "_gap") if state is not None else fills.with_staleness(df, v, axis, "_gap")
    held = F.last(col(v), ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0))
    if state is not None:
        x = x.join(state.select(*axis.by, F.col("prev").alias("_prev")), list(axis.by), "left")
        held = F.coalesce(held, F.col("_prev"))
    x = x.withColumn("_held", held)
    return x.groupBy(*axis.by).agg(F.max_by(F.struct(F.col("_held").alias("prev"), F.col("_gap").alias("gap")), F.struct(*axis.order)).alias("s")).select(*axis.by, "s.*")


def _given(new: DataFrame, state: DataFrame, v: str, axis: Axis) -> DataFrame:
    """_seen: whether the new rows have had a value; _gap: rows since the last value, old or new; _prev: the state's."""
    x = fills.with_staleness(new, v, axis, "_gap").join(state.select(*axis.by, F.col("prev").alias("_prev"), F.col("gap").alias("_before")), list(axis.by), "left")
    x = x.withColumn("_seen", F.count(col(v)).over(axis.rows().rowsBetween(FIRST, 0)) > 0)
    return x.withColumn("_gap", F.when(F.col("_seen"), F.col("_gap")).otherwise(F.col("_gap") + F.coalesce("_before", F.lit(0))))


def staleness(new: DataFrame, state: DataFrame, v: str, axis: Axis, out: str = "stale") -> DataFrame:
    return _given(new, state, v, axis).withColumn(out, F.col("_gap").cast("long")).select(*[c for c in new.columns if c != out], out)


def ffill(new: DataFrame, state: DataFrame, v: str, axis: Axis, n: int = 0, start_decay: float = 0.0, end_decay: float | None = None, out: str = "out") -> DataFrame:
    x = _given(new, state, v, axis)
    held = F.coalesce(F.last(col(v), ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0)), F.col("_prev"))
    return x.withColumn(out, fills.faded(held, F.col("_gap"), n, start_decay, end_decay)).select(*[c for c in new.columns if c != out], out)


# --- volatility of changes and crossovers ----------------------------------------------------------------------------------


def _change(rows: DataFrame, v: str, axis: Axis) -> DataFrame:
    return rows.withColumn("_change", diff(v, axis))


def ewmvol_state(df: DataFrame, v: str, axis: Axis, n: float) -> tuple[DataFrame, DataFrame]:
    """(the last observation, the moments of the changes)."""
    x = _change(df, v, axis)
    return tail(df, v, axis, 1), ewm.final_state(ewm.moments(x, "_change", axis, n, ewm.powers("_change", 2)), axis, "_change")


def ewmvol(new: DataFrame, state: tuple[DataFrame, DataFrame], v: str, axis: Axis, n: float, rms: bool = True, out: str = "out") -> DataFrame:
    x = resumed(state[0], new, lambda d: _change(d, v, axis))
    return (ewm.ewmrms if rms else ewm.ewmstd)(x, "_change", axis, n, state=state[1], out=out).drop("_change")


def average_state(df: DataFrame, v: str, axis: Axis, n: float, clock: str | None = None, wgt: str | None = None, top: int = 3) -> DataFrame:
    """State of ewma, ewmrms, ewmvar, ewmstd and ewmskew alike."""
    return ewm.final_state(ewm.moments(df, v, axis, n, ewm.powers(v, top), clock, wgt), axis, v, clock)


def ewmacd_state(df: DataFrame, v: str, axis: Axis, fast: float, slow: float, vol: float | None = None) -> tuple:
    return average_state(df, v, axis, fast), average_state(df, v, axis, slow), None if vol is None else ewmvol_state(df, v, axis, vol)


def ewmacd(new: DataFrame, state: tuple, v: str, axis: Axis, fast: float, slow: float, vol: float | None = None, out: str = "out") -> DataFrame:
    x = ewm.ewma(new, v, axis, fast, state=state[0], out="_fast")
    x = ewm.ewma(x, v, axis, slow, state=state[1], out="_slow")
    value = (F.col("_fast") - F.col("_slow")) / F.lit(ewm.ou_factor(fast, slow))
    if vol is not None:
        x = ewmvol(x, state[2], v, axis, vol, out="_vol") if set(x.columns) == set(state[2][0].columns) else x.join(ewmvol(new, state[2], v, axis, vol, out="_vol").select(*axis.by, *axis.order, "_vol"), [*axis.by, *axis.order])
        value = value / F.nullif(F.col("_vol"), F.lit(0.0))
    return x.withColumn(out, value).select(*[c for c in new.columns if c != out], out)
