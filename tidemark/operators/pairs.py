"""Exponentially weighted statistics of pairs of series: correlation, covariance, regression.

A panel is long: (by..., time, series, value). Each pair is made of the rows where both have a value, and differences run
over those rows only. The join on time is keyed, each pair once; moments are window sums partitioned by pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.axis import FIRST, Axis, col
from tidemark.functions.fills import decay, init2v
from tidemark.operators.ewm import RANGE, _gates, ewma, ewmstd, final_state, moments, variance
from tidemark.operators.states import last_rows, resumed


def pairs(panel: DataFrame, time: str, name: str, value: str, by: list[str] | None = None, other: DataFrame | None = None, diagonal: bool = False) -> DataFrame:
    """(by, time, i, j, x, y) of every pair i < j (i <= j with `diagonal`) of one panel, or of every i with every j of
    `other`, where both have a value."""
    by = by or []
    a = panel.where(col(value).isNotNull()).select(*by, time, F.col(name).alias("i"), F.col(value).alias("x"))
    b = (panel if other is None else other).where(col(value).isNotNull()).select(*by, time, F.col(name).alias("j"), F.col(value).alias("y"))
    both = a.join(b, [*by, time])
    return both if other is not None else both.where("i <= j" if diagonal else "i < j")


def levels(panel: DataFrame, time: str, name: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Returns cumulated; missing ones stay missing."""
    axis = Axis([*(by or []), name], time)
    return panel.withColumn(value, F.when(col(value).isNotNull(), F.sum(value).over(axis.upto(value))))


def pair_moments(rows: DataFrame, time: str, n: float, by: list[str] | None = None, overlapping: int = 1, wgt: str | None = None, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(by, time, i, j) with _m_a1, _m_a2, _m_b1, _m_b2, _m_ab, t0, w2, n0, n1 of the changes over `overlapping` common rows,
    going on from `state` where it is given."""
    axis = Axis([*(by or []), "i", "j"], time)

    def changes(x: DataFrame) -> DataFrame:
        return x.withColumn("dx", F.col("x") - F.lag("x", overlapping).over(axis.rows())).withColumn("dy", F.col("y") - F.lag("y", overlapping).over(axis.rows()))

    x = changes(rows) if state is None else resumed(state[0], rows, changes)
    dx, dy = F.col("dx"), F.col("dy")
    return moments(x, "dx", axis, n, {"_m_a1": dx, "_m_a2": dx * dx, "_m_b1": dy, "_m_b2": dy * dy, "_m_ab": dx * dy}, None, wgt, None if state is None else state[1])


def pair_state(rows: DataFrame, time: str, n: float, by: list[str] | None = None, overlapping: int = 1, wgt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What pair_moments goes on from: the last common rows of each pair, and its moments. `rows`: as pairs() gives them."""
    axis = Axis([*(by or []), "i", "j"], time)
    return last_rows(rows, axis, overlapping), final_state(pair_moments(rows, time, n, by, overlapping, wgt), axis, "dx")


def ewmx(a: DataFrame, b: DataFrame, time: str, name: str, value: str, n: float, by: list[str] | None = None, overlapping: int = 1, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(time, i, j, t0, w2, n0, n1, a1, a2, b1, b2, ab): the weighted sums that the statistics of a pair are made of."""
    x = pair_moments(pairs(a, time, name, value, by, b), time, n, by, overlapping, None, state)
    parts = ("t0", "w2", "n0", "n1"), ("a1", "a2", "b1", "b2", "ab")
    return x.select(*(by or []), "i", "j", time, *(F.col(f"_{c}").alias(c) for c in parts[0]), *(F.col(f"_m_{c}").alias(c) for c in parts[1]))


def _parts() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("_t0", "_m_a1", "_m_a2", "_m_b1", "_m_b2", "_m_ab", "_w2"))


def _correlation(bias: bool) -> Column:
    t0, a1, a2, b1, b2, ab, w2 = _parts()
    scale = F.sqrt(variance(t0, a1, a2, w2, bias)) * F.sqrt(variance(t0, b1, b2, w2, bias))
    return F.when(scale > 0, (ab / t0 - (a1 / t0) * (b1 / t0)) / scale)


def _gated(value: Column, min_sample: float | None, min_periods: int | None) -> Column:
    least, count = _gates(min_sample, min_periods, 0)
    return F.when((F.col("_n0") >= least) & (F.col("_n1") >= count), value)


def filled(result: DataFrame, panel: DataFrame, time: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Every pair at every time of the panel, with its last result."""
    by = by or []
    pairs_ = result.select(*by, "i", "j").distinct()
    times = panel.select(*by, time).distinct()
    grid = pairs_.join(times, by) if by else pairs_.crossJoin(times)  # this is the result's size; the optimizer sees which side is small
    keys = [*by, "i", "j", time]
    w = Window.partitionBy(*by, "i", "j").orderBy(time).rowsBetween(FIRST, 0)
    return grid.join(result.select(*keys, *values), keys, "left").select(*keys, *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values))


def ewmxcor(a: DataFrame, b: DataFrame, time: str, name: str, value: str, n: float, bias: bool = True, overlapping: int = 1, ffill: bool = True, min_sample: float | None = None, min_periods: int | None = None, by: list[str] | None = None, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(time, i, j, c): correlation of the changes of every series of `a` with every series of `b`."""
    m = pair_moments(pairs(a, time, name, value, by, b), time, n, by, overlapping, None, state)
    out = m.withColumn("c", _gated(_correlation(bias), min_sample, min_periods)).select(*(by or []), "i", "j", time, "c")
    return filled(out, a.unionByName(b), time, ["c"], by) if ffill else out


def ewmx_lr(a: DataFrame, b: DataFrame, time: str, name: str, value: str, n: float, bias: bool = True, ffill: bool = True, min_sample: float | None = None, min_periods: int | None = None, by: list[str] | None = None, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(time, i, j, m, c): regression of the changes of b on those of a, db = c + m da."""
    x = pair_moments(pairs(a, time, name, value, by, b), time, n, by, 1, None, state)
    t0, a1, a2, b1, _, ab, w2 = _parts()
    var = variance(t0, a1, a2, w2, bias)
    slope = F.when(var > 0, (ab / t0 - (a1 / t0) * (b1 / t0)) / var)
    x = x.withColumn("m", _gated(slope, min_sample, min_periods)).withColumn("c", b1 / t0 - F.col("m") * a1 / t0)
    out = x.select(*(by or []), "i", "j", time, "m", "c")
    return filled(out, a.unionByName(b), time, ["m", "c"], by) if ffill else out


def ewmcorrelation(panel: DataFrame, time: str, name: str, value: str, n: float, bias: bool = False, overlapping: int = 1, ffill: bool = True, min_sample: float | None = None, min_periods: int | None = None, by: list[str] | None = None, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(time, i, j, c), i < j: correlation of the changes of every pair of levels."""
    m = pair_moments(pairs(panel, time, name, value, by), time, n, by, overlapping, None, state)
    out = m.withColumn("c", _gated(_correlation(bias), min_sample, min_periods)).select(*(by or []), "i", "j", time, "c")
    return filled(out, panel, time, ["c"], by) if ffill else out


def ewmcorr(panel: DataFrame, time: str, name: str, value: str, n: float, **kwargs) -> DataFrame:
    """The same for returns."""
    return ewmcorrelation(levels(panel, time, name, value, kwargs.get("by")), time, name, value, n, **kwargs)


def ewmcovariance(panel: DataFrame, time: str, name: str, value: str, n: float, overlapping: int = 1, ffill: bool = True, min_sample: float | None = None, min_periods: int | None = None, by: list[str] | None = None, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(time, i, j, c), i <= j: covariance of the changes of every pair of levels."""
    m = pair_moments(pairs(panel, time, name, value, by, diagonal=True), time, n, by, overlapping, None, state)
    t0, a1, _, b1, _, ab, _ = _parts()
    out = m.withColumn("c", _gated(ab / t0 - (a1 / t0) * (b1 / t0), min_sample, min_periods)).select(*(by or []), "i", "j", time, "c")
    return filled(out, panel, time, ["c"], by) if ffill else out


def ewmcovar(panel: DataFrame, time: str, name: str, value: str, n: float, **kwargs) -> DataFrame:
    return ewmcovariance(levels(panel, time, name, value, kwargs.get("by")), time, name, value, n, **kwargs)


def symmetric(upper: DataFrame, value: str = "c", unit_diagonal: bool = False) -> DataFrame:
    """Both halves of pairs i < j (and i = j), with 1 on the diagonal if asked for."""
    rest = [c for c in upper.columns if c not in ("i", "j", value)]
    swapped = upper.where("i <> j").select(*rest, F.col("j").alias("i"), F.col("i").alias("j"), value)
    out = upper.select(*rest, "i", "j", value).unionByName(swapped)
    if not unit_diagonal:
        return out
    ones = out.select(*rest, "i").distinct().select(*rest, "i", F.col("i").alias("j"), F.lit(1.0).alias(value))
    return out.unionByName(ones)


def overlapping_returns(panel: DataFrame, time: str, name: str, value: str, k: int, out: str = "out") -> DataFrame:
    """Sums over the last k rows, a missing one as 0; null without an observation among them or before k rows."""
    w = Axis(name, time).rows()
    last = w.rowsBetween(-(k - 1), 0)
    return panel.withColumn(out, F.when((F.row_number().over(w) >= k) & (F.count(value).over(last) > 0), F.sum(F.coalesce(value, F.lit(0.0))).over(last)))


def ewmcorr_psd(grid: DataFrame, time: str, name: str, value: str, n: float, min_sample: float = 0.25, min_periods: int = 1, demean: bool = True, shrinkage: float = 0.0) -> DataFrame:
    """(time, i, j, c), i <= j: correlation of returns that is positive semi-definite by construction. `grid` holds every
    series at every time. S decays by the root of the weight for each of the two series that trades, so the exponent of
    a pair is half the sum of their counts and S is a window sum."""
    w = decay(n)
    axis = Axis(name, time)
    m = moments(grid, value, axis, n, {"_m1": F.col(value)})
    held = lambda c: F.last(c, ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0))
    earlier = F.lag(F.col("_m1") / F.col("_t0")).over(axis.valid(value))
    x = F.col(value) - F.coalesce(earlier, F.lit(0.0)) if demean else F.col(value)
    m = m.withColumn("_x", F.when(F.col(value).isNotNull(), x)).select(time, name, "_x", F.coalesce(held("_n1"), F.lit(0)).alias("_n"), F.coalesce(held("_n0"), F.lit(0.0)).alias("_w"))
    a = m.select(time, F.col(name).alias("i"), F.col("_x").alias("x"), F.col("_n").alias("na"), F.col("_w").alias("wa"))
    b = m.select(time, F.col(name).alias("j"), F.col("_x").alias("y"), F.col("_n").alias("nb"), F.col("_w").alias("wb"))
    block = max(1, math.floor(RANGE / -math.log(w))) if 0 < w < 1 else 1
    p = a.join(b, time).where("i <= j").withColumn("_e", (F.col("na") + F.col("nb")) / 2)
    p = p.withColumn("_block", F.floor(F.col("_e") / block)).withColumn("_at", F.col("_e") - F.col("_block") * block)
    c = F.coalesce((1 - w) * F.col("x") * F.col("y") * F.pow(F.lit(w), -F.col("_at")), F.lit(0.0))
    here = F.sum(c).over(Window.partitionBy("i", "j", "_block").orderBy(time).rowsBetween(FIRST, 0))
    before = F.sum(c).over(Window.partitionBy("i", "j").orderBy("_block").rangeBetween(-1, -1))
    s = here * F.pow(F.lit(w), F.col("_at")) + F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(w), F.col("_at") + block)
    p = p.withColumn("s", s)
    own = p.where("i = j").select(time, F.col("i").alias("k"), F.when((F.col("s") > 0) & (F.col("wa") >= min_sample) & (F.col("na") >= min_periods), F.col("s")).alias("d"))
    out = p.join(own.select(time, F.col("k").alias("i"), F.col("d").alias("di")), [time, "i"]).join(own.select(time, F.col("k").alias("j"), F.col("d").alias("dj")), [time, "j"])
    value_ = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise((1 - shrinkage) * F.col("s") / (F.sqrt("di") * F.sqrt("dj")))
    return out.select(time, "i", "j", F.when(F.col("di").isNotNull() & F.col("dj").isNotNull(), value_).alias("c"))


def ewmcombine(
    grid: DataFrame, time: str, name: str, value: str, weight: str, n: float = 128, vol_days: float | None = None, corr: float | DataFrame | None = None, by: list[str] | None = None,
) -> DataFrame:
    """(by, time, data, rho, vol, mult, normalized_mult): signals combined by weight, with the volatility that one common
    correlation rho implies, of the time before. `grid` holds every signal at every time; a signal counts from its first
    value on, its last value standing for missing ones. With `vol_days`, signals are divided by their own volatility first.

    `corr`: a centre of mass, or correlations (by, time, i, j, c) of every pair, i < j, at every time: volatility then comes
    from the whole matrix; a pair without a correlation so far has rho. Portfolios (`by`) are apart from each other; one
    portfolio's sums, one row a time, are one series."""
    by = by or []
    axis = Axis([*by, name], time)
    g = grid
    if vol_days:
        g = ewmstd(g, value, axis, vol_days, out="_own")
        g = g.withColumn("_own", F.nullif(F.last("_own", ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0)), F.lit(0.0)))
    held = F.last(value, ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0))
    g = g.withColumn("_a", held).withColumn("_w", F.when(F.col("_a").isNotNull(), F.coalesce(weight, F.lit(0.0))).otherwise(0.0))
    if vol_days:
        g = g.withColumn("_a", F.col("_a") / F.col("_own"))
    sums = g.groupBy(*by, time).agg(F.sum(F.coalesce("_a", F.lit(0.0)) * F.col("_w")).alias("data"), F.sum("_w").alias("w1"), F.sum(F.col("_w") * F.col("_w")).alias("wsq"))
    sums = sums.withColumn("wij", F.col("w1") * F.col("w1") - F.col("wsq"))
    if not by:
        sums = sums.withColumn("_all", F.lit(0))
    one = Axis(by or "_all", time)  # one row for each time
    sums = sums.withColumn("point", (F.col("data") * F.col("data") - F.col("wsq")) / F.nullif(F.when(F.abs("wij") > 1e-12, F.col("wij")), F.lit(0.0)))
    x = ewma(sums, "point", one, n, out="rho")
    var = F.col("wsq") + F.col("wij") * F.col("rho")
    if corr is not None:
        c = corr if isinstance(corr, DataFrame) else ewmcorr(grid, time, name, value, corr, by=by or None)
        w = g.select(*by, time, F.col(name), "_w")
        pair = c.join(w.withColumnsRenamed({name: "i", "_w": "_wi"}), [*by, time, "i"]).join(w.withColumnsRenamed({name: "j", "_w": "_wj"}), [*by, time, "j"])
        known = F.last("c", ignorenulls=True).over(Window.partitionBy(*by, "i", "j").orderBy(time).rowsBetween(FIRST, 0))
        pair = pair.withColumn("c", known).withColumn("_ww", 2 * F.col("_wi") * F.col("_wj"))
        cross = pair.groupBy(*by, time).agg(F.sum(F.col("c") * F.col("_ww")).alias("_cross"), F.sum(F.when(F.col("c").isNotNull(), F.col("_ww"))).alias("_covered"))
        x = x.join(cross, [*by, time], "left")
        var = F.col("wsq") + F.coalesce("_cross", F.lit(0.0)) + (F.col("wij") - F.coalesce("_covered", F.lit(0.0))) * F.col("rho")
    x = x.withColumn("_v", F.when(var > 0, var))
    x = x.withColumn("_p", F.when(F.col("_v").isNotNull(), F.lag("_v").over(one.valid("_v"))))
    x = x.withColumn("vol", F.sqrt(F.last("_p", ignorenulls=True).over(one.rows().rowsBetween(FIRST, 0))))
    return x.select(*by, time, "data", "rho", "vol", (1 / F.col("vol")).alias("mult"), (F.col("w1") / F.col("vol")).alias("normalized_mult"))


def ewmcombined(grid: DataFrame, time: str, name: str, value: str, weight: str, n: float = 128, vol_days: float | None = None, corr: float | DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, time, data): the combined signal alone."""
    return ewmcombine(grid, time, name, value, weight, n, vol_days, corr, by).select(*(by or []), time, "data")


def rms_combine(grid: DataFrame, time: str, name: str, value: str, weight: str, n: float = 1024, max_leverage: float = 5.0, by: list[str] | None = None) -> DataFrame:
    """(by, time, data, rho, vol, var, leverage, mult): signals of unit mean square combined by weight to unit mean square.

    One common correlation rho is the average, over a centre of mass of n, of each time's point estimate from the squares
    of the weighted signals, held within -1 and 1; the first 0.3 n estimates count as 0. The leverage, sum of the absolute
    weights over volatility, is capped (unless max_leverage is 0), which sets a floor to volatility. A missing signal has
    no weight."""
    by = by or []
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    ws = w * F.col(value)
    sums = grid.groupBy(*by, time).agg(F.coalesce(F.sum(ws), F.lit(0.0)).alias("ws"), F.sum(ws * ws).alias("ws2"), F.coalesce(F.sum(w * w), F.lit(0.0)).alias("w2"), F.coalesce(F.sum(F.abs(w)), F.lit(0.0)).alias("wa"))
    if not by:
        sums = sums.withColumn("_all", F.lit(0))
    one = Axis(by or "_all", time)
    sums = sums.withColumn("wij", F.col("wa") * F.col("wa") - F.col("w2"))
    sums = sums.withColumn("point", (F.col("ws2") - F.col("w2")) / F.when(F.abs("wij") > 1e-12, F.col("wij")))
    sums = sums.withColumn("point", init2v("point", one, int(0.3 * n), 0.0))
    x = ewma(sums, "point", one, n, out="rho").withColumn("rho", F.when(F.col("rho").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rho")))))
    x = x.withColumn("var", F.when(F.col("rho").isNotNull(), F.greatest(F.lit(0.0), F.col("w2") + F.col("rho") * F.col("wij")))).withColumn("vol", F.sqrt("var"))
    x = x.withColumn("leverage", F.col("wa") / F.nullif(F.col("vol"), F.lit(0.0)))
    if max_leverage > 0:
        x = x.withColumn("leverage", F.when(F.col("var").isNotNull(), F.least(F.coalesce("leverage", F.lit(float(max_leverage))), F.lit(float(max_leverage)))))
        x = x.withColumn("vol", F.col("wa") / F.nullif(F.col("leverage"), F.lit(0.0)))
    mult = 1 / F.nullif(F.col("vol"), F.lit(0.0))
    return x.select(*by, time, (F.col("ws") * mult).alias("data"), "rho", "vol", "var", "leverage", mult.alias("mult"))
