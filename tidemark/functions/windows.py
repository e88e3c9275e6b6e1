"""Shifts, running and rolling statistics over observations, as columns; whole-series reductions as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.axis import FIRST, Axis, col, over_valid, positive, where_valid

# --- shift, difference, ratio, running sums ---------------------------------------------------------------------------


def shift(v: str, axis: Axis, n: int = 1) -> Column:
    """The n-th observation before (n < 0: after)."""
    x = col(v)
    return where_valid(v, x if not n else F.lag(x, n).over(axis.valid(v)) if n > 0 else F.lead(x, -n).over(axis.valid(v)))


def diff(v: str, axis: Axis, n: int = 1) -> Column:
    return col(v) - shift(v, axis, n)


def ratio(v: str, axis: Axis, n: int = 1) -> Column:
    return col(v) / F.nullif(shift(v, axis, n), F.lit(0.0))


def cumprod(v: str, axis: Axis) -> Column:
    return where_valid(v, F.product(col(v)).over(axis.upto(v)))


def expanding_sum(v: str, axis: Axis) -> Column:
    return where_valid(v, F.sum(col(v)).over(axis.upto(v)))


cumsum = expanding_sum

# --- statistics of any frame ------------------------------------------------------------------------------------------


def rms(v: Column) -> tuple[Column, ...]:
    return F.avg(v * v)


def corrected_skew(skew: Column, n: Column, bias: bool) -> Column:
    """Null without variance; unless biased, corrected for the number of observations where there are more than 2."""
    skew = F.when(~F.isnan(skew), skew)
    if bias:
        return skew
    n = n.cast("double")
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(skew)


def scaled_rank(values: Column, x: Column) -> Column:
    """Rank of x among an array of values, ties averaged, from -1 to 1; 0 where it is alone."""
    n = F.size(values)
    less = F.size(F.filter(values, lambda y: y < x))
    equal = F.size(F.filter(values, lambda y: y == x))
    return F.when(n == 1, F.lit(0.0)).otherwise(2 * (less + (equal - 1) / F.lit(2.0)) / (n - 1) - 1)


# --- expanding --------------------------------------------------------------------------------------------------------


def expanding_mean(v: str, axis: Axis) -> Column:
    return where_valid(v, F.avg(col(v)).over(axis.upto(v)))


def expanding_rms(v: str, axis: Axis) -> Column:
    return where_valid(v, F.sqrt(rms(col(v)).over(axis.upto(v))))


def expanding_std(v: str, axis: Axis) -> Column:
    return where_valid(v, F.stddev_samp(col(v)).over(axis.upto(v)))


def expanding_skew(v: str, axis: Axis, bias: bool = False) -> Column:
    w = axis.upto(v)
    return F.when(col(v).isNotNull() & (F.row_number().over(axis.valid(v)) >= 3), corrected_skew(F.skewness(col(v)).over(w), F.count(col(v)).over(w), bias))


def expanding_min(v: str, axis: Axis) -> Column:
    return where_valid(v, F.min(col(v)).over(axis.upto(v)))


def expanding_max(v: str, axis: Axis) -> Column:
    return where_valid(v, F.max(col(v)).over(axis.upto(v)))


def expanding_median(v: str, axis: Axis) -> Column:
    return where_valid(v, F.percentile(col(v), 0.5).over(axis.upto(v)))


def expanding_rank(v: str, axis: Axis) -> Column:
    return where_valid(v, scaled_rank(F.collect_list(col(v)).over(axis.upto(v)), col(v)))


# --- rolling ----------------------------------------------------------------------------------------------------------


def rolling_mean(v: str, axis: Axis, n: int) -> Column:
    return over_valid(v, axis, n, F.avg(col(v)).over(axis.last(v, positive(n))))


def rolling_sum(v: str, axis: Axis, n: int) -> Column:
    return over_valid(v, axis, n, F.sum(col(v)).over(axis.last(v, positive(n))))


def rolling_rms(v: str, axis: Axis, n: int) -> Column:
    return over_valid(v, axis, n, F.sqrt(rms(col(v)).over(axis.last(v, positive(n)))))


def rolling_std(v: str, axis: Axis, n: int) -> Column:
    return over_valid(v, axis, n, F.stddev_samp(col(v)).over(axis.last(v, positive(n))))


def rolling_skew(v: str, axis: Axis, n: int, bias: bool = False) -> Column:
    return over_valid(v, axis, n, corrected_skew(F.skewness(col(v)).over(axis.last(v, positive(n))), F.lit(n), bias))


def rolling_min(v: str, axis: Axis, n: int) -> Column:
    return over_valid(v, axis, n, F.min(col(v)).over(axis.last(v, positive(n))))


def rolling_max(v: str, axis: Axis, n: int) -> Column:
    return over_valid(v, axis, n, F.max(col(v)).over(axis.last(v, positive(n))))


def rolling_median(v: str, axis: Axis, n: int) -> Column:
    return over_valid(v, axis, n, F.percentile(col(v), 0.5).over(axis.last(v, positive(n))))


def rolling_rank(v: str, axis: Axis, n: int) -> Column:
    return over_valid(v, axis, n, scaled_rank(F.collect_list(col(v)).over(axis.last(v, positive(n))), col(v)))


def rolling_quantile(v: str, axis: Axis, n: int, quantile: float | list[float] = 0.5, min_periods: int | None = None, interpolation: str = "linear") -> Column:
    """Quantile of the last n observations, from `min_periods` (n) of them on; an array for a list of quantiles."""
    w = axis.last(v, positive(n))
    if isinstance(quantile, (list, tuple)):
        return F.array(*(rolling_quantile(v, axis, n, q, min_periods, interpolation) for q in quantile))
    if interpolation == "linear":
        out = F.percentile(col(v), quantile).over(w)
    else:
        values = F.array_sort(F.collect_list(col(v)).over(w))
        at = quantile * (F.size(values) - 1)
        low, high = (F.element_at(values, (f(at) + 1).cast("int")) for f in (F.floor, F.ceil))
        nearest = F.element_at(values, (F.rint(at) + 1).cast("int"))
        out = {"lower": low, "higher": high, "midpoint": (low + high) / 2, "nearest": nearest}[interpolation]
    return over_valid(v, axis, n if min_periods is None else min_periods, out)


def rolling_turnover(df: DataFrame, v: str, axis: Axis, n: int = 256, interval: float = 1 / 260, out: str = "out") -> DataFrame:
    """Sum of trades a year over the root of the annual mean square position. A missing position is the previous one;
    the sums reach over n - 1 rows."""
    names = df.columns
    held = F.coalesce(F.last(col(v), ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0)), F.lit(0.0))
    x = df.withColumn("_p", held)
    x = x.withColumn("_t", F.abs(F.col("_p") - F.coalesce(F.lag("_p").over(axis.rows()), F.lit(0.0))))
    w = axis.rows().rowsBetween(-(n - 2), 0)
    years = n * interval
    variance = F.sum(F.col("_p") * F.col("_p")).over(w) * interval / years
    return x.withColumn(out, F.when(variance > 0, F.sum("_t").over(w) / years / F.sqrt(variance))).select(*names, out)


# --- reductions -------------------------------------------------------------------------------------------------------


def ts_count(v: str) -> Column:
    return F.count(col(v))


def ts_sum(v: str) -> Column:
    return F.coalesce(F.sum(col(v)), F.lit(0.0))


def ts_mean(v: str) -> Column:
    return F.avg(col(v))


def ts_rms(v: str) -> Column:
    return F.sqrt(rms(col(v)))


def ts_std(v: str) -> Column:
    return F.stddev_samp(col(v))


def ts_skew(v: str, bias: bool = False) -> Column:
    return corrected_skew(F.skewness(col(v)), F.count(col(v)), bias)


def ts_min(v: str) -> Column:
    return F.min(col(v))


def ts_max(v: str) -> Column:
    return F.max(col(v))


def ts_median(v: str) -> Column:
    return F.percentile(col(v), 0.5)


def ts_cor(a: str, b: str, min_sample: int = 3) -> Column:
    """Correlation over rows that have both, null unless there are more than `min_sample`."""
    both = col(a).isNotNull() & col(b).isNotNull()
    c = F.corr(F.when(both, col(a)), F.when(both, col(b)))
    return F.when(F.count(F.when(both, 1)) > min_sample, F.when(~F.isnan(c), c))


def ts_interval(df: DataFrame, by: str, time: str, min_freq: float = 0.5, out: str = "seconds") -> DataFrame:
    """The commonest spacing of a series in seconds (the smallest of equals), or the median spacing if less than
    `min_freq` of the spacings are that; null for fewer than 2 rows."""
    axis = Axis(by, time)
    gaps = df.select(by, (F.unix_micros(time) / 1e6 - F.unix_micros(F.lag(time).over(axis.rows())) / 1e6).alias("_gap"))
    counts = gaps.groupBy(by, "_gap").agg(F.count("_gap").alias("_n"))
    mode = counts.groupBy(by).agg(F.max(F.struct(F.col("_n"), (-F.col("_gap")).alias("_g"))).alias("_m"), F.sum("_n").alias("_all"))
    middle = gaps.groupBy(by).agg(F.percentile("_gap", 0.5).alias("_median"))
    return mode.join(middle, by).select(by, F.when(F.col("_all") > 0, F.when(F.col("_m._n") >= min_freq * F.col("_all"), -F.col("_m._g")).otherwise(F.col("_median"))).alias(out))
