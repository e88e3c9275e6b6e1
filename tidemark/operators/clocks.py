"""Differences, ratios and rolling statistics on a clock: the last observation of each earlier tick, and the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.axis import Axis, col, where_valid
from tidemark.functions.windows import corrected_skew
from tidemark.operators.ewm import with_ticks


def _over_ticks(df: DataFrame, v: str, axis: Axis, clock: str, make, out: str) -> DataFrame:
    """make(over), where over(aggregate, value, first, last) is an aggregate of the last values of ticks `first` to `last`
    back from the current one."""
    names = [c for c in df.columns if c != out]
    x = with_ticks(df, v, axis, clock)
    w = Window.partitionBy(*axis.by, col(v).isNull()).orderBy("_seq")

    def over(aggregate, value: Column, first: int, last: int) -> Column:
        return aggregate(F.when(F.col("_last"), value)).over(w.rangeBetween(-first, -last))

    return x.withColumn(out, where_valid(v, make(over))).select(*names, out)


def diff(df: DataFrame, v: str, axis: Axis, clock: str, n: int = 1, out: str = "out") -> DataFrame:
    return _over_ticks(df, v, axis, clock, lambda over: col(v) - over(F.max, col(v), n, n), out)


def ratio(df: DataFrame, v: str, axis: Axis, clock: str, n: int = 1, out: str = "out") -> DataFrame:
    return _over_ticks(df, v, axis, clock, lambda over: col(v) / F.nullif(over(F.max, col(v), n, n), F.lit(0.0)), out)


def _sum(over, value: Column, n: int) -> Column:
    return (F.coalesce(over(F.sum, value, n - 1, 1), F.lit(0.0)) if n > 1 else F.lit(0.0)) + value


def _enough(n: int, value: Column) -> Column:
    return F.when(F.col("_seq") >= n, value)


def rolling_sum(df: DataFrame, v: str, axis: Axis, n: int, clock: str, out: str = "out") -> DataFrame:
    return _over_ticks(df, v, axis, clock, lambda over: _enough(n, _sum(over, col(v), n)), out)


def rolling_mean(df: DataFrame, v: str, axis: Axis, n: int, clock: str, out: str = "out") -> DataFrame:
    return _over_ticks(df, v, axis, clock, lambda over: _enough(n, _sum(over, col(v), n) / n), out)


def rolling_rms(df: DataFrame, v: str, axis: Axis, n: int, clock: str, out: str = "out") -> DataFrame:
    return _over_ticks(df, v, axis, clock, lambda over: _enough(n, F.sqrt(_sum(over, col(v) * col(v), n) / n)), out)


def rolling_std(df: DataFrame, v: str, axis: Axis, n: int, clock: str, out: str = "out") -> DataFrame:
    def make(over):
        s, q = _sum(over, col(v), n), _sum(over, col(v) * col(v), n)
        return F.when((F.col("_seq") >= n) & F.lit(n > 1), F.sqrt(F.greatest(F.lit(0.0), q / max(1, n - 1) - s * s / (max(1, n - 1) * n))))

    return _over_ticks(df, v, axis, clock, make, out)


def rolling_skew(df: DataFrame, v: str, axis: Axis, n: int, clock: str, bias: bool = False, out: str = "out") -> DataFrame:
    def make(over):
        m1, m2, m3 = (_sum(over, F.pow(col(v), F.lit(k)), n) / n for k in (1, 2, 3))
        var = m2 - m1 * m1
        skew = (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / F.pow(var, F.lit(1.5))
        return _enough(n, F.when(var > 0, corrected_skew(skew, F.lit(n), bias)))

    return _over_ticks(df, v, axis, clock, make, out)
