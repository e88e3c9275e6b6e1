"""Fills, nulls and positions of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.axis import FIRST, LAST, Axis, col


def decay(n: float) -> float:
    """The weight that is left after one step: n / (n + 1) for a centre of mass n >= 1, n itself below 1."""
    return n / (n + 1) if n >= 1 else float(n)


def nth_valid(df: DataFrame, v: str, axis: Axis, n: int = 1, nonzero: bool = False, out: str = "pos") -> DataFrame:
    """One row per series: 0-based place of its n-th observation (n < 0: from the end), null if there is none.
    With `nonzero`, zeros aren't counted."""
    if not n:
        raise ValueError("n must not be 0")
    held = F.when(col(v) != 0, col(v)) if nonzero else col(v)
    x = df.select(*axis.by, *axis.order, held.alias("_v")).withColumn("_pos", F.row_number().over(axis.rows()) - 1)
    x = x.withColumn("_n", F.row_number().over(axis.valid("_v", backward=n < 0)))
    return x.groupBy(*axis.by).agg(F.min(F.when(F.col("_v").isNotNull() & (F.col("_n") == abs(n)), F.col("_pos"))).cast("long").alias(out))


def fnna(df: DataFrame, v: str, axis: Axis, n: int = 1) -> DataFrame:
    return nth_valid(df, v, axis, n)


def fnnz(df: DataFrame, v: str, axis: Axis, n: int = 1) -> DataFrame:
    return nth_valid(df, v, axis, n, nonzero=True)


def ffill(df: DataFrame, v: str, axis: Axis, n: int = 0, start_decay: float = 0.0, end_decay: float | None = None, out: str = "out") -> DataFrame:
    """Forward fill over at most n rows (0: any number); a fill decays from 1 at `start_decay` rows to 0 at `end_decay`.
    Without a limit on rows there is no decay."""
    x = with_staleness(df, v, axis, "_stale")
    held = F.last(col(v), ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0))
    return x.withColumn(out, faded(held, F.col("_stale"), n, start_decay, end_decay)).drop("_stale")


def faded(held: Column, stale: Column, n: int, start_decay: float, end_decay: float | None) -> Column:
    """A value that is filled in `stale` rows after it was seen."""
    if not n:
        return held
    held = F.when(stale <= n, held)
    if end_decay is None:
        return held
    return held * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (stale - start_decay) / F.lit(float(end_decay - start_decay))))


def bfill(df: DataFrame, v: str, axis: Axis, n: int = -1, out: str = "out") -> DataFrame:
    """Backward fill over at most n rows (-1: any number)."""
    x = with_staleness(df, v, axis, "_ahead", backward=True)
    held = F.first(col(v), ignorenulls=True).over(axis.rows().rowsBetween(0, LAST))
    return x.withColumn(out, held if n < 0 else F.when(F.col("_ahead") <= n, held)).drop("_ahead")


def with_staleness(df: DataFrame, v: str, axis: Axis, out: str = "stale", backward: bool = False, before: int = 0) -> DataFrame:
    """Rows since the last value; rows before the first count on from `before`."""
    names = df.columns
    x = df.withColumn("_place", F.row_number().over(axis.rows(backward)))
    last = F.max(F.when(col(v).isNotNull(), F.col("_place"))).over(axis.rows(backward).rowsBetween(FIRST, 0))
    return x.withColumn(out, (F.col("_place") - F.coalesce(last, F.lit(-before))).cast("long")).select(*names, out)


def ewfill(df: DataFrame, v: str, axis: Axis, fwd_n: float, bwd_n: float | None = None, target: float = 0.0, out: str = "out") -> DataFrame:
    """Fill from both sides: the mean of the previous and the next value, each decayed towards `target` by its distance."""
    f, b = decay(fwd_n), decay(fwd_n if bwd_n is None else bwd_n)
    x = with_staleness(with_staleness(df, v, axis, "_f"), v, axis, "_b", backward=True)
    before = F.last(col(v), ignorenulls=True).over(axis.rows().rowsBetween(FIRST, 0))
    after = F.first(col(v), ignorenulls=True).over(axis.rows().rowsBetween(0, LAST))

    def side(value, w, k):
        kept = F.pow(F.lit(w), k)
        return F.coalesce(value * kept + (1 - kept) * target, F.lit(float(target)))

    filled = 0.5 * side(before, f, F.col("_f")) + 0.5 * side(after, b, F.col("_b"))
    return x.withColumn(out, F.coalesce(col(v), filled)).drop("_f", "_b")


def v2na(v: str | Column, old: float = 0.0, new: float | None = None) -> Column:
    return F.when(col(v) == old, F.lit(new)).otherwise(col(v))


def na2v(v: str | Column, new: float = 0.0) -> Column:
    return F.coalesce(col(v), F.lit(new))


def init2v(v: str, axis: Axis, n: int = 0, new: float | None = None) -> Column:
    """The first n observations replaced."""
    return F.when(col(v).isNotNull() & (F.row_number().over(axis.valid(v)) <= n), F.lit(new)).otherwise(col(v))


def fnna_like(v: str, axis: Axis, target: float | Column = 1.0) -> Column:
    """`target`, null before the first observation."""
    return F.when(F.count(col(v)).over(axis.rows().rowsBetween(FIRST, 0)) > 0, target if isinstance(target, Column) else F.lit(target))
