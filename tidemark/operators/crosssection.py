"""Ranks among the series of one time, bars, and correlation codes: all plain expressions."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.axis import FIRST, Axis, col
from tidemark.operators.ewm import RANGE


def xrank(panel: DataFrame, time: str, name: str, value: str, weight: str | None = None, beta: str | None = None, vol: float | None = -1.0, scale: int = 0, reweight: bool = False, out: str = "out") -> DataFrame:
    """Rank within each time in (-1, 1): the weighted sum over other series of 2 P(mine is above theirs) - 1.

    `vol` 0: P is 1 or 0 (half for equals); below 0: the weighted deviation of the values of that time; P has exponential
    tails. scale 1, 2, 3 divide by a deviation of the ranks (net of beta, plain, weighted).

    2 P - 1 is the sign of the difference times 1 - exp(-|difference| / vol), so a rank is made of running sums over the
    values of a time in order: of weights, and of weights times exp(value / vol). As in tidemark.operators.ewm, blocks keep
    these powers in range. One sort of each time's values; no pair of series is ever formed.
    """
    x = panel.withColumns({"_a": col(value), "_w": col(weight) if weight else F.lit(1.0), "_b": col(beta) if beta else F.lit(1.0)})
    x = x.withColumn("_wb", F.when(F.col("_a").isNotNull(), F.col("_w") * F.col("_b")))
    same = Window.partitionBy(time, F.col("_a").isNull())
    total, s1, s2 = (F.sum(c).over(same) for c in (F.col("_wb"), F.col("_wb") * F.col("_a"), F.col("_wb") * F.col("_a") * F.col("_a")))
    x = x.withColumn("_t", F.nullif(total, F.lit(0.0))).withColumn("_mean", s1 / F.col("_t"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), s2 / F.col("_t") - F.col("_mean") * F.col("_mean")))
    x = x.withColumn("_vol", deviation if vol is None or vol < 0 else F.lit(float(vol)))
    x = x.withColumn("_z", F.when(F.col("_vol") > 0, (F.col("_a") - F.col("_mean")) / F.col("_vol")).otherwise(F.col("_a")))
    soft = F.col("_vol") > 0

    def side(sign: int):
        """Sum of weights below (sign 1) or above, each times 1 - exp(-distance); equals cancel out."""
        z = F.col("_z") if sign > 0 else -F.col("_z")
        block = F.floor(z / RANGE)
        at = z - block * RANGE
        order = F.asc("_z") if sign > 0 else F.desc("_z")
        weights = F.sum("_wb").over(same.orderBy(order).rangeBetween(FIRST, 0))
        here = F.sum(F.col("_wb") * F.exp(at)).over(Window.partitionBy(time, F.col("_a").isNull(), block).orderBy(order).rangeBetween(FIRST, 0))
        there = F.sum(F.col("_wb") * F.exp(at)).over(Window.partitionBy(time, F.col("_a").isNull()).orderBy(block).rangeBetween(-1, -1))
        return weights, here * F.exp(-at) + F.coalesce(there, F.lit(0.0)) * F.exp(-at - RANGE)

    (below, near_below), (above, near_above) = side(1), side(-1)
    x = x.withColumns({"_below": below, "_above": above, "_near_below": near_below, "_near_above": near_above})
    rank = (F.col("_below") - F.col("_above") - F.when(soft, F.col("_near_below") - F.col("_near_above")).otherwise(F.lit(0.0))) / F.col("_t")
    j = x.withColumn("_r", F.when(F.col("_a").isNotNull() & F.col("_t").isNotNull(), F.when(F.col("_w") != 0, rank).otherwise(0.0)))
    if scale:
        w = F.when(F.col("_a").isNotNull(), F.col("_w"))
        share = F.sum(w)
        s = j.groupBy(time).agg(
            share.alias("_sw"), F.sum(F.pow(w * F.col("_r"), F.lit(2)) * (1 - F.col("_b") * F.col("_b"))).alias("_s3"), F.sum(F.col("_r") * F.col("_r")).alias("_q"), F.sum("_r").alias("_p"), F.sum(w * F.col("_r") * F.col("_r")).alias("_wq")
        )
        std = {1: F.sqrt("_s3") / F.col("_sw"), 2: F.sqrt(F.col("_q") - F.col("_p") * F.col("_p")), 3: F.sqrt(F.col("_wq") / F.col("_sw"))}[scale]
        j = j.join(s, time).withColumn("_r", F.col("_r") / F.nullif(std, F.lit(0.0)))
        if reweight and scale in (1, 3):
            j = j.withColumn("_w", F.col("_w") / F.col("_sw"))
    return j.withColumn(out, F.col("_r") * F.col("_w") if reweight else F.col("_r")).select(*panel.columns, out)


# --- bars -------------------------------------------------------------------------------------------------------------


def daily_to_eod(bar: DataFrame, by: str, time: str, open_: str = "open", volume: str = "volume", day: Column | None = None) -> DataFrame:
    """Of bars that grow within a trading day, the last of each day: a day ends where the next bar's volume falls or its
    open changes. The newest bar of each series stays. Two ends on one date: the later counts."""
    axis = Axis(by, time).rows()
    ends = (F.lead(volume).over(axis) < F.col(volume)) | (F.lead(open_).over(axis) != F.col(open_)) | F.lead(time).over(axis).isNull()
    x = bar.withColumn("_end", ends).where("_end").withColumn("_day", F.to_date(time) if day is None else day)
    last = Window.partitionBy(by, "_day").orderBy(F.desc(time))
    return x.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_end", "_k").withColumnRenamed("_day", "day")


def ohlc_r2(o1: str | Column, h1: str | Column, l1: str | Column, c1: str | Column, c0: str | Column, model: str = "yz", alpha: float | None = None) -> Column:
    """Variance of one bar: cc, p, rs, gk, yz, c or o. yz falls back to gk and then cc where it is missing, and to cc
    where the high isn't above the low."""
    o1, h1, l1, c1, c0 = map(col, (o1, h1, l1, c1, c0))
    k = ((alpha or 1.34) - 1) / ((alpha or 1.34) + 1)
    o, c, cc, u, d = o1 - c0, c1 - o1, c1 - c0, h1 - o1, l1 - o1
    v = {"o": o * o, "c": c * c, "cc": cc * cc, "rs": u * (u - c) + d * (d - c), "p": (u - d) * (u - d) / (4 * math.log(2))}
    # fixed weights of the published estimators
    v["gk"] = v["o"] - 0.383 * v["c"] + 1.364 * v["p"] + 0.019 * v["rs"]
    v["yz"] = F.when(h1 - l1 <= 0, v["cc"]).otherwise(F.coalesce(v["o"] + k * v["c"] + (1 - k) * v["rs"], v["gk"], v["cc"]))
    return v[model.lower()]


def bar_r2(bar: DataFrame, axis: Axis, o: str = "open", h: str = "high", l: str = "low", c: str = "close", model: str = "yz", alpha: float | None = None, short_range: float | None = None, long_range: float | None = None, out: str = "out") -> DataFrame:  # noqa: E741
    """ohlc_r2 with the close before; with both ranges, scaled so that its average deviation is that of close to close."""
    from tidemark.functions.windows import shift
    from tidemark.operators.ewm import ewma

    names = [x for x in bar.columns if x != out]
    x = bar.withColumn("_c0", shift(c, axis)).withColumn(out, ohlc_r2(o, h, l, c, "_c0", model, alpha))
    if short_range and long_range and model.lower() != "cc":
        x = x.withColumn("_cc", ohlc_r2(o, h, l, c, "_c0", "cc"))
        for source, to in (("_cc", "_m1"), (out, "_m2")):
            x = ewma(x, source, axis, short_range, out="_s").withColumn("_s", F.sqrt("_s"))
            x = ewma(x, "_s", axis, long_range, out=to)
        x = x.withColumn(out, F.col(out) * F.pow(F.col("_m1") / F.col("_m2"), F.lit(2)))
    return x.select(*names, out)


# --- correlation codes and matrices as pairs ----------------------------------------------------------------------------

# Scale of each stored type.
CORRELATION_CODEC = {"int8": 100, "int16": 10000}


def encode_correlation(c: str | Column, dtype: str = "int8") -> Column:
    """As whole hundredths (int8) or ten-thousandths (int16), ties to even; null stays null."""
    c = col(c)
    x = F.when(c.isNotNull(), F.rint(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)) * CORRELATION_CODEC[dtype]))
    return x.cast("byte" if dtype == "int8" else "short")


def decode_correlation(x: str | Column, dtype: str = "int8") -> Column:
    return col(x).cast("double") / CORRELATION_CODEC[dtype]


def correlation_resolution(dtype: str | None = None) -> float:
    """Difference of two neighbouring stored correlations: of a code, or of a double if it isn't coded."""
    return 1 / CORRELATION_CODEC[dtype] if dtype else sys.float_info.epsilon


def quantisation_noise(dtype: str | None, m: int) -> float:
    """How far rounding may move the eigenvalues of a correlation matrix of m series: twice the spread of a random symmetric
    matrix whose entries are uniform within one step."""
    return 2 * math.sqrt(m / 12) * correlation_resolution(dtype)


def normalise_diagonal(matrix: DataFrame, time: str, value: str = "c") -> DataFrame:
    """m_ij / sqrt(m_ii m_jj); null where a diagonal entry isn't positive."""
    d = matrix.where((F.col("i") == F.col("j")) & (F.col(value) > 0))
    di, dj = (d.select(time, F.col("i").alias(k), F.col(value).alias(f"_d{k}")) for k in "ij")
    x = matrix.join(di, [time, "i"], "left").join(dj, [time, "j"], "left")
    return x.select(time, "i", "j", (F.col(value) / F.sqrt(F.col("_di") * F.col("_dj"))).alias(value))


def shrink_to_identity(matrix: DataFrame, shrinkage: float, value: str = "c") -> DataFrame:
    return matrix.withColumn(value, (1 - shrinkage) * F.col(value) + F.when(F.col("i") == F.col("j"), shrinkage).otherwise(0.0))


def quadratic_form(matrix: DataFrame, time: str, left: DataFrame, right: DataFrame | None = None, value: str = "c", weight: str = "w", power: float = 1.0, out: str = "out") -> DataFrame:
    """(time, out): left' M right to a power, vectors as (time, i, weight). Entries that are missing count as nothing;
    0 to a negative power is null."""
    l = left.select(time, F.col("i"), F.col(weight).alias("_l"))  # noqa: E741
    r = (left if right is None else right).select(time, F.col("i").alias("j"), F.col(weight).alias("_r"))
    s = matrix.join(l, [time, "i"]).join(r, [time, "j"]).groupBy(time).agg(F.sum(F.col("_l") * F.col(value) * F.col("_r")).alias(out))
    return s if power == 1.0 else s.withColumn(out, F.pow(F.nullif(F.col(out), F.lit(0.0)) if power < 0 else F.col(out), F.lit(power)))


def near_correlation_matrix(spark, rho: float, n: int) -> DataFrame:
    """rho to the distance of i and j."""
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")).withColumn("c", F.pow(F.lit(rho), F.abs(F.col("i") - F.col("j"))))


def beta_correlation_matrix(beta: DataFrame, name: str, value: str) -> DataFrame:
    """b_i b_j off the diagonal and 1 on it, for the few series of a matrix."""
    a, b = (beta.select(F.col(name).alias(k), F.col(value).alias(f"_b{k}")) for k in "ij")
    return a.crossJoin(b).select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("_bi") * F.col("_bj")).alias("c"))
