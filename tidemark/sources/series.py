"""Tables as series: missing values made one kind, panels between long and wide, alignment in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.axis import FIRST, Axis, clean, col


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def series(df: DataFrame, keys: list[str], time: str, value: str | Column, name: str = "v") -> DataFrame:
    """(keys, time, value as double with NaN as null); only these columns are read."""
    return df.select(*keys, time, clean(value).alias(name))


def wide(df: DataFrame, time: str, series_col: str, value: str, names: list) -> DataFrame:
    """One column for each named series."""
    return df.groupBy(time).pivot(series_col, names).agg(F.first(col(value), ignorenulls=True))


def long(df: DataFrame, time: str, names: list[str], series_col: str = "series", value: str = "v") -> DataFrame:
    return df.unpivot([time], names, series_col, value)


def full_panel(df: DataFrame, time: str, series_col: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Every series at every time that any series has, null where it has none: as many rows as that takes."""
    by = by or []
    times, names = df.select(*by, time).distinct(), df.select(*by, series_col).distinct()
    grid = times.join(names, by) if by else times.crossJoin(names)
    return grid.join(df.select(*by, time, series_col, value), [*by, time, series_col], "left")


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Rows of `left` with the newest values of `right` at or before their time: one union and one window, without a
    range join. A null in `right` doesn't hide an older value."""
    names = left.columns
    l = left.withColumns({f"_r_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values} | {"_side": F.lit(1)})
    r = right.select(*by, time, *(F.col(v).alias(f"_r_{v}") for v in values), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(FIRST, 0)
    filled = both.withColumns({v: F.last(f"_r_{v}", ignorenulls=True).over(w) for v in values})
    return filled.where("_side = 1").select(*names, *(v for v in values if v not in names))


def new_rows(df: DataFrame, done: DataFrame, by: list[str], time: str) -> DataFrame:
    """Rows later than the last one of their series in `done`: what an incremental run has to compute."""
    last = done.groupBy(*by).agg(F.max(time).alias("_done"))
    return df.join(last, by, "left").where(F.col("_done").isNull() | (F.col(time) > F.col("_done"))).drop("_done")


def appended(done: DataFrame, new: DataFrame, by: list[str], time: str) -> DataFrame:
    """Old results and new ones, which replace those of the same series and time."""
    kept = done.join(new.select(*by, time), [*by, time], "left_anti")
    return kept.unionByName(new)


def reindex_matrices(matrix: DataFrame, times: DataFrame, time: str, fill: float | None = None, value: str = "c") -> DataFrame:
    """(time, i, j, value) at the given times: the newest whole matrix at or before each, its missing entries left missing;
    or, with `fill`, that number where no matrix is of the very time. Matrices move whole, entries aren't mixed."""
    wanted = times.select(time).distinct()
    if fill is not None:
        entries = matrix.select("i", "j").distinct().crossJoin(wanted)
        return entries.join(matrix.select(time, "i", "j", F.coalesce(value, F.lit(float("nan"))).alias("_c")), [time, "i", "j"], "left").select(time, "i", "j", F.when(F.col("_c").isNull(), F.lit(float(fill))).otherwise(F.nullif(F.col("_c"), F.lit(float("nan")))).alias(value))
    held = matrix.select(time).distinct().withColumn("_of", F.col(time)).withColumn("_all", F.lit(0))
    placed = as_of(wanted.withColumn("_all", F.lit(0)), held, ["_all"], time, ["_of"]).where("_of is not null")  # one row a time
    return placed.select(time, "_of").join(matrix.withColumnRenamed(time, "_of"), "_of").select(time, "i", "j", value)


def resampled(df: DataFrame, by: list[str], time: str, value: str, width: str, volume: str | None = None) -> DataFrame:
    """(by, time, open, high, low, close, volume): bars of the values of each `width` ("1 hour", "1 day", ...). Without a
    volume column, the number of values."""
    bucket = F.window(time, width)["start"]
    return df.where(col(value).isNotNull()).groupBy(*by, bucket.alias(time)).agg(
        F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), (F.sum(volume) if volume else F.count(value)).alias("volume")
    )


def autocorrelated(spark: SparkSession, n_series: int, length: int, weights: list[float], seed: int = 0) -> DataFrame:
    """(series, t, v): autoregressive series for tests: the last values times `weights`, and a normal shock of unit variance."""
    from tidemark.operators.sequential import fold

    rows = spark.range(n_series * length).select(F.floor(F.col("id") / length).alias("series"), (F.col("id") % length).alias("t"), F.randn(seed).alias("_shock"))

    def step(state, shock):
        x = shock + sum(a * b for a, b in zip(weights, state))
        return [x, *state][: len(weights)], x

    return fold(rows, Axis("series", "t"), step, list, ["_shock"], "v").drop("_shock")
