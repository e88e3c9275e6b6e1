"""Steps that need a matrix at once: eigenvalues, inverses, repairs. One matrix is one group of (time, i, j, c) rows,
worked on in numpy; its size is that of a panel squared, whatever the number of times."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.axis import Axis
from tidemark.operators.ewm import final_state, moments
from tidemark.operators.sequential import by_portfolio
from tidemark.operators.states import last_rows, resumed


def dense(rows: pd.DataFrame, value: str = "c") -> tuple[np.ndarray, list]:
    """(matrix with NaN for missing entries, names); the upper half stands for both."""
    names = sorted(set(rows["i"]) | set(rows["j"]))
    at = {k: i for i, k in enumerate(names)}
    m = np.full((len(names), len(names)), np.nan)
    i, j = rows["i"].map(at).to_numpy(), rows["j"].map(at).to_numpy()
    m[i, j] = rows[value].to_numpy(float)
    m = np.where(np.isnan(m), m.T, m)
    return m, names


def clip_eigenvalues(m: np.ndarray, least: float = 0.0) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return m if values.min() >= least else (vectors * np.maximum(values, least)) @ vectors.T


def repaired(m: np.ndarray, least: float = 1e-8, shrinkage: float = 0.0) -> np.ndarray:
    """Positive semi-definite correlation: symmetric, without markets that lack a diagonal, missing entries 0,
    eigenvalues at least `least`, unit diagonal, shrunk to the identity."""
    out = np.full(m.shape, np.nan)
    ok = np.flatnonzero(~np.isnan(np.diag(m)))
    if len(ok):
        x = m[np.ix_(ok, ok)]
        x = np.nan_to_num((x + x.T) / 2)
        x = clip_eigenvalues(x, least)
        d = np.sqrt(np.diag(x))
        x = x / np.outer(d, d)
        np.fill_diagonal(x, 1.0)
        out[np.ix_(ok, ok)] = (1 - shrinkage) * x + shrinkage * np.eye(len(ok))
    return out


def valid_part(m: np.ndarray) -> np.ndarray:
    """Without rows and columns that hold nothing on the diagonal; other missing entries 0."""
    ok = ~np.isnan(np.diag(m))
    return np.nan_to_num(m[np.ix_(ok, ok)])


def by_matrix(matrix: DataFrame, time: str, fn: Callable[[np.ndarray, list], list[tuple]], schema: str, value: str = "c") -> DataFrame:
    """Rows (time, ...) that fn gives for each time's matrix."""
    kind = matrix.schema[time].dataType.simpleString()
    columns = [s.strip().split(" ")[0] for s in schema.split(",")]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fn(*dense(rows, value)), columns=columns)
        out.insert(0, time, key[0])
        return out

    return matrix.select(time, "i", "j", value).groupBy(time).applyInPandas(run, f"{time} {kind}, {schema}")


def _entries(m: np.ndarray, names: list) -> list[tuple]:
    return [(a, b, None if np.isnan(m[i, j]) else float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]


def psd_correlation(matrix: DataFrame, time: str, least: float = 1e-8, shrinkage: float = 0.0) -> DataFrame:
    kind = matrix.schema["i"].dataType.simpleString()
    return by_matrix(matrix, time, lambda m, names: _entries(repaired(m, least, shrinkage), names), f"i {kind}, j {kind}, c double")


def min_eigenvalues(matrix: DataFrame, time: str) -> DataFrame:
    def least(m, _):
        x = valid_part(m)
        return [(float(np.linalg.eigvalsh(x).min()) if len(x) else None,)]

    return by_matrix(matrix, time, least, "out double")


def eigenvalues(matrix: DataFrame, time: str) -> DataFrame:
    """(time, k, out): eigenvalues from the largest."""
    return by_matrix(matrix, time, lambda m, _: [(k, float(x)) for k, x in enumerate(np.linalg.eigvalsh(valid_part(m))[::-1])], "k int, out double")


def eigenvectors(matrix: DataFrame, time: str) -> DataFrame:
    """(time, k, i, out): unit eigenvectors from the largest eigenvalue. The sign is such that the first entry, by name, that
    is not nearly 0 is positive."""

    def rows(m, names):
        ok = [n for n, d in zip(names, np.diag(m)) if not np.isnan(d)]
        vectors = np.linalg.eigh(valid_part(m))[1][:, ::-1]
        return [(k, n, float(x * np.sign(v[np.flatnonzero(np.abs(v) > 1e-9)[0]]))) for k, v in enumerate(vectors.T) for n, x in zip(ok, v)]

    return by_matrix(matrix, time, rows, f"k int, i {matrix.schema['i'].dataType.simpleString()}, out double")


def det(matrix: DataFrame, time: str) -> DataFrame:
    return by_matrix(matrix, time, lambda m, _: [(float(np.linalg.det(valid_part(m))),)], "out double")


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of the least |Ax - b|^2: rows with a missing b go, missing entries of A are 0."""
    ok = ~np.isnan(b)
    return np.linalg.lstsq(np.nan_to_num(a[ok]), b[ok], rcond=None)[0]


def masked(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """fn on what is left of its array without the rows and columns that hold nothing; its result, of the same shape, is put
    back where it came from."""

    def run(a: np.ndarray) -> np.ndarray:
        held = ~np.isnan(a)
        kept = np.ix_(*(np.flatnonzero(held.any(axis=tuple(k for k in range(a.ndim) if k != i))) for i in range(a.ndim)))
        out = np.full(a.shape, np.nan)
        out[kept] = fn(a[kept])
        return out

    return run


def along_time(rows: DataFrame, by: list[str], time: str, asset: str, fn: Callable, inputs: list[str]) -> DataFrame:
    """(by, time, asset, out): fn(previous result or None, arrays of a time's inputs) for each time in turn. Every asset has
    a row at every time; an input may be an array column, such as the row of a matrix."""
    kind = rows.schema[asset].dataType.simpleString()

    def step(state, names, values):
        result = fn(state, *values)
        return result, [(n, None if np.isnan(x) else float(x)) for n, x in zip(names, result)]

    return by_portfolio(rows, by, time, asset, step, lambda n: None, inputs, f"{asset} {kind}, out double")


def by_time(matrix: DataFrame, time: str, fn: Callable[[np.ndarray], np.ndarray], value: str = "c") -> DataFrame:
    """(time, i, j, c) of a function of each time's valid matrix: rows and columns without a diagonal are left out before and
    null after."""
    kind = matrix.schema["i"].dataType.simpleString()

    def run(m: np.ndarray, names: list) -> list[tuple]:
        out = np.full(m.shape, np.nan)
        ok = np.flatnonzero(~np.isnan(np.diag(m)))
        if len(ok):
            out[np.ix_(ok, ok)] = fn(np.nan_to_num(m[np.ix_(ok, ok)]))
        return _entries(out, names)

    return by_matrix(matrix, time, run, f"i {kind}, j {kind}, c double", value)


def clipped(matrix: DataFrame, time: str, least: float = 0.0) -> DataFrame:
    """(time, i, j, c): eigenvalues below `least` raised to it."""
    return by_time(matrix, time, lambda m: clip_eigenvalues(m, least))


# --- regressions over time --------------------------------------------------------------------------------------------


def _regression(df: DataFrame, by: list[str], time: str, columns: list[str], target: str | None, n: float, overlapping: int, wgt: str | None, state: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """(rows with _t0 and the weighted sums of products of changes, rows with the changes): all window sums. Rows that lack a
    value take no part; a change is over `overlapping` rows that have all."""
    every = [*columns, *([target] if target else [])]
    axis = Axis(by, time)

    def changes(x: DataFrame) -> DataFrame:
        x = x.withColumn("_ok", F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in every)), F.lit(1.0)))
        w = axis.valid("_ok")
        return x.withColumns({f"_d{k}": F.when(F.col("_ok").isNotNull(), F.col(c) - F.lag(c, overlapping).over(w)) for k, c in enumerate(every)})

    x = changes(df) if state is None else resumed(state[0], df, changes)
    d = [F.col(f"_d{k}") for k in range(len(every))]
    m = len(columns)
    terms = {f"_m{i}_{j}": d[i] * d[j] for i in range(m) for j in range(i, m)}
    if target:
        terms |= {f"_mb{i}": d[i] * d[m] for i in range(m)}
    return moments(x, "_d0", axis, n, terms, None, wgt, None if state is None else state[1]), x


def regression_state(df: DataFrame, by: list[str], time: str, columns: list[str], target: str | None, n: float, overlapping: int = 1, wgt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What ewm_glm and ewm_aai go on from: the last rows that have all values, and the moments."""
    every = [*columns, *([target] if target else [])]
    x, _ = _regression(df, by, time, columns, target, n, overlapping, wgt, None)
    whole = df.where(" and ".join(f"`{c}` is not null" for c in every))
    return last_rows(whole, Axis(by, time), overlapping), final_state(x, Axis(by, time), "_d0")


def _solved(x: DataFrame, by: list[str], time: str, columns: list[str], target: str | None, min_sample: float, overlapping: int) -> DataFrame:
    """(by, time, i, j, c), or with a target (by, time, regressor, out): inverses of a batch of rows at once."""
    m = len(columns)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    keys = [*by, time]
    kinds = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in keys)
    x = x.select(*keys, "_t0", F.array(*(F.col(f"_m{i}_{j}") for i, j in pairs)).alias("_aa"), *([F.array(*(F.col(f"_mb{i}") for i in range(m))).alias("_ab")] if target else []))
    wide = m if target else m * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            t0 = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            flat = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).reshape(rows, len(pairs))
            result = np.full((rows, wide), np.nan)
            ok = np.flatnonzero(np.nan_to_num(t0) > min_sample)
            if len(ok):
                aa = np.empty((len(ok), m, m))
                for k, (i, j) in enumerate(pairs):
                    aa[:, i, j] = aa[:, j, i] = flat[ok, k] / t0[ok]
                full = np.linalg.matrix_rank(aa) == m
                ok, inverse = ok[full], np.linalg.inv(aa[full])
                if target:
                    ab = batch.column(len(keys) + 2).flatten().to_numpy(zero_copy_only=False).reshape(rows, m)
                    result[ok] = (inverse @ (ab[ok] / t0[ok, None])[:, :, None])[:, :, 0] / overlapping
                else:
                    result[ok] = inverse.reshape(len(ok), -1)
            at = pa.array(np.repeat(np.arange(rows), wide))
            names = [columns * rows] if target else [[c for c in columns for _ in columns] * rows, columns * m * rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), *(pa.array(c, pa.string()) for c in names), pa.array(result.ravel(), pa.float64(), from_pandas=True)], [*keys, *(["regressor", "out"] if target else ["i", "j", "c"])])

    return x.mapInArrow(run, kinds + (", regressor string, out double" if target else ", i string, j string, c double"))


def ewm_glm(df: DataFrame, by: list[str], time: str, regressors: list[str], target: str, n: float, overlapping: int = 1, min_sample: float = 0.25, wgt: str | None = None, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(by, time, regressor, out): rolling regression of the target's changes on those of the regressors, divided by
    `overlapping`; null before enough weight or where the moments have no inverse."""
    x, _ = _regression(df, by, time, regressors, target, n, overlapping, wgt, state)
    return _solved(x, by, time, regressors, target, min_sample, overlapping)


def ewm_aai(df: DataFrame, by: list[str], time: str, columns: list[str], n: float, overlapping: int = 1, min_sample: float = 0.25, wgt: str | None = None, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(by, time, i, j, c): inverse of the weighted second moments of changes."""
    x, _ = _regression(df, by, time, columns, None, n, overlapping, wgt, state)
    return _solved(x, by, time, columns, None, min_sample, overlapping)


def least_squares_by(df: DataFrame, by: list[str], columns: list[str], target: str) -> DataFrame:
    """(by, regressor, out): least squares of the target on the columns, for each group: rows with a missing target go,
    missing entries are 0. Only sums of products are gathered, whatever the number of rows."""
    m = len(columns)
    x = df.where(F.col(target).isNotNull()).select(*by, *(F.coalesce(c, F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(columns)), F.col(target).alias("_y"))
    sums = x.groupBy(*by).agg(*(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_m{i}_{j}") for i in range(m) for j in range(i, m)), *(F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"_mb{i}") for i in range(m)), F.lit(1.0).alias("_t0"))
    return _solved(sums, by[:-1], by[-1], columns, target, 0.0, 1)


def risk_parity(cov: np.ndarray, budget: np.ndarray | None = None, start: np.ndarray | None = None, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Weights whose contributions to risk are as `budget`, by cyclical coordinate descent, from `start` where it is given;
    null (NaN) for assets without variance or budget, and for all of a matrix that gives a portfolio negative variance."""
    given = np.ones(len(cov)) if budget is None else np.nan_to_num(np.asarray(budget, float))
    out = np.full(len(cov), np.nan)
    ok = np.flatnonzero((np.nan_to_num(np.diag(cov)) > 0) & (given > 0))
    if not len(ok):
        return out
    c = np.nan_to_num(cov[np.ix_(ok, ok)])
    b = given[ok] / given[ok].sum()
    x = 1 / np.sqrt(np.diag(c))
    if start is not None:
        old = np.asarray(start, float)[ok]
        x = np.where(np.isnan(old) | (old <= 0), x, old)
    for _ in range(rounds):
        old = x.copy()
        for i in range(len(x)):
            variance = x @ c @ x
            if not variance >= 0:
                return out
            sigma = np.sqrt(variance)
            other = c[i] @ x - c[i, i] * x[i]
            x[i] = (-other + np.sqrt(other * other + 4 * c[i, i] * b[i] * sigma)) / (2 * c[i, i])
        if np.abs(x / x.sum() - old / old.sum()).max() < tol:
            break
    out[ok] = x / x.sum()
    return out


def riskparity(matrix: DataFrame, time: str, budgets: dict | None = None) -> DataFrame:
    """(time, i, w) of each covariance matrix. `budgets`: shares of risk by asset, equal where it is not given. Every matrix
    stands for itself: the solution is unique, so where the search begins doesn't show."""
    kind = matrix.schema["i"].dataType.simpleString()

    def weights(m: np.ndarray, names: list) -> list[tuple]:
        w = risk_parity(m, None if budgets is None else np.array([budgets.get(n, 0.0) for n in names]))
        return [(n, None if np.isnan(x) else float(x)) for n, x in zip(names, w)]

    return by_matrix(matrix, time, weights, f"i {kind}, w double")
