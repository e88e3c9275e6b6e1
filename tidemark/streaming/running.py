"""Folds with kept state, for Structured Streaming.

running() turns a step of tidemark.operators.sequential, or one of those below, into a streaming operator: the state of
each series is what the fold ended with, so new rows never need the old ones. Rows of a batch are taken in time order.
Rows older than the newest that a series has seen come too late, as a clock can't run back: they change no state, and come
out without a result (or, with late="drop", not at all).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.fills import decay


def ewma_step(n: float) -> tuple[Callable, Callable]:
    w = decay(n)

    def step(state, x):
        t0, t1 = state
        if x is None:
            return state, None
        t0, t1 = t0 * w + 1 - w, t1 * w + (1 - w) * x
        return (t0, t1), t1 / t0

    return step, lambda: (0.0, 0.0)


def sum_step() -> tuple[Callable, Callable]:
    return (lambda s, x: (s, None) if x is None else (s + x, s + x)), lambda: 0.0


def rolling_mean_step(n: int) -> tuple[Callable, Callable]:
    def step(state, x):
        if x is None:
            return state, None
        state = (*state, x)[-n:]
        return state, sum(state) / n if len(state) == n else None

    return step, tuple


def running(df: DataFrame, by: str, time: str, value: str, step: Callable, start: Callable, out: str = "out", late: str = "null") -> DataFrame:
    """(by, time, value, out) of a stream, appended as rows come."""
    kinds = [df.schema[c].dataType.simpleString() for c in (by, time)]

    def run(key, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, newest = pickle.loads(kept.get[0]) if kept.exists else (start(), None)
        rows = pd.concat(parts).sort_values(time, kind="stable")
        if newest is not None and late == "drop":
            rows = rows[rows[time] >= newest]
        results = []
        for t, x in zip(rows[time], rows[value]):
            if newest is not None and t < newest:
                results.append(None)
                continue
            state, r = step(state, None if pd.isna(x) else float(x))
            newest = t
            results.append(r)
        kept.update((pickle.dumps((state, newest)),))
        yield pd.DataFrame({by: key[0], time: rows[time], value: rows[value], out: pd.array(results, dtype="Float64")})

    return df.select(by, time, value).groupBy(by).applyInPandasWithState(
        run, f"{by} {kinds[0]}, {time} {kinds[1]}, {value} double, {out} double", "state binary", "append", GroupStateTimeout.NoTimeout
    )
