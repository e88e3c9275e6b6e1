"""Operators whose next step depends on their own last result: folds over one series, or one portfolio, in time order.

Rows are dealt by series and sorted by time; a task walks through its rows and carries the state from batch to batch, so a
series needs no group in memory, however long. What a fold ends with can be kept (fold_state) and given to the fold of the
rows that come next. States are plain numbers and lists, kept as JSON.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.axis import Axis
from tidemark.functions.fills import decay


def _numbers(column: pa.Array) -> list:
    return [None if x is None or x != x else float(x) for x in column.to_pylist()]


def _placed(df: DataFrame, axis: Axis, columns: list[str], state: DataFrame | None) -> DataFrame:
    """Each series in one task and in order, after a row with its state where it has one.

    They are dealt by a hash of the keys: a deal by the keys themselves is left out where rows lie by them already, as after
    a join, and adaptive execution may then spread a series over tasks (a join that becomes a broadcast, or is skewed)."""
    rows = df.select(*columns).withColumn("_state", F.lit(None).cast("string"))
    if state is not None:
        keys = (F.col(c).cast(df.schema[c].dataType).alias(c) for c in axis.by)
        rows = rows.unionByName(state.select(*keys, F.col("state").alias("_state")), allowMissingColumns=True)
    return rows.repartition(F.xxhash64(*axis.by)).sortWithinPartitions(*axis.by, F.col("_state").isNull(), *axis.order)


def fold(df: DataFrame, axis: Axis, step: Callable, start: Callable[[], object], inputs: list[str], out: str = "out", state: DataFrame | None = None) -> DataFrame:
    """Adds what step(state, *inputs) -> (state, result) gives for each row, in order, from start() on, or from `state` (as
    fold_state gives it). Missing inputs are None."""
    names = [c for c in df.columns if c != out]
    keys, values = [names.index(c) for c in axis.by], [names.index(c) for c in inputs]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            results = []
            for key, saved, *row in zip(zip(*(batch.column(i).to_pylist() for i in keys)), batch.column(len(names)).to_pylist(), *(_numbers(batch.column(i)) for i in values)):
                if key != now:
                    now, held = key, json.loads(saved) if saved is not None else start()
                if saved is None:
                    held, result = step(held, *row)
                    results.append(result)
            rows = batch.filter(batch.column(len(names)).is_null())
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), pa.array(results, pa.float64())], [*names, out])

    return _placed(df, axis, names, state).mapInArrow(run, schema)


def fold_state(df: DataFrame, axis: Axis, step: Callable, start: Callable[[], object], inputs: list[str], state: DataFrame | None = None) -> DataFrame:
    """(by, state): what the fold of each series ends with. Series of `state` without new rows keep theirs."""
    columns = list(dict.fromkeys([*axis.by, *axis.order, *inputs]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*axis.by, "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, None, []
        for batch in batches:
            at = batch.schema.names.index
            for key, saved, *row in zip(zip(*(batch.column(at(c)).to_pylist() for c in axis.by)), batch.column(len(columns)).to_pylist(), *(_numbers(batch.column(at(c))) for c in inputs)):
                if key != now:
                    if now is not None:
                        done.append((*now, json.dumps(held)))
                    now, held = key, json.loads(saved) if saved is not None else start()
                if saved is None:
                    held, _ = step(held, *row)
            types = [batch.schema.field(at(c)).type for c in axis.by]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * len(names), [*types, pa.string()])], names)
            done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, json.dumps(held)), [*types, pa.string()])], names)

    return _placed(df, axis, columns, state).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in axis.by) + ", state string")


# --- order statistics ---------------------------------------------------------------------------------------------------


class Ordered:
    """Numbers in order, in blocks of up to 2000: adding and finding take the square root of their number of steps."""

    MOST = 2000

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.n = 0

    def add(self, x: float) -> None:
        b = min(bisect_left(self.blocks, x, key=lambda block: block[-1]), max(0, len(self.blocks) - 1))
        if not self.blocks:
            self.blocks.append([])
        block = self.blocks[b]
        insort(block, x)
        self.n += 1
        if len(block) > self.MOST:
            self.blocks[b : b + 1] = [block[: self.MOST // 2], block[self.MOST // 2 :]]

    def below(self, x: float, equal: bool = False) -> int:
        """How many are less than x, or not more."""
        find = bisect_right if equal else bisect_left
        b = find(self.blocks, x, key=lambda block: block[-1])
        return sum(map(len, self.blocks[:b])) + (find(self.blocks[b], x) if b < len(self.blocks) else 0)

    def __getitem__(self, k: int) -> float:
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)


def expanding_rank(df: DataFrame, v: str, axis: Axis, out: str = "out") -> DataFrame:
    """Rank of each observation among those so far, ties averaged, from -1 to 1; 0 for the first."""

    def step(held: Ordered, x):
        if x is None:
            return held, None
        held.add(x)
        less, upto = held.below(x), held.below(x, True)
        return held, 0.0 if held.n == 1 else 2 * (less + (upto - less - 1) / 2) / (held.n - 1) - 1

    return fold(df, axis, step, Ordered, [v], out)


def expanding_median(df: DataFrame, v: str, axis: Axis, out: str = "out") -> DataFrame:
    """Median of the observations so far."""

    def step(held: Ordered, x):
        if x is None:
            return held, None
        held.add(x)
        return held, (held[(held.n - 1) // 2] + held[held.n // 2]) / 2

    return fold(df, axis, step, Ordered, [v], out)


# --- buffers ------------------------------------------------------------------------------------------------------------


def buffer_step(pos: float, band: float, target: float | None, new_band: float | None, unit: float = 0.0, rounding_band: float = 0.0):
    """((position, band), result): the position stays while it is inside target +- band, else goes to the near edge.
    With a unit, edges are whole units, halves to even."""
    band = band if new_band is None else new_band
    if target is None:
        return (pos, band), None
    if unit:
        half = max(band / unit, rounding_band)
        low, high = round(target / unit - half) * unit, round(target / unit + half) * unit
    else:
        low, high = target - band, target + band
    pos = min(max(pos, low), high) if low <= high else low
    return (pos, band), pos


def buffer_fold(unit: float = 0.0, rounding_band: float = 0.0, start: float = 0.0) -> tuple[Callable, Callable]:
    return lambda s, a, b: buffer_step(*s, a, b, unit, rounding_band), lambda: (start, 0.0)


def buffer(df: DataFrame, target: str, band: str, axis: Axis, unit: float = 0.0, rounding_band: float = 0.0, start: float = 0.0, state: DataFrame | None = None, out: str = "out") -> DataFrame:
    return fold(df, axis, *buffer_fold(unit, rounding_band, start), [target, band], out, state)


# --- filters ------------------------------------------------------------------------------------------------------------


def zmooth_fold(n: float, max_move: float = 4.2, exc_zero: bool = False) -> tuple[Callable, Callable]:
    """Step and start of zmooth: the state is the level and the decayed weight and square of the moves made so far."""
    if max_move <= 0:
        raise ValueError("max_move must be positive")
    w = decay(n)

    def made(move: float, most: float, towards: float | None) -> float:
        """What becomes of a move when moves up to `most` count as usual (0: all do)."""
        if not most or abs(move) <= most:
            return move
        if towards is None:
            return math.copysign(most, move)
        return towards if towards * move > 0 else 0.0

    def step(state, value, smooth):
        if value is None:
            return state, None
        if state is None:
            return (value, 0.0, 0.0), value
        level, weight, square = state
        usual = math.sqrt(square / weight) if weight else 0.0
        move = made(value - level, max_move * usual, None if smooth is None else smooth - level)
        if move or not exc_zero:
            weight, square = w * weight + (1 - w), w * square + (1 - w) * move**2
        return (level + move, weight, square), level + move

    return step, lambda: None


def zmooth(df: DataFrame, v: str, axis: Axis, n: float, smooth: str | None = None, max_move: float = 4.2, exc_zero: bool = False, state: DataFrame | None = None, out: str = "out") -> DataFrame:
    """A move beyond max_move volatilities becomes the move to `smooth` if that is on the same side, none if it is on the
    other, and is cut where there is no `smooth`. Volatility is of the moves so filtered."""
    x = df if smooth else df.withColumn("_smooth", F.lit(None).cast("double"))
    return fold(x, axis, *zmooth_fold(n, max_move, exc_zero), [v, smooth or "_smooth"], out, state).drop("_smooth")


def clipped_fold(n: float, max_move: float, rms: bool = True, bias: bool = False, min_sample: float = 0.25, min_periods: int = 3, exc_zero: bool = False) -> tuple[Callable, Callable]:
    """Step and start of ewm_clipped: the state holds the decayed sums of weights, of cut values and of values as given."""
    w = decay(n)

    def deviation(weight, first, second, square):
        var = second / weight - (first / weight) ** 2
        r = 1.0 if bias else 1 - square / weight**2
        return math.sqrt(var / r) if var >= 0 and r > 0 else None

    def step(state, a, wgt):
        t0, t1, t2, w2, raw2, n0, count, last, limit = state
        if a is None:
            return state, None
        if exc_zero and a == 0:
            return state, last
        x = a if not limit else max(-limit * max_move, min(limit * max_move, a))
        own = (1 - w) * (1.0 if wgt is None else wgt)
        t0, t1, t2, w2, raw2 = t0 * w + own, t1 * w + own * x, t2 * w + own * x * x, w2 * w * w + own * own, raw2 * w + own * a * a
        n0, count = n0 * w + 1 - w, count + 1
        if rms:
            last, limit = (math.sqrt(t2 / t0), math.sqrt(raw2 / t0)) if t0 > 0 else (None, None)
        else:
            last = limit = deviation(t0, t1, t2, w2) if n0 >= min_sample and count >= min_periods and t0 > 0 else None
        return (t0, t1, t2, w2, raw2, n0, count, last, limit), last

    return step, lambda: (0.0,) * 6 + (0, None, None)


def ewm_clipped(df: DataFrame, v: str, axis: Axis, n: float, max_move: float, rms: bool = True, bias: bool = False, min_sample: float = 0.25, min_periods: int = 3, wgt: str | None = None, exc_zero: bool = False, state: DataFrame | None = None, out: str = "out") -> DataFrame:
    """ewmrms or ewmstd of values cut at max_move volatilities: of the values as given (rms), or the last result (std). With
    `exc_zero`, zeros repeat the last result."""
    if max_move <= 0:
        raise ValueError("max_move must be positive")
    x = df if wgt else df.withColumn("_wgt", F.lit(None).cast("double"))
    return fold(x, axis, *clipped_fold(n, max_move, rms, bias, min_sample, min_periods, exc_zero), [v, wgt or "_wgt"], out, state).drop("_wgt")


# --- portfolios -------------------------------------------------------------------------------------------------------


def track(cov: np.ndarray, target: np.ndarray, position: np.ndarray | None = None, multiplier: np.ndarray | None = None, min_change: float = 0.01, search: int = 2, most: int = 20) -> tuple[np.ndarray, float]:
    """(whole positions, squared error of tracking the target, in money where there is a multiplier).

    The position first goes to the whole unit nearest the target on its own side. Then one-unit moves towards the target
    are made, each asset's once, the best of each round, as long as a move lowers the error by a share of `min_change`. In
    a round assets are tried by descending slope of the error, and no more once `search` of them lower it enough (0: all
    are tried). A missing target is not traded."""
    money = np.ones(len(target)) if multiplier is None else np.nan_to_num(multiplier)
    c = np.nan_to_num(cov) * np.outer(money, money)
    pos = np.zeros(len(target)) if position is None else np.array(position, float)
    off = lambda p: np.nan_to_num(target - p)
    error = lambda p: float(off(p) @ c @ off(p))
    pos = pos + np.trunc(off(pos))
    base, moved = error(pos), set()
    while len(moved) < most and base > 0:
        unit = np.sign(off(pos))
        slope = (c @ off(pos)) * unit
        good = []
        for i in np.argsort(-slope, kind="stable").tolist():
            if slope[i] > 0 and i not in moved:
                new = error(pos + unit[i] * (np.arange(len(pos)) == i))
                if new / base - 1 < -abs(min_change):
                    good.append((new, i))
                if search and len(good) >= search:
                    break
        if not good:
            break
        base, i = min(good)
        pos[i] += unit[i]
        moved.add(i)
    return pos, base


def multi_buffer_step(
    target: np.ndarray, band: np.ndarray, risk: np.ndarray, previous: np.ndarray, mult: float, unit: float = 1.0, risk_band: float = 0.1,
    rounding_band: float = 0.0, position_target: np.ndarray | None = None,
) -> tuple[float, np.ndarray, float]:
    """(multiplier, positions, mismatch). Position targets (the targets, unless given) times a multiplier are buffered. The
    mismatch is the risk of what is held over the target's risk, less 1; `risk` is the covariance in money.

    While the mismatch stays within risk_band, the multiplier stays. Else it is looked for up to risk_band higher (lower),
    where the mismatch comes to the near edge of the band: five halvings of the interval while its ends lie on both sides
    of the edge, then the end nearer the old multiplier; the old one, if it holds no other positions. The move is taken
    back if it overshoots the other edge."""
    c, t = np.nan_to_num(risk), np.nan_to_num(target)
    p = t if position_target is None else np.nan_to_num(position_target)
    size = math.sqrt(max(0.0, t @ c @ t))

    def held(m):
        return np.array([buffer_step(x, 0.0, y * m, b, unit, rounding_band)[1] for x, y, b in zip(previous, p, band)])

    def off(positions):
        return math.sqrt(max(0.0, positions @ c @ positions)) / size - 1 if size else 0.0

    pos = held(mult)
    miss = off(pos)
    if abs(miss) <= risk_band:
        return mult, pos, miss
    side = math.copysign(1.0, miss)  # too much risk: 1
    edge = side * risk_band
    ends = sorted((mult, mult - side * risk_band))
    beyond = [off(held(m)) - edge for m in ends]
    for _ in range(5):
        if beyond[0] * beyond[1] >= 0:
            break
        middle = sum(ends) / 2
        value = off(held(middle)) - edge
        k = 1 if beyond[0] * value < 0 else 0
        ends[k], beyond[k] = middle, value
    middle = sum(ends) / 2
    if off(held(middle)) == off(held(mult)):
        new = mult
    else:
        new = ends[0] if mult < middle else ends[1]
    moved = held(new)
    if side * off(moved) < -risk_band:
        return mult, pos, miss
    return new, moved, off(moved)


def by_portfolio(df: DataFrame, by: list[str], time: str, asset: str, step: Callable, start: Callable[[int], object], inputs: list[str], schema: str) -> DataFrame:
    """A fold over the times of each portfolio: step(state, assets, arrays of the inputs) -> (state, rows). Rows are dealt by
    portfolio and sorted by time; one time's assets are in memory at once. Every asset has a row at every time."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    columns = [*by, time, *(s.strip().split(" ")[0] for s in schema.split(","))]
    full = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, time)) + ", " + schema

    types = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portfolio, moment, state, held, out = None, None, None, [], []

        def close():
            nonlocal state
            if held:
                names, *values = zip(*held)
                state, rows = step(state, list(names), [np.array([np.nan if x is None else x for x in v], float) for v in values])
                out.extend((*portfolio, moment, *r) for r in rows)
                held.clear()

        for batch in batches:
            for key, t, *row in zip(zip(*(batch.column(i).to_pylist() for i in range(len(by)))), *(batch.column(i).to_pylist() for i in range(len(by), batch.num_columns))):
                if (key, t) != (portfolio, moment):
                    close()
                    if key != portfolio:
                        state = None
                    portfolio, moment = key, t
                if state is None and not held:
                    state = start
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(columns), types)], names=columns)
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(columns), types)], names=columns)

    inner = step

    def step(state, names, values):  # the state of a portfolio's first time follows from its size
        return inner(start(len(names)) if state is start else state, names, values)

    return df.select(*by, time, asset, *inputs).repartition(*by).sortWithinPartitions(*by, time, asset).mapInArrow(run, full)
