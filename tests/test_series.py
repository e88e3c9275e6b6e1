"""Golden values, laws that hold on any data, and edge cases of the time-series operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fills
from tidemark.functions import windows as W
from tidemark.functions.axis import Axis, clean
from tidemark.operators import clocks, crosssection, ewm, matrices, pairs, sequential, states
from tidemark.sources.series import appended, as_of, autocorrelated, full_panel, new_rows, reindex_matrices

A = Axis("k", "pos")
N = None


def frame(spark, values, **more):
    rows = [(0, i, None if v is None else float(v), *map(float, x)) for i, (v, *x) in enumerate(zip(values, *more.values()))]
    kinds = "".join(f", {name} double" for name in more)
    return spark.createDataFrame(rows, f"k int, pos long, v double{kinds}")


def values(df, c="out"):
    return [None if x is None else round(x, 9) for x in (r[c] for r in df.orderBy("pos").collect())]


def column(spark, data, make):
    return values(frame(spark, data).withColumn("out", make()))


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        y = None if y is None or (isinstance(y, float) and math.isnan(y)) else y
        assert (x is None) == (y is None), (a, b)
        assert x is None or abs(x - y) < 1e-6, (a, b)


GAPPY = [1.0, N, 3.0, 2.5, N, N, 4.0, 1.5, 9.0, N, 2.0, 6.0]
FUNCTIONS = {
    "shift": lambda: W.shift("v", A, 2), "diff": lambda: W.diff("v", A), "ratio": lambda: W.ratio("v", A), "cumsum": lambda: W.cumsum("v", A), "cumprod": lambda: W.cumprod("v", A),
    **{f"expanding_{x}": lambda x=x: getattr(W, f"expanding_{x}")("v", A) for x in "mean rms std skew min max median rank".split()},
    **{f"rolling_{x}": lambda x=x: getattr(W, f"rolling_{x}")("v", A, 3) for x in "mean sum rms std skew min max median rank quantile".split()},
}


def test_missing_rows_change_nothing(spark):
    """Computing with missing rows equals deleting them, computing, and putting them back."""
    gappy = frame(spark, GAPPY)
    dense = gappy.where("v is not null")
    for name, make in FUNCTIONS.items():
        a, b = gappy.withColumn("out", make()), dense.withColumn("out", make())
        want = {r["pos"]: r["out"] for r in b.collect()}
        assert {r["pos"]: r["out"] for r in a.collect()} == {i: want.get(i) for i in range(len(GAPPY))}, name


def test_as_pandas_on_dense_data(spark):
    x = pd.Series(np.random.default_rng(0).normal(0, 1, 60))
    df = frame(spark, x.tolist())
    r = x.rolling(5)
    for make, want in (
        (lambda: W.rolling_mean("v", A, 5), r.mean()), (lambda: W.rolling_std("v", A, 5), r.std()), (lambda: W.rolling_skew("v", A, 5), r.skew()), (lambda: W.rolling_median("v", A, 5), r.median()),
        (lambda: W.rolling_quantile("v", A, 5, 0.3), r.quantile(0.3)), (lambda: W.expanding_std("v", A), x.expanding().std()), (lambda: W.expanding_skew("v", A), x.expanding().skew()), (lambda: W.rolling_max("v", A, 5), r.max()),
    ):
        close(values(df.withColumn("out", make())), want.tolist())
    e = x.ewm(com=7)
    close(values(ewm.ewma(df, "v", A, 7)), e.mean().tolist())
    close(values(ewm.ewmstd(df, "v", A, 7, min_periods=2)), e.std().tolist())
    close(values(ewm.ewmvar(df, "v", A, 7, bias=True, min_periods=1))[1:], e.var(bias=True).tolist()[1:])


def test_golden_values(spark):
    assert column(spark, [1.0, 2, N, 0, 4, 2], lambda: W.expanding_rank("v", A)) == [0, 1, N, -1, 1, 0.25]
    assert column(spark, [1.0, 2, N, 0, 4, 2, 3, 1, 2], lambda: W.rolling_rank("v", A, 3)) == [N, N, N, -1, 1, 0, 0, -1, 0]
    data = [N, N, 1.0, N, N, 2.0, N, N]
    assert [fills.fnna(frame(spark, data), "v", A, n).first()["pos"] for n in (1, 2, -1, -2, 3)] == [2, 5, 5, 2, N]
    with pytest.raises(ValueError):
        fills.fnna(frame(spark, data), "v", A, 0)
    stale = [N, 1.0, N, N, 2.0, N, N, N]
    assert values(fills.with_staleness(frame(spark, stale), "v", A, "out")) == [1, 0, 1, 2, 0, 1, 2, 3]
    assert values(fills.with_staleness(frame(spark, stale), "v", A, "out", before=3)) == [4, 0, 1, 2, 0, 1, 2, 3]
    assert values(fills.ffill(frame(spark, stale), "v", A, 2)) == [N, 1, 1, 1, 2, 2, 2, N]
    assert values(fills.ffill(frame(spark, stale), "v", A, 2, 0, 2)) == [N, 1, 0.5, 0, 2, 1, 0, N]


def test_clocks(spark):
    ticks = frame(spark, [float(i * i) for i in range(10)], tick=[0.0, 0, 1, 1, 1, 2, 2, 2, 2, 3])
    assert values(clocks.diff(ticks, "v", A, "tick", 1)) == [N, N, 3, 8, 15, 9, 20, 33, 48, 17]
    assert values(clocks.diff(ticks, "v", A, "tick", 2)) == [N, N, N, N, N, 24, 35, 48, 63, 65]
    two = frame(spark, [float(i) for i in range(10)], tick=[1.0, 1, 2, 2, 3, 3, 4, 4, 5, 5])
    assert [x and 2 * x for x in values(clocks.rolling_mean(two, "v", A, 2, "tick"))] == [N, N, 3, 4, 7, 8, 11, 12, 15, 16]
    assert [x and round(x * x, 6) for x in values(clocks.rolling_std(two, "v", A, 2, "tick"))][2:] == [0.5, 2, 0.5, 2, 0.5, 2, 0.5, 2]


def reference_ewma(xs, n, ticks=None):
    """The recurrence itself, a tick's newest value replacing the one before."""
    w, out, done, now = n / (n + 1), [], (0.0, 0.0), None
    for i, x in enumerate(xs):
        if x is None:
            out.append(None)
            continue
        t = len([y for y in xs[: i + 1] if y is not None]) if ticks is None else ticks[i]
        if now is None or t != now[0]:
            if now is not None:
                p = w ** (t - now[0])
                done = tuple(p * (d + c) for d, c in zip(done, now[1]))
        now = (t, ((1 - w), (1 - w) * x))
        out.append((done[1] + now[1][1]) / (done[0] + now[1][0]))
    return out


def test_ewma_on_long_series_and_clocks(spark):
    rng = np.random.default_rng(1)
    xs = [None if rng.random() < 0.3 else float(x) for x in rng.normal(0, 1, 3000)]
    close(values(ewm.ewma(frame(spark, xs), "v", A, 2)), reference_ewma(xs, 2))  # over several blocks
    ticks = np.sort(rng.integers(0, 200, 300)).astype(float).tolist()
    close(values(ewm.ewma(frame(spark, xs[:300], tick=ticks), "v", A, 5, "tick")), reference_ewma(xs[:300], 5, ticks))


def test_resumed_from_state_equals_all_at_once(spark):
    df = frame(spark, GAPPY * 3)
    old, new = df.where("pos < 17"), df.where("pos >= 17")
    state = ewm.final_state(ewm.moments(old, "v", A, 3, {"_m1": F.col("v")}), A, "v")
    want = values(ewm.ewma(df, "v", A, 3))
    assert values(ewm.ewma(new, "v", A, 3, state=state)) == want[17:]
    done = ewm.ewma(old, "v", A, 3)
    assert values(appended(done, ewm.ewma(new_rows(df, done, ["k"], "pos"), "v", A, 3, state=state), ["k"], "pos")) == want


def test_empty_constant_and_clashing_names(spark):
    empty = frame(spark, [])
    for make in FUNCTIONS.values():
        assert empty.withColumn("out", make()).count() == 0
    assert ewm.ewmstd(empty, "v", A, 3).count() == 0
    assert column(spark, [2.0] * 4, lambda: W.rolling_skew("v", A, 3)) == [N] * 4
    assert column(spark, [N] * 3, lambda: W.expanding_mean("v", A)) == [N] * 3
    named = frame(spark, [1.0, 2.0, 4.0]).withColumn("_w", F.lit("x")).withColumn("t0", F.lit("y"))
    out = ewm.ewma(named, "v", A, 1)
    assert [r["t0"] for r in out.collect()] == ["y"] * 3 and "_w" in out.columns
    assert frame(spark, [float("nan"), 1.0]).select(clean("v").alias("x")).collect()[0]["x"] is None


def test_zero_divisors(spark):
    assert column(spark, [0.0, 3.0, 0.0], lambda: W.ratio("v", A)) == [N, N, 0]
    with pytest.raises(ValueError):
        W.rolling_mean("v", A, 0)


def test_buffer_and_zmooth(spark):
    df = frame(spark, [0.0, 1.0, 3.0, 2.2, N, -1.0]).withColumn("band", F.lit(1.0))
    assert values(sequential.buffer(df, "v", "band", A)) == [0, 0, 2, 2, N, 0]
    assert values(sequential.buffer(df, "v", "band", A, unit=2.0)) == [0, 0, 2, 2, N, 0]
    jump = frame(spark, [0.0, 1.0, 0.0, 1.0, 50.0, 1.0])
    out = values(sequential.zmooth(jump, "v", A, 5, max_move=2.0))
    assert out[:4] == [0, 1, 0, 1] and out[4] == 3
    with pytest.raises(ValueError):
        sequential.zmooth(jump, "v", A, 5, max_move=0)


def test_clipping_far_away_changes_nothing(spark):
    df = frame(spark, GAPPY)
    close(values(sequential.ewm_clipped(df, "v", A, 4, 1e9)), values(ewm.ewmrms(df, "v", A, 4)))
    close(values(sequential.ewm_clipped(df, "v", A, 4, 1e9, rms=False)), values(ewm.ewmstd(df, "v", A, 4)))


def test_matrices():
    m = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    fixed = matrices.repaired(m)
    assert np.linalg.eigvalsh(fixed).min() > -1e-12 and np.allclose(np.diag(fixed), 1)
    holes = m.copy()
    holes[1, :] = holes[:, 1] = np.nan
    assert np.isnan(matrices.repaired(holes)[1]).all() and np.isfinite(matrices.repaired(holes)[0, 2])
    w = matrices.risk_parity(np.diag([1.0, 4.0, 0.0]))
    assert np.allclose(w, [2 / 3, 1 / 3, np.nan], equal_nan=True)
    c = np.cov(np.random.default_rng(4).normal(0, [1, 2, 3, 4], (60, 4)).T)
    budget = np.array([0.4, 0.3, 0.3, 0.0])
    w = matrices.risk_parity(c, budget, np.array([0.1, np.nan, 0.5, 0.4]))
    assert np.isnan(w[3]) and np.allclose(w[:3] * (c[:3, :3] @ w[:3]) / (w[:3] @ c[:3, :3] @ w[:3]), budget[:3]) and abs(w[:3].sum() - 1) < 1e-9
    twice = matrices.masked(lambda a: 2 * a)(np.array([[np.nan, 1.0, np.nan], [np.nan, np.nan, np.nan], [np.nan, 3.0, 4.0]]))
    assert np.array_equal(twice, [[np.nan, 2, np.nan], [np.nan] * 3, [np.nan, 6, 8]], equal_nan=True)
    assert np.allclose(matrices.least_squares(np.array([[1.0, 0], [0, 1], [1, 1]]), np.array([1.0, 2, np.nan])), [1, 2])


def test_regressions_against_a_loop(spark):
    rng = np.random.default_rng(3)
    a = np.cumsum(rng.normal(0, 1, (60, 3)), 0)
    y = a @ [2.0, -1.0, 0.5] + rng.normal(0, 0.1, 60)
    a[rng.random((60, 3)) < 0.05] = np.nan
    rows = [(k, t, *(None if np.isnan(x) else float(x) for x in a[t]), float(y[t])) for k in (0, 1) for t in range(60)]
    df = spark.createDataFrame(rows, "k int, t int, a double, b double, c double, y double")
    for overlapping in (1, 3):
        ok = [t for t in range(60) if not np.isnan(a[t]).any()]
        aa, ab, t0, want = np.zeros((3, 3)), np.zeros(3), 0.0, {}
        for n, t in enumerate(ok):
            if n >= overlapping:
                da, dy = a[t] - a[ok[n - overlapping]], y[t] - y[ok[n - overlapping]]
                aa, ab, t0 = aa * 0.9 + 0.1 * np.outer(da, da), ab * 0.9 + 0.1 * da * dy, t0 * 0.9 + 0.1
                if t0 > 0.35:
                    want[t] = np.linalg.solve(aa, ab) / overlapping
        out = matrices.ewm_glm(df, ["k"], "t", ["a", "b", "c"], "y", 9, overlapping, 0.35)
        got = {(r["k"], r["t"], r["regressor"]): r["out"] for r in out.collect()}
        assert len(got) == 360
        for (_, t, name), x in got.items():
            assert (x is None) == (t not in want) and (x is None or abs(x - want[t]["abc".index(name)]) < 1e-8)
        state = matrices.regression_state(df.where("t < 31"), ["k"], "t", ["a", "b", "c"], "y", 9, overlapping)
        later = matrices.ewm_glm(df.where("t >= 31"), ["k"], "t", ["a", "b", "c"], "y", 9, overlapping, 0.35, state=state)
        for r in later.collect():
            x = got[r["k"], r["t"], r["regressor"]]
            assert (x is None) == (r["out"] is None) and (x is None or abs(x - r["out"]) < 1e-8)


def plain_track(c, target, start, min_change, search):
    """As a person would do it: list every move, try the steepest first, take the best of the good ones."""
    pos = [s + math.trunc(x - s) for s, x in zip(start, target)]
    error = lambda p: sum((target[i] - p[i]) * c[i][j] * (target[j] - p[j]) for i in range(len(p)) for j in range(len(p)))
    done = set()
    while len(done) < 20 and error(pos) > 0:
        off = [x - p for x, p in zip(target, pos)]
        slopes = [(sum(c[i][j] * off[j] for j in range(len(pos))) * np.sign(off[i]), i) for i in range(len(pos))]
        good = []
        for slope, i in sorted(slopes, key=lambda x: (-x[0], x[1])):
            new = [p + (np.sign(off[i]) if j == i else 0) for j, p in enumerate(pos)]
            if slope > 0 and i not in done and error(new) / error(pos) - 1 < -min_change and (not search or len(good) < search):
                good.append((error(new), i, new))
        if not good:
            break
        _, i, pos = min(good, key=lambda x: x[:2])
        done.add(i)
    return pos


def test_tracking_against_plain_steps():
    rng = np.random.default_rng(8)
    for search in (0, 1, 2):
        for _ in range(40):
            x = rng.normal(0, 1, (30, 5))
            c, target, start = np.cov(x.T), rng.normal(0, 3, 5), rng.integers(-3, 4, 5).astype(float)
            pos, error = sequential.track(c, target, start, search=search)
            assert pos.tolist() == plain_track(c.tolist(), target.tolist(), start.tolist(), 0.01, search)
            assert abs(error - (target - pos) @ c @ (target - pos)) < 1e-9
    money = np.array([2.0, 1, 1, 1, 0.5])
    assert sequential.track(c, target, multiplier=money)[0].tolist() == sequential.track(c * np.outer(money, money), target)[0].tolist()
    assert sequential.track(np.eye(2), np.array([np.nan, 1.4]), np.array([2.0, 0]))[0].tolist() == [2, 1]


def test_multibuffer_keeps_the_risk_band():
    rng = np.random.default_rng(9)
    seen = set()
    for _ in range(300):
        n = int(rng.integers(1, 5))
        c = np.cov(rng.normal(0, 1, (20, n)).T).reshape(n, n)
        target, previous, m = rng.normal(0, 4, n), rng.integers(-5, 6, n).astype(float), float(rng.uniform(0.7, 1.3))
        new, pos, miss = sequential.multi_buffer_step(target, np.full(n, 0.8), c, previous, m)
        kept = np.array([sequential.buffer_step(p, 0.0, x * m, 0.8, 1.0)[1] for p, x in zip(previous, target)])
        off = math.sqrt(kept @ c @ kept) / math.sqrt(target @ c @ target) - 1
        assert abs(miss - (math.sqrt(pos @ c @ pos) / math.sqrt(target @ c @ target) - 1)) < 1e-9 and abs(new - m) <= 0.1 + 1e-9
        assert (pos == [sequential.buffer_step(p, 0.0, x * new, 0.8, 1.0)[1] for p, x in zip(previous, target)]).all()
        if abs(off) <= 0.1:
            assert new == m
        else:  # the multiplier goes against the mismatch, and never over to the other side
            assert (new - m) * off <= 0 and (new == m or -0.1 <= math.copysign(1, off) * miss)
        seen.add((abs(off) <= 0.1, new == m))
    assert len(seen) == 3


def test_zmooth_against_a_loop(spark):
    rng = np.random.default_rng(10)
    xs = [None if rng.random() < 0.2 else float(x) for x in np.cumsum(rng.standard_t(2, 200))]
    smooth = [None if rng.random() < 0.5 else float(x) for x in rng.normal(0, 5, 200)]
    level, moves, want = None, [], []
    for x, s in zip(xs, smooth):
        if x is not None:
            if level is not None:
                move = x - level
                weights = [(5 / 6) ** (len(moves) - 1 - i) for i in range(len(moves))]
                vol = math.sqrt(sum(w * m * m for w, m in zip(weights, moves)) / sum(weights)) if moves else 0
                if vol and abs(move) > 1.5 * vol:
                    move = math.copysign(1.5 * vol, move) if s is None else s - level if (s - level) * move > 0 else 0.0
                moves.append(move)
                level += move
            else:
                level = x
        want.append(None if x is None else level)
    df = spark.createDataFrame([(0, i, x, s) for i, (x, s) in enumerate(zip(xs, smooth))], "k int, pos long, v double, s double")
    close(values(sequential.zmooth(df, "v", A, 5, "s", 1.5)), want)


def test_folds_go_on_from_state(spark):
    rng = np.random.default_rng(11)
    rows = [(k, i, None if rng.random() < 0.3 else float(rng.normal(0, 3)), 1.0) for k in range(30) for i in range(int(rng.integers(1, 40)))]
    df = spark.createDataFrame(rows, "k int, pos long, v double, band double").repartition(4)
    old, new = df.where("pos < 9 and k < 25"), df.where("pos >= 9 or k >= 25")
    step, start = sequential.buffer_fold(0.5)
    state = sequential.fold_state(old, A, step, start, ["v", "band"])
    want = {(r["k"], r["pos"]): r["out"] for r in sequential.buffer(df, "v", "band", A, unit=0.5).collect()}
    got = {(r["k"], r["pos"]): r["out"] for r in sequential.buffer(new, "v", "band", A, unit=0.5, state=state).collect()}
    assert got == {k: want[k] for k in got} and len(got) == new.count()
    both = sequential.fold_state(new, A, step, start, ["v", "band"], state)
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in sequential.fold_state(df, A, step, start, ["v", "band"]).collect()}
    assert sequential.fold_state(df.limit(0), A, step, start, ["v", "band"]).count() == 0


def test_folds_of_joined_rows(spark):
    """A series stays in one task though its rows lie by their keys after a join, which becomes a broadcast as it runs."""
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10m", "adaptive.coalescePartitions.enabled": "false"}
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 20).alias("k"), F.floor(F.col("id") / 20).alias("pos"))
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        joined = rows.join(spark.range(20).select(F.col("id").alias("k"), F.lit(1.0).alias("v")), "k", "left")
        got = sequential.fold(joined, A, lambda s, x: (s + x, s + x), lambda: 0.0, ["v"]).select("pos", "out").collect()
    finally:
        for k in settings:
            spark.conf.unset(f"spark.sql.{k}")
    assert len(got) == 4000 and all(out == pos + 1 for pos, out in got)


def test_states_of_rows_without_values(spark):
    """New rows without any value, series that only one side has, and no rows at all."""
    old = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (3, 0, 2.0)], "k int, pos long, v double")
    new = spark.createDataFrame([(0, 2, None), (0, 3, None), (1, 1, None), (1, 2, 5.0), (2, 0, 7.0), (2, 1, None)], "k int, pos long, v double")
    every = old.unionByName(new)
    for what in "sum mean rms std skew min max".split():
        make = getattr(W, f"expanding_{what}")
        want = {(r["k"], r["pos"]): r["out"] for r in every.withColumn("out", make("v", A)).collect()}
        got = {(r["k"], r["pos"]): r["out"] for r in states.expanding_resumed(new, states.moment_state(old, ["k"], "v"), "v", A, what).collect()}
        assert got == {k: want[k] for k in got} and len(got) == 6, what
    for n in (1, 2):
        run = lambda d, n=n: d.withColumn("out", W.rolling_max("v", A, n))
        want = {(r["k"], r["pos"]): r["out"] for r in run(every).collect()}
        got = {(r["k"], r["pos"]): r["out"] for r in states.resumed(states.tail(old, "v", A, n), new, run).collect()}
        assert got == {k: want[k] for k in got}
    state = states.fill_state(old, "v", A)
    want = {(r["k"], r["pos"]): (r["f"], r["s"]) for r in fills.with_staleness(fills.ffill(every, "v", A, 2, out="f"), "v", A, "s").collect()}
    filled = {(r["k"], r["pos"]): r["out"] for r in states.ffill(new, state, "v", A, 2).collect()}
    stale = {(r["k"], r["pos"]): r["stale"] for r in states.staleness(new, state, "v", A).collect()}
    assert {k: (filled[k], stale[k]) for k in filled} == {k: want[k] for k in filled}
    merged, whole = states.fill_state(new, "v", A, state), states.fill_state(every.where("k < 3"), "v", A)
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in whole.collect()}
    assert states.expanding_resumed(new.limit(0), states.moment_state(old, ["k"], "v"), "v", A, "mean").count() == 0


def test_ranks_and_medians_of_long_series(spark):
    rng = np.random.default_rng(12)
    xs = [None if rng.random() < 0.1 else float(x) for x in rng.integers(0, 300, 5000)]
    df = frame(spark, xs)
    ranks, medians = values(sequential.expanding_rank(df, "v", A)), values(sequential.expanding_median(df, "v", A))
    seen = []
    for x, rank, median in zip(xs, ranks, medians):
        if x is None:
            assert rank is None and median is None
            continue
        seen.append(x)
        if len(seen) % 97 in (0, 1):
            a = np.array(seen)
            less, equal = (a < x).sum(), (a == x).sum()
            assert abs(rank - (2 * (less + (equal - 1) / 2) / (len(a) - 1) - 1 if len(a) > 1 else 0)) < 1e-8 and median == np.median(a)


@pytest.mark.parametrize("scale,reweight,vol", [(0, False, -1.0), (1, False, 0.0), (2, False, 0.01), (3, False, -1.0), (1, True, 2.0), (3, True, -1.0)])
def test_xrank_against_all_pairs(spark, scale, reweight, vol):
    rng = np.random.default_rng(13)
    rows = [(t, f"s{j:02d}", None if rng.random() < 0.1 else float(rng.choice([rng.normal(0, 1), 0.5, 1000.0])), float(rng.choice([0, 1, 2])), float(rng.uniform(0.2, 0.9))) for t in range(5) for j in range(12)]
    df = spark.createDataFrame(rows, "t int, s string, v double, w double, b double")
    got = {(r["t"], r["s"]): r["out"] for r in crosssection.xrank(df, "t", "s", "v", "w", "b", vol, scale, reweight).collect()}
    for t in range(5):
        mine = [r for r in rows if r[0] == t and r[2] is not None]
        a, w, b = (np.array([r[k] for r in mine]) for k in (2, 3, 4))
        wb = w * b
        total = wb.sum()
        sd = math.sqrt(max(0, (wb * a * a).sum() / total - ((wb * a).sum() / total) ** 2)) if vol < 0 else vol
        d = a[:, None] - a[None, :]
        p = np.where(d > 0, 1 - np.exp(-np.abs(d) / sd) / 2, np.exp(-np.abs(d) / sd) / 2) if sd > 0 else (np.sign(d) + 1) / 2
        r = np.where(w != 0, ((2 * p - 1) * wb[None, :] / total).sum(1), 0.0)
        std = {0: 1.0, 1: math.sqrt(((w * r) ** 2 * (1 - b * b)).sum()) / w.sum(), 2: math.sqrt((r * r).sum() - r.sum() ** 2) if (r * r).sum() > r.sum() ** 2 else np.nan, 3: math.sqrt((w * r * r).sum() / w.sum())}[scale]
        r = r / std * ((w / w.sum() if scale in (1, 3) else w) if reweight else 1)
        for (_, s, *_), x in zip(mine, r):
            if not np.isnan(x):
                assert abs(got[t, s] - x) < 1e-9
    assert all(got[r[0], r[1]] is None for r in rows if r[2] is None)


def test_matrices_at_other_times(spark):
    m = spark.createDataFrame([(1, "a", "a", 1.0), (1, "a", "b", 0.5), (4, "a", "a", 2.0), (4, "a", "b", None)], "t int, i string, j string, c double")
    times = spark.createDataFrame([(0,), (1,), (3,), (9,)], "t int")
    got = sorted(tuple(r) for r in reindex_matrices(m, times, "t").collect() if r["j"] == "b")
    assert [(x[0], x[3]) for x in got] == [(1, 0.5), (3, 0.5), (9, None)]
    assert {(r["t"], r["c"]) for r in reindex_matrices(m, times, "t", fill=7.0).collect() if r["j"] == "b"} == {(0, 7.0), (1, 0.5), (3, 7.0), (9, 7.0)}
    sums = matrices.along_time(m.where("j = 'a'").select(F.lit("p").alias("p"), "t", "i", F.array("c").alias("row")), ["p"], "t", "i", lambda last, x: x[:, 0] + (0 if last is None else last), ["row"])
    assert [r["out"] for r in sums.orderBy("t").collect()] == [1, 3]
    walk = autocorrelated(spark, 3, 400, [0.9], seed=4).toPandas()
    assert len(walk) == 1200 and all(0.8 < g.sort_values("t").v.autocorr() < 0.97 for _, g in walk.groupby("series"))


def test_positions():
    pos, error = sequential.track(np.eye(2), np.array([2.6, -1.2]))
    assert pos.tolist() == [3, -1] and abs(error - 0.2) < 1e-9
    m, held, miss = sequential.multi_buffer_step(np.array([40.4, 26.6]), np.array([2.5, 2.5]), np.eye(2), np.zeros(2), 1.0)
    assert abs(miss) <= 0.1 + 1e-9 and (held == np.rint(held)).all()
    assert sequential.multi_buffer_step(np.zeros(2), np.zeros(2), np.eye(2), np.zeros(2), 1.0)[2] == 0


def test_pairs_against_pandas(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (40, 3)).cumsum(0)
    df = spark.createDataFrame([(t, str(j), float(x[t, j])) for t in range(40) for j in range(3) if (t + j) % 7], "t int, s string, v double")
    got = {(r["i"], r["j"]): r["c"] for r in pairs.ewmcorrelation(df, "t", "s", "v", 10, bias=True).where("t = 39").collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        both = pd.DataFrame({a: [x[t, c] if (t + c) % 7 else np.nan for t in range(40)] for a, c in (("a", i), ("b", j))}).dropna().diff().dropna()
        assert abs(got[str(i), str(j)] - both["a"].ewm(com=10).corr(both["b"]).iloc[-1]) < 1e-9
    psd = pairs.ewmcorr_psd(full_panel(df, "t", "s", "v"), "t", "s", "v", 10)
    m, _ = matrices.dense(psd.where("t = 39").toPandas())
    assert np.linalg.eigvalsh(m).min() > -1e-9
    assert crosssection.encode_correlation("c") is not None


def test_codes_and_ranks(spark):
    df = spark.createDataFrame([(0.126,), (None,), (-1.2,)], "c double")
    assert [r["x"] for r in df.select(crosssection.encode_correlation("c").alias("x")).collect()] == [13, None, -100]
    p = spark.createDataFrame([(0, "a", 3.0), (0, "b", 1.0), (0, "c", None), (0, "d", 3.0)], "t int, s string, v double")
    out = {r["s"]: r["out"] for r in crosssection.xrank(p, "t", "s", "v", vol=0.0).collect()}
    assert out["c"] is None and abs(sum(v for v in out.values() if v is not None)) < 1e-12 and out["a"] == out["d"] > out["b"]


def test_as_of(spark):
    left = spark.createDataFrame([(0, 1), (0, 5), (1, 3)], "k int, pos long")
    right = spark.createDataFrame([(0, 1, 1.0), (0, 4, None), (0, 6, 9.0)], "k int, pos long, x double")
    assert {(r["k"], r["pos"]): r["x"] for r in as_of(left, right, ["k"], "pos", ["x"]).collect()} == {(0, 1): 1.0, (0, 5): 1.0, (1, 3): None}


def test_stream(spark, tmp_path):
    from tidemark.streaming.running import ewma_step, running

    for i in range(2):
        part = pd.DataFrame({"k": [0, 0, 1], "pos": [2 * i, 2 * i + 1, i], "v": [1.0 + i, 2.0 + i, None]})
        spark.createDataFrame(part, "k int, pos long, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("k int, pos long, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    step, start = ewma_step(3)
    q = running(stream, "k", "pos", "v", step, start).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["pos"]: r["out"] for r in spark.read.parquet(str(tmp_path / "out")).where("k = 0").collect()}
    close([got[i] for i in range(4)], reference_ewma([1.0, 2.0, 2.0, 3.0], 3))


def test_stream_of_late_rows(spark, tmp_path):
    from tidemark.streaming.running import running, sum_step

    for i, pos in enumerate(([1, 5], [5, 3, 6])):
        spark.createDataFrame([(0, p, 1.0) for p in pos], "k int, pos long, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for late, want in (("null", [(1, 1), (3, None), (5, 2), (5, 3), (6, 4)]), ("drop", [(1, 1), (5, 2), (5, 3), (6, 4)])):
        stream = spark.readStream.schema("k int, pos long, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = tmp_path / late
        q = running(stream, "k", "pos", "v", *sum_step(), late=late).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"state-{late}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(((r["pos"], r["out"]) for r in spark.read.parquet(str(out)).collect()), key=lambda x: (x[0], x[1] or 0)) == want


def test_matrix_queries_take_the_whole_panel(spark, sf):
    from tidemark.plans import panel_queries as P

    def by_time(df):
        out = {}
        for r in df.collect():
            m = out.setdefault(r["t"], {})
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["c"]
        return out

    d = P.panel(spark, sf)
    got = {}
    for r in P.QUERIES["riskparity"](spark, sf).collect():
        got.setdefault(r["t"], {})[r["i"]] = r["w"]
    want = by_time(P.COVARIANCES(d))
    assert set(got) == set(want) and len({t.hour for t in got}) == 24
    for t, m in want.items():
        names = sorted({i for i, _ in m})
        w = matrices.risk_parity(np.array([[m.get((i, j), np.nan) for j in names] for i in names]))
        assert np.allclose(np.array([got[t][i] for i in names], float), w, atol=2e-6, equal_nan=True)
    want = by_time(P.CORR(d).where("c is not null"))
    got = {r["t"]: r["out"] for r in P.QUERIES["det"](spark, sf).collect()}
    assert set(got) == set(want)
    for t, m in want.items():
        names = sorted({i for i, _ in m})
        assert abs(got[t] - np.linalg.det(np.array([[1.0 if i == j else m.get((i, j), 0.0) for j in names] for i in names]))) < 2e-6
