"""Every operator that can go on from saved state, run in two parts: the older rows leave a state, the newer ones go on from it,
and both together have to be what the same operator's SQL gives for all rows at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fills
from tidemark.functions import windows as W
from tidemark.operators import clocks, ewm, pairs, sequential
from tidemark.operators import states as S
from tidemark.plans import panel_queries as P
from tidemark.plans.queries import AXIS, NEAR, QUERIES, SQL, _r, events, rounded
from tidemark.sources.series import appended, new_rows

BY = ["user_id"]


def halves(e: DataFrame, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    return e.where(~P.LATER(time)), e.where(P.LATER(time))


def add(name: str, old_run: Callable[[DataFrame], DataFrame], new_run: Callable[[DataFrame, DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame] = lambda e: e) -> None:
    """old_run(old rows) and new_run(old rows, new rows) -> rows with event_id and out. new_run takes nothing but a state from
    the old rows."""

    def query(spark, sf_dir):
        old, new = halves(prepare(events(spark, sf_dir)))
        return old_run(old).select("event_id", "out").unionByName(new_run(old, new).select("event_id", "out")).select("event_id", rounded("out").alias("out"))

    QUERIES[f"{name}_resumed"] = query
    SQL[f"{name}_resumed"] = SQL[name]


def with_column(make: Callable) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumn("out", make())


# --- the last observations -------------------------------------------------------------------------------------------------

TAILS = {
    "shift": (2, lambda: W.shift("v", AXIS, 2)), "diff": (1, lambda: W.diff("v", AXIS)), "ratio": (1, lambda: W.ratio("v", AXIS)),
    **{f"rolling_{x}": (9, lambda x=x: getattr(W, f"rolling_{x}")("v", AXIS, 10)) for x in "mean sum rms std skew min max median rank".split()},
    "rolling_quantile": (9, lambda: W.rolling_quantile("v", AXIS, 10, 0.3)),
}
for name, (n, make) in TAILS.items():
    add(name, with_column(make), lambda old, new, n=n, make=make: S.resumed(S.tail(old, "v", AXIS, n), new, with_column(make)))

CLOCKS = {"diff": (3, lambda d: clocks.diff(d, "v", AXIS, "d", 2)), "ratio": (2, lambda d: clocks.ratio(d, "v", AXIS, "d", 1))}
CLOCKS |= {f"rolling_{x}": (3, lambda d, x=x: getattr(clocks, f"rolling_{x}")(d, "v", AXIS, 3, "d")) for x in "mean sum rms std skew".split()}
for name, (n, run) in CLOCKS.items():
    add(f"{name}_clock", run, lambda old, new, n=n, run=run: S.resumed(S.tail(old, "v", AXIS, n, "d"), new, run))


def held(e: DataFrame) -> DataFrame:
    """A missing position stands for the one before: filled, so that a tail of rows says it all."""
    return fills.ffill(e, "v", AXIS, out="v")


add("rolling_tover", lambda d: W.rolling_turnover(d, "v", AXIS, 8), lambda old, new: S.resumed(S.last_rows(old, AXIS, 8), new, lambda d: W.rolling_turnover(d, "v", AXIS, 8)), held)

# --- counts and sums of powers ---------------------------------------------------------------------------------------------

for what in "sum mean rms std skew min max".split():
    make = getattr(W, f"expanding_{what}")
    add(f"expanding_{what}", with_column(lambda make=make: make("v", AXIS)), lambda old, new, what=what: S.expanding_resumed(new, S.moment_state(old, BY, "v"), "v", AXIS, what))
add("cumprod", with_column(lambda: W.cumprod("x", AXIS)), lambda old, new: S.expanding_resumed(new, S.moment_state(old, BY, "x"), "x", AXIS, "cumprod"), lambda e: e.withColumn("x", 1 + F.col("v") / 10000))


def add_reduction(name: str, run: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    QUERIES[f"{name}_resumed"] = lambda spark, sf_dir: run(*halves(events(spark, sf_dir))).select("user_id", rounded("out").alias("out"))
    SQL[f"{name}_resumed"] = SQL[name]


for what in "count sum mean rms std skew min max".split():
    add_reduction(f"ts_{what}", lambda old, new, what=what: S.from_moments(S.moment_state(new, BY, "v", S.moment_state(old, BY, "v")), BY, what))
add_reduction("ts_cor", lambda old, new: old.unionByName(new).select("user_id").distinct().join(S.cor_from_state(S.pair_state(new, BY, "v", "b", S.pair_state(old, BY, "v", "b")), BY), "user_id", "left"))

# --- fills -----------------------------------------------------------------------------------------------------------------

add("ffill", lambda d: fills.ffill(d, "v", AXIS), lambda old, new: S.ffill(new, S.fill_state(old, "v", AXIS), "v", AXIS))
add("ffill_limit_decay", lambda d: fills.ffill(d, "v", AXIS, 2, 0, 3), lambda old, new: S.ffill(new, S.fill_state(old, "v", AXIS), "v", AXIS, 2, 0, 3))
add("staleness", lambda d: fills.with_staleness(d, "v", AXIS, "out"), lambda old, new: S.staleness(new, S.fill_state(old, "v", AXIS), "v", AXIS, "out"))

# --- decayed moments -------------------------------------------------------------------------------------------------------

for name in ("ewma", "ewmrms", "ewmvar", "ewmstd", "ewmskew"):
    run = getattr(ewm, name)
    add(name, lambda d, run=run: run(d, "v", AXIS, 7), lambda old, new, run=run: run(new, "v", AXIS, 7, state=S.average_state(old, "v", AXIS, 7)))
add("ewma_clock", lambda d: ewm.ewma(d, "v", AXIS, 4, "d"), lambda old, new: ewm.ewma(new, "v", AXIS, 4, "d", state=S.average_state(old, "v", AXIS, 4, "d")))
add("ewmvol", lambda d: ewm.ewmvol(d, "v", AXIS, 7), lambda old, new: S.ewmvol(new, S.ewmvol_state(old, "v", AXIS, 7), "v", AXIS, 7))
add("ewmacd", lambda d: ewm.ewmacd(d, "v", AXIS, 2, 7), lambda old, new: S.ewmacd(new, S.ewmacd_state(old, "v", AXIS, 2, 7), "v", AXIS, 2, 7))

# --- pairs -----------------------------------------------------------------------------------------------------------------


def add_pairs(name: str, run: Callable, rows: Callable[[DataFrame], DataFrame], scale: int = 1) -> None:
    """run(panel, state, ffill); rows(panel): the common rows of each pair."""

    def resumed(panel: DataFrame) -> DataFrame:
        levels = P.LEVELLED(panel)
        old, new = halves(levels, "t")
        both = run(old, None).unionByName(run(new, pairs.pair_state(rows(old), "t", P.N)))
        return pairs.filled(both, levels, "t", ["c"]).withColumn("c", F.col("c") / scale)

    P.add_rows(f"{name}_resumed", resumed, ["i", "j", "t", "c"], f"SELECT i, j, t, {_r(f'c / {scale}')} AS c FROM ({SQL[name].replace('round(', '(').replace(NEAR, ')')})")


add_pairs("ewmcorrelation", lambda d, state: pairs.ewmcorrelation(d, "t", "s", "v", P.N, ffill=False, state=state), lambda d: pairs.pairs(d, "t", "s", "v"))
add_pairs("ewmcovariance", lambda d, state: pairs.ewmcovariance(d, "t", "s", "v", P.N, ffill=False, state=state), lambda d: pairs.pairs(d, "t", "s", "v", diagonal=True), 1000)
VIEWS = lambda d: d.where("s = 'view'")
add_pairs("ewmxcor", lambda d, state: pairs.ewmxcor(d, VIEWS(d), "t", "s", "v", P.N, ffill=False, state=state).where("i <> j"), lambda d: pairs.pairs(d, "t", "s", "v", other=VIEWS(d)))

# --- folds -----------------------------------------------------------------------------------------------------------------

STEPS = {
    "buffer": (sequential.buffer_fold(7.0), ["v", "band"]), "zmooth": (sequential.zmooth_fold(5, 1.5), ["v", "none"]),
    "ewmrms_max_move": (sequential.clipped_fold(5, 1.2), ["v", "none"]), "ewmstd_max_move": (sequential.clipped_fold(5, 1.2, rms=False), ["v", "none"]),
}
for name, (steps, inputs) in STEPS.items():
    prepare = lambda e: e.withColumn("band", F.lit(60.0)).withColumn("none", F.lit(None).cast("double"))
    add(name, P.FOLDS[name], lambda old, new, name=name, steps=steps, inputs=inputs: P.FOLDS[name](new, state=sequential.fold_state(old, AXIS, *steps, inputs)), prepare)


def _persisted(e: DataFrame) -> DataFrame:
    """Only rows later than those done are computed, and appended to them."""
    old, _ = halves(e)
    done = ewm.ewma(old, "v", AXIS, 7)
    later = ewm.ewma(new_rows(e, done, BY, "ts"), "v", AXIS, 7, state=S.average_state(old, "v", AXIS, 7))
    return appended(done, later, BY, "ts").select("event_id", rounded("out").alias("out"))


QUERIES["persist_data"] = lambda spark, sf_dir: _persisted(events(spark, sf_dir))
SQL["persist_data"] = SQL["ewma"]
