"""The registered queries of the time-series operators, each with its SQL for DuckDB.

Series: `events` by user in time, the value missing where the event is an error. Panels: values of `lineitem` summed by
supplier and day, and of `orders` by priority and day. Floats are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fills
from tidemark.functions import windows as W
from tidemark.functions.axis import Axis, where_valid
from tidemark.operators import clocks, ewm, sequential
from tidemark.sources.series import series, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AXIS = Axis("user_id", ["ts", "event_id"])
E_SQL = """e AS (
    SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS v,
        CASE WHEN event_type <> 'error' AND event_type <> 'view' THEN value * value END AS b,
        CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN 0.0 ELSE value END AS z,
        date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) AS day
    FROM events)"""
VALID = "(PARTITION BY user_id, v IS NULL ORDER BY ts, event_id {})"
ROWS = "(PARTITION BY user_id ORDER BY ts, event_id {})"
UPTO, BACK = "ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
AHEAD = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value").cast("double")
    return e.select(
        "user_id", "ts", "event_id", F.when(kind != "error", value).alias("v"), F.when((kind != "error") & (kind != "view"), value * value).alias("b"),
        F.when(kind == "error", None).when(kind == "click", F.lit(0.0)).otherwise(value).alias("z"),
    )


#: Added before rounding, so that exact halves, which engines round in different ways, are off the edge.
EDGE = "1.37e-7"
NEAR = f" + {EDGE}, 6) + 0.0"


def rounded(c: str | Column) -> Column:
    return F.round((c if isinstance(c, Column) else F.col(c)) + F.lit(float(EDGE)), 6) + 0.0


def _r(sql: str) -> str:
    return f"round({sql}{NEAR}"


def add(name: str, run: Callable[[DataFrame], DataFrame], sql: str, source=events) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(source(spark, sf_dir))
    SQL[name] = sql


def add_column(name: str, make: Callable[[], Column], sql: str, ctes: str = E_SQL, frm: str = "e") -> None:
    """A query of event_id and one result for each event."""
    add(name, lambda e: e.select("event_id", rounded(make()).alias("out")), f"WITH {ctes} SELECT event_id, {_r(sql)} AS out FROM {frm}")


def add_frame(name: str, make: Callable[[DataFrame], DataFrame], sql: str, ctes: str = E_SQL, frm: str = "e") -> None:
    add(name, lambda e: make(e).select("event_id", rounded("out").alias("out")), f"WITH {ctes} SELECT event_id, {_r(sql)} AS out FROM {frm}")


def if_valid(x: str, n: int = 1) -> str:
    return f"CASE WHEN v IS NOT NULL AND row_number() OVER {VALID.format('')} >= {n} THEN {x} END"


def skew_sql(count: str, m: Callable[[int], str], bias: bool = False) -> str:
    mean = m(1)
    var = f"({m(2)} - {mean} * {mean})"
    biased = f"(({m(3)} - 3 * {mean} * {m(2)} + 2 * {mean} * {mean} * {mean}) / pow({var}, 1.5))"
    return f"CASE WHEN {var} > 1e-9 THEN {biased} * " + (f"CASE WHEN {count} > 2 THEN sqrt({count} * ({count} - 1.0)) / ({count} - 2) ELSE 1 END END" if not bias else "1 END")


# --- fills and positions ----------------------------------------------------------------------------------------------

POS = f", p AS (SELECT *, row_number() OVER {ROWS.format('')} - 1 AS pos FROM e)"
for name, column, test in (("fnna", "v", "v IS NOT NULL"), ("fnnz", "z", "z IS NOT NULL AND z <> 0")):
    for n, order in ((2, "ASC"), (-1, "DESC")):
        add(
            f"{name}_{'first' if n > 0 else 'last'}",
            lambda e, n=n, name=name, column=column: getattr(fills, name)(e, column, AXIS, n),
            f"WITH {E_SQL}{POS} SELECT user_id, CAST(max(pos) FILTER (k = {abs(n)}) AS BIGINT) AS pos FROM (SELECT user_id, pos, CASE WHEN {test} THEN row_number() OVER (PARTITION BY user_id, {test} ORDER BY pos {order}) END AS k FROM p) GROUP BY user_id",
        )
LAST_V, NEXT_V = f"last_value(v IGNORE NULLS) OVER {ROWS.format(UPTO)}", f"first_value(v IGNORE NULLS) OVER {ROWS.format(AHEAD)}"
STALE = f"{POS}, s AS (SELECT *, pos - coalesce(max(CASE WHEN v IS NOT NULL THEN pos END) OVER {ROWS.format(UPTO)}, -1) AS stale, min(CASE WHEN v IS NOT NULL THEN pos END) OVER {ROWS.format(AHEAD)} - pos AS ahead, {LAST_V} AS lv, {NEXT_V} AS nv FROM p)"
add_frame("ffill", lambda e: fills.ffill(e, "v", AXIS), "lv", E_SQL + STALE, "s")
add_frame("ffill_limit_decay", lambda e: fills.ffill(e, "v", AXIS, 2, 0, 3), "CASE WHEN stale <= 2 THEN lv * greatest(0.0, least(1.0, 1 - stale / 3.0)) END", E_SQL + STALE, "s")
add_frame("bfill", lambda e: fills.bfill(e, "v", AXIS), "nv", E_SQL + STALE, "s")
add_frame("bfill_limit", lambda e: fills.bfill(e, "v", AXIS, 1), "CASE WHEN ahead <= 1 THEN nv END", E_SQL + STALE, "s")
add_frame("staleness", lambda e: fills.with_staleness(e, "v", AXIS, "out"), "CAST(stale AS DOUBLE)", E_SQL + STALE, "s")
SIDE = "coalesce({0} * pow({1}, {2}) + (1 - pow({1}, {2})) * 7.0, 7.0)"
add_frame(
    "ewfill", lambda e: fills.ewfill(e, "v", AXIS, 3, 0.5, 7.0),
    f"coalesce(v, 0.5 * {SIDE.format('lv', '0.75', 'stale')} + 0.5 * {SIDE.format('nv', '0.5', 'ahead')})", E_SQL + STALE, "s",
)
add_column("v2na", lambda: fills.v2na("z"), "CASE WHEN z = 0 THEN NULL ELSE z END")
add_column("na2v", lambda: fills.na2v("v", 5.0), "coalesce(v, 5.0)")
add_column("init2v", lambda: fills.init2v("v", AXIS, 2, -1.0), f"CASE WHEN v IS NOT NULL AND row_number() OVER {VALID.format('')} <= 2 THEN -1.0 ELSE v END")
add_column("fnna_like", lambda: fills.fnna_like("v", AXIS, F.col("z")), f"CASE WHEN count(v) OVER {ROWS.format(UPTO)} > 0 THEN z END")

# --- shift, difference, ratio, running --------------------------------------------------------------------------------

LAG, LEAD = "lag(v, {}) OVER " + VALID.format(""), "lead(v, {}) OVER " + VALID.format("")
add_column("shift", lambda: W.shift("v", AXIS, 2), if_valid(LAG.format(2)))
add_column("shift_back", lambda: W.shift("v", AXIS, -1), if_valid(LEAD.format(1)))
add_column("diff", lambda: W.diff("v", AXIS), if_valid("v - " + LAG.format(1)))
add_column("diff_back", lambda: W.diff("v", AXIS, -2), if_valid("v - " + LEAD.format(2)))
add_column("ratio", lambda: W.ratio("v", AXIS), if_valid(f"v / nullif({LAG.format(1)}, 0)"))
add(
    "cumprod", lambda e: e.select("event_id", rounded(W.cumprod("x", AXIS)).alias("out")), f"WITH {E_SQL} SELECT event_id, {_r(if_valid(f'product(1 + v / 10000) OVER {VALID.format(UPTO)}'))} AS out FROM e",
    lambda s, d: events(s, d).withColumn("x", 1 + F.col("v") / 10000),
)
for name, agg in (("sum", "sum(v)"), ("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("max", "max(v)"), ("median", "quantile_cont(v, 0.5)")):
    add_column(f"expanding_{name}", lambda f=getattr(W, f"expanding_{name}"): f("v", AXIS), if_valid(f"{agg} OVER {VALID.format(UPTO)}"))
    add_column(f"rolling_{name}", lambda f=getattr(W, f"rolling_{name}"): f("v", AXIS, 10), if_valid(f"{agg} OVER {VALID.format(BACK.format(9))}", 10))
add_frame("expanding_median", lambda e: sequential.expanding_median(e, "v", AXIS), if_valid(f"quantile_cont(v, 0.5) OVER {VALID.format(UPTO)}"))
add_column("cumsum", lambda: W.cumsum("v", AXIS), if_valid(f"sum(v) OVER {VALID.format(UPTO)}"))
add_column("expanding_rms", lambda: W.expanding_rms("v", AXIS), if_valid(f"sqrt(avg(v * v) OVER {VALID.format(UPTO)})"))
add_column("rolling_rms", lambda: W.rolling_rms("v", AXIS, 10), if_valid(f"sqrt(avg(v * v) OVER {VALID.format(BACK.format(9))})", 10))
for name, frame, n, f in (("expanding_skew", UPTO, 3, lambda: W.expanding_skew("v", AXIS)), ("rolling_skew", BACK.format(9), 10, lambda: W.rolling_skew("v", AXIS, 10))):
    add_column(name, f, if_valid(skew_sql(f"(count(v) OVER {VALID.format(frame)})", lambda k, frame=frame: f"(avg(pow(v, {k})) OVER {VALID.format(frame)})"), n))
RANK = "CASE WHEN len(l) = 1 THEN 0.0 ELSE 2 * (len(list_filter(l, lambda x: x < v)) + (len(list_filter(l, lambda x: x = v)) - 1) / 2.0) / (len(l) - 1.0) - 1 END"
for name, frame, n, f in (("expanding_rank", UPTO, 1, lambda e: sequential.expanding_rank(e, "v", AXIS)), ("rolling_rank", BACK.format(9), 10, lambda e: e.withColumn("out", W.rolling_rank("v", AXIS, 10)))):
    add_frame(name, f, f"CASE WHEN v IS NOT NULL AND k >= {n} THEN {RANK} END", f"{E_SQL}, l AS (SELECT event_id, v, row_number() OVER {VALID.format('')} AS k, list(v) OVER {VALID.format(frame)} AS l FROM e)", "l")
add_column("rolling_quantile", lambda: W.rolling_quantile("v", AXIS, 10, 0.3), if_valid(f"quantile_cont(v, 0.3) OVER {VALID.format(BACK.format(9))}", 10))
add_column("rolling_quantile_ramp", lambda: W.rolling_quantile("v", AXIS, 10, 0.75, 3), if_valid(f"quantile_cont(v, 0.75) OVER {VALID.format(BACK.format(9))}", 3))
add_column("rolling_quantile_lower", lambda: W.rolling_quantile("v", AXIS, 10, 0.33, None, "lower"), "CASE WHEN v IS NOT NULL AND k >= 10 THEN list_sort(l)[CAST(floor(0.33 * (len(l) - 1)) AS BIGINT) + 1] END", f"{E_SQL}, l AS (SELECT event_id, v, row_number() OVER {VALID.format('')} AS k, list(v) OVER {VALID.format(BACK.format(9))} AS l FROM e)", "l")
add_frame(
    "rolling_tover", lambda e: W.rolling_turnover(e, "v", AXIS, 8),
    f"CASE WHEN q > 0 THEN t / (8 / 260.0) / sqrt(q / 8) END",
    f"{E_SQL}, h AS (SELECT *, coalesce({LAST_V}, 0) AS p FROM e), t AS (SELECT *, abs(p - coalesce(lag(p) OVER {ROWS.format('')}, 0)) AS d FROM h), "
    f"s AS (SELECT event_id, sum(d) OVER {ROWS.format(BACK.format(6))} AS t, sum(p * p) OVER {ROWS.format(BACK.format(6))} AS q FROM t)", "s",
)

# --- reductions -------------------------------------------------------------------------------------------------------


def add_reduction(name: str, make: Callable[[], Column], sql: str) -> None:
    add(name, lambda e: e.groupBy("user_id").agg(rounded(make()).alias("out")), f"WITH {E_SQL} SELECT user_id, {_r(sql)} AS out FROM e GROUP BY user_id")


for name, sql in (("count", "count(v)"), ("sum", "coalesce(sum(v), 0)"), ("mean", "avg(v)"), ("rms", "sqrt(avg(v * v))"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("max", "max(v)"), ("median", "quantile_cont(v, 0.5)")):
    add_reduction(f"ts_{name}", lambda f=getattr(W, f"ts_{name}"): f("v"), sql)
add_reduction("ts_skew", lambda: W.ts_skew("v"), skew_sql("count(v)", lambda k: f"avg(pow(v, {k}))"))
add_reduction("ts_cor", lambda: W.ts_cor("v", "b"), "CASE WHEN count(b) > 3 THEN corr(v, b) END")
add(
    "ts_interval", lambda e: W.ts_interval(e.withColumn("ts", F.date_trunc("hour", "ts")), "user_id", "ts", 0.3).withColumn("seconds", rounded("seconds")),
    f"""WITH {E_SQL}, g AS (SELECT user_id, (epoch_us(date_trunc('hour', ts)) - epoch_us(lag(date_trunc('hour', ts)) OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts)))) / 1e6 AS g FROM e),
    c AS (SELECT user_id, g, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, g) AS k FROM g WHERE g IS NOT NULL GROUP BY user_id, g),
    m AS (SELECT user_id, quantile_cont(g, 0.5) AS m FROM g GROUP BY user_id)
    SELECT user_id, {_r("CASE WHEN n >= 0.3 * a THEN c.g ELSE m END")} AS seconds FROM m LEFT JOIN c USING (user_id) WHERE k = 1 OR k IS NULL""",
)

# --- clocks -----------------------------------------------------------------------------------------------------------

TICKS = f""", k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, v IS NULL ORDER BY day) AS seq, lead(day) OVER {VALID.format('')} IS DISTINCT FROM day AS fin FROM e),
f AS (SELECT k.event_id, k.v, k.seq, j.v AS u, j.seq AS useq FROM k LEFT JOIN k j ON j.user_id = k.user_id AND j.v IS NOT NULL AND j.fin AND j.seq < k.seq WHERE k.v IS NOT NULL),
g AS (SELECT event_id, any_value(v) AS v, any_value(seq) AS seq, max(u) FILTER (useq = seq - 1) AS u1, max(u) FILTER (useq = seq - 2) AS u2,
    coalesce(sum(u) FILTER (useq > seq - 3), 0) AS s1, coalesce(sum(u * u) FILTER (useq > seq - 3), 0) AS s2, coalesce(sum(u * u * u) FILTER (useq > seq - 3), 0) AS s3 FROM f GROUP BY event_id),
o AS (SELECT e.event_id, g.v, seq, u1, u2, s1 + g.v AS s1, s2 + g.v * g.v AS s2, s3 + g.v * g.v * g.v AS s3 FROM e LEFT JOIN g USING (event_id))"""


def add_clock(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add_frame(name, make, sql, E_SQL + TICKS, "o")


add_clock("diff_clock", lambda e: clocks.diff(e, "v", AXIS, "d", 2), "v - u2")
add_clock("ratio_clock", lambda e: clocks.ratio(e, "v", AXIS, "d", 1), "v / nullif(u1, 0)")
for name, sql in (("sum", "s1"), ("mean", "s1 / 3"), ("rms", "sqrt(s2 / 3)"), ("std", "sqrt(greatest(0, s2 / 2 - s1 * s1 / 6))"), ("skew", skew_sql("3", lambda k: f"(s{k} / 3)"))):
    add_clock(f"rolling_{name}_clock", lambda e, f=getattr(clocks, f"rolling_{name}"): f(e, "v", AXIS, 3, "d"), f"CASE WHEN seq >= 3 THEN {sql} END")

# --- exponentially weighted -------------------------------------------------------------------------------------------


def moments_sql(n: float, value: str = "v", tick: str = "seq", wgt: str = "1.0") -> str:
    """CTE m: the moments by their definition, a join of each observation with those before it."""
    w = n / (n + 1) if n >= 1 else n
    k = f"SELECT *, {value} AS x, {wgt} AS g, row_number() OVER (PARTITION BY user_id, {value} IS NULL ORDER BY ts, event_id) AS seq FROM e"
    k = f"SELECT *, {'true' if tick == 'seq' else f'lead({tick}) OVER (PARTITION BY user_id, x IS NULL ORDER BY ts, event_id) IS DISTINCT FROM {tick}'} AS fin FROM ({k})"
    a = f"pow({w}, k.{tick} - j.{tick}) * {1 - w} * j.g"
    sums = ", ".join(f"sum({a} * pow(j.x, {i})) AS t{i}" for i in range(4))
    return f""", k AS ({k}), m AS (SELECT k.event_id, any_value(k.x) AS x, {sums}, sum(pow({a}, 2)) AS w2, sum(pow({w}, k.{tick} - j.{tick}) * {1 - w}) AS n0, count(*) AS n1
    FROM k JOIN k j ON j.user_id = k.user_id AND j.x IS NOT NULL AND (j.event_id = k.event_id OR (j.fin AND j.{tick} < k.{tick})) WHERE k.x IS NOT NULL GROUP BY k.event_id),
    o AS (SELECT e.event_id, e.user_id, e.ts, e.v, e.z, m.* EXCLUDE (event_id) FROM e LEFT JOIN m USING (event_id))"""


VAR = "(t2 / t0 - (t1 / t0) * (t1 / t0))"
UNBIASED = f"CASE WHEN n0 >= 0.25 AND n1 >= 3 AND {VAR} >= 0 AND w2 / (t0 * t0) < 1 THEN {VAR} / (1 - w2 / (t0 * t0)) END"
EWM_SKEW = skew_sql("({d} * t0)", lambda k: f"(t{k} / t0)")
add_frame("ewma", lambda e: ewm.ewma(e, "v", AXIS, 7), "t1 / t0", E_SQL + moments_sql(7), "o")
add_frame("ewma_clock", lambda e: ewm.ewma(e, "v", AXIS, 4, "d"), "t1 / t0", E_SQL + moments_sql(4, tick="day"), "o")
add_frame("ewma_weighted", lambda e: ewm.ewma(e.withColumn("g", 1 + F.col("v") / 100), "v", AXIS, 0.9, wgt="g"), "t1 / t0", E_SQL + moments_sql(0.9, wgt="(1 + v / 100)"), "o")
add_frame("ewmrms", lambda e: ewm.ewmrms(e, "v", AXIS, 7), "sqrt(t2 / t0)", E_SQL + moments_sql(7), "o")
add_frame("ewmrms_exc_zero", lambda e: ewm.ewmrms(e, "z", AXIS, 5, exc_zero=True), f"CASE WHEN z IS NOT NULL THEN last_value(sqrt(t2 / t0) IGNORE NULLS) OVER {ROWS.format(UPTO)} END", E_SQL + moments_sql(5, "nullif(z, 0)"), "o")
add_frame("ewmstd", lambda e: ewm.ewmstd(e, "v", AXIS, 7), f"sqrt({UNBIASED})", E_SQL + moments_sql(7), "o")
add_frame("ewmvar", lambda e: ewm.ewmvar(e, "v", AXIS, 7), f"CASE WHEN n0 >= 0.25 AND n1 >= 3 THEN {VAR} END", E_SQL + moments_sql(7), "o")
add_frame("ewmskew", lambda e: ewm.ewmskew(e, "v", AXIS, 7), f"CASE WHEN n0 >= 0.25 AND n1 >= 4 THEN {EWM_SKEW.format(d=8)} END".replace("{d}", "8"), E_SQL + moments_sql(7), "o")
CHANGE = f"(v - lag(v) OVER {VALID.format('')})"
CHANGED = E_SQL.replace("e AS (", "e0 AS (") + f", e AS (SELECT * EXCLUDE (v), v AS price, CASE WHEN v IS NOT NULL THEN {CHANGE} END AS v FROM e0)"
add_frame("ewmvol", lambda e: ewm.ewmvol(e, "v", AXIS, 7), "sqrt(t2 / t0)", CHANGED + moments_sql(7), "o")
MEAN_CTES = moments_sql(2).replace(" k AS", " k1 AS").replace("FROM k JOIN k j", "FROM k1 k JOIN k1 j").replace(" m AS", " m1 AS").replace("LEFT JOIN m ", "LEFT JOIN m1 ").replace("m.*", "m1.*").replace(" o AS", " o1 AS")
add_frame(
    "ewmacd", lambda e: ewm.ewmacd(e, "v", AXIS, 2, 7), f"(o1.t1 / o1.t0 - o.t1 / o.t0) / {ewm.ou_factor(2, 7)!r}",
    E_SQL + MEAN_CTES + moments_sql(7), "o JOIN o1 USING (event_id)",
)
QUERIES["ou_factor"] = lambda spark, _: spark.createDataFrame([(f, s, ewm.ou_factor(f, s)) for f in range(2, 20) for s in range(f + 1, 40)], "fast int, slow int, out double").withColumn("out", rounded("out"))
SQL["ou_factor"] = f"SELECT CAST(a AS INTEGER) AS fast, CAST(b AS INTEGER) AS slow, {_r('sqrt(f * f / (1 - f * f) + s * s / (1 - s * s) - 2 * f * s / (1 - f * s))')} AS out FROM (SELECT a, b, 1 - 1 / (1.0 + a) AS f, 1 - 1 / (1.0 + b) AS s FROM range(2, 20) x(a), range(3, 40) y(b) WHERE b > a)"
add_frame("ewma_quarters", lambda e: ewm.ewma(e, "v", AXIS, 4, "q"), "t1 / t0", E_SQL.replace("FROM events)", ", year(ts) * 4 + quarter(ts) AS quarter FROM events)") + moments_sql(4, tick="quarter"), "o")
