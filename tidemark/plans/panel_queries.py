"""Registered queries over panels, matrices, bars and positions, with their SQL where SQL can say it.

Panel: values of `events` summed by event type and hour, as returns; levels are their running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.axis import Axis
from tidemark.operators import crosssection as X
from tidemark.operators import ewm, matrices, pairs, sequential
from tidemark.plans.queries import AXIS, NEAR, QUERIES, SQL, _r, add, add_frame, events, rounded
from tidemark.sources.series import as_of, full_panel, reindex_matrices, resampled, table

PANEL_SQL = "p AS (SELECT event_type AS s, date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY ALL)"
N = 20
DECAY, OWN = N / (N + 1), 1 - N / (N + 1)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("s"), F.date_trunc("hour", "ts").alias("t")).agg(F.sum(F.col("value").cast("double")).alias("v"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_panel(panel(spark, sf_dir), "t", "s", "v")


def add_rows(name: str, run, columns: list[str], sql: str | None, source=panel) -> None:
    QUERIES[name] = lambda spark, sf_dir: (lambda d: d.select(*(rounded(c).alias(c) if kind == "double" else F.col(c) for c, kind in d.dtypes if c in columns)))(run(source(spark, sf_dir)))
    if sql:
        SQL[name] = sql


LEVELS = "l AS (SELECT s, t, sum(v) OVER (PARTITION BY s ORDER BY t) AS v FROM p)"


def pair_sql(value: str, level: str, on: str, gate: str = "n0 >= 0.25", ffill: bool = True, times: str = "p") -> str:
    moments = ", ".join(f"sum(pow({DECAY}, a.k - b.k) * {OWN} * {x}) AS {n}" for n, x in (("t0", "1"), ("a1", "b.dx"), ("a2", "b.dx * b.dx"), ("b1", "b.dy"), ("b2", "b.dy * b.dy"), ("ab", "b.dx * b.dy")))
    fill = "last_value(c IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY t ROWS UNBOUNDED PRECEDING)" if ffill else "c"
    return f"""WITH {PANEL_SQL}, {LEVELS},
    q AS (SELECT a.s AS i, b.s AS j, a.t, a.v AS x, b.v AS y FROM {level} a JOIN {level} b ON a.t = b.t AND a.s {on} b.s),
    d AS (SELECT i, j, t, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, row_number() OVER w AS k FROM q WINDOW w AS (PARTITION BY i, j ORDER BY t)),
    m AS (SELECT a.i, a.j, a.t, {moments}, sum(pow({DECAY}, 2 * (a.k - b.k)) * {OWN * OWN}) AS w2, sum(pow({DECAY}, a.k - b.k) * {OWN}) AS n0
        FROM d a JOIN d b ON a.i = b.i AND a.j = b.j AND b.k <= a.k AND b.dx IS NOT NULL WHERE a.dx IS NOT NULL GROUP BY a.i, a.j, a.t),
    c AS (SELECT i, j, t, CASE WHEN {gate} THEN {value} END AS c FROM m),
    g AS (SELECT i, j, t FROM (SELECT DISTINCT i, j FROM c) CROSS JOIN (SELECT DISTINCT t FROM {times}))
    SELECT i, j, t, {_r(fill)} AS c FROM g LEFT JOIN c USING (i, j, t)"""


COV = "(ab / t0 - (a1 / t0) * (b1 / t0))"
VA, VB = "(a2 / t0 - (a1 / t0) * (a1 / t0))", "(b2 / t0 - (b1 / t0) * (b1 / t0))"
R = "(1 - w2 / (t0 * t0))"
BIASED = f"CASE WHEN {VA} > 0 AND {VB} > 0 THEN {COV} / sqrt({VA} * {VB}) END"
UNBIASED = f"CASE WHEN {VA} > 0 AND {VB} > 0 AND {R} > 0 THEN {COV} / sqrt({VA} / {R} * {VB} / {R}) END"
LEVELLED = lambda d: pairs.levels(d, "t", "s", "v")
add_rows("ewmxcor", lambda d: pairs.ewmxcor(LEVELLED(d), LEVELLED(d).where("s = 'view'"), "t", "s", "v", N).where("i <> j"), ["i", "j", "t", "c"], pair_sql(BIASED, "l", "<> b.s AND b.s = 'view' AND a.s <>"))
add_rows("ewmcorrelation", lambda d: pairs.ewmcorrelation(LEVELLED(d), "t", "s", "v", N), ["i", "j", "t", "c"], pair_sql(UNBIASED, "l", "<"))
add_rows("ewmcorr", lambda d: pairs.ewmcorr(d, "t", "s", "v", N), ["i", "j", "t", "c"], pair_sql(UNBIASED, "l", "<"))
add_rows("ewmcovariance", lambda d: pairs.ewmcovariance(LEVELLED(d), "t", "s", "v", N), ["i", "j", "t", "c"], pair_sql(COV, "l", "<="))
add_rows("ewmcovar", lambda d: pairs.ewmcovar(d, "t", "s", "v", N), ["i", "j", "t", "c"], pair_sql(COV, "l", "<="))
add_rows("ewmx_lr", lambda d: pairs.ewmx_lr(LEVELLED(d).where("s = 'click'"), LEVELLED(d).where("s = 'view'"), "t", "s", "v", N).select("i", "j", "t", F.col("m").alias("c")), ["i", "j", "t", "c"], pair_sql(f"CASE WHEN {VA} > 0 THEN {COV} / {VA} END", "l", "<> b.s AND a.s = 'click' AND b.s = 'view' AND a.s <>", times="p WHERE s IN ('click', 'view')"))
GRID_SQL = f"{PANEL_SQL}, g AS (SELECT s, t, v FROM (SELECT DISTINCT t FROM p) CROSS JOIN (SELECT DISTINCT s FROM p) LEFT JOIN p USING (s, t))"
add_rows(
    "overlapping_returns", lambda d: pairs.overlapping_returns(d, "t", "s", "v", 3), ["s", "t", "out"],
    f"WITH {GRID_SQL} SELECT s, t, {_r('CASE WHEN row_number() OVER (PARTITION BY s ORDER BY t) >= 3 THEN sum(v) OVER (PARTITION BY s ORDER BY t ROWS 2 PRECEDING) END')} AS out FROM g", grid,
)
add_rows(
    "ewmcorr_psd", lambda d: pairs.ewmcorr_psd(d, "t", "s", "v", N, demean=False), ["i", "j", "t", "c"],
    f"""WITH {GRID_SQL}, n AS (SELECT s, t, v, count(v) OVER (PARTITION BY s ORDER BY t) AS k FROM g),
    q AS (SELECT a.s AS i, b.s AS j, a.t, a.v * b.v AS x, (a.k + b.k) / 2.0 AS e, a.k AS ka, b.k AS kb FROM n a JOIN n b ON a.t = b.t AND a.s <= b.s),
    m AS (SELECT a.i, a.j, a.t, any_value(a.ka) AS ka, any_value(a.kb) AS kb, sum(pow({DECAY}, a.e - b.e) * {OWN} * b.x) AS s FROM q a JOIN q b ON a.i = b.i AND a.j = b.j AND b.t <= a.t GROUP BY a.i, a.j, a.t),
    d AS (SELECT i, t, s, 1 - pow({DECAY}, ka) AS w FROM m WHERE i = j)
    SELECT m.i, m.j, m.t, {_r(f"CASE WHEN x.s > 0 AND y.s > 0 AND x.w >= 0.25 AND y.w >= 0.25 THEN CASE WHEN m.i = m.j THEN 1.0 ELSE m.s / (sqrt(x.s) * sqrt(y.s)) END END")} AS c
    FROM m JOIN d x ON x.i = m.i AND x.t = m.t JOIN d y ON y.i = m.j AND y.t = m.t""", grid,
)


def weights():
    return F.when(F.col("s") == "view", 0.5).when(F.col("s") == "error", -0.3).otherwise(0.25)


add_rows(
    "ewmcombine", lambda d: pairs.ewmcombine(d.withColumn("v", F.col("v") / 100).withColumn("w", weights()), "t", "s", "v", "w", N), ["t", "data", "rho", "vol"],
    f"""WITH {GRID_SQL}, h AS (SELECT s, t, last_value(v / 100 IGNORE NULLS) OVER (PARTITION BY s ORDER BY t ROWS UNBOUNDED PRECEDING) AS a, CASE s WHEN 'view' THEN 0.5 WHEN 'error' THEN -0.3 ELSE 0.25 END AS w FROM g),
    u AS (SELECT t, sum(a * w) AS x, sum(w) AS w1, sum(w * w) AS w2, row_number() OVER (ORDER BY t) AS k FROM h WHERE a IS NOT NULL GROUP BY t),
    o AS (SELECT t, k, x, w2, w1 * w1 - w2 AS wij, CASE WHEN abs(w1 * w1 - w2) > 1e-12 THEN (x * x - w2) / (w1 * w1 - w2) END AS r FROM u),
    k AS (SELECT *, count(r) OVER (ORDER BY t) AS n FROM o),
    e AS (SELECT a.t, sum(pow({DECAY}, a.n - b.n) * b.r) / sum(pow({DECAY}, a.n - b.n)) AS rho FROM k a JOIN k b ON b.n <= a.n AND b.r IS NOT NULL WHERE a.r IS NOT NULL GROUP BY a.t),
    f AS (SELECT t, x, rho, CASE WHEN w2 + wij * rho > 0 THEN w2 + wij * rho END AS var FROM k LEFT JOIN e USING (t)),
    z AS (SELECT *, CASE WHEN var IS NOT NULL THEN lag(var) OVER (PARTITION BY var IS NULL ORDER BY t) END AS pv FROM f)
    SELECT t, {_r("x")} AS data, {_r("rho")} AS rho, {_r("sqrt(last_value(pv IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING))")} AS vol FROM z""", grid,
)
SIGNALS = lambda d: d.withColumn("v", F.col("v") / 100).withColumn("w", weights())
add_rows("ewmcombined", lambda d: pairs.ewmcombined(SIGNALS(d), "t", "s", "v", "w", N), ["t", "data"], f"WITH {GRID_SQL}, h AS (SELECT t, last_value(v / 100 IGNORE NULLS) OVER (PARTITION BY s ORDER BY t ROWS UNBOUNDED PRECEDING) AS a, CASE s WHEN 'view' THEN 0.5 WHEN 'error' THEN -0.3 ELSE 0.25 END AS w FROM g) SELECT t, {_r('coalesce(sum(a * w), 0)')} AS data FROM h GROUP BY t", grid)
add_rows(
    "rms_combine", lambda d: pairs.rms_combine(SIGNALS(d), "t", "s", "v", "w", N, 2.0), ["t", "data", "rho", "vol", "leverage"],
    f"""WITH {GRID_SQL}, h AS (SELECT t, v / 100 AS a, CASE s WHEN 'view' THEN 0.5 WHEN 'error' THEN -0.3 ELSE 0.25 END AS w FROM g WHERE v IS NOT NULL),
    u AS (SELECT t, sum(a * w) AS x, sum(a * w * a * w) AS x2, sum(w * w) AS w2, sum(abs(w)) AS wa, row_number() OVER (ORDER BY t) AS k FROM h GROUP BY t),
    o AS (SELECT *, wa * wa - w2 AS wij, CASE WHEN abs(wa * wa - w2) > 1e-12 THEN (x2 - w2) / (wa * wa - w2) END AS p FROM u),
    q AS (SELECT *, count(p) OVER (ORDER BY t) AS n FROM o), z AS (SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN n <= 6 THEN 0 ELSE p END END AS r FROM q),
    y AS (SELECT a.t, greatest(-1, least(1, sum(pow({DECAY}, a.n - b.n) * b.r) / sum(pow({DECAY}, a.n - b.n)))) AS rho FROM z a JOIN z b ON b.n <= a.n AND b.r IS NOT NULL WHERE a.r IS NOT NULL GROUP BY a.t),
    f AS (SELECT z.t, x, wa, rho, greatest(0, w2 + rho * wij) AS var FROM z LEFT JOIN y USING (t)), l AS (SELECT *, CASE WHEN rho IS NOT NULL THEN CASE WHEN var > 0 THEN least(wa / sqrt(var), 2.0) ELSE 2.0 END END AS leverage FROM f)
    SELECT t, {_r("x / (wa / leverage)")} AS data, {_r("rho")} AS rho, {_r("wa / leverage")} AS vol, {_r("leverage")} AS leverage FROM l""", grid,
)
TAIL = "CASE WHEN vol > 0 THEN CASE WHEN a.v > b.v THEN 1 - exp(-abs(a.v - b.v) / vol) / 2 ELSE exp(-abs(a.v - b.v) / vol) / 2 END ELSE 0.5 END"
add_rows(
    "xrank", lambda d: X.xrank(d, "t", "s", "v"), ["s", "t", "out"],
    f"WITH {PANEL_SQL}, q AS (SELECT t, count(*) AS n, sqrt(greatest(0, avg(v * v) - avg(v) * avg(v))) AS vol FROM p GROUP BY t) SELECT a.s, a.t, {_r(f'sum(CASE WHEN a.s = b.s THEN 0 ELSE 2 * ({TAIL}) - 1 END / n)')} AS out FROM p a JOIN p b ON a.t = b.t JOIN q ON q.t = a.t GROUP BY a.s, a.t",
)
add_rows(
    "xrank_hard", lambda d: X.xrank(d, "t", "s", "v", vol=0.0), ["s", "t", "out"],
    f"WITH {PANEL_SQL}, q AS (SELECT t, count(*) AS n FROM p GROUP BY t) SELECT a.s, a.t, {_r('sum(sign(a.v - b.v) / n)')} AS out FROM p a JOIN p b ON a.t = b.t JOIN q ON q.t = a.t GROUP BY a.s, a.t",
)

# --- matrices -----------------------------------------------------------------------------------------------------------

COVARIANCES = lambda d: pairs.ewmcovariance(LEVELLED(d), "t", "s", "v", N).where("c is not null")
CORRELATIONS = lambda d: pairs.symmetric(pairs.ewmcorrelation(LEVELLED(d), "t", "s", "v", N).where("c is not null"), unit_diagonal=True)
add_rows("normalise_diagonal", lambda d: X.normalise_diagonal(COVARIANCES(d), "t"), ["i", "j", "t", "c"], f"WITH c AS ({pair_sql(COV, 'l', '<=').replace('round(', '(').replace(NEAR, ')')}) SELECT c.i, c.j, c.t, {_r('c.c / sqrt(x.c * y.c)')} AS c FROM c LEFT JOIN c x ON x.t = c.t AND x.i = c.i AND x.j = c.i AND x.c > 0 LEFT JOIN c y ON y.t = c.t AND y.i = c.j AND y.j = c.j AND y.c > 0 WHERE c.c IS NOT NULL")
UPPER = f"c AS ({pair_sql(UNBIASED, 'l', '<').replace('round(', '(').replace(NEAR, ')')})"
CORR = lambda d: pairs.ewmcorrelation(LEVELLED(d), "t", "s", "v", N)
add_rows("encode_correlations", lambda d: CORR(d).withColumn("out", X.encode_correlation("c").cast("int")), ["i", "j", "t", "out"], f"WITH {UPPER} SELECT i, j, t, CAST(CASE WHEN c IS NOT NULL THEN round_even(greatest(least(c, 1), -1) * 100, 0) END AS INTEGER) AS out FROM c")
add_rows("decode_correlations", lambda d: CORR(d).withColumn("out", X.decode_correlation(X.encode_correlation("c", "int16"), "int16")), ["i", "j", "t", "out"], f"WITH {UPPER} SELECT i, j, t, {_r('CASE WHEN c IS NOT NULL THEN round_even(greatest(least(c, 1), -1) * 10000, 0) / 10000 END')} AS out FROM c")
add_rows("shrink_to_identity", lambda d: X.shrink_to_identity(CORR(d), 0.2), ["i", "j", "t", "c"], f"WITH {UPPER} SELECT i, j, t, {_r('c * 0.8')} AS c FROM c")
add_rows(
    "matmul", lambda d: X.quadratic_form(CORR(d), "t", d.select("t", F.col("s").alias("i"), (F.col("v") / 100).alias("w"))), ["t", "out"],
    f"WITH {UPPER}, w AS (SELECT event_type AS s, date_trunc('hour', ts) AS t, sum(value) / 100 AS v FROM events GROUP BY ALL) SELECT c.t, {_r('sum(a.v * c * b.v)')} AS out FROM c JOIN w a ON a.t = c.t AND a.s = i JOIN w b ON b.t = c.t AND b.s = j GROUP BY c.t",
)
# Whole matrices: what SQL can say of them is said by sums over their entries, or by roots of the characteristic polynomial.
FULL = f"""{UPPER}, h AS (SELECT DISTINCT t, s FROM (SELECT t, unnest([i, j]) AS s FROM c WHERE c IS NOT NULL)),
    u AS (SELECT a.t, a.s AS i, b.s AS j, coalesce(c, 0) AS c FROM h a JOIN h b ON a.t = b.t AND a.s < b.s LEFT JOIN c ON c.t = a.t AND c.i = a.s AND c.j = b.s),
    f AS (SELECT t, i, j, c FROM u UNION ALL SELECT t, j, i, c FROM u
    UNION ALL SELECT t, s, s, 1.0 FROM h),
    f2 AS (SELECT a.t, a.i, b.j, sum(a.c * b.c) AS c FROM f a JOIN f b ON a.t = b.t AND a.j = b.i GROUP BY ALL),
    s AS (SELECT t, p1, p2, p3, p4, p5, k FROM (SELECT t, sum(c) FILTER (i = j) AS p1, sum(c * c) AS p2, count(DISTINCT i) AS k FROM f GROUP BY t)
        JOIN (SELECT f.t, sum(f.c * f2.c) AS p3 FROM f JOIN f2 ON f2.t = f.t AND f2.i = f.i AND f2.j = f.j GROUP BY f.t) USING (t)
        JOIN (SELECT t, sum(c * c) AS p4 FROM f2 GROUP BY t) USING (t)
        JOIN (SELECT a.t, sum(a.c * b.c * f.c) AS p5 FROM f2 a JOIN f2 b ON a.t = b.t AND a.j = b.i JOIN f ON f.t = a.t AND f.i = b.j AND f.j = a.i GROUP BY a.t) USING (t)),
    e2 AS (SELECT *, p1 AS e1, (p1 * p1 - p2) / 2 AS e2 FROM s), e3 AS (SELECT *, (e2 * p1 - e1 * p2 + p3) / 3 AS e3 FROM e2),
    e4 AS (SELECT *, (e3 * p1 - e2 * p2 + e1 * p3 - p4) / 4 AS e4 FROM e3), e5 AS (SELECT *, (e4 * p1 - e3 * p2 + e2 * p3 - e1 * p4 + p5) / 5 AS e5 FROM e4)"""
CHARACTERISTIC = "CASE k WHEN 2 THEN x * x - e1 * x + e2 WHEN 3 THEN ((x - e1) * x + e2) * x - e3 WHEN 4 THEN (((x - e1) * x + e2) * x - e3) * x + e4 ELSE ((((x - e1) * x + e2) * x - e3) * x + e4) * x - e5 END"
SLOPE = "CASE k WHEN 2 THEN 2 * x - e1 WHEN 3 THEN (3 * x - 2 * e1) * x + e2 WHEN 4 THEN ((4 * x - 3 * e1) * x + 2 * e2) * x - e3 ELSE (((5 * x - 4 * e1) * x + 3 * e2) * x - 2 * e3) * x + e4 END"
#: The least root by Newton's steps from below, which never pass it.
LEAST_ROOT = FULL + f""", n AS (SELECT t, k, e1, e2, e3, e4, e5, CAST(-k AS DOUBLE) AS x, 0 AS step FROM e5
    UNION ALL SELECT t, k, e1, e2, e3, e4, e5, x - ({CHARACTERISTIC}) / ({SLOPE}), step + 1 FROM n WHERE step < 60 AND ({SLOPE}) <> 0)"""
add_rows("psd_correlation", lambda d: matrices.psd_correlation(CORRELATIONS(d), "t", shrinkage=0.1), ["i", "j", "t", "c"], None)
add_rows("clip_eigenvalues", lambda d: matrices.clipped(CORRELATIONS(d), "t", 1e-8), ["i", "j", "t", "c"], None)


def checked(matrix: DataFrame, least: float, trace: str) -> DataFrame:
    """Whether a repaired matrix is symmetric, has no eigenvalue below `least` and the diagonal that it should have."""
    twin = matrix.select("t", F.col("i").alias("j"), F.col("j").alias("i"), F.col("c").alias("twin"))
    same = matrix.join(twin, ["t", "i", "j"]).groupBy("t").agg(F.max(F.abs(F.col("c") - F.col("twin"))).alias("off"), F.expr(trace).alias("diagonal"), F.countDistinct("i").alias("k"))
    low = matrices.min_eigenvalues(matrix, "t")
    return same.join(low, "t").select("t", "k", ((F.col("off") < 1e-9) & F.col("diagonal") & (F.col("out") > least - 1e-9)).alias("fine"))


for name, make, least, trace in (
    ("psd_correlation", lambda d: matrices.psd_correlation(CORRELATIONS(d), "t", shrinkage=0.1), 0.1, "max(abs(CASE WHEN i = j THEN c - 1 ELSE 0 END)) < 1e-9"),
    ("clip_eigenvalues", lambda d: matrices.clipped(CORRELATIONS(d), "t", 1e-8), 1e-8, "sum(CASE WHEN i = j THEN c - 1 ELSE 0 END) > -1e-9"),
):
    add_rows(f"{name}_checks", lambda d, make=make, least=least, trace=trace: checked(make(d), least, trace), ["t", "k", "fine"], f"WITH {FULL} SELECT t, count(DISTINCT i) AS k, true AS fine FROM f GROUP BY t")
add_rows("min_eigenvalues", lambda d: matrices.min_eigenvalues(CORRELATIONS(d), "t").withColumn("out", F.round("out", 4)), ["t", "out"], f"WITH RECURSIVE {LEAST_ROOT} SELECT t, round(round(x, 4){NEAR} AS out FROM n QUALIFY row_number() OVER (PARTITION BY t ORDER BY step DESC) = 1")


def power_sums(d: DataFrame) -> DataFrame:
    """The sums of the powers 1 to 5 of five eigenvalues leave no doubt about any of them."""
    return matrices.eigenvalues(CORRELATIONS(d), "t").groupBy("t").agg(F.count("*").alias("k"), *(F.sum(F.pow("out", F.lit(float(k)))).alias(f"p{k}") for k in range(1, 6)))


def rebuilt(d: DataFrame) -> DataFrame:
    """Eigenvectors times eigenvalues times eigenvectors."""
    vectors = matrices.eigenvectors(CORRELATIONS(d), "t")
    a, b = (vectors.select("t", "k", F.col("i").alias(name), F.col("out").alias(f"v{name}")) for name in "ij")
    return a.join(b, ["t", "k"]).join(matrices.eigenvalues(CORRELATIONS(d), "t"), ["t", "k"]).groupBy("t", "i", "j").agg(F.sum(F.col("vi") * F.col("vj") * F.col("out")).alias("c"))


add_rows("eigenvalues", lambda d: matrices.eigenvalues(CORRELATIONS(d), "t"), ["t", "k", "out"], None)
add_rows("eigenvalues_power_sums", power_sums, ["t", "k", "p1", "p2", "p3", "p4", "p5"], f"WITH {FULL} SELECT t, k, {', '.join(f'{_r(p)} AS {p}' for p in ('p1', 'p2', 'p3', 'p4', 'p5'))} FROM s")
add_rows("eigenvectors", lambda d: matrices.eigenvectors(CORRELATIONS(d), "t"), ["t", "k", "i", "out"], None)
add_rows("eigenvectors_rebuilt", rebuilt, ["t", "i", "j", "c"], f"WITH {FULL} SELECT t, i, j, {_r('c')} AS c FROM f")
add_rows("det", lambda d: matrices.det(CORRELATIONS(d), "t"), ["t", "out"], f"WITH {FULL} SELECT t, {_r('CASE k WHEN 2 THEN e2 WHEN 3 THEN e3 WHEN 4 THEN e4 ELSE e5 END')} AS out FROM e5")
add_rows("riskparity", lambda d: matrices.riskparity(COVARIANCES(d), "t"), ["t", "i", "w"], None)


def contributions(d: DataFrame) -> DataFrame:
    """Each asset's share of the risk of the weights, and their sum, for matrices that are positive semi-definite by
    construction, so that every asset has a weight."""
    c = pairs.ewmcorr_psd(d, "t", "s", "v", N, demean=False, shrinkage=0.1).where("c is not null")
    w = matrices.riskparity(c, "t").where("w is not null")
    risk = pairs.symmetric(c).join(w, ["t", "i"]).join(w.select("t", F.col("i").alias("j"), F.col("w").alias("wj")), ["t", "j"]).groupBy("t", "i").agg(F.sum(F.col("w") * F.col("c") * F.col("wj")).alias("part"), F.first("w").alias("w"))
    every = Window.partitionBy("t")
    return risk.select("t", "i", F.round(F.col("part") / F.sum("part").over(every), 5).alias("share"), F.round(F.sum("w").over(every), 6).alias("weights"))


add_rows("riskparity_contributions", contributions, ["t", "i", "share", "weights"], f"SELECT t, i, round(round(1.0 / count(*) OVER (PARTITION BY t), 5){NEAR} AS share, {_r('1.0')} AS weights FROM ({SQL['ewmcorr_psd']}) WHERE i = j AND c IS NOT NULL", grid)


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of clicks, views and all the rest together, over the times that have them."""
    p = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("rest")
    sums = p.groupBy(kind.alias("s"), F.date_trunc("hour", "ts").alias("t")).agg(F.sum(F.col("value").cast("double")).alias("v"))
    return LEVELLED(sums).groupBy("t").pivot("s", ["click", "view", "rest"]).agg(F.first("v")).withColumn("k", F.lit(0))


WIDE_SQL = f"""p AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'rest' END AS s, date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY ALL), {LEVELS},
    w AS (SELECT t, max(v) FILTER (s = 'click') AS a, max(v) FILTER (s = 'view') AS b, max(v) FILTER (s = 'rest') AS y FROM l GROUP BY t)"""


def regression_sql(every: str) -> str:
    """Moments of the changes of clicks and views (and the rest) over the rows that have them all, and the inverse of two by two."""
    return f"""WITH {WIDE_SQL}, k AS (SELECT * FROM w WHERE {every}), d AS (SELECT t, a - lag(a) OVER (ORDER BY t) AS a, b - lag(b) OVER (ORDER BY t) AS b, y - lag(y) OVER (ORDER BY t) AS y, row_number() OVER (ORDER BY t) AS k FROM k),
    m AS (SELECT x.t, sum(pow({DECAY}, x.k - z.k) * {OWN}) AS t0, {', '.join(f'sum(pow({DECAY}, x.k - z.k) * {OWN} * z.{p} * z.{q}) AS {p}_{q}' for p, q in ('aa', 'ab', 'bb', 'ay', 'by'))} FROM d x JOIN d z ON z.k <= x.k AND z.a IS NOT NULL WHERE x.a IS NOT NULL GROUP BY x.t),
    n AS (SELECT *, a_a / t0 * b_b / t0 - a_b / t0 * a_b / t0 AS det FROM m WHERE t0 > 0.25)"""


add_rows(
    "ewm_glm", lambda d: matrices.ewm_glm(d, ["k"], "t", ["click", "view"], "rest", N), ["t", "regressor", "out"],
    regression_sql("a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL") + f""" SELECT w.t, r.regressor, {_r("CASE r.regressor WHEN 'click' THEN (b_b * a_y - a_b * b_y) / (t0 * t0) / det ELSE (a_a * b_y - a_b * a_y) / (t0 * t0) / det END")} AS out FROM w CROSS JOIN (SELECT unnest(['click', 'view']) AS regressor) r LEFT JOIN n ON n.t = w.t""", wide_panel,
)
add_rows(
    "ewm_aai", lambda d: matrices.ewm_aai(d, ["k"], "t", ["click", "view"], N).withColumn("c", F.col("c") * 1e6), ["t", "i", "j", "c"],
    regression_sql("a IS NOT NULL AND b IS NOT NULL") + f""" SELECT w.t, i.i, j.j, {_r("1e6 * CASE WHEN i.i <> j.j THEN -a_b / t0 WHEN i.i = 'click' THEN b_b / t0 ELSE a_a / t0 END / det")} AS c FROM w CROSS JOIN (SELECT unnest(['click', 'view']) AS i) i CROSS JOIN (SELECT unnest(['click', 'view']) AS j) j LEFT JOIN n ON n.t = w.t""", wide_panel,
)


def _glm_resumed(d: DataFrame) -> DataFrame:
    old, new = d.where(~LATER("t")), d.where(LATER("t"))
    columns = ["click", "view"], "rest", N
    state = matrices.regression_state(old, ["k"], "t", *columns)
    return matrices.ewm_glm(old, ["k"], "t", *columns).unionByName(matrices.ewm_glm(new, ["k"], "t", *columns, state=state))


def LATER(time: str):  # noqa: N802
    return F.col(time) >= F.lit("2024-01-15").cast("timestamp")


add_rows("ewm_glm_resumed", _glm_resumed, ["t", "regressor", "out"], SQL["ewm_glm"], wide_panel)
add_rows(
    "least_squares", lambda d: matrices.least_squares_by(d, ["k"], ["click", "view"], "rest"), ["regressor", "out"],
    f"""WITH {WIDE_SQL}, m AS (SELECT sum(coalesce(a, 0) * coalesce(a, 0)) AS a_a, sum(coalesce(a, 0) * coalesce(b, 0)) AS a_b, sum(coalesce(b, 0) * coalesce(b, 0)) AS b_b, sum(coalesce(a, 0) * y) AS a_y, sum(coalesce(b, 0) * y) AS b_y FROM w WHERE y IS NOT NULL)
    SELECT regressor, {_r("CASE regressor WHEN 'click' THEN (b_b * a_y - a_b * b_y) / (a_a * b_b - a_b * a_b) ELSE (a_a * b_y - a_b * a_y) / (a_a * b_b - a_b * a_b) END")} AS out FROM m CROSS JOIN (SELECT unnest(['click', 'view']) AS regressor)""", wide_panel,
)
QUERIES["quantisation_noise"] = lambda spark, _: spark.createDataFrame([(d, m, X.quantisation_noise(d, m), X.correlation_resolution(d)) for d in X.CORRELATION_CODEC for m in (2, 5, 200)], "dtype string, m int, noise double, resolution double").withColumns({c: rounded(c) for c in ("noise", "resolution")})
SQL["quantisation_noise"] = f"SELECT dtype, CAST(m AS INTEGER) AS m, {_r('2 * sqrt(m / 12.0) / scale')} AS noise, {_r('1.0 / scale')} AS resolution FROM (VALUES ('int8', 100.0), ('int16', 10000.0)) x(dtype, scale), (VALUES (2), (5), (200)) y(m)"
DAYS = lambda d: d.select(F.date_trunc("day", "t").alias("t")).distinct()
add_rows(
    "reindex_3d", lambda d: reindex_matrices(CORR(d).where("c is not null"), DAYS(d), "t"), ["i", "j", "t", "c"],
    f"WITH {UPPER}, v AS (SELECT * FROM c WHERE c IS NOT NULL), w AS (SELECT DISTINCT date_trunc('day', ts) AS t FROM events), m AS (SELECT w.t, max(v.t) AS u FROM w JOIN v ON v.t <= w.t GROUP BY w.t) SELECT i, j, m.t, {_r('c')} AS c FROM m JOIN v ON v.t = m.u",
)
add_rows("ewmx", lambda d: pairs.ewmx(LEVELLED(d).where("s <> 'view'"), LEVELLED(d).where("s = 'view'"), "t", "s", "v", N).where("t0 is not null").select("i", "j", "t", (F.col("ab") / F.col("t0")).alias("c")), ["i", "j", "t", "c"], f"SELECT * FROM ({pair_sql('ab / t0', 'l', '<> b.s AND b.s = ' + chr(39) + 'view' + chr(39) + ' AND a.s <>', gate='true', ffill=False)}) WHERE c IS NOT NULL")

# --- bars and positions -------------------------------------------------------------------------------------------------

BARS_SQL = "b AS (SELECT event_type AS s, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("s"), F.date_trunc("day", "ts").alias("t")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))


V = {"o": "(open - c0) * (open - c0)", "c": "(close - open) * (close - open)", "cc": "(close - c0) * (close - c0)", "rs": "((high - open) * (high - close) + (low - open) * (low - close))", "p": "((high - low) * (high - low) / (4 * ln(2)))"}
V["gk"] = f"({V['o']} - 0.383 * {V['c']} + 1.364 * {V['p']} + 0.019 * {V['rs']})"
V["yz"] = f"CASE WHEN high <= low THEN {V['cc']} ELSE {V['o']} + 0.34 / 2.34 * {V['c']} + (1 - 0.34 / 2.34) * {V['rs']} END"
for model in V:
    add_rows(f"bar_r2_{model}", lambda d, m=model: X.bar_r2(d, Axis("s", "t"), model=m), ["s", "t", "out"], f"WITH {BARS_SQL}, x AS (SELECT *, lag(close) OVER (PARTITION BY s ORDER BY t) AS c0 FROM b) SELECT s, t, {_r(V[model])} AS out FROM x", bars)


add_rows(
    "resampled", lambda d: resampled(d.withColumn("at", F.col("ts")), ["event_type"], "ts", "value", "6 hours"), ["event_type", "ts", "high", "low", "volume"],
    f"SELECT event_type, to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP AS ts, {_r('max(value)')} AS high, {_r('min(value)')} AS low, count(value) AS volume FROM events GROUP BY ALL", lambda s, d: table(s, d, "events"),
)


def growing_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Axis(["s", "day"], ["ts", "event_id"]).rows()
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("s"), F.to_date("ts").alias("day"), "ts", "event_id", "value")
    return e.withColumn("open", F.first("value").over(w)).withColumn("volume", F.count("*").over(w)).drop("day")


add_rows(
    "bar_daily_to_eod", lambda d: X.daily_to_eod(d, "s", "ts", day=F.date_trunc("day", "ts")), ["s", "day", "value", "volume"],
    f"SELECT event_type AS s, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, {_r('arg_max(value, ts)')} AS value, count(*) AS volume FROM events GROUP BY ALL", growing_bars,
)
FOLDS = {
    "buffer": lambda e, **k: sequential.buffer(e.withColumn("band", F.lit(60.0)), "v", "band", AXIS, unit=7.0, **k), "zmooth": lambda e, **k: sequential.zmooth(e, "v", AXIS, 5, max_move=1.5, **k),
    "ewmrms_max_move": lambda e, **k: sequential.ewm_clipped(e, "v", AXIS, 5, 1.2, **k), "ewmstd_max_move": lambda e, **k: sequential.ewm_clipped(e, "v", AXIS, 5, 1.2, rms=False, **k),
}
for name, run in FOLDS.items():
    add_frame(name, run, "v")
add_frame("ts_iterate", lambda e: sequential.fold(e, AXIS, lambda s, x: (s, None) if x is None else (0.5 * s + x, 0.5 * s + x), lambda: 0.0, ["v"]), "s", "e AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, v IS NULL ORDER BY ts, event_id) AS k FROM e), m AS (SELECT a.event_id, sum(pow(0.5, a.k - b.k) * b.v) AS s FROM k a JOIN k b ON a.user_id = b.user_id AND b.k <= a.k AND b.v IS NOT NULL WHERE a.v IS NOT NULL GROUP BY a.event_id)", "e LEFT JOIN m USING (event_id)")


def recursive(first: str, then: str, out: str) -> str:
    """Each result from the one before, by a recursion over a series' observations: r is the row before, k the row."""
    return f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN CAST(value AS DOUBLE) END AS v FROM events),
    k AS (SELECT user_id, event_id, v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e WHERE v IS NOT NULL),
    r AS (SELECT user_id, event_id, n, {first} FROM k WHERE n = 1 UNION ALL SELECT user_id, event_id, n, {then})
    SELECT e.event_id, {_r(out)} AS out FROM e LEFT JOIN r USING (event_id)"""


def _next(columns: str, *steps: str) -> str:
    """`columns` of the last of some nested selects, each of which adds columns to the one before."""
    frm = "SELECT k.user_id, k.event_id, k.n, k.v, r.* EXCLUDE (user_id, event_id, n) FROM r JOIN k ON k.user_id = r.user_id AND k.n = r.n + 1"
    for step in steps:
        frm = f"SELECT *, {step} FROM ({frm})"
    return f"{columns} FROM ({frm})"


LOW, HIGH = (f"round_even(v / 7.0 {sign} 60.0 / 7.0, 0) * 7" for sign in "-+")
SQL["buffer"] = recursive(f"least(greatest(0.0, {LOW}), {HIGH}) AS pos", _next(f"least(greatest(pos, {LOW}), {HIGH})"), "pos")
W5, OWN5 = (f"CAST({x!r} AS DOUBLE)" for x in (5 / 6, 1 - 5 / 6))
SQL["zmooth"] = recursive(
    "v AS z, CAST(0 AS DOUBLE) AS t0, CAST(0 AS DOUBLE) AS t2",
    _next(f"z + move, t0 * {W5} + {OWN5}, t2 * {W5} + {OWN5} * move * move", "CASE WHEN t0 > 0 THEN 1.5 * sqrt(t2 / t0) ELSE 0 END AS most", "CASE WHEN most > 0 AND abs(v - z) > most THEN sign(v - z) * most ELSE v - z END AS move"),
    "z",
)
SQL["ewmrms_max_move"] = recursive(
    f"{OWN5} AS t0, {OWN5} * v * v AS t2, {OWN5} * v * v AS raw",
    _next(f"t0 * {W5} + {OWN5}, t2 * {W5} + {OWN5} * x * x, raw * {W5} + {OWN5} * v * v", "sqrt(raw / t0) AS most", "CASE WHEN most > 0 THEN greatest(least(v, 1.2 * most), -1.2 * most) ELSE v END AS x"),
    "sqrt(t2 / t0)",
)
DEVIATION = "CASE WHEN n >= 3 AND t0 >= 0.25 AND t2 / t0 - (t1 / t0) * (t1 / t0) >= 0 AND w2 / (t0 * t0) < 1 THEN sqrt((t2 / t0 - (t1 / t0) * (t1 / t0)) / (1 - w2 / (t0 * t0))) END"
SQL["ewmstd_max_move"] = recursive(
    f"{OWN5} AS t0, {OWN5} * v AS t1, {OWN5} * v * v AS t2, {OWN5} * {OWN5} AS w2",
    _next(f"t0 * {W5} + {OWN5}, t1 * {W5} + {OWN5} * x, t2 * {W5} + {OWN5} * x * x, w2 * {W5} * {W5} + {OWN5} * {OWN5}", f"{DEVIATION.replace('n >= 3', 'n - 1 >= 3')} AS most", "CASE WHEN most > 0 THEN greatest(least(v, 1.2 * most), -1.2 * most) ELSE v END AS x"),
    DEVIATION,
)


def _zeros(n):
    import numpy as np

    return np.zeros(n)


def _tracked(state, names, inputs):
    pos, error = sequential.track(inputs[1], inputs[0], state)
    return pos, [(n, float(p), float(error)) for n, p in zip(names, pos)]


def _multi(state, names, inputs):
    m, previous = state
    m, pos, miss = sequential.multi_buffer_step(inputs[0], inputs[0] * 0 + 0.6, inputs[1], previous, m)
    return (m, pos), [(n, float(p), float(m), float(miss)) for n, p in zip(names, pos)]


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets (a fiftieth of each hour's value) and the rows of each time's covariance matrix."""
    g = grid(spark, sf_dir)
    full = pairs.symmetric(pairs.ewmcovariance(LEVELLED(panel(spark, sf_dir)), "t", "s", "v", N))
    rows = full.groupBy("t", F.col("i").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda x: x["c"]).alias("risk"))
    names = g.select("s").distinct().count()  # a matrix has a row and a column for each
    return g.withColumn("target", F.coalesce("v", F.lit(0.0)) / 50).join(rows.where(F.size("risk") == names), ["t", "s"]).withColumn("k", F.lit(0))


add_rows("minimize_tracking_error", lambda d: sequential.by_portfolio(d, ["k"], "t", "s", _tracked, _zeros, ["target", "risk"], "s string, out double, error double"), ["t", "s", "out", "error"], None, portfolio)
add_rows("multibuffer", lambda d: sequential.by_portfolio(d, ["k"], "t", "s", _multi, lambda n: (1.0, _zeros(n)), ["target", "risk"], "s string, out double, mult double, mismatch double"), ["t", "s", "out", "mult", "mismatch"], None, portfolio)

# --- alignment and increments -------------------------------------------------------------------------------------------

add(
    "as_of_join",
    lambda e: as_of(e.where("v is null").select("user_id", "ts", "event_id"), e.where("v is not null").select("user_id", "ts", "v"), ["user_id"], "ts", ["v"]).select("event_id", rounded("v").alias("out")),
    f"WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) SELECT a.event_id, {_r('b.v')} AS out FROM (SELECT * FROM e WHERE v IS NULL) a ASOF LEFT JOIN (SELECT * FROM e WHERE v IS NOT NULL) b ON a.user_id = b.user_id AND a.ts >= b.ts",
)
