"""Queries over models, their evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import features as f
from tidebook.functions import filters
from tidebook.operators import calibration, series, stats
from tidebook.operators.walk_forward import WalkForward, regression_walk, regression_walk_wide, replay, scored
from tidebook.plans.features import BASE, LABELS, W, sql_of
from tidebook.plans.registry import HOURLY, TICKS, query, r, rounded, t_cdf, t_logpdf
from tidebook.sources import tables

X, Y = "momentum_20_1", "forward_log_return"
FEATURES = ("log_return_1", "momentum_20_1", "volatility_20")
TRAIN = f"""WITH w AS ({sql_of(f.minimal_set()).replace("round(", "(").replace(", 6) + 0.0 AS", ") AS")}),
    y AS ({LABELS} SELECT symbol, as_of AS timestamp, realised_at, fwd AS forward_log_return FROM l WHERE realised_at IS NOT NULL),
    t AS (SELECT * FROM w JOIN y USING (symbol, timestamp)
          WHERE log_return_1 IS NOT NULL AND momentum_20_1 IS NOT NULL AND volatility_20 IS NOT NULL)"""
RETURNS = f"{BASE}, ret AS (SELECT symbol, timestamp, n, close, r FROM b)"


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.training_set(tables.hourly_bars(spark, sf_dir), f.minimal_set(), 5)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = f.Frames()
    return f.with_helpers(tables.hourly_bars(spark, sf_dir), frames).select("symbol", "timestamp", "close", F.col("_n").alias("n"), F.col("_r").alias("r"))


@query(
    "scaler",
    f"""{TRAIN} SELECT symbol, count(*) AS n, {", ".join(r(f"avg({x})", f"mean_{x}") + ", " + r(f"stddev_samp({x})", f"sd_{x}") for x in FEATURES)}
        FROM t GROUP BY symbol""",
)
def scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.scaler(training(spark, sf_dir), list(FEATURES), ["symbol"]))


@query(
    "scaled_features",
    f"""{TRAIN} SELECT symbol, timestamp, {r("(momentum_20_1 - avg(momentum_20_1) OVER p) / stddev_samp(momentum_20_1) OVER p", X)}
        FROM t WINDOW p AS (PARTITION BY symbol)""",
)
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training(spark, sf_dir).select("symbol", "timestamp", X)
    return rounded(stats.scaled(rows, stats.scaler(rows, [X], ["symbol"]), [X], ["symbol"]))


SUMS = """count(*) AS n, count(*)::DOUBLE AS weight, sum(y * y) AS yy, sum(y) AS xy_0, sum(x * y) AS xy_1,
    count(*)::DOUBLE AS xx_0_0, sum(x) AS xx_0_1, sum(x * x) AS xx_1_1"""


@query(
    "gram_sums",
    f"""{TRAIN}, d AS (SELECT symbol, momentum_20_1 AS x, forward_log_return AS y FROM t), s AS (SELECT symbol, {SUMS} FROM d GROUP BY symbol)
        SELECT symbol, n, round(weight, 5) + 0.0 AS weight, round(yy, 5) + 0.0 AS yy, round(xy_0, 5) + 0.0 AS xy_0, round(xy_1, 5) + 0.0 AS xy_1,
               round(xx_0_0, 5) + 0.0 AS xx_0_0, round(xx_0_1, 5) + 0.0 AS xx_0_1, round(xx_1_1, 5) + 0.0 AS xx_1_1 FROM s""",
)
def gram_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training(spark, sf_dir).withColumn("one", F.lit(1.0))
    return rounded(stats.gram(rows, ["one", X], Y, ["symbol"]), 5)


@query(
    "gram_discounted",
    f"""{TRAIN}, d AS (SELECT symbol, momentum_20_1 AS x, forward_log_return AS y,
            0.99 ** (row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) - 1) AS w FROM t)
        SELECT symbol, count(*) AS n, {r("sum(w)", "weight")}, {r("sum(w * x * y)", "xy_0")}, {r("sum(w * y * y)", "yy")}, {r("sum(w * x * x)", "xx_0_0")} FROM d GROUP BY symbol""",
)
def gram_discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = stats.gram(training(spark, sf_dir), [X], Y, ["symbol"], forgetting=0.99)
    return rounded(sums.select("symbol", "n", "weight", "xy_0", "yy", "xx_0_0"))


POSTERIOR = """SELECT *, xx_0_0 + 1 AS p00, xx_0_1 AS p01, xx_1_1 + 1 AS p11, (xx_0_0 + 1) * (xx_1_1 + 1) - xx_0_1 * xx_0_1 AS det FROM s"""
SOLVED = f"""SELECT *, (p11 * xy_0 - p01 * xy_1) / det AS m0, (p00 * xy_1 - p01 * xy_0) / det AS m1, 2 + weight / 2 AS shape FROM ({POSTERIOR})"""
RATED = f"SELECT *, greatest(0.0004 + 0.5 * (yy - m0 * xy_0 - m1 * xy_1), 1e-12) AS rate FROM ({SOLVED})"


@query(
    "blr_fit",
    f"""{TRAIN}, d AS (SELECT symbol, momentum_20_1 AS x, forward_log_return AS y FROM t), s AS (SELECT symbol, {SUMS} FROM d GROUP BY symbol)
        SELECT symbol, n, {r("m0", "m0")}, {r("m1", "m1")}, {r("shape", "shape")}, {r("rate", "rate")}, {r("p11 / det", "v00")},
               {r("-p01 / det", "v01")}, {r("p00 / det", "v11")} FROM ({RATED})""",
)
def blr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training(spark, sf_dir).withColumn("one", F.lit(1.0))
    return rounded(stats.posterior_two(stats.gram(rows, ["one", X], Y, ["symbol"]), ["symbol"]))


@query(
    "blr_fit_general",
    f"""{TRAIN}, d AS (SELECT symbol, momentum_20_1 AS x, forward_log_return AS y FROM t), s AS (SELECT symbol, {SUMS} FROM d GROUP BY symbol)
        SELECT symbol, n, {r("m0", "m0")}, {r("m1", "m1")}, {r("shape", "shape")}, {r("rate", "rate")} FROM ({RATED})""",
)
def blr_fit_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solver for any number of columns, on two."""
    rows = training(spark, sf_dir).withColumn("one", F.lit(1.0))
    fitted = stats.posterior(stats.gram(rows, ["one", X], Y, ["symbol"]), 2, ["symbol"])
    return rounded(fitted.select("symbol", "n", F.col("mean")[0].alias("m0"), F.col("mean")[1].alias("m1"), "shape", "rate"))


WALK = f"""{TRAIN}, d AS (SELECT symbol, timestamp, momentum_20_1 AS x, forward_log_return AS y, row_number() OVER ({W}) AS i FROM t),
    s AS (SELECT symbol, i AS e, count(*) OVER q AS n, (count(*) OVER q)::DOUBLE AS weight, sum(y * y) OVER q AS yy, sum(y) OVER q AS xy_0,
                 sum(x * y) OVER q AS xy_1, (count(*) OVER q)::DOUBLE AS xx_0_0, sum(x) OVER q AS xx_0_1, sum(x * x) OVER q AS xx_1_1
          FROM d WINDOW q AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    a AS (SELECT *, 256 + ((i - 256) // 20) * 20 - 6 AS e FROM d WHERE i >= 256),
    p AS (SELECT a.symbol, a.timestamp, a.e, a.y, 2 * shape AS df, m0 + m1 * x AS loc,
                 sqrt(rate / shape * (1 + (p11 - 2 * p01 * x + p00 * x * x) / det)) AS scale, (p11 - 2 * p01 * x + p00 * x * x) / det AS lev
          FROM a JOIN ({RATED}) z ON a.symbol = z.symbol AND a.e = z.e)"""


@query(
    "blr_walk_forward",
    f"""{WALK} SELECT symbol, timestamp, e::INT AS train_end, {r("df", "df")}, {r("loc", "loc")}, {r("scale", "scale")},
        round(scale * scale * df / (df - 2) * lev / (1 + lev), 8) + 0.0 AS epistemic_variance FROM p""",
)
def blr_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regression_walk(training(spark, sf_dir), X, Y, WalkForward())
    wide = rounded(out.select("symbol", "timestamp", "train_end", "df", "loc", "scale", F.col("epistemic_variance").cast("string").alias("e")))
    return wide.withColumn("epistemic_variance", F.round(F.col("e").cast("double"), 8) + F.lit(0.0)).drop("e")


#: Three columns, the last 400 rows at most, each row discounted by its age.
WIDE = WalkForward(initial_train=250, refit_every=20, horizon=5, max_train=400)
WIDE_FORGETTING = 0.99


def _wide_sql() -> str:
    """The same refits by a join of rows with the windows that hold them, and a 3 x 3 inverse by cofactors."""
    names = dict(zip("abc", FEATURES, strict=True))
    pairs = ["aa", "ab", "ac", "bb", "bc", "cc"]
    sums = ", ".join([f"sum(w * {p[0]} * {p[1]}) AS {p}" for p in pairs] + [f"sum(w * {c} * y) AS y{c}" for c in "abc"])
    lam = {p: f"({p} + 1)" if p[0] == p[1] else p for p in pairs}
    co = {
        "aa": "{bb} * {cc} - {bc} * {bc}", "ab": "{ac} * {bc} - {ab} * {cc}", "ac": "{ab} * {bc} - {ac} * {bb}",
        "bb": "{aa} * {cc} - {ac} * {ac}", "bc": "{ab} * {ac} - {aa} * {bc}", "cc": "{aa} * {bb} - {ab} * {ab}",
    }
    co = {k: v.format(**lam) for k, v in co.items()}
    det = f"({lam['aa']} * ({co['aa']}) + ab * ({co['ab']}) + ac * ({co['ac']}))"
    inv = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    mean = ", ".join(f"{' + '.join(f'{inv(i, j)} * y{j}' for j in 'abc')} AS m{i}" for i in "abc")
    lev = " + ".join(f"{inv(i, j)} * t.{i} * t.{j}" for i in "abc" for j in "abc")
    return f"""{TRAIN}, d AS (SELECT symbol, timestamp, {", ".join(f"{c} AS {k}" for k, c in names.items())}, forward_log_return AS y,
            row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS i FROM t),
        q AS (SELECT *, (250 + floor((i - 256) / 20) * 20)::BIGINT AS e FROM d WHERE i >= 256),
        g AS (SELECT f.symbol, f.e, count(*) AS n, sum(w) AS weight, sum(w * y * y) AS yy, {sums}
              FROM (SELECT f.symbol, f.e, {", ".join(f"d.{c}" for c in "abc")}, d.y, 0.99 ** (f.e - d.i) AS w
                    FROM (SELECT DISTINCT symbol, e FROM q) f JOIN d ON d.symbol = f.symbol AND d.i <= f.e AND d.i > f.e - 400) f GROUP BY 1, 2),
        v AS (SELECT *, {", ".join(f"({c}) / {det} AS i{k}" for k, c in co.items())} FROM g),
        m AS (SELECT *, {mean} FROM v),
        o AS (SELECT *, 2 + weight / 2 AS shape, greatest(0.0004 + 0.5 * (yy - ma * ya - mb * yb - mc * yc), 1e-12) AS rate FROM m),
        p AS (SELECT t.symbol, t.timestamp, o.e AS train_end, o.n AS train_rows, 2 * shape AS df, ma * t.a + mb * t.b + mc * t.c AS loc, {lev} AS lev, rate, shape
              FROM q t JOIN o ON o.symbol = t.symbol AND o.e = t.e)
        SELECT symbol, timestamp, train_end, train_rows, {r("df", "df")}, {r("loc", "loc")}, {r("sqrt(rate / shape * (1 + lev))", "scale")},
            round(rate / shape * (1 + lev) * df / (df - 2) * lev / (1 + lev), 8) + 0.0 AS epistemic_variance FROM p"""


@query("blr_walk_forward_wide", _wide_sql())
def blr_walk_forward_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward on three features with a training window and forgetting."""
    rows = training(spark, sf_dir).select("symbol", "timestamp", *FEATURES, Y)
    out = regression_walk_wide(rows, list(FEATURES), Y, WIDE, WIDE_FORGETTING)
    spread = F.col("epistemic_variance").cast("string").alias("e")
    wide = rounded(out.select("symbol", "timestamp", "train_end", "train_rows", "df", "loc", "scale", spread))
    return wide.withColumn("epistemic_variance", F.round(F.col("e").cast("double"), 8) + F.lit(0.0)).drop("e")


@query(
    "walk_forward_report",
    f"""{WALK}, sc AS (SELECT symbol, timestamp, y AS outcome, loc AS mean, scale * sqrt(df / (df - 2)) AS sd, {t_cdf("((y - loc) / scale)", "df")} AS u,
            1 - {t_cdf("((0 - loc) / scale)", "df")} AS p, y > 0 AS up, {t_logpdf("((y - loc) / scale)", "df", "scale")} AS logpdf FROM p),
        one AS (SELECT symbol, count(*) AS n, avg((p - up::INT) ** 2) AS brier, avg(logpdf) AS log_score, avg(sd) AS sharpness, avg(outcome - mean) AS bias FROM sc GROUP BY 1),
        k AS (SELECT symbol, u, row_number() OVER (PARTITION BY symbol ORDER BY u) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM sc),
        ks AS (SELECT symbol, max(greatest(i / n - u, u - (i - 1) / n)) AS ks FROM k GROUP BY 1),
        c AS (SELECT symbol, level::DOUBLE AS level, avg((u BETWEEN (1 - level) / 2 AND (1 + level) / 2)::INT) AS empirical
              FROM sc, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) AS level) GROUP BY 1, 2),
        ie AS (SELECT symbol, avg(abs(empirical - level)) AS interval_error, sum(empirical - level) < 0 AS is_overconfident FROM c GROUP BY 1),
        b AS (SELECT symbol, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS predicted, avg(up::INT) AS observed FROM sc GROUP BY 1, 2),
        ec AS (SELECT symbol, sum(n * abs(predicted - observed)) / sum(n) AS ece FROM b GROUP BY 1)
        SELECT symbol, n, {r("brier", "brier")}, {r("log_score", "log_score")}, {r("sharpness", "sharpness")}, {r("bias", "bias")}, {r("ks", "ks")},
               {r("interval_error", "interval_error")}, is_overconfident, {r("ece", "ece")}
        FROM one JOIN ks USING (symbol) JOIN ie USING (symbol) JOIN ec USING (symbol)""",
)
def walk_forward_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of the walk-forward regression."""
    rows = scored(regression_walk(training(spark, sf_dir), X, Y, WalkForward()), Y)
    return rounded(calibration.assess(rows, ["symbol"]))


@query("replay_fused")
def replay_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of three models with reliability weights; a fold per symbol."""
    rows = series.training_set(tables.hourly_bars(spark, sf_dir), f.minimal_set(), 5).withColumn("r", F.col("log_return_1"))
    return rounded(replay(rows).select("symbol", "as_of", "outcome", "epistemic_variance", "w_momentum", "w_volatility", "w_regime", "u", "p_positive", "logpdf"))


REGIME_SQL = f"""{RETURNS}, c AS (SELECT symbol, timestamp, r, row_number() OVER ({W}) AS i, avg(r) OVER (PARTITION BY symbol) AS centre FROM ret WHERE r IS NOT NULL),
    q AS (SELECT *, (r - centre) ** 2 AS q FROM c), d AS (SELECT *, q - avg(q) OVER (PARTITION BY symbol) AS d FROM q),
    l AS (SELECT *, d * lead(d, 1) OVER ({W}) AS near, d * lead(d, 20) OVER ({W}) AS far FROM d),
    s AS (SELECT symbol, count(*) AS n, avg(r) AS centre, var_samp(r) AS total, coalesce(avg(near), 0) AS near, coalesce(avg(far), 0) AS far FROM l GROUP BY 1),
    bm AS (SELECT symbol, (i - 1) // 21 AS b, avg(r) AS m FROM c GROUP BY 1, 2 HAVING count(*) = 21),
    bv AS (SELECT symbol, var_samp(m) AS between, count(*) AS blocks FROM bm GROUP BY 1),
    x AS (SELECT s.*, n / (n + 250.0) AS w, CASE WHEN blocks >= 2 THEN (between - total / 21) / (1 - 1 / 21.0) ELSE 0 END AS debiased,
          CASE WHEN near > 0 AND far > 0 THEN (far / near) ** (1 / 19.0) ELSE 0.96 END AS measured FROM s LEFT JOIN bv USING (symbol)),
    y AS (SELECT *, w * greatest(0, debiased) + (1 - w) * (0.25 / 252) ** 2 AS dv, least(0.99, greatest(0.5, w * measured + (1 - w) * 0.96)) AS held FROM x),
    z AS (SELECT *, greatest(total - dv, 1e-12) AS mv FROM y),
    params AS (SELECT symbol, centre, sqrt(dv) AS drift_spread, held AS persistence, mv AS mean_variance,
               sqrt(w * greatest(0, near / held) + (1 - w) * (0.55 * mv) ** 2) / mv AS dispersion, n AS n_rows FROM z)"""


@query(
    "regime_params",
    f"""{REGIME_SQL} SELECT symbol, {r("centre", "centre")}, {r("drift_spread", "drift_spread")}, {r("persistence", "persistence")},
        {r("mean_variance", "mean_variance")}, {r("dispersion", "dispersion")}, n_rows FROM params""",
)
def regime_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.regime_scalars(returns(spark, sf_dir)))


def _states() -> str:
    """Drifts, variances, df and scales of the three states, as columns of `st`."""
    pi, ds, vs = filters.STATIONARY, filters.DRIFT_SHAPE, filters.VARIANCE_SHAPE
    widest = (1 - filters.VARIANCE_FLOOR) / max(1e-12, -vs.min())
    cols = [f"least(dispersion, {float(widest)!r}) AS disp"]
    for k in range(3):
        cols.append(f"centre + drift_spread * {float(ds[k])!r} AS d{k}")
        cols.append(f"2 + {pi[k]} * n_rows / 2 AS a{k}")
        cols.append(f"mean_variance * (1 + least(dispersion, {float(widest)!r}) * {float(vs[k])!r}) AS v{k}")
        cols.append(f"{pi[k]} * n_rows + 1 AS k{k}")
    inner = f"SELECT symbol, persistence, {', '.join(cols)} FROM params"
    outer = ", ".join(f"d{k}, 2 * a{k} AS f{k}, sqrt(v{k} * (a{k} - 1) / a{k} * (1 + 1 / k{k})) AS s{k}" for k in range(3))
    return f"st AS (SELECT symbol, persistence AS h, {outer} FROM ({inner}))"


def _density(k: int) -> str:
    z = f"((r - d{k}) / s{k})"
    return f"lgamma((f{k} + 1) / 2) - lgamma(f{k} / 2) - 0.5 * ln(f{k} * pi()) - ln(s{k}) - (f{k} + 1) / 2 * ln(1 + {z} * {z} / f{k})"


_PI = filters.STATIONARY
REGIME_FILTER_SQL = f"""WITH RECURSIVE {REGIME_SQL.removeprefix("WITH ")}, {_states()},
    e AS (SELECT c.symbol, c.timestamp, c.i, h, {", ".join(f"{_density(k)} AS l{k}" for k in range(3))} FROM c JOIN st USING (symbol)),
    g AS (SELECT symbol, timestamp, i, h, {", ".join(f"exp(l{k} - greatest(l0, l1, l2)) AS e{k}" for k in range(3))}, greatest(l0, l1, l2) AS top FROM e),
    run AS (
        SELECT symbol, 0::BIGINT AS i, {", ".join(f"{p}::DOUBLE AS b{k}" for k, p in enumerate(_PI))}, 0.0::DOUBLE AS ll, NULL::TIMESTAMP AS timestamp FROM st
        UNION ALL
        SELECT symbol, i, u0 / (u0 + u1 + u2), u1 / (u0 + u1 + u2), u2 / (u0 + u1 + u2), ll + ln(u0 + u1 + u2) + top, timestamp
        FROM (SELECT g.symbol, g.i, g.timestamp, g.top, ll, {", ".join(f"(h * b{k} + (1 - h) * {p}) * e{k} AS u{k}" for k, p in enumerate(_PI))}
              FROM run JOIN g ON g.symbol = run.symbol AND g.i = run.i + 1))
    SELECT symbol, timestamp, {r("b0", "p_bullish")}, {r("b1", "p_bearish")}, {r("b2", "p_neutral")}, round(ll, 4) + 0.0 AS log_likelihood FROM run WHERE i > 0"""


@query("regime_filter", REGIME_FILTER_SQL)
def regime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns(spark, sf_dir).where("r IS NOT NULL")
    out = stats.regime_filter(rows, stats.regime_scalars(rows))
    return rounded(out.withColumn("log_likelihood", F.round("log_likelihood", 4)))


def _variance_sql() -> str:
    d = filters.DISCOUNTS
    ks = range(len(d))
    gain = lambda k: (
        f"(a{k} * ln(g{k}) + lgamma(a{k} + 0.5) - lgamma(a{k}) - (a{k} + 0.5) * ln(g{k} + z / 2))"
    )
    zero = ", ".join(f"0.0::DOUBLE AS s{k}, 0.0::DOUBLE AS q{k}, -ln(5)::DOUBLE AS w{k}" for k in ks)
    evolved = ", ".join(f"2 + {d[k]} * s{k} / 2 AS a{k}, greatest(0.0004 + {d[k]} * q{k} / 2, 1e-18) AS g{k}" for k in ks)
    keep = ", ".join(f"s{k}, q{k}, w{k}" for k in ks)
    moved = ", ".join(f"CASE WHEN seen THEN 0.98 * w{k} + {gain(k)} ELSE 0.98 * w{k} END AS m{k}" for k in ks)
    top = "greatest(" + ", ".join(f"m{k}" for k in ks) + ")"
    norm = "ln(" + " + ".join(f"exp(m{k} - top)" for k in ks) + ")"
    floored = ", ".join(f"greatest(m{k} - top - norm, -46) AS x{k}" for k in ks)
    again = "ln(" + " + ".join(f"exp(x{k})" for k in ks) + ")"
    nxt = ", ".join(
        f"{d[k]} * s{k} + seen::INT, {d[k]} * q{k} + CASE WHEN seen THEN z ELSE 0 END, x{k} - {again}" for k in ks
    )
    noise = " + ".join(f"exp(w{k}) * greatest(0.0004 + q{k} / 2, 1e-18) / (1 + s{k} / 2)" for k in ks)
    n_eff = " + ".join(f"exp(w{k}) * s{k}" for k in ks)
    disc = " + ".join(f"exp(w{k}) * {d[k]}" for k in ks)
    ent = " + ".join(f"-exp(w{k}) * w{k}" for k in ks)
    shape = [f"(2 + {d[k]} * s{k} / 2)" for k in ks]
    rate = [f"greatest(0.0004 + {d[k]} * q{k} / 2, 1e-18)" for k in ks]
    plug = " + ".join(f"exp(w{k}) * 5 * {rate[k]} / {shape[k]}" for k in ks)
    infl = " + ".join(f"exp(w{k}) * 5 * {rate[k]} / ({shape[k]} * ({shape[k]} - 1))" for k in ks)
    real = " + ".join(f"exp(w{k}) * 5 * {rate[k]} / ({shape[k]} - 1)" for k in ks)
    df = " + ".join(f"exp(w{k}) * 2 * {shape[k]}" for k in ks)
    return f"""WITH RECURSIVE {RETURNS.removeprefix("WITH ")},
        run AS (
            SELECT DISTINCT symbol, 0::BIGINT AS n, NULL::TIMESTAMP AS timestamp, {zero} FROM ret
            UNION ALL
            SELECT symbol, n, timestamp, {nxt} FROM (
              SELECT *, {floored} FROM (SELECT *, {norm} AS norm FROM (SELECT *, {top} AS top FROM (SELECT *, {moved} FROM (
                SELECT ret.symbol, ret.n, ret.timestamp, ret.r IS NOT NULL AS seen, coalesce(ret.r * ret.r, 0.0) AS z, {keep}, {evolved}
                FROM run JOIN ret ON ret.symbol = run.symbol AND ret.n = run.n + 1))))))
        SELECT symbol, timestamp, {r(noise, "noise_variance")}, {r(n_eff, "effective_n", 4)}, {r(disc, "expected_discount")}, {r(ent, "entropy")},
            {r(plug, "plugin_variance")}, {r(infl, "inflation")}, {r(real, "realised_variance")}, {r(df, "predictive_df", 4)} FROM run WHERE n > 0"""


@query("var_filter", _variance_sql())
def var_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's first return is missing and only ages the evidence."""
    out = stats.variance_filter(returns(spark, sf_dir))
    out = out.withColumns({c: F.round(c, 4) for c in ("effective_n", "predictive_df")})
    return rounded(out.drop("uncertainty", "n_seen", "n_skipped"))


# --- calibration -------------------------------------------------------------------------------------------------------
#: Predictions by rule, so that SQL has them too.
SCORES_SQL = f"""WITH {TICKS}, p AS (SELECT symbol, event_id, ((event_id * 7919) % 10007 + 0.5) / 10007 AS u, ((event_id * 104729) % 1009) / 1009.0 AS p,
    (event_id * 31) % 1013 < 400 + (event_id * 104729) % 300 AS up, price / 1000 - 0.02 AS outcome, ((event_id * 17) % 101) / 5000.0 - 0.01 AS mean,
    0.01 + ((event_id * 13) % 97) / 3000.0 AS sd FROM ticks)"""


def synthetic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return tables.ticks(spark, sf_dir).select(
        "symbol",
        "event_id",
        ((n * 7919 % 10007 + 0.5) / 10007).cast("double").alias("u"),
        (n * 104729 % 1009 / 1009.0).cast("double").alias("p"),
        (n * 31 % 1013 < 400 + n * 104729 % 300).alias("up"),
        (F.col("price") / 1000 - 0.02).alias("outcome"),
        (n * 17 % 101 / 5000.0 - 0.01).cast("double").alias("mean"),
        (0.01 + n * 13 % 97 / 3000.0).cast("double").alias("sd"),
        F.when(n % 50 == 0, F.lit(float("inf"))).otherwise(-n * 7 % 11 / 3.0).cast("double").alias("logpdf"),
    )


@query(
    "pit_ks",
    f"""{SCORES_SQL}, k AS (SELECT symbol, u, row_number() OVER (PARTITION BY symbol ORDER BY u) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM p)
        SELECT symbol, {r("max(greatest(i / n - u, u - (i - 1) / n))", "ks")}, count(*) AS n FROM k GROUP BY symbol""",
)
def pit_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.kolmogorov(synthetic_scores(spark, sf_dir), ["symbol"]))


COVERED = """c AS (SELECT symbol, level::DOUBLE AS level, avg((u BETWEEN (1 - level) / 2 AND (1 + level) / 2)::INT) AS empirical, count(*) AS n
    FROM p, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) AS level) GROUP BY 1, 2)"""


@query("coverage_curve", f"""{SCORES_SQL}, {COVERED} SELECT symbol, {r("level", "level")}, {r("empirical", "empirical")}, n FROM c""")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.coverage(synthetic_scores(spark, sf_dir), ["symbol"]))


@query(
    "interval_error",
    f"""{SCORES_SQL}, {COVERED} SELECT symbol, {r("avg(abs(empirical - level))", "interval_error")}, sum(empirical - level) < 0 AS is_overconfident FROM c GROUP BY symbol""",
)
def interval_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.interval_error(calibration.coverage(synthetic_scores(spark, sf_dir), ["symbol"]), ["symbol"]))


BINNED = """b AS (SELECT symbol, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p)::DOUBLE AS predicted, avg(up::INT) AS observed FROM p GROUP BY 1, 2)"""


@query("reliability_bins", f"""{SCORES_SQL}, {BINNED} SELECT symbol, bin, n, {r("predicted", "predicted")}, {r("observed", "observed")} FROM b""")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.reliability(synthetic_scores(spark, sf_dir), ["symbol"]))


@query("calibration_error", f"""{SCORES_SQL}, {BINNED} SELECT symbol, {r("sum(n * abs(predicted - observed)) / sum(n)", "ece")} FROM b GROUP BY symbol""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.calibration_error(calibration.reliability(synthetic_scores(spark, sf_dir), ["symbol"]), ["symbol"]))


@query(
    "score_summary",
    f"""{SCORES_SQL} SELECT symbol, count(*) AS n, {r("avg((p - up::INT) ** 2)", "brier")},
        {r("avg(CASE WHEN event_id % 50 <> 0 THEN (-event_id * 7) % 11 / 3.0 END)", "log_score")}, {r("avg(sd)", "sharpness")}, {r("avg(outcome - mean)", "bias")}
        FROM p GROUP BY symbol""",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.scores(synthetic_scores(spark, sf_dir), ["symbol"]))


@query(
    "regime_terciles",
    f"""{SCORES_SQL}, t AS (SELECT symbol, quantile_cont(sd, 1 / 3.0) AS lo, quantile_cont(sd, 2 / 3.0) AS hi FROM p GROUP BY 1),
        x AS (SELECT p.*, CASE WHEN sd <= lo THEN 'low' WHEN sd <= hi THEN 'middle' ELSE 'high' END AS regime FROM p JOIN t USING (symbol))
        SELECT symbol, regime, count(*) AS n, {r("avg((p - up::INT) ** 2)", "brier")} FROM x GROUP BY 1, 2""",
)
def regime_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.terciles(synthetic_scores(spark, sf_dir), ["symbol"], "sd")
    return rounded(rows.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), calibration.brier(F.col("p"), F.col("up")).alias("brier")))


@query(
    "model_health",
    f"""{SCORES_SQL}, {COVERED}, ie AS (SELECT symbol, avg(abs(empirical - level)) AS e FROM c GROUP BY 1),
        m AS (SELECT symbol AS model, avg((p - up::INT) ** 2) AS brier, count(*) AS n, max(sd) * 30 AS uncertainty, avg(abs(p - 0.5)) * 2 AS disagreement,
                     count(*) > 100 AS fitted, e AS interval_error, symbol = 'view' AS unknown FROM p JOIN ie USING (symbol) GROUP BY symbol, e),
        c6 AS (SELECT model, 'fitted' AS name, fitted::INT::DOUBLE AS observed, fitted AS ok FROM m UNION ALL
               SELECT model, 'interval_error', CASE WHEN NOT unknown THEN interval_error END, interval_error <= 0.15 FROM m UNION ALL
               SELECT model, 'brier', brier, brier <= 0.3 FROM m UNION ALL
               SELECT model, 'uncertainty', CASE WHEN unknown THEN 'inf'::DOUBLE ELSE uncertainty END, uncertainty <= 1 AND NOT unknown FROM m UNION ALL
               SELECT model, 'n', n::DOUBLE, n >= 30 FROM m UNION ALL SELECT model, 'disagreement', disagreement, disagreement <= 0.9 FROM m),
        st AS (SELECT *, CASE WHEN observed IS NULL THEN 'skipped' WHEN ok THEN 'pass' ELSE 'fail' END AS status FROM c6)
        SELECT model, name, status, CASE WHEN isinf(observed) THEN 1e9 ELSE round(observed, 6) + 0.0 END AS observed,
               min((status <> 'fail')::INT) OVER (PARTITION BY model) = 1 AS healthy FROM st""",
)
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six checks from scores; of one model the interval error is absent and the uncertainty not finite."""
    rows = synthetic_scores(spark, sf_dir)
    errors = calibration.interval_error(calibration.coverage(rows, ["symbol"]), ["symbol"])
    unknown = F.col("symbol") == "view"
    report = (
        rows.groupBy("symbol")
        .agg(
            calibration.brier(F.col("p"), F.col("up")).alias("brier"),
            F.count(F.lit(1)).alias("n"),
            (F.max("sd") * 30).alias("uncertainty"),
            (F.avg(F.abs(F.col("p") - 0.5)) * 2).alias("disagreement"),
        )
        .join(errors.drop("is_overconfident"), "symbol")
        .withColumns(
            {
                "fitted": F.col("n") > 100,
                "interval_error": F.when(~unknown, F.col("interval_error")),
                "uncertainty": F.when(unknown, float("inf")).otherwise(F.col("uncertainty")),
            }
        )
        .withColumnRenamed("symbol", "model")
    )
    found = calibration.model_health(report)
    return rounded(found.withColumn("observed", F.when(F.col("observed") < float("inf"), F.col("observed")).when(F.col("observed").isNotNull(), 1e9)))


# --- portfolios ----------------------------------------------------------------------------------------------------------
@query(
    "metrics_performance",
    f"""{BASE}, w AS (SELECT symbol, timestamp, close, CASE WHEN lc - {"lag(lc, 5) OVER (" + W + ")"} > 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS weight FROM b),
        s AS (SELECT *, coalesce(lag(weight) OVER ({W}), 0) AS held, lead(close) OVER ({W}) / close - 1 AS step FROM w),
        t AS (SELECT *, abs(weight - held) AS traded, weight * step AS profit, (1 - abs(weight - held) * 0.0008) * (1 + weight * step * 0.00001) - 1 AS ret FROM s WHERE step IS NOT NULL),
        e AS (SELECT *, exp(sum(ln(1 + ret)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM t),
        p AS (SELECT *, greatest(1, max(equity) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM e)
        SELECT symbol, count(*) + 1 AS n_bars, round(max(1 - equity / peak), 5) + 0.0 AS max_drawdown, round(sum(traded), 5) + 0.0 AS turnover,
               round(avg(ret) / stddev_samp(ret) * 15.874507866387544, 5) + 0.0 AS sharpe,
               round(avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * 15.874507866387544, 5) + 0.0 AS sortino,
               round(arg_max(equity, timestamp) ** (252 / (count(*) + 1)) - 1, 5) + 0.0 AS cagr, round(arg_max(equity, timestamp) - 1, 5) + 0.0 AS total_return,
               round(stddev_samp(ret) * 15.874507866387544, 5) + 0.0 AS volatility,
               round(sum(greatest(profit, 0)) / sum(greatest(-profit, 0)), 5) + 0.0 AS profit_factor,
               round(avg((profit > 0)::INT), 5) + 0.0 AS win_rate FROM p GROUP BY symbol""",
)
def metrics_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long or half short by five-bar momentum. Returns are scaled down, as tick prices are no market's."""
    frames = f.Frames()
    up = F.ln("close") - F.lag(F.ln("close"), 5).over(frames.ordered)
    bars = tables.hourly_bars(spark, sf_dir)
    path = bars.select("symbol", "timestamp", "close", F.when(up > 0, 1.0).otherwise(-0.5).alias("weight"))
    out = stats.performance(path, scale=1e-5)
    return rounded(out, 5)


@query(
    "equity_state",
    f"""WITH {HOURLY}, e AS (SELECT symbol, timestamp, close + 1000 AS equity FROM bars)
        SELECT symbol, timestamp, {r("equity", "equity")}, {r("max(equity) OVER q", "peak")}, {r("1 - equity / max(equity) OVER q", "drawdown")},
               {r("first(equity) OVER d", "day_start")}, {r("greatest(0, 1 - equity / first(equity) OVER d)", "daily_loss")}
        FROM e WINDOW q AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      d AS (PARTITION BY symbol, timestamp::DATE ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def equity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = tables.hourly_bars(spark, sf_dir).select("symbol", "timestamp", (F.col("close") + 1000).alias("equity"))
    return rounded(stats.equity_state(curve, ["symbol"]))


@query(
    "exposure",
    """WITH p AS (SELECT o_custkey % 50 AS portfolio, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * (o_orderkey % 7 + 1)::DOUBLE AS quantity,
        o_totalprice AS last_price FROM orders)
        SELECT portfolio, round(sum(abs(quantity * last_price)) / 1e9, 6) + 0.0 AS gross, round(sum(quantity * last_price) / 1e9, 6) + 0.0 AS net,
               count(*) AS n_positions FROM p GROUP BY 1""",
)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    positions = tables.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("portfolio"),
        (F.when(n % 3 == 0, -1).otherwise(1) * (n % 7 + 1)).cast("double").alias("quantity"),
        F.col("o_totalprice").alias("last_price"),
        F.lit(1e9).alias("equity"),
    )
    return rounded(stats.exposure(positions))


@query(
    "sector_exposure",
    """WITH p AS (SELECT o_custkey % 50 AS portfolio, nullif(o_orderpriority, '3-MEDIUM') AS sector,
            abs(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * (o_orderkey % 7 + 1)::DOUBLE * o_totalprice) / 1e9 AS weight FROM orders)
        SELECT portfolio, sector, round(sum(weight), 6) + 0.0 AS exposure, count(*) AS n_positions FROM p WHERE sector IS NOT NULL GROUP BY 1, 2""",
)
def sector_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long and short positions both add to their sector; one priority stands for no sector."""
    n = F.col("o_orderkey")
    positions = tables.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("portfolio"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("sector"),
        (F.when(n % 3 == 0, -1).otherwise(1) * (n % 7 + 1)).cast("double").alias("quantity"),
        F.col("o_totalprice").alias("last_price"),
        F.lit(1e9).alias("equity"),
    )
    return rounded(stats.sector_exposure(positions))


@query(
    "tally",
    """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tally(tables.table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
