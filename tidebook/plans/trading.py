"""Queries from predictions to fills, and over journals, books and wire formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.config import RiskLimits
from tidebook.functions import features as f
from tidebook.functions import market, mixtures
from tidebook.operators import books, trading
from tidebook.plans.features import BASE, over
from tidebook.plans.market import quotes
from tidebook.plans.registry import HOURLY, TICKS, query, r, rounded, t_cdf, t_logpdf
from tidebook.sources import frames, tables, vendors

LIMITS = RiskLimits()

#: Two models by rule from trailing means and deviations of returns scaled to a hundredth.
PREDS_SQL = f"""{BASE}, m AS (SELECT symbol, timestamp AS as_of, n, {over("avg(r)", 20)} / 100 AS m20, {over("stddev_samp(r)", 20)} / 100 AS s20,
        {over("avg(r)", 60)} / 100 AS m60, {over("stddev_samp(r)", 60)} / 100 AS s60 FROM b),
    pr AS (SELECT symbol, as_of, n, m20, s20, m60, s60, exp(-0.5) / (1 + exp(-0.5)) AS wa, 1 / (1 + exp(-0.5)) AS wb FROM m WHERE n > 60),
    fu AS (SELECT *, wa * m20 + wb * m60 AS mean, wa * (m20 - (wa * m20 + wb * m60)) ** 2 + wb * (m60 - (wa * m20 + wb * m60)) ** 2 AS dis,
           wa * s20 * s20 * 10 / 8.0 + wb * s60 * s60 * 30 / 28.0 AS inner_var, wa * s20 * s20 / 20 + wb * s60 * s60 / 60 AS within FROM pr),
    fused AS (SELECT symbol, as_of, n, mean, dis, inner_var + dis AS var, within, within + dis AS epi FROM fu)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two models per bar: mixture, log weight and epistemic variance."""
    w = f.Frames()
    helped = f.with_helpers(tables.hourly_bars(spark, sf_dir), w).select(
        "symbol",
        F.col("timestamp").alias("as_of"),
        "_n",
        *[(w.mean(f.R(), n) / 100).alias(f"m{n}") for n in (20, 60)],
        *[(w.sd(f.R(), n) / 100).alias(f"s{n}") for n in (20, 60)],
    )

    def model(name: str, n: int, df: float, log_weight: float):
        scale = F.col(f"s{n}")
        return F.struct(
            F.lit(name).alias("model"),
            F.lit(log_weight).alias("log_weight"),
            F.array(F.struct(F.lit(1.0).alias("w"), F.col(f"m{n}").alias("loc"), scale.alias("scale"), F.lit(df).alias("df"))).alias("mixture"),
            (scale * scale / n).alias("epistemic_variance"),
        )

    both = F.array(model("fast", 20, 10.0, -1.0), model("slow", 60, 30.0, -0.5))
    return helped.where("_n > 60").select("symbol", "as_of", F.lit(5).alias("horizon_bars"), F.inline(both))


@query(
    "fuse_pool",
    f"""{PREDS_SQL} SELECT symbol, as_of, 2::BIGINT AS n_models, {r("mean", "mean", 9)}, {r("var", "variance", 9)}, {r("dis", "disagreement", 9)},
        {r("epi", "epistemic_variance", 9)}, round(exp(-0.5) / (1 + exp(-0.5)), 9) AS w_fast, round(1 / (1 + exp(-0.5)), 9) AS w_slow, 2 AS n_components,
        {r("wa * m20 + wb * m60", "pooled_loc", 9)} FROM fused JOIN pr USING (symbol, as_of)""",
)
def fuse_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = trading.fuse(predictions(spark, sf_dir))
    weights = [F.col("weights")[k]["weight"].alias(f"w_{m}") for k, m in enumerate(("fast", "slow"))]
    pooled = F.aggregate("mixture", F.lit(0.0), lambda acc, c: acc + c["w"] * c["loc"]).alias("pooled_loc")
    figures = ["n_models", "mean", "variance", "disagreement", "epistemic_variance"]
    return rounded(fused.select("symbol", "as_of", *figures, *weights, F.size("mixture").alias("n_components"), pooled), 9)


@query(
    "model_agreement",
    f"""{PREDS_SQL}, s AS (SELECT *, least(1, greatest(0, dis / var)) AS share FROM fused)
        SELECT symbol, as_of, {r("share", "disagreement_share")}, CASE WHEN share <= 0.1 THEN 'high' WHEN share <= 0.35 THEN 'medium' ELSE 'low' END AS agreement,
               {r("epi / var", "epistemic_share")} FROM s""",
)
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trading.agreement(trading.fuse(predictions(spark, sf_dir)))
    return rounded(out.select("symbol", "as_of", "disagreement_share", "agreement", "epistemic_share"))


#: What a decision reads, by rule from the pool's moments, so that SQL has it too.
DECISION_SQL = f"""{PREDS_SQL}, d AS (SELECT symbol, as_of, n, var AS variance, epi / var + (n % 10) / 12.0 AS share, 1 / (1 + exp(-400 * mean)) AS p,
        1 / (1 + exp((mean + 0.05) / sqrt(var) * 3)) AS below, 1 / (1 + exp((0.05 - mean) / sqrt(var) * 3)) AS above,
        mean - 1.7 * sqrt(var) AS lo, mean + 1.7 * sqrt(var) AS hi, CASE WHEN n % 17 = 0 THEN as_of + INTERVAL 4 DAY ELSE as_of + INTERVAL 1 HOUR END AS now FROM fused),
    g AS (SELECT *, p >= 0.6 AS buy, p <= 0.4 AS sell,
        CASE WHEN abs(epoch(now) - epoch(as_of)) / 86400 > 3 THEN 'stale_posterior' WHEN NOT variance > 0 THEN 'uncertainty_too_high'
             WHEN share > 0.6 THEN 'uncertainty_too_high' WHEN 1 - share < 0.55 THEN 'model_disagreement' WHEN p < 0.6 AND p > 0.4 THEN 'edge_too_small'
             WHEN CASE WHEN p >= 0.6 THEN below ELSE above END > 0.15 THEN 'loss_probability_too_high' END AS reason FROM d),
    i AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'no_trade' WHEN buy THEN 'buy' ELSE 'sell' END AS action,
        CASE WHEN reason IS NULL THEN greatest(CASE WHEN buy THEN -lo ELSE hi END, 0, 1e-4) END AS downside FROM g),
    intents AS (SELECT *, CASE WHEN reason IS NULL THEN least(0.005 / downside, 0.05) ELSE 0.0::DOUBLE END AS target_weight FROM i)"""


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = trading.fuse(predictions(spark, sf_dir)).select("symbol", "as_of", "mean", "variance", "epistemic_variance")
    n = F.row_number().over(f.Window.partitionBy("symbol").orderBy("as_of")) + 60
    sd = F.sqrt("variance")
    m = F.col("mean")
    logistic = lambda x: 1 / (1 + F.exp(x))
    rows = fused.withColumn("n", n).select(
        "symbol",
        "as_of",
        "n",
        "variance",
        (F.col("epistemic_variance") / F.col("variance") + F.col("n") % 10 / 12.0).alias("epistemic_share"),
        logistic(-400 * m).alias("p_positive"),
        logistic((m + 0.05) / sd * 3).alias("p_below_loss"),
        logistic((0.05 - m) / sd * 3).alias("p_above_loss"),
        (m - 1.7 * sd).alias("q_low"),
        (m + 1.7 * sd).alias("q_high"),
        F.when(F.col("n") % 17 == 0, F.col("as_of") + F.expr("INTERVAL 4 DAYS")).otherwise(F.col("as_of") + F.expr("INTERVAL 1 HOUR")).alias("now"),
    )
    return trading.decide(rows, LIMITS)


@query(
    "decide_gates",
    f"""{DECISION_SQL} SELECT symbol, as_of, action, reason, {r("downside", "downside")}, {r("target_weight", "target_weight")} FROM intents""",
)
def decide_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intents(spark, sf_dir).select("symbol", "as_of", "action", "reason", "downside", "target_weight"))


def _pool_cdf(x: str) -> str:
    return f"(wa * {t_cdf(f'(({x} - m20) / s20)', '10')} + wb * {t_cdf(f'(({x} - m60) / s60)', '30')})"


def _quantiles(levels: tuple[float, ...]) -> str:
    """Quantiles of the pools by fifty halvings, as common table expressions over PREDS_SQL."""
    start = "least(m20, m60) - 40 * greatest(s20, s60) AS low, greatest(m20, m60) + 40 * greatest(s20, s60) AS high"
    return f"""qs AS (SELECT symbol, as_of, wa, wb, m20, s20, m60, s60, level::DOUBLE AS level, 0 AS step, {start}
            FROM pr, (SELECT unnest({list(levels)}) AS level)
        UNION ALL
        SELECT symbol, as_of, wa, wb, m20, s20, m60, s60, level, step + 1, CASE WHEN below THEN mid ELSE low END, CASE WHEN below THEN high ELSE mid END
        FROM (SELECT *, {_pool_cdf("mid")} < level AS below FROM (SELECT *, (low + high) / 2 AS mid FROM qs WHERE step < 50))),
        q AS (SELECT symbol, as_of, level, (low + high) / 2 AS q FROM qs WHERE step = 50)"""


TAILS_SQL = f"""{PREDS_SQL.replace("WITH", "WITH RECURSIVE", 1)}, {_quantiles((0.05, 0.95))},
    lo AS (SELECT symbol, as_of, q AS lo FROM q WHERE level < 0.5), hi AS (SELECT symbol, as_of, q AS hi FROM q WHERE level > 0.5),
    z AS (SELECT pr.symbol, pr.as_of, var, epi / var AS share, 1 - {_pool_cdf("0")} AS p, {_pool_cdf("-0.05")} AS below, 1 - {_pool_cdf("0.05")} AS above, lo, hi
          FROM pr JOIN fused USING (symbol, as_of) JOIN lo USING (symbol, as_of) JOIN hi USING (symbol, as_of)),
    g AS (SELECT *, p >= 0.6 AS buy, CASE WHEN NOT var > 0 OR share > 0.6 THEN 'uncertainty_too_high' WHEN 1 - share < 0.55 THEN 'model_disagreement'
              WHEN p < 0.6 AND p > 0.4 THEN 'edge_too_small' WHEN CASE WHEN p >= 0.6 THEN below ELSE above END > 0.15 THEN 'loss_probability_too_high' END AS reason FROM z),
    d AS (SELECT *, CASE WHEN reason IS NULL THEN greatest(CASE WHEN buy THEN -lo ELSE hi END, 0, 1e-4) END AS downside FROM g)"""


@query(
    "decide_tails",
    f"""{TAILS_SQL} SELECT symbol, as_of, CASE WHEN reason IS NOT NULL THEN 'no_trade' WHEN buy THEN 'buy' ELSE 'sell' END AS action, reason,
        {r("p", "p_positive")}, {r("lo", "q_low")}, {r("hi", "q_high")}, {r("downside", "downside")},
        CASE WHEN reason IS NULL THEN round(least(0.005 / downside, 0.05), 6) + 0.0 ELSE 0.0::DOUBLE END AS target_weight FROM d""",
)
def decide_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on tails of the mixtures themselves."""
    fused = trading.agreement(trading.fuse(predictions(spark, sf_dir))).withColumn("now", F.col("as_of"))
    out = trading.decide(trading.tails(fused, LIMITS), LIMITS)
    return rounded(out.select("symbol", "as_of", "action", "reason", "p_positive", "q_low", "q_high", "downside", "target_weight"))


@query(
    "mixture_scores",
    f"""{PREDS_SQL.replace("WITH", "WITH RECURSIVE", 1)}, {_quantiles((0.5,))}, j AS (SELECT * FROM pr JOIN fused USING (symbol, as_of) JOIN q USING (symbol, as_of))
        SELECT symbol, as_of, {r(_pool_cdf("mean"), "u")}, {r("q", "median")},
               {r(f"ln(wa * exp({t_logpdf('((mean - m20) / s20)', '10.0', 's20')}) + wb * exp({t_logpdf('((mean - m60) / s60)', '30.0', 's60')}))", "logpdf")} FROM j""",
)
def mixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT, log density and median of every pool at its own mean."""
    fused = trading.fuse(predictions(spark, sf_dir))
    m = F.col("mixture")
    return rounded(
        fused.select(
            "symbol",
            "as_of",
            mixtures.cdf(m, F.col("mean")).alias("u"),
            mixtures.logpdf(m, F.col("mean")).alias("logpdf"),
            mixtures.quantile(m, 0.5).alias("median"),
        )
    )


#: Weights by rule of the hour: both unknown, one unknown, one model absent, else softmax of two log weights that vary.
WEIGHED_SQL = PREDS_SQL.replace(
    "exp(-0.5) / (1 + exp(-0.5)) AS wa, 1 / (1 + exp(-0.5)) AS wb FROM m WHERE n > 60)",
    """kind <> 2 AS answered, CASE kind WHEN 0 THEN 0.5 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 / (1 + exp(ls - lf)) END AS wa, 1 - wa AS wb
        FROM (SELECT *, hour(as_of) % 6 AS kind, -0.4 * (day(as_of) % 5) AS lf, -0.7 * (day(as_of) % 3) AS ls FROM m) WHERE n > 60)""",
).replace("WITH", "WITH RECURSIVE", 1)


def weighed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two models with log weights that vary, are unknown, or with one model that gives no answer."""
    kind, day, fast = F.hour("as_of") % 6, F.dayofmonth("as_of"), F.col("model") == "fast"
    weight = F.when((kind == 0) | ((kind == 1) & fast), None).when(fast, -0.4 * (day % 5)).otherwise(-0.7 * (day % 3))
    return predictions(spark, sf_dir).where(~((kind == 2) & fast)).withColumn("log_weight", weight)


@query(
    "fuse_weights",
    f"""{WEIGHED_SQL}, {_quantiles((0.05, 0.95))}, j AS (SELECT * FROM pr JOIN fused USING (symbol, as_of)),
    ends AS (SELECT symbol, as_of, min(q) AS lo, max(q) AS hi FROM q GROUP BY 1, 2)
    SELECT symbol, as_of, 1 + answered::BIGINT AS n_models, {r("mean", "mean", 9)}, {r("var", "variance", 9)}, {r("dis", "disagreement", 9)}, {r("epi", "epistemic_variance", 9)},
        CASE WHEN answered THEN round(wa, 9) + 0.0 END AS w_fast, {r("wb", "w_slow", 9)},
        {r("CASE WHEN answered THEN -(CASE WHEN wa > 0 THEN wa * ln(wa) ELSE 0 END + CASE WHEN wb > 0 THEN wb * ln(wb) ELSE 0 END) / ln(2) ELSE 0 END", "weight_entropy")},
        {r(f"1 - ({_pool_cdf('0.001')})", "p_above")}, {r(f"wa * exp({t_logpdf('((0 - m20) / s20)', '10.0', 's20')}) + wb * exp({t_logpdf('((0 - m60) / s60)', '30.0', 's60')})", "pdf_zero", 5)},
        {r("lo", "low")}, {r("hi", "high")} FROM j JOIN ends USING (symbol, as_of)""",
)
def fuse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools under weights that vary, with what is read off the pool: tail, density and central interval of 90 %."""
    fused = trading.fuse(weighed_predictions(spark, sf_dir))
    m, own = F.col("mixture"), lambda name: F.filter("weights", lambda w: w["model"] == name)
    span = mixtures.credible_interval(m, 0.9)
    figures = ["n_models", "mean", "variance", "disagreement", "epistemic_variance"]
    read = fused.select(
        "symbol",
        "as_of",
        *[F.round(c, 9).alias(c) if c != "n_models" else F.col(c) for c in figures],
        *[F.round(F.get(own(n), F.lit(0))["weight"], 9).alias(f"w_{n}") for n in ("fast", "slow")],
        F.round(mixtures.normalised_entropy(F.col("weights.weight")), 6).alias("weight_entropy"),
        F.round(mixtures.probability_above(m, 0.001), 6).alias("p_above"),
        F.round(mixtures.pdf(m, 0.0), 5).alias("pdf_zero"),
        F.round(span["lower"], 6).alias("low"),
        F.round(span["upper"], 6).alias("high"),
    )
    return rounded(read, 9)


BOOK_SQL = """bk AS (SELECT *, n % 29 = 0 AS halted, (n % 40) / 1500.0 AS daily_loss, (n % 50) / 300.0 AS drawdown,
        (n % 3 - 1) * 10.0 AS held, CASE WHEN n % 3 = 1 THEN 0 ELSE 0.01::DOUBLE * (n % 6) END AS pos, n % 12 AS slots,
        CASE WHEN n % 4 <> 0 THEN 0.02::DOUBLE * (n % 14) END AS sec, 0.03::DOUBLE * (n % 22) AS port, CASE WHEN n % 5 <> 0 THEN 0.3 + (n % 35) / 100.0 END AS vol,
        CASE WHEN n % 7 <> 0 THEN 4e7 + (n % 9) * 1e7 END AS tov FROM intents)"""

RISK_SQL = f"""{DECISION_SQL}, {BOOK_SQL},
    cr AS (SELECT *, action <> 'no_trade' AND target_weight > 0 AS acts,
        (action = 'sell' AND held > 0) OR (action = 'buy' AND held < 0) AS reducing,
        halted OR daily_loss > 0.02 OR drawdown > 0.15 OR (held = 0 AND slots + 1 > 10) OR coalesce(vol > 0.6, false) OR coalesce(tov < 5e7, false) AS stopped FROM bk),
    hr AS (SELECT *, greatest(0, 0.05::DOUBLE - pos) + CASE WHEN reducing THEN 2 * pos ELSE 0 END AS h1, CASE WHEN sec IS NOT NULL THEN greatest(0, 0.25::DOUBLE - sec) + CASE WHEN reducing THEN 2 * pos ELSE 0 END END AS h2,
        greatest(0, 0.6::DOUBLE - port) + CASE WHEN reducing THEN 2 * pos ELSE 0 END AS h3 FROM cr),
    kr AS (SELECT *, CASE WHEN NOT acts OR stopped OR h1 <= 0 OR (sec IS NOT NULL AND h2 <= 0) OR h3 <= 0 THEN 0.0::DOUBLE
        ELSE greatest(0, least(target_weight, h1, coalesce(h2, 1e9), h3)) END AS approved,
        CASE WHEN NOT acts THEN 0 WHEN stopped THEN halted::INT + (daily_loss > 0.02)::INT + (drawdown > 0.15)::INT + (held = 0 AND slots + 1 > 10)::INT
             + coalesce(vol > 0.6, false)::INT + coalesce(tov < 5e7, false)::INT
             ELSE (h1 <= 0)::INT + coalesce(h2 <= 0, false)::INT + (h3 <= 0)::INT END AS failures FROM hr)"""


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = intents(spark, sf_dir).withColumns(
        {
            "halted": n % 29 == 0,
            "daily_loss": n % 40 / 1500.0,
            "drawdown": n % 50 / 300.0,
            "held_quantity": (n % 3 - 1) * 10.0,
            "position_weight": F.when(n % 3 == 1, 0.0).otherwise(0.01 * (n % 6)),
            "n_positions": n % 12,
            "sector_exposure": F.when(n % 4 != 0, 0.02 * (n % 14)),
            "portfolio_exposure": 0.03 * (n % 22),
            "annualised_volatility": F.when(n % 5 != 0, 0.3 + n % 35 / 100.0),
            "daily_turnover": F.when(n % 7 != 0, 4e7 + n % 9 * 1e7),
        }
    )
    return trading.review(rows, LIMITS)


@query(
    "risk_review",
    f"""{RISK_SQL} SELECT symbol, as_of, {r("approved", "approved_weight")}, approved > 0 AND approved < target_weight AS was_reduced, failures FROM kr""",
)
def risk_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rulings(spark, sf_dir)
    failures = F.size(F.filter("checks", lambda c: c["status"] == "fail"))
    return rounded(out.select("symbol", "as_of", "approved_weight", "was_reduced", failures.alias("failures")))


def _risk_check(name: str, value: str, allowed: float, failed: str, skipped: str = "false", when: str = "acts") -> str:
    """One check of every ruling, in SQL."""
    return f"""SELECT '{name}' AS name, CASE WHEN {skipped} THEN 'skipped' WHEN {failed} THEN 'fail' ELSE 'pass' END AS status,
        CASE WHEN NOT ({skipped}) THEN ({value})::DOUBLE END AS observed, CASE WHEN NOT ({skipped}) THEN {allowed}::DOUBLE END AS allowed FROM ar WHERE {when}"""


CHECKS_SQL = " UNION ALL ".join(
    [
        "SELECT 'actionable' AS name, 'skipped' AS status, NULL::DOUBLE AS observed, NULL::DOUBLE AS allowed FROM ar WHERE NOT acts",
        _risk_check("kill_switch", "halted::INT", 0, "halted"),
        _risk_check("daily_loss", "daily_loss", 0.02, "daily_loss > 0.02"),
        _risk_check("drawdown", "drawdown", 0.15, "drawdown > 0.15"),
        _risk_check("open_positions", "slots + 1", 10, "slots + 1 > 10", "held <> 0"),
        _risk_check("volatility", "vol", 0.6, "vol > 0.6", "vol IS NULL"),
        _risk_check("liquidity", "tov", 5e7, "tov < 5e7", "tov IS NULL"),
        _risk_check("position_weight", "CASE WHEN h1 <= 0 THEN pos ELSE pos + least(a0, h1) END", 0.05, "h1 <= 0", when="acts AND NOT stopped"),
        _risk_check("sector_exposure", "CASE WHEN h2 <= 0 THEN sec ELSE sec + least(a1, h2) END", 0.25, "h2 <= 0", "sec IS NULL", "acts AND NOT stopped"),
        _risk_check("portfolio_exposure", "CASE WHEN h3 <= 0 THEN port ELSE port + least(a2, h3) END", 0.6, "h3 <= 0", when="acts AND NOT stopped"),
    ]
)


@query(
    "risk_checks",
    f"""{RISK_SQL}, ar AS (SELECT *, target_weight AS a0, least(target_weight, h1) AS a1, least(target_weight, h1, coalesce(h2, 1e9)) AS a2 FROM hr),
        x AS ({CHECKS_SQL})
        SELECT name, status, count(*) AS n, {r("sum(observed)", "observed", 4)}, {r("sum(allowed)", "allowed", 4)} FROM x GROUP BY 1, 2""",
)
def risk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of all rulings by name and status, with what they saw and allowed."""
    found = rulings(spark, sf_dir).select(F.inline("checks"))
    seen = lambda c: F.round(F.sum(F.when(~F.isnan(c), F.col(c))), 4)
    out = found.groupBy("name", "status").agg(F.count(F.lit(1)).alias("n"), seen("observed").alias("observed"), seen("allowed").alias("allowed"))
    return rounded(out, 4)


@query(
    "ruled_orders",
    f"""{RISK_SQL} SELECT symbol || '-' || lpad(row_number() OVER (PARTITION BY symbol ORDER BY as_of)::VARCHAR, 8, '0') AS order_id, symbol, as_of,
        action AS side, {r("approved * 1e6 / 100", "quantity")} FROM kr WHERE approved > 0""",
)
def ruled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = rulings(spark, sf_dir).withColumn("equity", F.lit(1e6)).withColumn("last_price", F.lit(100.0))
    return rounded(trading.orders(priced))


FILLS_SQL = f"""{TICKS}, o AS (SELECT event_id, symbol, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
        ['market', 'limit', 'stop_loss'][(event_id % 5 % 3 + 1)::INT] AS order_type, (event_id % 13 + 1)::DOUBLE AS quantity, price AS last_price, volume,
        price * (1 + (event_id % 7 - 3) / 2000.0) AS limit_price FROM ticks),
    w AS (SELECT *, CASE WHEN side = 'buy' THEN last_price * 1.0005 ELSE last_price * 0.9995 END AS worse, order_type = 'limit' AS lim FROM o),
    e AS (SELECT *, CASE WHEN lim AND side = 'buy' THEN least(worse, limit_price) WHEN lim THEN greatest(worse, limit_price) ELSE worse END AS px,
        lim AND ((side = 'buy' AND worse > limit_price) OR (side = 'sell' AND worse < limit_price)) AS missed,
        CASE WHEN volume <= 0 THEN quantity ELSE least(quantity, 0.1 * volume) END AS q FROM w),
    f AS (SELECT *, CASE WHEN missed THEN 'open' WHEN order_type = 'stop_loss' THEN 'rejected' WHEN q < quantity THEN 'partially_filled' ELSE 'filled' END AS status FROM e),
    fills AS (SELECT *, CASE WHEN status IN ('filled', 'partially_filled') THEN q ELSE 0.0 END AS filled FROM f)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kinds = F.array(*map(F.lit, ("market", "limit", "stop_loss")))
    placed = tables.ticks(spark, sf_dir).select(
        "event_id",
        "symbol",
        F.when(n % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.element_at(kinds, (n % 5 % 3 + 1).cast("int")).alias("order_type"),
        (n % 13 + 1).cast("double").alias("quantity"),
        F.col("price").alias("last_price"),
        "volume",
        (F.col("price") * (1 + (n % 7 - 3) / 2000.0)).alias("limit_price"),
    )
    return trading.paper_fills(placed)


@query(
    "paper_fills",
    f"""WITH {FILLS_SQL} SELECT event_id, status, {r("filled", "filled")}, CASE WHEN filled > 0 THEN round(px, 6) + 0.0 END AS fill_price,
        {r("CASE WHEN filled > 0 THEN greatest(filled * px * 0.0003, 0) ELSE 0 END", "fees")} FROM fills""",
)
def paper_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fills(spark, sf_dir).select("event_id", "status", "filled", "fill_price", "fees"))


@query(
    "cash_flows",
    f"""WITH {FILLS_SQL} SELECT symbol, round(sum(CASE WHEN side = 'buy' THEN -filled * px ELSE filled * px END - filled * px * 0.0003), 4) + 0.0 AS cash_flow,
        {r("sum(CASE WHEN side = 'buy' THEN filled ELSE -filled END)", "quantity")}, count(*) AS n FROM fills WHERE filled > 0 GROUP BY symbol""",
)
def cash_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fills(spark, sf_dir).where("filled > 0").select(
        "symbol", "side", F.col("filled").alias("quantity"), F.col("fill_price").alias("price"), F.col("fees").alias("commission")
    )
    out = done.groupBy("symbol").agg(
        F.round(F.sum(market.cash_flow()), 4).alias("cash_flow"), F.sum(market.signed_quantity()).alias("quantity"), F.count(F.lit(1)).alias("n")
    )
    return rounded(out)


#: One fill applied to a held quantity q at average price a: delta is signed, px its price.
AFTER = """CASE WHEN abs(q + delta) < 1e-9 THEN 0.0 ELSE q + delta END"""
AVERAGE = """CASE WHEN abs(q + delta) < 1e-9 THEN 0.0 WHEN q = 0 OR sign(q + delta) <> sign(q) THEN px
    WHEN abs(q + delta) > abs(q) THEN (q * a + delta * px) / (q + delta) ELSE a END"""


@query(
    "settled_book",
    f"""WITH RECURSIVE {FILLS_SQL}, s AS (SELECT symbol, event_id, side, filled, px, filled * px * 0.0003 AS fee, CASE WHEN side = 'buy' THEN filled ELSE -filled END AS delta,
            row_number() OVER (PARTITION BY symbol ORDER BY event_id) AS i FROM fills WHERE filled > 0),
        run AS (SELECT DISTINCT symbol, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BOOLEAN AS accepted, 5000.0::DOUBLE AS cash, 0.0::DOUBLE AS q, 0.0::DOUBLE AS a FROM s
            UNION ALL
            SELECT symbol, i, event_id, ok, CASE WHEN ok THEN cash - delta * px - fee ELSE cash END, CASE WHEN ok THEN {AFTER} ELSE q END, CASE WHEN ok THEN {AVERAGE} ELSE a END
            FROM (SELECT s.*, cash, q, a, side <> 'buy' OR filled * px + fee <= cash AS ok FROM run JOIN s ON s.symbol = run.symbol AND s.i = run.i + 1))
        SELECT symbol AS account, seq, symbol, accepted, {r("cash", "cash")}, {r("q", "quantity")}, {r("a", "average_price")} FROM run WHERE i > 0""",
)
def settled_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills through the cash and positions of an account per symbol, in order: a fold."""
    rows = fills(spark, sf_dir).withColumn("account", F.col("symbol")).withColumn("seq", F.col("event_id"))
    return rounded(trading.settle(rows, 5_000.0))


@query(
    "cancelled_orders",
    f"""WITH {FILLS_SQL} SELECT event_id, CASE WHEN event_id % 3 = 0 AND status = 'open' THEN 'cancelled' ELSE status END AS status,
        event_id % 3 = 0 AND status = 'open' AS cancelled,
        CASE WHEN event_id % 3 = 0 THEN CASE WHEN status = 'open' THEN 'cancelled' ELSE 'cannot cancel an order that is ' || status END END AS note FROM fills""",
)
def cancelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order is asked to be cancelled; only open ones are."""
    receipts = fills(spark, sf_dir).select(F.col("event_id").alias("order_id"), "status")
    out = books.cancel_orders(receipts, receipts.where("order_id % 3 = 0").select("order_id"))
    return out.select(F.col("order_id").alias("event_id"), "status", "cancelled", "note")


@query(
    "marked_books",
    f"""WITH {FILLS_SQL}, held AS (SELECT symbol AS account, sum(CASE WHEN side = 'buy' THEN filled ELSE -filled END) AS quantity,
            sum(filled * px) / sum(filled) AS average_price, sum(CASE WHEN side = 'buy' THEN -filled ELSE filled END * px - filled * px * 0.0003) + 1e6 AS cash
            FROM fills WHERE filled > 0 GROUP BY 1),
        q AS (SELECT symbol AS account, arg_max(price, ts) AS price FROM ticks WHERE symbol <> 'view' AND ts < TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1),
        m AS (SELECT held.*, coalesce(q.price, average_price) AS last_price FROM held LEFT JOIN q USING (account))
        SELECT account, {r("last_price", "last_price", 4)}, {r("quantity * (last_price - average_price)", "unrealised_pnl", 3)}, {r("cash", "cash", 3)},
               {r("quantity * last_price", "worth", 3)}, {r("cash + quantity * last_price", "equity", 3)} FROM m""",
)
def marked_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's account marked at its last tick before a moment; one symbol has no quote and keeps its average."""
    done = fills(spark, sf_dir).where("filled > 0").select("symbol", "side", F.col("filled").alias("quantity"), F.col("fill_price").alias("price"), F.col("fees").alias("commission"))
    held = done.groupBy(F.col("symbol")).agg(
        F.sum(market.signed_quantity()).alias("quantity"),
        (F.sum(F.col("quantity") * F.col("price")) / F.sum("quantity")).alias("average_price"),
        (F.sum(market.cash_flow()) + 1e6).alias("cash"),
    )
    positions = held.select("symbol", F.col("symbol").alias("account"), "quantity", "average_price", F.col("average_price").alias("last_price"))
    before = tables.ticks(spark, sf_dir).where("symbol <> 'view' AND ts < TIMESTAMP_NTZ '2024-01-25 00:00:00'")
    marked = books.mark_to_market(positions, before.select("symbol", F.col("ts").alias("timestamp"), F.col("price").alias("last_price")))
    equity = books.equity_of(marked, held.select(F.col("symbol").alias("account"), "cash"))
    out = equity.join(marked.select("account", "last_price", "unrealised_pnl"), "account")
    return out.select("account", F.round("last_price", 4).alias("last_price"), *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("unrealised_pnl", "cash", "worth", "equity")])


# --- books ---------------------------------------------------------------------------------------------------------------
BOOKS_SQL = """a AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS q, sum(l_extendedprice) / sum(l_quantity) AS p FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1),
    b AS (SELECT l_suppkey AS symbol, sum(l_quantity) + (l_suppkey % 7 = 0)::INT AS q, sum(l_extendedprice) / sum(l_quantity) * (CASE WHEN l_suppkey % 6 = 0 THEN 1.01 ELSE 1 END) AS p
          FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY l_suppkey),
    j AS (SELECT coalesce(a.symbol, b.symbol)::VARCHAR AS symbol, a.q AS lq, b.q AS vq, a.p AS lp, b.p AS vp FROM a FULL JOIN b ON a.symbol = b.symbol)"""


@query(
    "reconcile",
    f"""WITH {BOOKS_SQL}
        SELECT symbol, 'unexpected_position' AS kind, NULL::DOUBLE AS local, vq::DOUBLE AS venue FROM j WHERE lq IS NULL AND vq <> 0
        UNION ALL SELECT symbol, 'missing_position', lq, NULL FROM j WHERE vq IS NULL
        UNION ALL SELECT symbol, 'quantity_mismatch', lq, vq FROM j WHERE abs(lq - vq) > 0
        UNION ALL SELECT symbol, 'average_price_mismatch', round(lp, 6) + 0.0, round(vp, 6) + 0.0 FROM j WHERE lq <> 0 AND vq <> 0 AND abs(lp - vp) / greatest(abs(lp), abs(vp)) > 1e-4""",
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("quantity"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("average_price")
    )
    key = F.col("l_suppkey")
    local = lines.where(key % 10 != 0).withColumn("symbol", key.cast("string"))
    venue = lines.where(key % 9 != 0).select(
        key.cast("string").alias("symbol"),
        (F.col("quantity") + (key % 7 == 0).cast("int")).alias("quantity"),
        (F.col("average_price") * F.when(key % 6 == 0, 1.01).otherwise(1.0)).alias("average_price"),
    )
    return rounded(books.reconcile_positions(local, venue))


@query(
    "reconcile_orders",
    """WITH a AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS s, o_totalprice AS q FROM orders WHERE o_orderkey % 10 <> 0),
        b AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 14 <> 0 THEN 'buy' ELSE 'sell' END AS s, o_totalprice AS q FROM orders WHERE o_orderkey % 9 <> 0)
        SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'unexpected_order' WHEN b.id IS NULL THEN 'missing_order' ELSE 'order_mismatch' END AS kind,
               a.q AS local, b.q AS venue FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.s <> b.s OR a.q <> b.q""",
)
def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = tables.table(spark, sf_dir, "orders").select(n, n.cast("string").alias("id"), F.col("o_totalprice").alias("quantity"))
    local = rows.where(n % 10 != 0).withColumn("side", F.when(n % 2 == 0, "buy").otherwise("sell"))
    venue = rows.where(n % 9 != 0).withColumn("side", F.when((n % 2 == 0) & (n % 14 != 0), "buy").otherwise("sell"))
    return books.reconcile_orders(local, venue)


JOURNAL_SQL = f"""{FILLS_SQL}, jl AS (SELECT fills.symbol, fills.event_id AS line, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS as_of, CASE WHEN fills.event_id % 97 = 0 THEN 'halted' WHEN fills.event_id % 31 = 0 THEN 'refit' ELSE 'bar' END AS event,
    side AS action, filled, CASE WHEN filled > 0 THEN px END AS fill_price, CASE WHEN filled > 0 THEN filled * px * 0.0003 ELSE 0 END AS fees,
    'o' || (fills.event_id // 2)::VARCHAR AS order_id, 1000 + (fills.event_id % 100)::DOUBLE AS equity FROM fills JOIN ticks USING (event_id))"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines by rule: fills as bar events, with refits and halts between them."""
    n = F.col("event_id")
    moments = tables.ticks(spark, sf_dir).select("event_id", "ts")
    return (
        fills(spark, sf_dir)
        .join(moments, "event_id")
        .select(
            "symbol",
            F.col("event_id").alias("line"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("as_of"),
            F.when(n % 97 == 0, "halted").when(n % 31 == 0, "refit").otherwise("bar").alias("event"),
            F.col("side").alias("action"),
            "filled",
            "fill_price",
            "fees",
            F.concat(F.lit("o"), F.floor(n / 2).cast("string")).alias("order_id"),
            (1000 + n % 100).cast("double").alias("equity"),
        )
    )


@query(
    "journal_state",
    f"""WITH {JOURNAL_SQL} SELECT symbol, count(*) AS entries, max(as_of) AS last_as_of,
        arg_max(equity, line) FILTER (event = 'bar') AS last_equity, count(*) FILTER (event = 'bar' AND filled <> 0) AS fills,
        count(DISTINCT order_id) FILTER (event = 'bar') AS orders, count(*) FILTER (event = 'halted') AS halted FROM jl GROUP BY symbol""",
)
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.journal_state(journal(spark, sf_dir))


@query(
    "rebuild_account",
    f"""WITH {JOURNAL_SQL} SELECT symbol, {r("sum(CASE WHEN action = 'buy' THEN filled ELSE -filled END)", "quantity")},
        round(sum(CASE WHEN action = 'buy' THEN -filled ELSE filled END * fill_price - fees), 4) + 0.0 AS cash_moved,
        count(*) FILTER (fill_price IS NULL) AS priceless, 100000.0::DOUBLE AS opening_cash FROM jl WHERE event = 'bar' AND filled > 0 GROUP BY symbol""",
)
def rebuild_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = books.rebuilt_cash(journal(spark, sf_dir), 100_000.0)
    return rounded(out.withColumn("cash_moved", F.round("cash_moved", 4)))


@query(
    "rebuild_positions",
    f"""WITH RECURSIVE {JOURNAL_SQL}, s AS (SELECT symbol, fill_price AS px, CASE WHEN action = 'buy' THEN filled ELSE -filled END AS delta,
            row_number() OVER (PARTITION BY symbol ORDER BY as_of, order_id) AS i FROM jl WHERE event = 'bar' AND filled > 0 AND fill_price IS NOT NULL),
        run AS (SELECT DISTINCT symbol, 0::BIGINT AS i, 0.0::DOUBLE AS q, 0.0::DOUBLE AS a FROM s
            UNION ALL
            SELECT symbol, i, {AFTER}, {AVERAGE} FROM (SELECT s.*, q, a FROM run JOIN s ON s.symbol = run.symbol AND s.i = run.i + 1)),
        ends AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1)
        SELECT symbol, {r("q", "quantity")}, {r("a", "average_price")} FROM ends WHERE q <> 0""",
)
def rebuild_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average prices depend on the order of fills: a fold per symbol."""
    return rounded(books.rebuild_positions(journal(spark, sf_dir)))


@query(
    "after_restart",
    f"""WITH {HOURLY}, e AS (SELECT symbol, timestamp, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS n FROM bars
            WHERE timestamp <= TIMESTAMP '2024-01-20 00:00:00' AND symbol <> 'view'),
        mark AS (SELECT symbol, max(timestamp) AS m FROM e GROUP BY 1)
        SELECT bars.symbol, bars.timestamp FROM bars LEFT JOIN mark USING (symbol) WHERE m IS NULL OR timestamp > m""",
)
def after_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of bars whose last lines are halts and refits; one symbol has no line."""
    bars = tables.hourly_bars(spark, sf_dir)
    entries = bars.where("timestamp <= TIMESTAMP_NTZ '2024-01-20 00:00:00' AND symbol <> 'view'").select(
        "symbol",
        F.when(F.col("timestamp") < F.lit("2024-01-19 12:00:00").cast("timestamp_ntz"), "bar")
        .when(F.hour("timestamp") % 2 == 0, "halted")
        .otherwise("refit")
        .alias("event"),
        F.col("timestamp").cast("string").alias("as_of"),
    )
    return books.after_restart(bars, entries).select("symbol", "timestamp")


# --- wire formats ----------------------------------------------------------------------------------------------------------
#: Packets of two modes a tick, in SQL; k is the place of the packet in its frame.
PACKETS_SQL = f"""{"WITH " + TICKS}, pk AS (SELECT event_id, k AS position, price, volume, ts, ['ltp', 'index_quote', 'index_full', 'quote', 'full'][((event_id + 2 * k) % 5 + 1)::INT] AS mode,
        round(price * 100) AS units, CASE event_id % 9 WHEN 3 THEN 1e7 WHEN 6 THEN 1e4 ELSE 100 END AS divisor FROM ticks, (SELECT unnest([0, 1]) AS k)),
    dp AS (SELECT event_id, position, mode, (event_id * 256 + event_id % 9)::BIGINT AS token, (event_id % 9)::INT AS segment, units / divisor AS last_price,
        CASE WHEN mode IN ('quote', 'full') THEN volume::BIGINT END AS volume, CASE WHEN mode = 'full' THEN (event_id % 4 * 10)::BIGINT END AS bid_quantity,
        CASE WHEN mode = 'full' THEN (units - 5) / divisor END AS bid, CASE WHEN mode = 'full' THEN (event_id % 3)::BIGINT END AS ask_quantity,
        CASE WHEN mode = 'full' THEN (units + 5) / divisor END AS ask, CASE WHEN mode = 'full' THEN date_trunc('second', ts) END AS exchange_timestamp FROM pk)"""


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as binary frames of two packets, of all five lengths, then cut and decoded."""
    n = F.col("event_id")
    word = lambda x, width=8: F.lpad(F.substring(F.hex(x.cast("long")), -width, width), width, "0")  # noqa: E731  two's complement
    zeros = lambda size: F.repeat(F.lit("00"), size)
    units = F.round(F.col("price") * 100)
    head = F.concat(word(n * 256 + n % 9), word(units))
    traded = F.concat(head, zeros(8), word(F.col("volume")))
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    full = F.concat(traded, zeros(40), word(second), word(n % 4 * 10), word(units - 5), zeros(52), word(n % 3), word(units + 5), zeros(52))
    kinds = F.array(head, F.concat(head, zeros(20)), F.concat(head, zeros(24)), F.concat(traded, zeros(24)), full)
    packet = lambda k: F.element_at(kinds, ((n + 2 * k) % 5 + 1).cast("int"))
    framed = lambda x: F.concat(word(F.length(x) / 2, 4), x)
    frame = F.unhex(F.concat(word(F.lit(2), 4), framed(packet(0)), framed(packet(1))))
    return frames.decode(frames.packets(tables.ticks(spark, sf_dir).select("event_id", frame.alias("frame")))).drop("packet")


@query(
    "binary_ticks",
    f"""{PACKETS_SQL} SELECT event_id, position::INT AS position, mode, token, segment, {r("last_price", "last_price", 9)}, volume, bid_quantity, {r("bid", "bid", 9)},
        ask_quantity, {r("ask", "ask", 9)}, exchange_timestamp FROM dp""",
)
def binary_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of all five lengths, two a frame."""
    return rounded(_packets(spark, sf_dir), 9)


@query(
    "frame_quotes",
    f"""{PACKETS_SQL} SELECT token::VARCHAR AS symbol, exchange_timestamp AS timestamp, {r("last_price", "last_price", 9)},
        CASE WHEN bid > 0 AND bid_quantity > 0 THEN round(bid, 9) + 0.0 END AS bid, CASE WHEN ask > 0 AND ask_quantity > 0 THEN round(ask, 9) + 0.0 END AS ask,
        bid_quantity, ask_quantity, coalesce(volume::DOUBLE, 0.0) AS volume FROM dp WHERE last_price > 0""",
)
def frame_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets as quotes; sides without quantity are absent."""
    return rounded(frames.to_quotes(_packets(spark, sf_dir)), 9)


@query(
    "vendor_candles",
    f"""WITH {HOURLY}, c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS n FROM bars)
        SELECT symbol, timestamp, {r("close", "close")}, CASE WHEN n % 5 = 0 THEN 0.0::DOUBLE ELSE round(volume, 6) + 0.0 END AS volume FROM c
        WHERE timestamp + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25 00:30:00'""",
)
def vendor_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as candles with epoch or ISO stamps, repeated with other prices, absent volumes and an unfinished last one."""
    n = F.row_number().over(f.Window.partitionBy("symbol").orderBy("timestamp"))
    bars = tables.hourly_bars(spark, sf_dir).withColumn("n", n)
    epoch = F.unix_timestamp(F.col("timestamp").cast("timestamp")) - 330 * 60
    stamp = F.when(F.col("n") % 2 == 0, epoch.cast("string")).otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = bars.select(
        "symbol", F.lit(0).alias("seq"), stamp.alias("stamp"), "open", "high", "low", "close", F.when(F.col("n") % 5 != 0, F.col("volume")).alias("volume")
    )
    again = rows.withColumns({"seq": F.lit(1), "close": F.col("low")})
    done, _ = vendors.candles_to_bars(rows.unionByName(again), "1h", "2024-01-25 00:30:00")
    return rounded(done.select("symbol", "timestamp", "close", "volume"))


# --- feeds -----------------------------------------------------------------------------------------------------------------
ARRIVALS = f"""{TICKS}, ar AS (SELECT *, event_id + (CASE WHEN event_id % 11 = 0 THEN 7 ELSE 0 END) AS arrival FROM ticks),
    v AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ar)"""


@query(
    "late_ticks",
    f"""WITH {ARRIVALS} SELECT symbol, CASE WHEN ts < seen THEN 'out_of_order' WHEN ts = seen THEN 'duplicate' ELSE 'accepted' END AS verdict, count(*) AS n FROM v GROUP BY 1, 2""",
)
def late_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.streaming.gate import verdicts

    n = F.col("event_id")
    rows = tables.ticks(spark, sf_dir).withColumn("arrival", n + F.when(n % 11 == 0, 7).otherwise(0))
    out = verdicts(rows, ["arrival", "event_id"])
    return out.groupBy("symbol", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feed_gaps",
    f"""WITH {TICKS}, g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before FROM ticks)
        SELECT symbol, ts, before, epoch(ts - before) > 3600 AS after_silence FROM g WHERE before IS NOT NULL AND epoch(ts - before) > 3600""",
)
def feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.streaming.gate import silences

    return silences(tables.ticks(spark, sf_dir), 3600)


@query(
    "quote_book",
    f"""{"WITH " + TICKS.replace("ticks AS", "ticks AS")}, q AS (SELECT symbol, event_id % 5 <> 0 AS has_bid, event_id % 7 <> 0 AS has_ask FROM ticks)
        SELECT symbol, count(*) FILTER (has_bid AND has_ask) AS two_sided, count(*) AS n FROM q GROUP BY symbol""",
)
def quote_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes(spark, sf_dir)
    both = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    return rows.groupBy("symbol").agg(F.count_if(both).alias("two_sided"), F.count(F.lit(1)).alias("n"))
