"""From predictions to fills: fusion, decision, risk, execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.config import RiskLimits
from tidebook.functions import mixtures
from tidebook.functions.filters import Book
from tidebook.operators.folds import fold

# Bounds of the agreement labels.
AGREEMENT_BOUNDS = (0.1, 0.35)
TAIL, FLOOR_DOWNSIDE = 0.05, 1e-4
COMMISSION, SLIPPAGE, PARTICIPATION = 3e-4, 5e-4, 0.1


def fuse(results: DataFrame) -> DataFrame:
    """Pools the models that answered: rows (symbol, as_of, horizon_bars, model, log_weight, mixture, epistemic_variance).

    Weights are the softmax of the log weights of the models present (equal where all are
    null); the pool's components are theirs. Two answers of one model are an error.
    """
    moment = ["symbol", "as_of", "horizon_bars"]
    at = Window.partitionBy(*moment)
    raw = F.exp(F.col("log_weight") - F.max("log_weight").over(at))
    weighed = results.withColumn("_raw", F.coalesce(raw, F.lit(0.0)))
    total = F.sum("_raw").over(at)
    weighed = weighed.withColumn("weight", F.when(total > 0, F.col("_raw") / total).otherwise(1 / F.count(F.lit(1)).over(at)))
    parts = F.transform(
        mixtures.normalised(F.col("mixture")),
        lambda c: F.struct((c["w"] * F.col("weight")).alias("w"), c["loc"].alias("loc"), c["scale"].alias("scale"), c["df"].alias("df")),
    )
    own = mixtures.mean(F.col("mixture"))
    pooled = (
        weighed.withColumn("_parts", parts)
        .withColumn("_mean", own)
        .groupBy(*moment)
        .agg(
            F.flatten(F.array_sort(F.collect_list(F.struct("model", "_parts")))["_parts"]).alias("mixture"),
            F.count(F.lit(1)).alias("n_models"),
            F.count_distinct("model").alias("_distinct"),
            F.sum(F.col("weight") * F.col("epistemic_variance")).alias("within_epistemic"),
            (F.sum(F.col("weight") * F.col("_mean") * F.col("_mean")) - F.pow(F.sum(F.col("weight") * F.col("_mean")), F.lit(2.0))).alias("_between"),
            F.array_sort(F.collect_list(F.struct("model", "weight"))).alias("weights"),
        )
    )
    n_models = F.when(F.col("n_models") == F.col("_distinct"), F.col("n_models")).otherwise(F.raise_error(F.lit("two results from one model")))
    return (
        pooled.withColumn("n_models", n_models.cast("long"))
        .withColumn("disagreement", F.greatest(F.col("_between"), F.lit(0.0)))
        .withColumn("epistemic_variance", F.col("within_epistemic") + F.col("disagreement"))
        .withColumn("mean", mixtures.mean(F.col("mixture")))
        .withColumn("variance", mixtures.variance(F.col("mixture")))
        .drop("_distinct", "_between")
    )


def agreement(fused: DataFrame) -> DataFrame:
    """Share of the variance that is disagreement, its label, and the share that evidence could remove."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("disagreement") / F.col("variance")))
    low, high = AGREEMENT_BOUNDS
    return (
        fused.withColumn("disagreement_share", share)
        .withColumn("agreement", F.when(F.col("disagreement_share") <= low, "high").when(F.col("disagreement_share") <= high, "medium").otherwise("low"))
        .withColumn("epistemic_share", F.col("epistemic_variance") / F.col("variance"))
    )


def tails(fused: DataFrame, limits: RiskLimits) -> DataFrame:
    """Adds the probabilities and quantiles that a decision reads, all from the mixture."""
    read = mixtures.tails(F.col("mixture"), limits.large_loss_threshold, TAIL)
    return fused.withColumn("_tails", read).select(*fused.columns, "_tails.*")


def decide(rows: DataFrame, limits: RiskLimits, max_age_days: float = 3.0) -> DataFrame:
    """Adds action, reason, downside and target_weight; gates in order, the first that refuses names the reason.

    Needs as_of, variance, epistemic_share, p_positive, p_below_loss, p_above_loss, q_low and
    q_high; a column now (null: not checked) decides staleness.
    """
    age = F.abs(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("as_of").cast("timestamp"))) / 86_400e6
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    var, share = F.col("variance"), F.col("epistemic_share")
    buy = F.col("p_positive") >= limits.min_probability_positive
    sell = F.col("p_positive") <= 1 - limits.min_probability_positive
    loss = F.when(buy, F.col("p_below_loss")).otherwise(F.col("p_above_loss"))
    reason = (
        F.when(age > max_age_days, "stale_posterior")
        .when(bad(var) | (var <= 0), "uncertainty_too_high")
        .when(bad(share) | (share > limits.max_model_uncertainty), "uncertainty_too_high")
        .when(1 - share < limits.min_confidence, "model_disagreement")
        .when(~buy & ~sell, "edge_too_small")
        .when(loss > limits.max_probability_large_loss, "loss_probability_too_high")
    )
    adverse = F.greatest(F.when(buy, -F.col("q_low")).otherwise(F.col("q_high")), F.lit(0.0), F.lit(FLOOR_DOWNSIDE))
    return (
        rows.withColumn("reason", reason)
        .withColumn("action", F.when(F.col("reason").isNotNull(), "no_trade").when(buy, "buy").otherwise("sell"))
        .withColumn("downside", F.when(F.col("reason").isNull(), adverse))
        .withColumn(
            "target_weight",
            F.when(F.col("reason").isNull(), F.least(limits.risk_budget_per_trade / F.col("downside"), F.lit(limits.max_position_weight))).otherwise(0.0),
        )
    )


def review(intents: DataFrame, limits: RiskLimits) -> DataFrame:
    """Adds checks (name, status, observed, allowed) and approved_weight.

    Needs action, target_weight, halted, daily_loss, drawdown, held_quantity (0: none),
    position_weight, n_positions, sector_exposure (null: no sector), portfolio_exposure,
    annualised_volatility and daily_turnover (null: skipped). A failed check approves nothing;
    ceilings reduce to their headroom, and a trade that unwinds may also give back what is held.
    """
    acts = F.col("action").isin("buy", "sell") & (F.col("target_weight") > 0)
    opening = F.col("held_quantity") == 0
    reducing = ((F.col("action") == "sell") & (F.col("held_quantity") > 0)) | ((F.col("action") == "buy") & (F.col("held_quantity") < 0))
    nan = F.lit(float("nan"))

    def check(name: str, status: Column, observed: Column, allowed: Column | float) -> Column:
        allowed = F.lit(float(allowed)) if isinstance(allowed, (int, float)) else allowed
        skipped = status == "skipped"
        return F.struct(
            F.lit(name).alias("name"),
            status.alias("status"),
            F.when(skipped, nan).otherwise(observed.cast("double")).alias("observed"),
            F.when(skipped, nan).otherwise(allowed).alias("allowed"),
        )

    def gate(name: str, observed: Column, allowed: float, skip: Column | None = None) -> Column:
        status = F.when(observed <= allowed, "pass").otherwise("fail")
        return check(name, status if skip is None else F.when(skip, "skipped").otherwise(status), observed, allowed)

    turnover = F.col("daily_turnover")
    account = [
        check("kill_switch", F.when(F.col("halted"), "fail").otherwise("pass"), F.col("halted").cast("double"), 0.0),
        gate("daily_loss", F.col("daily_loss"), limits.max_daily_loss),
        gate("drawdown", F.col("drawdown"), limits.max_drawdown),
        gate("open_positions", F.col("n_positions") + 1, limits.max_open_positions, ~opening),
        gate("volatility", F.col("annualised_volatility"), limits.max_annualised_volatility, F.col("annualised_volatility").isNull()),
        check(
            "liquidity",
            F.when(turnover.isNull(), "skipped").when(turnover >= limits.min_daily_turnover, "pass").otherwise("fail"),
            turnover,
            limits.min_daily_turnover,
        ),
    ]

    def headroom(used: Column, cap: float) -> Column:
        gap = F.greatest(F.lit(0.0), F.lit(cap) - used)
        return F.when(reducing, 2 * F.col("position_weight") + gap).otherwise(gap)

    rows = intents.withColumn("_account", F.array(*account)).withColumn(
        "_stopped", F.exists("_account", lambda c: c["status"] == "fail")
    )
    rows = rows.withColumn("_allowed", F.col("target_weight"))
    ceilings = (
        ("position_weight", F.col("position_weight"), limits.max_position_weight),
        ("sector_exposure", F.col("sector_exposure"), limits.max_sector_exposure),
        ("portfolio_exposure", F.col("portfolio_exposure"), limits.max_portfolio_exposure),
    )
    names = []
    for name, used, cap in ceilings:
        room = headroom(used, cap)
        status = F.when(used.isNull(), "skipped").when(room <= 0, "fail").otherwise("pass")
        observed = F.when(room <= 0, used).otherwise(used + F.least("_allowed", room))
        rows = rows.withColumn(f"_{name}", check(name, status, observed, cap)).withColumn(
            "_allowed", F.when(used.isNull(), F.col("_allowed")).otherwise(F.least("_allowed", room))
        )
        names.append(f"_{name}")
    nothing = F.array(check("actionable", F.lit("skipped"), nan, 0.0))
    checks = F.when(~acts, nothing).when(F.col("_stopped"), F.col("_account")).otherwise(F.concat("_account", F.array(*names)))
    rows = rows.withColumn("checks", checks)
    failed = F.exists("checks", lambda c: c["status"] == "fail")
    return (
        rows.withColumn("approved_weight", F.when(~acts | failed, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_allowed"))))
        .withColumn("was_reduced", (F.col("approved_weight") > 0) & (F.col("approved_weight") < F.col("target_weight")))
        .drop("_account", "_stopped", "_allowed", *names)
    )


def orders(rulings: DataFrame) -> DataFrame:
    """Approved rulings as market orders: order_id, symbol, as_of, side and quantity."""
    quantity = F.col("approved_weight") * F.col("equity") / F.col("last_price")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("as_of"))
    return rulings.where("approved_weight > 0").select(
        F.concat("symbol", F.lit("-"), F.lpad(place.cast("string"), 8, "0")).alias("order_id"),
        "symbol",
        "as_of",
        F.col("action").alias("side"),
        quantity.alias("quantity"),
    )


def paper_fills(
    placed: DataFrame, commission: float = COMMISSION, slippage: float = SLIPPAGE, participation: float = PARTICIPATION, minimum: float = 0.0
) -> DataFrame:
    """Adds status, filled, fill_price and fees to orders priced against a quote, cash aside.

    Needs side, order_type, quantity, limit_price (null: none), last_price and volume. Slippage is
    always adverse; a bar without volume does not bound the fill.
    """
    buy = F.col("side") == "buy"
    worse = F.when(buy, F.col("last_price") * (1 + slippage)).otherwise(F.col("last_price") * (1 - slippage))
    limit = F.when(F.col("order_type") == "limit", F.col("limit_price"))
    missed = (buy & (worse > limit)) | (~buy & (worse < limit))
    price = F.when(limit.isNull(), worse).when(buy, F.least(worse, limit)).otherwise(F.greatest(worse, limit))
    quantity = F.when(F.col("volume") <= 0, F.col("quantity")).otherwise(F.least(F.col("quantity"), participation * F.col("volume")))
    status = (
        F.when(F.coalesce(missed, F.lit(False)), "open")
        .when(F.col("order_type").isin("stop_loss", "stop_loss_market"), "rejected")
        .when(quantity <= 0, "rejected")
        .when(quantity < F.col("quantity"), "partially_filled")
        .otherwise("filled")
    )
    done = F.col("status").isin("filled", "partially_filled")
    return (
        placed.withColumn("status", status)
        .withColumn("filled", F.when(done, quantity).otherwise(0.0))
        .withColumn("fill_price", F.when(done, price))
        .withColumn("fees", F.when(done, F.greatest(F.col("filled") * F.col("fill_price") * commission, F.lit(minimum))).otherwise(0.0))
    )


def settle(filled: DataFrame, cash: float) -> DataFrame:
    """Runs fills through the cash and position book of each account, in order; buys that cash cannot cover are rejected.

    Needs account, seq, symbol, side, filled, fill_price and fees. One account is one fold.
    """

    def step(book: Book, r) -> list[tuple]:
        covered = r.side != "buy" or r.filled * r.fill_price + r.fees <= book.cash
        if covered:
            book.apply(r.symbol, r.side, r.filled, r.fill_price, r.fees)
        quantity, average = book.positions.get(r.symbol, (0.0, 0.0))
        return [(r.account, r.seq, r.symbol, covered, book.cash, quantity, average)]

    schema = "account string, seq long, symbol string, accepted boolean, cash double, quantity double, average_price double"
    rows = filled.where("filled > 0").select("account", "seq", "symbol", "side", "filled", "fill_price", "fees")
    return fold(rows, "account", ["seq"], lambda _: Book(cash), step, schema)
