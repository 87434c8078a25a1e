"""Models as sums: scaling, Bayesian regression by sufficient statistics, regime scalars."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import filters
from tidebook.functions.market import ANNUALISER
from tidebook.operators import scans
from tidebook.runtime import ship_package


def scaler(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Mean and sample deviation of each column per group (deviations of nothing count as 1); groups need two rows."""
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns],
    )
    fixed = [F.when(F.col(f"sd_{c}") <= 1e-12, 1.0).otherwise(F.col(f"sd_{c}")).alias(f"sd_{c}") for c in columns]
    return sums.where("n >= 2").select(*keys, "n", *[f"mean_{c}" for c in columns], *fixed)


def scaled(rows: DataFrame, stats: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """`rows` with each column standardised by its group's statistics; groups are few, Spark picks the join."""
    out = rows.join(stats, keys)
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}"))
    return out.drop("n", *[f"mean_{c}" for c in columns], *[f"sd_{c}" for c in columns])


def gram(rows: DataFrame, x: list[str], y: str, keys: list[str], forgetting: float = 1.0, order: str = "timestamp") -> DataFrame:
    """Weighted sums that a regression needs: xx_i_j, xy_i, yy, weight and n per group.

    Row n of a group counts 1, the row before it `forgetting`, and so on. With
    `forgetting` 1 the sums need no order and are one partial aggregation.
    """
    if not 0 < forgetting <= 1:
        raise ValueError("forgetting must lie in (0, 1]")
    if forgetting < 1:
        back = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        rows = rows.withColumn("_w", F.pow(F.lit(forgetting), F.row_number().over(back) - 1))
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    w = F.col("_w")
    pairs = combinations_with_replacement(range(len(x)), 2)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("weight"),
        F.sum(w * F.col(y) * F.col(y)).alias("yy"),
        *[F.sum(w * F.col(c) * F.col(y)).alias(f"xy_{i}") for i, c in enumerate(x)],
        *[F.sum(w * F.col(x[i]) * F.col(x[j])).alias(f"xx_{i}_{j}") for i, j in pairs],
    )


def solve_posterior(row: dict, k: int, residual_scale: float = 0.02, coefficient_scale: float = 1.0, shape: float = 2.0) -> dict:
    """Normal-inverse-gamma posterior from sums of `gram`: mean, precision, shape and rate."""
    xx = np.empty((k, k))
    for i, j in combinations_with_replacement(range(k), 2):
        xx[i, j] = xx[j, i] = row[f"xx_{i}_{j}"]
    xy = np.array([row[f"xy_{i}"] for i in range(k)])
    precision = xx + np.eye(k) / coefficient_scale**2
    try:
        mean = np.linalg.solve(precision, xy)
    except np.linalg.LinAlgError:
        ridge = max(np.trace(precision) / k, 1.0) * np.sqrt(np.finfo(float).eps)
        mean = np.linalg.solve(precision + ridge * np.eye(k), xy)
    a = shape + row["weight"] / 2
    b = max(residual_scale**2 * (shape - 1) + 0.5 * (row["yy"] - mean @ xy), 1e-12)
    return {"mean": mean.tolist(), "precision": precision.ravel().tolist(), "shape": float(a), "rate": float(b)}


def posterior(sums: DataFrame, k: int, keys: list[str], **prior: float) -> DataFrame:
    """keys, n, mean, precision (row by row), shape and rate; one small solve per group in Arrow batches."""
    ship_package()
    kinds = dict(sums.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "n long, mean array<double>, precision array<double>, shape double, rate double"])

    def solve(batches):
        for batch in batches:
            rows = batch.to_dict("records")
            done = [{**{c: r[c] for c in (*keys, "n")}, **solve_posterior(r, k, **prior)} for r in rows]
            yield pd.DataFrame(done, columns=[*keys, "n", "mean", "precision", "shape", "rate"])

    return sums.mapInPandas(solve, schema)


def posterior_two(sums: DataFrame, keys: list[str], residual_scale: float = 0.02, coefficient_scale: float = 1.0, shape: float = 2.0) -> DataFrame:
    """The same posterior for an intercept and one slope, as expressions: m0, m1, shape, rate."""
    lam = 1 / coefficient_scale**2
    p00, p01, p11 = F.col("xx_0_0") + lam, F.col("xx_0_1"), F.col("xx_1_1") + lam
    det = p00 * p11 - p01 * p01
    m0 = (p11 * F.col("xy_0") - p01 * F.col("xy_1")) / det
    m1 = (p00 * F.col("xy_1") - p01 * F.col("xy_0")) / det
    rate = residual_scale**2 * (shape - 1) + 0.5 * (F.col("yy") - m0 * F.col("xy_0") - m1 * F.col("xy_1"))
    return sums.select(
        *keys,
        "n",
        m0.alias("m0"),
        m1.alias("m1"),
        (F.lit(shape) + F.col("weight") / 2).alias("shape"),
        F.greatest(rate, F.lit(1e-12)).alias("rate"),
        (p11 / det).alias("v00"),
        (-p01 / det).alias("v01"),
        (p00 / det).alias("v11"),
    )


def predictive_two(rows: DataFrame, fitted: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """`rows` with df, loc, scale and epistemic variance of the Student-t predictive at x."""
    at = F.col(x)
    leverage = F.col("v00") + 2 * F.col("v01") * at + F.col("v11") * at * at
    out = (
        rows.join(fitted.drop("n"), keys)
        .withColumn("df", 2 * F.col("shape"))
        .withColumn("loc", F.col("m0") + F.col("m1") * at)
        .withColumn("leverage", leverage)
        .withColumn("scale", F.sqrt(F.col("rate") / F.col("shape") * (1 + F.col("leverage"))))
    )
    var = F.when(F.col("df") > 2, F.pow("scale", F.lit(2.0)) * F.col("df") / (F.col("df") - 2))
    return out.withColumn("epistemic_variance", var * F.col("leverage") / (1 + F.col("leverage"))).drop(
        "m0", "m1", "shape", "rate", "v00", "v01", "v11", "leverage"
    )


def regime_scalars(returns: DataFrame, strength: float = 250.0) -> DataFrame:
    """Per symbol the scalars of the regime chain from column r in time order: sums, lags and block means.

    centre, drift_spread, persistence, mean_variance, dispersion and n_rows, each shrunk
    towards its prior by n / (n + strength).
    """
    block, far = filters.REGIME_BLOCK, filters.REGIME_FAR_LAG
    ordered = Window.partitionBy("symbol").orderBy("timestamp")
    everyone = Window.partitionBy("symbol")
    clean = returns.where("r IS NOT NULL").select(
        "symbol", "r", F.row_number().over(ordered).alias("i"), F.avg("r").over(everyone).alias("centre"), "timestamp"
    )
    squares = clean.withColumn("q", F.pow(F.col("r") - F.col("centre"), F.lit(2.0)))
    lagged = (
        squares.withColumn("q_mean", F.avg("q").over(everyone))
        .withColumn("d", F.col("q") - F.col("q_mean"))
        .withColumn("near", F.col("d") * F.lead("d", 1).over(ordered))
        .withColumn("far", F.col("d") * F.lead("d", far).over(ordered))
    )
    sums = lagged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("r").alias("centre"),
        F.var_samp("r").alias("total"),
        F.coalesce(F.avg("near"), F.lit(0.0)).alias("near"),
        F.coalesce(F.avg("far"), F.lit(0.0)).alias("far"),
    )
    blocks = (
        clean.groupBy("symbol", F.floor((F.col("i") - 1) / block).alias("b"))
        .agg(F.avg("r").alias("m"), F.count(F.lit(1)).alias("k"))
        .where(F.col("k") == block)
        .groupBy("symbol")
        .agg(F.var_samp("m").alias("between"), F.count(F.lit(1)).alias("blocks"))
    )
    prior_drift, prior_held, prior_dispersion = 0.25 / 252, 1 - 1 / 25, 0.55
    w = F.col("n_rows") / (F.col("n_rows") + strength)
    debiased = F.when(F.col("blocks") >= 2, (F.col("between") - F.col("total") / block) / (1 - 1 / block)).otherwise(0.0)
    measured = F.when((F.col("near") > 0) & (F.col("far") > 0), F.pow(F.col("far") / F.col("near"), F.lit(1 / (far - 1)))).otherwise(prior_held)
    return (
        sums.join(blocks, "symbol", "left")
        .where("n_rows >= 2")
        .withColumn("drift_variance", w * F.greatest(F.lit(0.0), F.coalesce(debiased, F.lit(0.0))) + (1 - w) * prior_drift**2)
        .withColumn("drift_spread", F.sqrt("drift_variance"))
        .withColumn("persistence", F.least(F.lit(0.99), F.greatest(F.lit(0.5), w * measured + (1 - w) * prior_held)))
        .withColumn("mean_variance", F.greatest(F.col("total") - F.col("drift_variance"), F.lit(1e-12)))
        .withColumn(
            "dispersion",
            F.sqrt(
                w * F.greatest(F.lit(0.0), F.col("near") / F.col("persistence"))
                + (1 - w) * F.pow(prior_dispersion * F.col("mean_variance"), F.lit(2.0))
            )
            / F.col("mean_variance"),
        )
        .select("symbol", "centre", "drift_spread", "persistence", "mean_variance", "dispersion", "n_rows")
    )


def variance_filter(returns: DataFrame, scale: float = 0.02, horizon: int = 5) -> DataFrame:
    """Readouts of the discounted variance filter after each bar, and of its predictive over `horizon` bars; null returns age the evidence.

    A symbol is cut in chunks that are filtered side by side.
    """
    return scans.variance_scan(returns, filters.VarianceFilter.a0, scale**2, horizon)


def regime_filter(returns: DataFrame, scalars: DataFrame) -> DataFrame:
    """Belief over bullish, bearish and neutral after each bar, and the running log likelihood, over chunks of each symbol."""
    return scans.regime_scan(returns, scalars)


def exposure(positions: DataFrame) -> DataFrame:
    """Per portfolio of positions (portfolio, symbol, quantity, last_price, sector, equity): gross and net weight, count."""
    value = F.col("quantity") * F.col("last_price")
    return positions.groupBy("portfolio").agg(
        (F.sum(F.abs(value)) / F.max("equity")).alias("gross"), (F.sum(value) / F.max("equity")).alias("net"), F.count(F.lit(1)).alias("n_positions")
    )


def position_weights(positions: DataFrame) -> DataFrame:
    """`positions` with weight: the share of their portfolio's equity, whichever way they point."""
    return positions.withColumn("weight", F.abs(F.col("quantity") * F.col("last_price")) / F.col("equity"))


def sector_exposure(positions: DataFrame) -> DataFrame:
    """Per portfolio and sector the gross weight, to which long and short positions both add; positions without a sector are left out."""
    held = position_weights(positions).where("sector IS NOT NULL")
    return held.groupBy("portfolio", "sector").agg(F.sum("weight").alias("exposure"), F.count(F.lit(1)).alias("n_positions"))


def equity_state(curve: DataFrame, keys: list[str], order: str = "timestamp") -> DataFrame:
    """`curve` (equity by moment) with running peak, drawdown, equity at the day's start and daily loss."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    of_day = Window.partitionBy(*keys, F.to_date(order)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        curve.withColumn("peak", F.max("equity").over(w))
        .withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))
        .withColumn("day_start", F.first("equity").over(of_day))
        .withColumn("daily_loss", F.greatest(F.lit(0.0), 1 - F.col("equity") / F.col("day_start")))
    )


def performance(positions: DataFrame, commission: float = 3e-4, slippage: float = 5e-4, scale: float = 1.0) -> DataFrame:
    """Metrics per symbol of holding `weight` from each bar to the next, from symbol, timestamp, close, weight.

    `scale` multiplies the bars' returns, for series that are not prices.
    """
    ordered = Window.partitionBy("symbol").orderBy("timestamp")
    path = ordered.rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        positions.withColumn("held", F.coalesce(F.lag("weight").over(ordered), F.lit(0.0)))
        .withColumn("step", (F.try_divide(F.lead("close").over(ordered), "close") - 1) * scale)
        .where("step IS NOT NULL")
        .withColumn("traded", F.abs(F.col("weight") - F.col("held")))
        .withColumn("profit", F.col("weight") * F.col("step"))
        .withColumn("ret", (1 - F.col("traded") * (commission + slippage)) * (1 + F.col("profit")) - 1)
        .withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(path)))
        .withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(path)))
    )
    used = F.col("weight") != 0
    sums = steps.groupBy("symbol").agg(
        (F.count(F.lit(1)) + 1).alias("n_bars"),
        F.max_by("equity", "timestamp").alias("equity"),
        F.max(1 - F.col("equity") / F.col("peak")).alias("max_drawdown"),
        F.avg("ret").alias("average"),
        F.stddev_samp("ret").alias("spread"),
        F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0)))).alias("downside"),
        F.sum("traded").alias("turnover"),
        F.count_if(used).alias("trades"),
        F.count_if(used & (F.col("profit") > 0)).alias("wins"),
        F.sum(F.when(used & (F.col("profit") > 0), F.col("profit")).otherwise(0.0)).alias("gains"),
        F.sum(F.when(used & (F.col("profit") <= 0), -F.col("profit")).otherwise(0.0)).alias("losses"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select(
        "symbol",
        "n_bars",
        (F.pow("equity", 252 / F.col("n_bars")) - 1).alias("cagr"),
        (F.col("equity") - 1).alias("total_return"),
        (ratio("average", "spread") * ANNUALISER).alias("sharpe"),
        (ratio("average", "downside") * ANNUALISER).alias("sortino"),
        "max_drawdown",
        (F.col("spread") * ANNUALISER).alias("volatility"),
        "turnover",
        ratio("wins", "trades").alias("win_rate"),
        ratio("gains", "losses").alias("profit_factor"),
    )


def tally(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of each column in one pass: column, value, n."""
    sets = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v"))
    return sets.groupBy("v.column", "v.value").agg(F.count(F.lit(1)).alias("n"))


def as_mixture(df: Column, loc: Column, scale: Column) -> Column:
    """One Student-t as a mixture."""
    return F.array(F.struct(F.lit(1.0).alias("w"), loc.alias("loc"), scale.alias("scale"), df.alias("df")))
