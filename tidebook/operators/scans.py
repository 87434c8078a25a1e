"""Path-dependent steps as two-pass scans over chunks of a series, so that one symbol is many tasks.

A step that composes has a summary per chunk: the effect of all its rows on whatever state
comes in. Summaries of a series, one row per chunk, give each chunk its starting state; a second pass
runs the chunks side by side from there. Three kinds of state compose here: decayed sums
(a factor and an addend), products of small matrices with a logarithm of their scale, and affine maps
of a position's average price. Within a chunk the same compositions are vectorised over its
rows in log2(rows) strides. A summary has a few numbers per `size` rows, so the scan over a series of 10^9
bars reads half a million rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import filters
from tidebook.functions.special import digamma, lgamma, t_logpdf, trigamma
from tidebook.runtime import ship_package

#: Rows of a chunk.
SIZE = 2048


def placed(rows: DataFrame, order: list[str], bucket: Column, size: int = SIZE) -> DataFrame:
    """`rows` with _n, their number from 1 in their symbol by `order`, and _chunk.

    `bucket` must rise with the order and hold a bounded part of a series; only within a bucket are
    rows sorted together. Nulls come first. Rows equal in `order` may trade places between runs.
    """
    marked = rows.withColumn("_bucket", F.coalesce(bucket.cast("string"), F.lit("")))
    counts = marked.groupBy("symbol", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("symbol", "_bucket").orderBy(*order)
    numbered = marked.withColumn("_place", F.row_number().over(within)).join(offsets, ["symbol", "_bucket"])
    n = (F.col("_offset") + F.col("_place")).cast("long")
    return numbered.withColumn("_n", n).withColumn("_chunk", F.floor((n - 1) / size)).drop("_bucket", "_offset", "_place")


def decayed(values: np.ndarray, factor: np.ndarray | float, start: np.ndarray | float) -> np.ndarray:
    """x[t] = factor x[t-1] + values[t] down the first axis, from x[-1] = start."""
    out = np.array(values, float)
    if not len(out):
        return out
    out[0] += factor * np.asarray(start, float)
    stride, power = 1, np.asarray(factor, float)
    while stride < len(out):
        out[stride:] += power * out[:-stride].copy()
        stride, power = 2 * stride, power * power
    return out


def products(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running products M[t] ... M[0], each scaled to a largest entry of one, and the logarithms of the scales."""
    out = np.array(matrices, float)
    scale = np.zeros(len(out))

    def even() -> None:
        top = out.max((1, 2))
        out[:] /= top[:, None, None]
        scale[:] += np.log(top)

    even()
    stride = 1
    while stride < len(out):
        later, logs = out[stride:] @ out[:-stride], scale[stride:] + scale[:-stride]
        out[stride:], scale[stride:] = later, logs
        even()
        stride *= 2
    return out, scale


# --- decayed sums: the variance filter ---------------------------------------------------------------------------------

_GRID = np.array(filters.DISCOUNTS)
_K = len(_GRID)
VARIANCE_SCHEMA = (
    "symbol string, timestamp timestamp_ntz, noise_variance double, uncertainty double, effective_n double, expected_discount double, "
    "entropy double, n_seen long, n_skipped long, plugin_variance double, inflation double, realised_variance double, predictive_df double"
)


def log_weights(gains: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The grid's log weights after each row. Sums of gains, unless a weight meets the floor: then row by row."""
    sums = decayed(gains, filters.FORGETTING, start)
    sums = sums - sums.max(1, keepdims=True)
    logs = sums - np.log(np.exp(sums).sum(1, keepdims=True))
    if (logs >= filters.LOG_FLOOR).all():
        return logs
    now = start
    for t, gain in enumerate(gains):
        logs[t] = now = filters.reweight(now, gain, filters.FORGETTING)
    return logs


def _variance_rows(pdf: pd.DataFrame, own: int, horizon: int, a0: float, b0: float) -> pd.DataFrame:
    """Readouts of the rows of chunk `own`, from its rows and those of the chunk before it."""
    pdf = pdf.sort_values("_n")
    r = pdf["r"].to_numpy(float, na_value=np.nan)
    seen = np.isfinite(r)
    z = np.where(seen, r, 0.0) ** 2
    first = pdf.iloc[0]
    s0, q0 = (np.array(first[c], float) for c in ("s", "q"))
    s = decayed(np.repeat(seen[:, None].astype(float), _K, 1), _GRID, s0)
    q = decayed(np.repeat(z[:, None], _K, 1), _GRID, q0)
    before = lambda x, x0: np.concatenate([x0[None], x[:-1]])
    a = a0 + _GRID * before(s, s0) / 2
    b = np.maximum(b0 + _GRID * before(q, q0) / 2, filters.LEAST_RATE)
    gain = a * np.log(b) + lgamma(a + 0.5) - lgamma(a) - (a + 0.5) * np.log(b + z[:, None] / 2)
    # after a whole chunk nothing is left of the weights that it began with
    logs = log_weights(np.where(seen[:, None], gain, 0.0), np.full(_K, -np.log(_K)))
    mine = pdf["_own"].to_numpy() == own
    s, q, w = s[mine], q[mine], np.exp(logs[mine])
    n_seen = int(first["seen"]) + np.cumsum(seen)[mine]
    a, b = a0 + s / 2, np.maximum(b0 + q / 2, filters.LEAST_RATE)
    each = 0.5 * (np.log(b) - digamma(a))
    centre = (w * each).sum(1, keepdims=True)
    ahead, rate = a0 + _GRID * s / 2, np.maximum(b0 + _GRID * q / 2, filters.LEAST_RATE)
    mix = lambda x: (w * x).sum(1)
    return pd.DataFrame({
        "symbol": pdf["symbol"].to_numpy()[mine], "timestamp": pdf["timestamp"].to_numpy()[mine],
        "noise_variance": mix(b / (a - 1)), "uncertainty": np.sqrt(mix(trigamma(a) / 4 + (each - centre) ** 2)),
        "effective_n": mix(s), "expected_discount": mix(_GRID), "entropy": -mix(np.log(w)),
        "n_seen": n_seen, "n_skipped": pdf["_n"].to_numpy()[mine] - n_seen,
        "plugin_variance": mix(horizon * rate / ahead), "inflation": mix(horizon * rate / (ahead * (ahead - 1))),
        "realised_variance": mix(horizon * rate / (ahead - 1)), "predictive_df": mix(2 * ahead),
    })


def variance_scan(returns: DataFrame, a0: float, b0: float, horizon: int, size: int = SIZE) -> DataFrame:
    """The variance filter of each symbol over chunks: sums of evidence compose, and weights are forgotten within a chunk.

    Weights of the grid follow from decayed sums of gains. A chunk is run with the one before it; what
    was known at that one's start has decayed to nothing by its end, also where the floor
    held a weight up, as the floor draws states together.
    """
    if filters.FORGETTING**size * -filters.LOG_FLOOR > 1e-14:
        raise ValueError("chunks are too short for the weights before them to be forgotten")
    ship_package()
    rows = placed(returns.select("symbol", "timestamp", "r"), ["timestamp"], F.date_trunc("month", "timestamp"), size)
    # a return that is not finite is a missing one
    held = (F.col("r") - F.col("r")) == 0
    rows = rows.withColumn("r", F.when(held, F.col("r")))
    left = F.lit(size - 1) - (F.col("_n") - 1) % size
    weight = F.col("r").isNotNull().cast("double")
    z = F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))
    sums = rows.groupBy("symbol", "_chunk").agg(
        F.array(*[F.sum(weight * F.pow(F.lit(d), left)) for d in filters.DISCOUNTS]).alias("s"),
        F.array(*[F.sum(z * F.pow(F.lit(d), left)) for d in filters.DISCOUNTS]).alias("q"),
        F.sum(weight).cast("long").alias("seen"),
    )

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        over = _GRID**size
        shifted = lambda x: np.concatenate([np.zeros((1, x.shape[1])), x[:-1]])
        s, q = (shifted(decayed(np.stack(pdf[c].to_numpy()).astype(float), over, 0.0)) for c in ("s", "q"))
        seen = np.concatenate([[0], np.cumsum(pdf["seen"].to_numpy())[:-1]])
        chunk = pdf["_chunk"].to_numpy()
        # chunk k is run from the start of the one before it
        out = pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "_run": chunk + 1, "s": list(s), "q": list(q), "seen": seen})
        return pd.concat([out.iloc[:1].assign(_run=0), out.iloc[:-1]]) if len(out) else out

    begin = sums.groupBy("symbol").applyInPandas(starts, "symbol string, _run long, s array<double>, q array<double>, seen long")
    runs = rows.withColumn("_own", F.col("_chunk")).withColumn("_run", F.explode(F.array(F.col("_chunk"), F.col("_chunk") + 1)))
    ready = runs.join(begin, ["symbol", "_run"])

    def chunk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _variance_rows(pdf, int(key[1]), horizon, a0, b0)

    return ready.groupBy("symbol", "_run").applyInPandas(chunk, VARIANCE_SCHEMA)


# --- products of matrices: the regime filter ----------------------------------------------------------------------------

REGIME_SCHEMA = "symbol string, timestamp timestamp_ntz, p_bullish double, p_bearish double, p_neutral double, log_likelihood double"
_SCALARS = ["centre", "drift_spread", "persistence", "mean_variance", "dispersion", "n_rows"]


def _steps(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per row the 3 x 3 matrix that moves a belief on and weighs it by the return, and the logarithm taken out of it."""
    first = pdf.iloc[0]
    p = filters.RegimeParameters(*[float(first[c]) for c in _SCALARS[:-1]], int(first["n_rows"]))
    r = pdf["r"].to_numpy(float, na_value=np.nan)
    seen = np.isfinite(r)
    density = t_logpdf(np.where(seen, r, 0.0)[:, None], *p.emission())
    top = density.max(1)
    if not np.isfinite(top[seen]).all():
        raise ValueError(f"no regime can account for a return of {r[seen][~np.isfinite(top[seen])][0]}")
    likely = np.where(seen[:, None], np.exp(density - top[:, None]), 1.0)
    moves = p.persistence * np.eye(3) + (1 - p.persistence) * np.array(filters.STATIONARY)[:, None]
    return likely[:, :, None] * moves, np.where(seen, top, 0.0)


def regime_scan(returns: DataFrame, scalars: DataFrame, size: int = SIZE) -> DataFrame:
    """The regime filter of each symbol over chunks: beliefs are products of matrices, missing returns mere propagation."""
    ship_package()
    rows = placed(returns.select("symbol", "timestamp", "r"), ["timestamp"], F.date_trunc("month", "timestamp"), size)
    known = rows.select("symbol", "_chunk").distinct().join(scalars.select("symbol", *_SCALARS), "symbol")
    ready = rows.join(known, ["symbol", "_chunk"])

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        matrices, tops = _steps(pdf.sort_values("_n"))
        whole, scale = products(matrices)
        return pd.DataFrame({"symbol": [key[0]], "_chunk": [key[1]], "m": [whole[-1].ravel()], "log": [scale[-1] + tops.sum()]})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        belief, log, beliefs, logs = np.array(filters.STATIONARY), 0.0, [], []
        for m, scale in zip(pdf["m"], pdf["log"], strict=True):
            beliefs.append(belief)
            logs.append(log)
            belief = np.reshape(m, (3, 3)) @ belief
            total = belief.sum()
            belief, log = belief / total, log + np.log(total) + scale
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "_chunk": pdf["_chunk"].to_numpy(), "belief": beliefs, "before": logs})

    summary = ready.groupBy("symbol", "_chunk").applyInPandas(product, "symbol string, _chunk long, m array<double>, log double")
    begin = summary.groupBy("symbol").applyInPandas(starts, "symbol string, _chunk long, belief array<double>, before double")

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        matrices, tops = _steps(pdf)
        running, scale = products(matrices)
        joint = running @ np.array(pdf["belief"].iloc[0], float)
        total = joint.sum(1)
        belief = joint / total[:, None]
        log = float(pdf["before"].iloc[0]) + np.log(total) + scale + np.cumsum(tops)
        names = ("p_bullish", "p_bearish", "p_neutral")
        return pd.DataFrame(
            {"symbol": pdf["symbol"], "timestamp": pdf["timestamp"], **{c: belief[:, k] for k, c in enumerate(names)}, "log_likelihood": log}
        )

    return ready.join(begin, ["symbol", "_chunk"]).groupBy("symbol", "_chunk").applyInPandas(chunk, REGIME_SCHEMA)


# --- affine maps: positions ---------------------------------------------------------------------------------------------

#: Quantities nearer to zero than this are none.
FLAT = 1e-9


def position_scan(fills: DataFrame, order: list[str], bucket: Column, size: int = SIZE) -> DataFrame:
    """Quantity and average price per symbol after all fills (symbol, delta, price, and the order), without flat ones.

    Quantities are running sums. Given them, a fill maps the average price a to p a + q: an increase weighs
    both prices, a reduction leaves a, a position that opens or crosses zero takes the fill's
    price, and one that closes has none. Such maps compose, so a chunk has one, in JVM functions alone. A quantity
    within FLAT of zero counts as none; what is left of it stays in the sums, far below FLAT.
    """
    rows = placed(fills, order, bucket, size)
    chunks = rows.groupBy("symbol", "_chunk").agg(F.sum("delta").alias("_moved"))
    earlier = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("symbol", "_chunk", F.coalesce(F.sum("_moved").over(earlier), F.lit(0.0)).alias("_start"))
    within = Window.partitionBy("symbol", "_chunk").orderBy("_n")
    flat = lambda x: F.when(F.abs(x) < FLAT, 0.0).otherwise(x)
    moved = (
        rows.join(offsets, ["symbol", "_chunk"])
        .withColumn("_after", F.col("_start") + F.sum("delta").over(within))
        .withColumn("_held", flat(F.coalesce(F.lag("_after").over(within), F.col("_start"))))
        .withColumn("_after", flat(F.col("_after")))
    )
    after, held = F.col("_after"), F.col("_held")
    fresh = (held == 0) | (F.signum(after) != F.signum(held))
    grows = F.abs(after) > F.abs(held)
    p = F.when((after == 0) | fresh, 0.0).when(grows, held / after).otherwise(1.0)
    q = F.when(after == 0, 0.0).when(fresh, F.col("price")).when(grows, F.col("delta") * F.col("price") / after).otherwise(0.0)

    def composed(steps: Column) -> Column:
        """One map for a list of maps in order."""
        one = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("q"))
        return F.aggregate(
            steps, one, lambda m, s: F.struct((m["p"] * s["p"]).alias("p"), (s["p"] * m["q"] + s["q"]).alias("q"))
        )

    maps = moved.groupBy("symbol", "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("_n", p.alias("p"), q.alias("q")))).alias("steps"),
        F.max_by("_after", "_n").alias("_after"),
    )
    by_chunk = maps.select("symbol", "_chunk", "_after", composed(F.col("steps")).alias("m"))
    whole = by_chunk.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("_chunk", F.col("m.p").alias("p"), F.col("m.q").alias("q")))).alias("steps"),
        F.max_by("_after", "_chunk").alias("quantity"),
    )
    return whole.where("quantity <> 0").select("symbol", "quantity", composed(F.col("steps"))["q"].alias("average_price"))
