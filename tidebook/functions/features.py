"""Features: pure functions of a bounded trailing window of one symbol.

A feature is a name, a lookback and a column. Its value is null while the symbol has
fewer than lookback + 1 bars (missing) and where its formula has no value
(undefined); it is never filled. Because every frame is bounded by the lookback, a
series can be cut into chunks that carry the last `lookback` bars of the chunk
before, which spreads one symbol over tasks (see operators.chunks).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.market import ANNUALISER, turnover

EPS = 2.0**-52
LN2 = math.log(2)


class Frames:
    """Frames over the bars of one symbol in time order; `keys` partition them."""

    def __init__(self, keys: tuple[str, ...] = ("symbol",)):
        self.ordered = Window.partitionBy(*keys).orderBy("timestamp")

    def last(self, n: int):
        return self.ordered.rowsBetween(-(n - 1), 0)

    def lag(self, x: Column, n: int) -> Column:
        return F.lag(x, n).over(self.ordered) if n else x

    def mean(self, x: Column, n: int) -> Column:
        return F.avg(x).over(self.last(n))

    def sd(self, x: Column, n: int) -> Column:
        return F.stddev_samp(x).over(self.last(n))

    def ema(self, x: Column, window: int) -> Column:
        """Seeded exponential average of the last 3 x window values, in closed form.

        The seed is the mean of the oldest `window` values; the other 2 x window
        follow with weights alpha (1 - alpha)^age.
        """
        alpha = 2 / (window + 1)
        return F.aggregate(
            F.collect_list(x).over(self.last(3 * window)),
            F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("v")),
            lambda acc, y: F.struct(
                (acc["i"] + 1).alias("i"),
                F.when(acc["i"] < window, acc["v"] + y / window).otherwise(acc["v"] + alpha * (y - acc["v"])).alias("v"),
            ),
            lambda acc: acc["v"],
        )

    def flat(self, x: Column, n: int) -> Column:
        """True where the window varies by no more than rounding."""
        top, low = F.max(x).over(self.last(n)), F.min(x).over(self.last(n))
        size = F.greatest(F.max(F.abs(x)).over(self.last(n)), F.lit(1.0))
        return (top - low) <= EPS * size * n


Build = Callable[[Frames], Column]


@dataclass(frozen=True)
class Feature:
    name: str
    lookback: int
    build: Build


def column(name: str) -> Callable[[], Column]:
    """A column that is made when it is used, as columns need a running session."""
    return lambda: F.col(name)


LC, R = column("_lc"), column("_r")  # log close, log return
C, H, L, O, V = map(column, ("close", "high", "low", "open", "volume"))  # noqa: E741


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero: bars that break the invariant give no value, and no error."""
    return F.try_divide(a, b)


def _positive(x: Column, value: Column | None = None) -> Column:
    """`value` (x itself by default) where x is above zero, else null."""
    return F.when(x > 0, x if value is None else value)


def log_return(h: int = 1) -> Feature:
    return Feature(f"log_return_{h}", h, lambda w: LC() - w.lag(LC(), h))


def simple_return(h: int = 1) -> Feature:
    return Feature(f"return_{h}", h, lambda w: ratio(C(), w.lag(C(), h)) - 1)


def _average(w: Frames, n: int, exponential: bool) -> Column:
    return w.ema(C(), n) if exponential else w.mean(C(), n)


def _average_lookback(n: int, exponential: bool) -> int:
    return 3 * n - 1 if exponential else n - 1


def moving_average(n: int = 20, exponential: bool = False) -> Feature:
    return Feature(f"{'ema' if exponential else 'sma'}_{n}", _average_lookback(n, exponential), lambda w: _average(w, n, exponential))


def price_to_moving_average(n: int = 20, exponential: bool = False) -> Feature:
    def build(w: Frames) -> Column:
        average = _average(w, n, exponential)
        return _positive(average, LC() - F.ln(average))

    return Feature(f"close_to_{'ema' if exponential else 'sma'}_{n}", _average_lookback(n, exponential), build)


def moving_average_spread(fast: int = 12, slow: int = 26, exponential: bool = True) -> Feature:
    if fast >= slow:
        raise ValueError("the fast window must be shorter than the slow one")

    def build(w: Frames) -> Column:
        a, b = _average(w, fast, exponential), _average(w, slow, exponential)
        return F.when((a > 0) & (b > 0), F.ln(a / b))

    return Feature(f"{'ema' if exponential else 'sma'}_spread_{fast}_{slow}", _average_lookback(slow, exponential), build)


def momentum(n: int = 60, skip: int = 5) -> Feature:
    name = f"momentum_{n}_{skip}" if skip else f"momentum_{n}"
    return Feature(name, n + skip, lambda w: w.lag(LC(), skip) - w.lag(LC(), n + skip))


def relative_strength_index(n: int = 14) -> Feature:
    def build(w: Frames) -> Column:
        change = F.col("_change")
        up = w.mean(F.greatest(change, F.lit(0.0)), n)
        down = w.mean(F.greatest(-change, F.lit(0.0)), n)
        return F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))

    return Feature(f"rsi_{n}", n, build)


def price_z_score(n: int = 20) -> Feature:
    return Feature(f"price_zscore_{n}", n - 1, lambda w: F.when(~w.flat(LC(), n), ratio(LC() - w.mean(LC(), n), w.sd(LC(), n))))


def drawdown_from_high(n: int = 60) -> Feature:
    return Feature(f"drawdown_{n}", n - 1, lambda w: F.ln(ratio(C(), F.max(H()).over(w.last(n)))))


def trend_slope(n: int = 20) -> Feature:
    def build(w: Frames) -> Column:
        slope = F.regr_slope(LC(), F.col("_n").cast("double")).over(w.last(n))
        return F.when(w.flat(LC(), n), 0.0).otherwise(slope)

    return Feature(f"trend_slope_{n}", n - 1, build)


def trend_quality(n: int = 20) -> Feature:
    def build(w: Frames) -> Column:
        fit = F.regr_r2(LC(), F.col("_n").cast("double")).over(w.last(n))
        return F.when(~w.flat(LC(), n), F.least(F.lit(1.0), fit))

    return Feature(f"trend_quality_{n}", n - 1, build)


def realised_volatility(n: int = 20, annualised: bool = True) -> Feature:
    factor = ANNUALISER if annualised else 1.0
    return Feature(f"volatility_{n}", n, lambda w: w.sd(R(), n) * factor)


def ewma_volatility(span: int = 20, annualised: bool = True) -> Feature:
    factor = ANNUALISER if annualised else 1.0

    def build(w: Frames) -> Column:
        level = w.ema(R() * R(), span)
        return _positive(level, F.sqrt(level) * factor)

    return Feature(f"ewma_volatility_{span}", 3 * span, build)


def _root(level: Column) -> Column:
    return _positive(level, F.sqrt(level) * ANNUALISER)


def parkinson_volatility(n: int = 20) -> Feature:
    return Feature(f"parkinson_volatility_{n}", n - 1, lambda w: _root(w.mean(F.pow(F.ln(ratio(H(), L())), F.lit(2.0)), n) / (4 * LN2)))


def garman_klass_volatility(n: int = 20) -> Feature:
    def build(w: Frames) -> Column:
        part = 0.5 * F.pow(F.ln(ratio(H(), L())), F.lit(2.0)) - (2 * LN2 - 1) * F.pow(F.ln(ratio(C(), O())), F.lit(2.0))
        return _root(w.mean(part, n))

    return Feature(f"garman_klass_volatility_{n}", n - 1, build)


def downside_volatility(n: int = 20) -> Feature:
    return Feature(
        f"downside_volatility_{n}",
        n,
        lambda w: F.sqrt(w.mean(F.pow(F.least(R(), F.lit(0.0)), F.lit(2.0)), n)) * ANNUALISER,
    )


def volatility_ratio(fast: int = 5, slow: int = 60) -> Feature:
    def build(w: Frames) -> Column:
        a, b = w.sd(R(), fast), w.sd(R(), slow)
        return F.when((a > 0) & (b > 0), F.ln(a / b))

    return Feature(f"volatility_ratio_{fast}_{slow}", slow, build)


def average_true_range(n: int = 14) -> Feature:
    return Feature(f"atr_pct_{n}", n, lambda w: ratio(w.mean(F.col("_range"), n), C()))


def relative_volume(n: int = 20) -> Feature:
    def build(w: Frames) -> Column:
        middle = F.percentile(V(), F.lit(0.5)).over(w.last(n))
        return F.when((middle > 0) & (V() > 0), F.ln(V() / middle))

    return Feature(f"relative_volume_{n}", n - 1, build)


def volume_z_score(n: int = 20) -> Feature:
    def build(w: Frames) -> Column:
        lv = F.col("_lv")
        sd = w.sd(lv, n)
        return F.when((F.min(V()).over(w.last(n)) > 0) & (sd > 0), (lv - w.mean(lv, n)) / sd)

    return Feature(f"volume_zscore_{n}", n - 1, build)


def median_turnover(n: int = 20) -> Feature:
    return Feature(f"turnover_median_{n}", n - 1, lambda w: F.percentile(F.col("_turnover"), F.lit(0.5)).over(w.last(n)))


def amihud_illiquidity(n: int = 20) -> Feature:
    def build(w: Frames) -> Column:
        return w.mean(F.when(F.col("_turnover") > 0, F.abs(R()) / F.col("_turnover")), n) * 1e6

    return Feature(f"amihud_{n}", n, build)


def minimal_set() -> list[Feature]:
    return [log_return(1), momentum(20, 1), realised_volatility(20)]


def default_set() -> list[Feature]:
    """Twenty-one features whose longest lookback is 140 bars."""
    # The standard set and its parameters.
    return [
        log_return(1),
        log_return(5),
        momentum(60, 5),
        momentum(120, 20),
        price_to_moving_average(50),
        moving_average_spread(12, 26),
        trend_slope(60),
        trend_quality(60),
        price_z_score(20),
        relative_strength_index(14),
        drawdown_from_high(120),
        realised_volatility(20),
        ewma_volatility(20),
        parkinson_volatility(20),
        downside_volatility(60),
        volatility_ratio(10, 120),
        average_true_range(14),
        relative_volume(20),
        volume_z_score(60),
        median_turnover(20),
        amihud_illiquidity(20),
    ]


def lookback(features: list[Feature]) -> int:
    return max((f.lookback for f in features), default=0)


def checked(features: list[Feature]) -> list[Feature]:
    names = [f.name for f in features]
    if len(set(names)) != len(names):
        raise ValueError(f"feature names repeat: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return features


def subset(features: list[Feature], names: list[str]) -> list[Feature]:
    known = {f.name: f for f in features}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise KeyError(f"unknown features: {unknown}")
    return [known[n] for n in names]


def with_helpers(bars: DataFrame, frames: Frames, number: Column | None = None) -> DataFrame:
    """Bars with the columns that features share: bar number, log close and volume, returns, ranges, turnover."""
    before = frames.lag(C(), 1)
    return (
        bars.withColumn("_n", F.row_number().over(frames.ordered) if number is None else number)
        .withColumn("_lc", F.ln(C()))
        .withColumn("_lv", F.when(V() > 0, F.ln(V())))
        .withColumn("_turnover", turnover())
        .withColumn("_r", LC() - frames.lag(LC(), 1))
        .withColumn("_change", C() - before)
        .withColumn("_range", F.greatest(H() - L(), F.abs(H() - before), F.abs(L() - before)))
    )


def compute(helped: DataFrame, features: list[Feature], frames: Frames, keep: list[str]) -> DataFrame:
    """`keep`, n_bars (up to the set's warm-up) and a column per feature."""
    need = lookback(features) + 1
    gated = [F.when(F.col("_n") >= f.lookback + 1, f.build(frames)).alias(f.name) for f in checked(features)]
    return helped.select(*keep, F.least(F.col("_n"), F.lit(need)).cast("int").alias("n_bars"), *gated)
