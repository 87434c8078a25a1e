"""Walk-forward evaluation and replay without a loop of jobs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import account, filters, special
from tidebook.operators.calibration import assess
from tidebook.operators.folds import fold
from tidebook.operators.life_cycle import LEAST_REGIME, Ensemble, log_score
from tidebook.operators.scans import decayed, placed
from tidebook.operators.stats import gram, posterior, posterior_two, predictive_two
from tidebook.runtime import ship_package


@dataclass(frozen=True)
class WalkForward:
    """initial_train rows, then a refit every so many; the embargo defaults to the horizon."""

    initial_train: int = 250
    refit_every: int = 20
    horizon: int = 5
    max_train: int | None = None
    embargo: int | None = None

    def __post_init__(self) -> None:
        if self.initial_train < 2 or self.refit_every < 1 or self.horizon < 1:
            raise ValueError("initial_train, refit_every and horizon are too small")
        if self.max_train is not None and self.max_train < self.initial_train:
            raise ValueError("max_train is below initial_train")
        if self.embargo is not None and self.embargo < 0:
            raise ValueError("the embargo must not be negative")

    @property
    def gap(self) -> int:
        return self.horizon if self.embargo is None else self.embargo

    @property
    def first(self) -> int:
        """Row number of the first prediction."""
        return self.initial_train + self.gap + 1


def regression_walk(rows: DataFrame, x: str, y: str, config: WalkForward, **prior: float) -> DataFrame:
    """Out-of-sample Student-t predictives of a regression of y on x, refitted on schedule.

    Training sums of every refit are running sums at its last training row, so all
    refits cost one window and one equi-join. Rows need symbol, timestamp, x and y.
    """
    ordered = Window.partitionBy("symbol").orderBy("timestamp")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0) if config.max_train is None else ordered.rowsBetween(-(config.max_train - 1), 0)
    xx, yy = F.col(x), F.col(y)
    sums = {"n": F.lit(1), "weight": F.lit(1.0), "yy": yy * yy, "xy_0": yy, "xy_1": xx * yy, "xx_0_0": F.lit(1.0), "xx_0_1": xx, "xx_1_1": xx * xx}
    numbered = rows.withColumn("i", F.row_number().over(ordered))
    ends = numbered.select("symbol", F.col("i").alias("train_end"), *[F.sum(v).over(so_far).alias(k) for k, v in sums.items()])
    epoch = F.floor((F.col("i") - config.first) / config.refit_every)
    asked = numbered.where(F.col("i") >= config.first).withColumn(
        "train_end", (config.first + epoch * config.refit_every - config.gap - 1).cast("int")
    )
    fitted = posterior_two(ends, ["symbol", "train_end"], **prior)
    return predictive_two(asked, fitted, x, ["symbol", "train_end"])


#: Refit periods whose sums one task adds up.
PERIODS = 1024


def discounted_sums(rows: DataFrame, x: list[str], y: str, config: WalkForward, forgetting: float = 1.0, periods: int = PERIODS) -> DataFrame:
    """Per symbol and train_end of every refit the sums of `gram` over its training rows, the last of which counts one.

    Rows (symbol, _n, x, y) are summed in segments that end where a training window ends or begins, discounted to the
    segment's end. Running sums over segments compose by powers of the discount: a
    chunk of `periods` refits has one summary, summaries give each chunk its start, and a window of at most max_train
    rows is the difference of two running sums.
    """
    if not 0 < forgetting <= 1:
        raise ValueError("forgetting must lie in (0, 1]")
    ship_package()
    step, first, longest = config.refit_every, config.initial_train, config.max_train
    n = F.col("_n")
    end = F.greatest(F.lit(first), first + F.ceil((n - first) / step) * step)
    if longest is not None:
        end = F.least(end, first - longest + F.ceil((n - first + longest) / step) * step)
    pairs = list(combinations_with_replacement(range(len(x)), 2))
    w = F.pow(F.lit(forgetting), F.col("_end") - n)
    values = [w, w * F.col(y) * F.col(y), *[w * F.col(c) * F.col(y) for c in x], *[w * F.col(x[i]) * F.col(x[j]) for i, j in pairs]]
    names = ["n", "weight", "yy", *[f"xy_{i}" for i in range(len(x))], *[f"xx_{i}_{j}" for i, j in pairs]]
    segments = rows.withColumn("_end", end.cast("long")).groupBy("symbol", "_end").agg(
        F.array(F.count(F.lit(1)).cast("double"), *[F.sum(v) for v in values]).alias("sums")
    )
    # counts are never discounted
    decay = np.array([1.0] + [forgetting] * len(values))
    span = periods * step
    chunk = F.floor((F.col("_end") - 1) / span)
    kept = [F.when(F.lit(k == 0), 1.0).otherwise(F.pow(F.lit(forgetting), (F.col("_chunk") + 1) * span - F.col("_end"))) for k in range(len(decay))]
    cut = segments.withColumn("_chunk", chunk)
    summary = cut.groupBy("symbol", "_chunk").agg(F.array(*[F.sum(v * F.col("sums")[k]) for k, v in enumerate(kept)]).alias("whole"))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        running = decayed(np.stack(pdf["whole"].to_numpy()).astype(float), decay**span, 0.0)
        before = np.concatenate([np.zeros((1, len(decay))), running[:-1]])
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "_chunk": pdf["_chunk"].to_numpy(), "start": list(before)})

    def running(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_end")
        now, at, out = np.array(pdf["start"].iloc[0], float), int(pdf["_chunk"].iloc[0]) * span, []
        for e, own in zip(pdf["_end"].tolist(), pdf["sums"], strict=True):
            now, at = decay ** (e - at) * now + own, e
            out.append(now)
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "_end": pdf["_end"].to_numpy(), "sums": out})

    begin = summary.groupBy("symbol").applyInPandas(starts, "symbol string, _chunk long, start array<double>")
    total = cut.join(begin, ["symbol", "_chunk"]).groupBy("symbol", "_chunk").applyInPandas(running, "symbol string, _end long, sums array<double>")
    fits = total.where((F.col("_end") >= first) & (F.pmod(F.col("_end") - first, F.lit(step)) == 0))
    sums = [F.col("sums")[k] for k in range(len(names))]
    if longest is not None:
        old = total.select("symbol", (F.col("_end") + longest).alias("_end"), F.col("sums").alias("old"))
        fits = fits.join(old, ["symbol", "_end"], "left")
        gone = decay**longest
        sums = [v - F.coalesce(F.col("old")[k], F.lit(0.0)) * float(gone[k]) for k, v in enumerate(sums)]
    return fits.select("symbol", F.col("_end").alias("train_end"), *[v.cast("long" if c == "n" else "double").alias(c) for c, v in zip(names, sums, strict=True)])


def regression_walk_wide(rows: DataFrame, x: list[str], y: str, config: WalkForward, forgetting: float = 1.0, **prior: float) -> DataFrame:
    """Out-of-sample Student-t predictives of a regression of y on any columns x, refitted on schedule.

    Training rows may be the last max_train, and count `forgetting` to the power of their age.
    No task meets a whole symbol: rows are numbered by counts, sums come from
    `discounted_sums`, each fit is one small solve in an Arrow batch, and predictions are expressions.
    A prediction is of one refit, of whose training none is realised later than it. Rows need symbol, timestamp, x and y.
    """
    k = len(x)
    numbered = placed(rows, ["timestamp"], F.date_trunc("month", "timestamp")).drop("_chunk")
    sums = discounted_sums(numbered, x, y, config, forgetting)
    fitted = posterior(sums, k, ["symbol", "train_end"], **prior)

    def inverted(batches):
        for b in batches:
            p = np.stack(b["precision"].to_numpy()).reshape(-1, k, k) if len(b) else np.zeros((0, k, k))
            yield b.drop(columns="precision").assign(inverse=list(np.linalg.inv(p).reshape(-1, k * k)))

    fits = fitted.mapInPandas(inverted, "symbol string, train_end long, n long, mean array<double>, shape double, rate double, inverse array<double>")
    epoch = F.floor((F.col("_n") - config.first) / config.refit_every)
    asked = numbered.where(F.col("_n") >= config.first).withColumn("train_end", config.initial_train + epoch * config.refit_every)
    at = [F.col(c) for c in x]
    loc = reduce(lambda a, b: a + b, [v * F.col("mean")[i] for i, v in enumerate(at)])
    leverage = reduce(lambda a, b: a + b, [at[i] * at[j] * F.col("inverse")[i * k + j] for i in range(k) for j in range(k)])
    out = asked.join(fits, ["symbol", "train_end"]).withColumn("_lev", leverage)
    df = 2 * F.col("shape")
    scale = F.sqrt(F.col("rate") / F.col("shape") * (1 + F.col("_lev")))
    spread = F.when(df > 2, scale * scale * df / (df - 2)) * F.col("_lev") / (1 + F.col("_lev"))
    return out.select(
        *rows.columns, "train_end", F.col("n").alias("train_rows"), df.alias("df"), loc.alias("loc"), scale.alias("scale"),
        spread.alias("epistemic_variance"),
    )


def scored(predictions: DataFrame, y: str) -> DataFrame:
    """Adds outcome, u (PIT), p (probability of a rise), up, logpdf, mean and sd to Student-t predictions."""
    ship_package()

    def score(batches):
        for b in batches:
            args = [b[c].to_numpy(float) for c in ("loc", "scale", "df")]
            outcome = b[y].to_numpy(float)
            sd = np.where(args[2] > 2, args[1] * np.sqrt(args[2] / np.maximum(args[2] - 2, 1e-12)), np.inf)
            yield pd.DataFrame(
                {
                    "symbol": b.symbol, "timestamp": b.timestamp, "outcome": outcome, "mean": args[0], "sd": sd,
                    "u": special.t_cdf(outcome, *args), "p": 1 - special.t_cdf(0.0, *args), "up": outcome > 0,
                    "logpdf": special.t_logpdf(outcome, *args),
                }
            )

    schema = "symbol string, timestamp timestamp_ntz, outcome double, mean double, sd double, u double, p double, up boolean, logpdf double"
    return predictions.select("symbol", "timestamp", y, "loc", "scale", "df").mapInPandas(score, schema)


MIXTURE = "array<struct<w:double,loc:double,scale:double,df:double>>"
REPLAY = (
    f"symbol string, as_of timestamp_ntz, realised_at timestamp_ntz, outcome double, mixture {MIXTURE}, epistemic_variance double, "
    "w_momentum double, w_volatility double, w_regime double, u double, p_positive double, logpdf double"
)


#: Kinds of events of a replay, in their order at one moment.
KNOWN, BAR = 0, 1


class _Replay:
    """What one symbol's replay holds between events: rows to train on, models, weights, answers that wait for their outcome."""

    def __init__(self, x: str, horizon: int, warmup: int, refit_every: int):
        self.x, self.horizon, self.warmup, self.refit_every = x, horizon, warmup, refit_every
        self.first = warmup + horizon + 1
        self.columns: dict[str, list] = {c: [] for c in ("as_of", x, "forward_log_return", "r")}
        self.models = Ensemble(x, horizon)
        self.reliability = filters.Reliability({m: float(-np.log(len(Ensemble.names))) for m in Ensemble.names})
        self.waiting: dict[object, dict] = {}

    def known(self, event) -> None:
        """An outcome exists now: it scores the answers of its bar, and models that were not fitted on it absorb it."""
        answers = self.waiting.pop(event.as_of, None)
        if answers is None:
            return
        self.reliability.score({m: log_score(event.outcome, parts) for m, (parts, _) in answers.items()})
        row = {"as_of": event.as_of, self.x: event.x, "forward_log_return": event.outcome, "r": event.r}
        if str(event.as_of) > self.models.models["momentum"].span.end:
            self.models.update(row)

    def bar(self, event) -> list[tuple]:
        """Stores the bar, refits where the schedule says so, and answers."""
        seen = self.columns["as_of"]
        if seen and event.as_of <= seen[-1]:
            raise ValueError(f"{event.symbol} has two rows at {event.as_of}")
        for name, value in zip(self.columns, (event.as_of, event.x, event.outcome, event.r), strict=True):
            self.columns[name].append(value)
        place = len(seen) - self.first
        if place < 0:
            return []
        if place % self.refit_every == 0:
            # outcomes of the last `horizon` rows before this one may not be known
            rows = pd.DataFrame({c: v[: len(seen) - self.horizon - 1] for c, v in self.columns.items()})
            self.models.fit(rows)
        if not math.isfinite(event.outcome):
            return []
        answers = self.models.predict({self.x: event.x})
        weights = self.reliability.weights()
        parts, epistemic, _ = account.pool(answers, weights)
        self.waiting[event.as_of] = answers
        m = tuple(np.array(v, float) for v in zip(*parts, strict=True))
        mixture = [dict(zip(("w", "loc", "scale", "df"), c, strict=True)) for c in parts]
        u, p = float(special.mixture_cdf(event.outcome, m)), float(1 - special.mixture_cdf(0.0, m))
        return [
            (event.symbol, event.as_of, event.realised_at, event.outcome, mixture, epistemic, *(weights[n] for n in Ensemble.names), u, p,
             float(special.mixture_logpdf(event.outcome, m)))
        ]

    def step(self, event) -> list[tuple]:
        if event.kind == BAR:
            return self.bar(event)
        self.known(event)
        return []


def replay(rows: DataFrame, x: str = "momentum_20_1", horizon: int = 5, warmup: int = 300, refit_every: int = 50) -> DataFrame:
    """Decision-time replay of three models per symbol: regression, variance filter and regime filter.

    Every row is two events: a bar at its time, and an outcome that is known from
    realised_at on. Events of a symbol in order of time, outcomes first, are one fold: an outcome is scored
    and absorbed, a bar refits the models every `refit_every` bars on the rows up to
    horizon + 1 bars before it, and the fused prediction is recorded. Rows whose outcome is not
    finite are neither trained on nor recorded (`skipped` counts them), two rows of one
    symbol at one time are an error, as is another horizon in a column horizon_bars; a
    symbol of fewer rows than warmup + horizon + 1 has no record. Rows need symbol, timestamp,
    realised_at, forward_log_return, r and x. The state keeps four numbers a bar.
    """
    if warmup < LEAST_REGIME or refit_every < 1 or horizon < 1:
        raise ValueError(f"a replay warms up over at least {LEAST_REGIME} bars, and refits and looks ahead by at least one")
    outcome = F.coalesce(F.col("forward_log_return"), F.lit(float("nan")))
    if "horizon_bars" in rows.columns:
        other = F.col("horizon_bars") != horizon
        outcome = F.when(other, F.raise_error(F.lit(f"a label is not of {horizon} bars")).cast("double")).otherwise(outcome)
    of_row = [F.col("timestamp").alias("as_of"), "realised_at", outcome.alias("outcome"), F.col("r").alias("r"), F.col(x).alias("x")]
    bars = rows.select("symbol", F.col("timestamp").alias("moment"), F.lit(BAR).alias("kind"), *of_row)
    finite = ~F.isnan("outcome") & (F.abs("outcome") < float("inf"))
    outcomes = rows.select("symbol", F.col("realised_at").alias("moment"), F.lit(KNOWN).alias("kind"), *of_row).where(finite)
    events = bars.unionByName(outcomes)
    return fold(events, "symbol", ["moment", "kind", "as_of"], lambda _: _Replay(x, horizon, warmup, refit_every), _Replay.step, REPLAY)


def skipped(rows: DataFrame) -> DataFrame:
    """Per symbol the rows of a replay whose outcome is not finite."""
    y = F.col("forward_log_return")
    bad = y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_examples"), F.count_if(bad).alias("n_skipped"))


#: Rows that a fit report needs beyond the first training window and the horizon.
LEAST_SCORED = 50


def fit_report(rows: DataFrame, x: str, y: str, config: WalkForward, **prior: float) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample calibration per symbol, and the regression fitted on all its rows.

    Symbols of fewer than initial_train + horizon + 50 rows are left out of both: a fit with
    nothing held out is of unknown quality.
    """
    counts = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_examples"))
    enough = counts.where(F.col("n_examples") >= config.initial_train + config.horizon + LEAST_SCORED)
    kept = rows.join(enough.select("symbol"), "symbol", "left_semi")
    report = assess(scored(regression_walk(kept, x, y, config, **prior), y), ["symbol"]).withColumnRenamed("n", "n_scored")
    sums = gram(kept.withColumn("_one", F.lit(1.0)), ["_one", x], y, ["symbol"])
    return report.join(enough, "symbol"), posterior_two(sums, ["symbol"], **prior)


def calibration_sweep(processes: dict[str, object], seeds: list[int], bars: int, spark: SparkSession, config: WalkForward) -> DataFrame:
    """Calibration of the walk-forward regression over simulated series: a row per process and seed.

    Every series is one symbol of one plan, so the sweep runs as one job.
    """
    from tidebook.functions.features import log_return, momentum
    from tidebook.operators.series import training_set
    from tidebook.sources.synthetic import simulate

    parts = []
    for name, law in sorted(processes.items()):
        for seed in seeds:
            one = spark.createDataFrame([(f"{name}/{seed}",)], "symbol string")
            parts.append(simulate(one, bars, law, seed))
    table = reduce(DataFrame.unionByName, parts)
    rows = training_set(table, [log_return(1), momentum(20, 1)], config.horizon)
    out = assess(scored(regression_walk(rows, "momentum_20_1", "forward_log_return", config), "forward_log_return"), ["symbol"])
    label = F.split("symbol", "/")
    return out.withColumns({"process": label[0], "seed": label[1].cast("int")}).drop("symbol")
