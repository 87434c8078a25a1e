"""Feature walks and forward labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.features import Feature, Frames, compute, lookback, ratio, with_helpers
from tidebook.operators.chunks import chunked, numbered

KEEP = ["symbol", "timestamp"]


def feature_walk(bars: DataFrame, features: list[Feature], complete_only: bool = False, chunk: int | None = None) -> DataFrame:
    """The feature vector at every bar: symbol, timestamp, n_bars and a column per feature.

    With `chunk` a symbol's series is spread over tasks in chunks of so many bars; the
    values are the same.
    """
    if chunk is None:
        frames = Frames()
        out = compute(with_helpers(bars, frames), features, frames, KEEP)
    else:
        reach = lookback(features) + 1
        frames = Frames(("symbol", "_chunk"))
        cut = chunked(numbered(bars, F.date_trunc("month", "timestamp")), reach, max(chunk, reach))
        helped = with_helpers(cut, frames, F.col("_n"))
        out = compute(helped, features, frames, [*KEEP, "_halo"]).where(~F.col("_halo")).drop("_halo")
    if complete_only:
        out = out.na.drop(subset=[f.name for f in features])
    return out


def features_at(bars: DataFrame, features: list[Feature], as_of: str) -> DataFrame:
    """The latest vector of each symbol that is known at `as_of`, with data_as_of."""
    known = bars.where(F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz"))
    walked = feature_walk(known, features)
    names = [c for c in walked.columns if c != "symbol"]
    latest = walked.groupBy("symbol").agg(F.max_by(F.struct(*names), "timestamp").alias("v"))
    return latest.select("symbol", F.lit(as_of).cast("timestamp_ntz").alias("as_of"), "v.*").withColumnRenamed("timestamp", "data_as_of")


def first_complete(walked: DataFrame, features: list[Feature]) -> DataFrame:
    """Per symbol the first bar at which every feature has a value."""
    return walked.na.drop(subset=[f.name for f in features]).groupBy("symbol").agg(F.min("timestamp").alias("first_complete"))


def completeness(walked: DataFrame, features: list[Feature]) -> DataFrame:
    """symbol, timestamp and the names of missing features (too few bars) and undefined ones (no value)."""
    missing = F.array_compact(F.array(*[F.when(F.col("n_bars") < f.lookback + 1, F.lit(f.name)) for f in features]))
    undefined = F.array_compact(
        F.array(*[F.when((F.col("n_bars") >= f.lookback + 1) & F.col(f.name).isNull(), F.lit(f.name)) for f in features])
    )
    return walked.select(
        *KEEP,
        missing.alias("missing"),
        undefined.alias("undefined"),
        (F.size(missing) + F.size(undefined) == 0).alias("complete"),
    )


def staleness(vectors: DataFrame) -> DataFrame:
    """Vectors of features_at with stale_seconds: how far their data lie behind the moment that they are for."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return vectors.withColumn("stale_seconds", (micros("as_of") - micros("data_as_of")) / 1e6)


def design_faults(walked: DataFrame, features: list[Feature], names: list[str]) -> DataFrame:
    """symbol, timestamp and faults: per named feature without a value whether it warms up, is undefined, or was never asked for."""
    known = {f.name: f for f in features}

    def fault(name: str) -> Column:
        if name not in known:
            return F.lit(f"{name}: never requested")
        warming = F.when(F.col("n_bars") < known[name].lookback + 1, F.lit(f"{name}: warming up"))
        return F.coalesce(warming, F.when(F.col(name).isNull(), F.lit(f"{name}: undefined")))

    return walked.select(*KEEP, F.array_compact(F.array(*map(fault, names))).alias("faults")).where(F.size("faults") > 0)


def design_rows(walked: DataFrame, names: list[str]) -> DataFrame:
    """symbol, timestamp and the array of the named features, for rows where all have values."""
    return walked.na.drop(subset=names).select(*KEEP, F.array(*names).alias("x"))


def _cut(bars: DataFrame, reach: int, ahead: int, chunk: int | None) -> tuple[DataFrame, Frames]:
    """Bars with _halo, and the frames to read them by: whole series, or chunks with the bars that they reach back and ahead to."""
    if chunk is None:
        return bars.withColumn("_halo", F.lit(False)), Frames()
    cut = chunked(numbered(bars, F.date_trunc("month", "timestamp")), reach, max(chunk, reach, ahead), ahead)
    return cut, Frames(("symbol", "_chunk"))


def _outcomes(frames: Frames, horizon: int) -> list[Column]:
    """realised_at, forward_log_return, mae and mfe over the next `horizon` bars."""
    if horizon < 1:
        raise ValueError("the horizon must be at least one bar")
    ahead = frames.ordered.rowsBetween(1, horizon)
    close = F.col("close")
    return [
        F.lead("timestamp", horizon).over(frames.ordered).alias("realised_at"),
        F.ln(ratio(F.lead("close", horizon).over(frames.ordered), close)).alias("forward_log_return"),
        F.least(F.lit(0.0), F.ln(ratio(F.min("low").over(ahead), close))).alias("mae"),
        F.greatest(F.lit(0.0), F.ln(ratio(F.max("high").over(ahead), close))).alias("mfe"),
    ]


def forward_labels(bars: DataFrame, horizon: int, chunk: int | None = None) -> DataFrame:
    """symbol, as_of, realised_at, forward_log_return, mae and mfe for bars with `horizon` later ones.

    With `chunk` a series is spread over tasks in chunks of so many bars, each with the
    `horizon` bars after it; the values are the same.
    """
    cut, frames = _cut(bars, 0, horizon, chunk)
    return (
        cut.select("symbol", F.col("timestamp").alias("as_of"), *_outcomes(frames, horizon), "_halo")
        .where("NOT _halo AND realised_at IS NOT NULL")
        .drop("_halo")
        .withColumn("horizon_bars", F.lit(horizon))
        .withColumn("went_up", F.col("forward_log_return") > 0)
    )


def training_set(bars: DataFrame, features: list[Feature], horizon: int, complete_only: bool = True, chunk: int | None = None) -> DataFrame:
    """Features and labels of the same bar, in one pass over each symbol, or over each of its chunks of so many bars."""
    cut, frames = _cut(bars, lookback(features) + 1, horizon, chunk)
    labelled = cut.select("*", *_outcomes(frames, horizon))
    helped = with_helpers(labelled, frames) if chunk is None else with_helpers(labelled, frames, F.col("_n"))
    kept = [*KEEP, "realised_at", "forward_log_return", "mae", "mfe", "_halo"]
    out = compute(helped, features, frames, kept).where("NOT _halo AND realised_at IS NOT NULL").drop("_halo")
    return out.na.drop(subset=[f.name for f in features]) if complete_only else out
