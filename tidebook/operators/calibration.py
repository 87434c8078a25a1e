"""Scoring predictions against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Credible levels and reliability bins.
LEVELS, BINS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99), 10
#: Ranges of u that are ranked side by side.
LANES = 4096


def kolmogorov(rows: DataFrame, keys: list[str], lanes: int = LANES) -> DataFrame:
    """Largest distance of the values u from a uniform distribution, per group; NaN where a value is.

    Equal values are counted first, so ties are one row; the others are ranked within `lanes` equal
    ranges of u, and counts of whole ranges carry the rank on. A group is therefore many tasks, and what is summed
    over a whole group is at most one number a range. Values outside 0 to 1 belong to the first and last range.
    """
    lane = F.least(F.greatest(F.floor(F.col("u") * lanes), F.lit(0)), F.lit(lanes - 1)).cast("int")
    tied = rows.where("u IS NOT NULL").groupBy(*keys, lane.alias("_lane"), "u").agg(F.count(F.lit(1)).alias("_ties"))
    before = Window.partitionBy(*keys).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    ranges = tied.groupBy(*keys, "_lane").agg(F.sum("_ties").alias("_in"))
    ranges = ranges.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_lane").alias("_at"),
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_offset"),
        F.sum("_in").over(Window.partitionBy(*keys)).alias("n"),
    )
    same = F.col("_lane") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_lane").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_offset") + F.col("_upto")
    gap = F.greatest(last / F.col("n") - F.col("u"), F.col("u") - (last - F.col("_ties")) / F.col("n"))
    ranked = tied.withColumn("_upto", F.sum("_ties").over(within)).join(ranges, same)
    return ranked.groupBy(*keys).agg(F.max(gap).alias("ks"), F.max("n").alias("n"))


def coverage(rows: DataFrame, keys: list[str], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Share of outcomes inside the central interval of each level; both ends count, as does the PIT u on them."""
    at = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    inside = F.col("u").between((1 - F.col("level")) / 2, (1 + F.col("level")) / 2)
    return (
        rows.where("u IS NOT NULL").select(*keys, "u", at).groupBy(*keys, "level").agg(F.avg(inside.cast("double")).alias("empirical"), F.count(F.lit(1)).alias("n"))
    )


def interval_error(covered: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance of empirical coverage from its level, and whether intervals are too narrow on the whole."""
    gap = F.col("empirical") - F.col("level")
    return covered.groupBy(*keys).agg(F.avg(F.abs(gap)).alias("interval_error"), (F.sum(gap) < 0).alias("is_overconfident"))


def reliability(rows: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """Predicted probability p against the frequency of `up` in equal bins, closed below, the last closed above; empty bins are left out."""
    bin_of = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return (
        rows.where("p IS NOT NULL")
        .groupBy(*keys, bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg(F.col("up").cast("double")).alias("observed"))
    )


def calibration_error(binned: DataFrame, keys: list[str]) -> DataFrame:
    return binned.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))


def brier(p: Column, up: Column) -> Column:
    """Mean squared distance of the probability from what happened, as an aggregate."""
    return F.avg(F.pow(p - up.cast("double"), F.lit(2.0)))


def scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, Brier score, mean log score, sharpness and bias from p, up, logpdf, sd, mean and outcome.

    Log scores and deviations that are not finite are left out of their means; where none is
    finite the log score is -inf and the sharpness inf.
    """
    inf = float("inf")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != inf), F.col(c))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        brier(F.col("p"), F.col("up")).alias("brier"),
        F.coalesce(F.avg(finite("logpdf")), F.lit(-inf)).alias("log_score"),
        F.coalesce(F.avg(finite("sd")), F.lit(inf)).alias("sharpness"),
        F.avg(F.col("outcome") - F.col("mean")).alias("bias"),
    )


def assess(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with all of the above."""
    covered = interval_error(coverage(rows, keys), keys)
    return (
        scores(rows, keys)
        .join(kolmogorov(rows, keys).drop("n"), keys, "left")
        .join(covered, keys, "left")
        .join(calibration_error(reliability(rows, keys), keys), keys, "left")
    )


def terciles(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """`rows` with regime low, middle or high by terciles of a column within the group."""
    cuts = rows.groupBy(*keys).agg(F.percentile(by, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_cut"))
    label = F.when(F.col(by) <= F.col("_cut")[0], "low").when(F.col(by) <= F.col("_cut")[1], "middle").otherwise("high")
    return rows.join(cuts, keys).withColumn("regime", label).drop("_cut")


def model_health(report: DataFrame) -> DataFrame:
    """Checks of fitted, interval_error, brier, uncertainty, n and disagreement: pass, fail or skipped (absent)."""

    def check(name: str, ok: Column) -> Column:
        value = F.col(name).cast("double")
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        status = F.when(value.isNull(), "skipped").when(bad, "fail").when(ok, "pass").otherwise("fail")
        return F.struct(F.lit(name).alias("name"), status.alias("status"), value.alias("observed"))

    checks = F.array(
        check("fitted", F.col("fitted")),
        check("interval_error", F.col("interval_error") <= 0.15),
        check("brier", F.col("brier") <= 0.3),
        check("uncertainty", F.col("uncertainty") <= 1),
        check("n", F.col("n") >= 30),
        check("disagreement", F.col("disagreement") <= 0.9),
    )
    return report.select("model", F.inline(checks)).withColumn(
        "healthy", F.min((F.col("status") != "fail").cast("int")).over(Window.partitionBy("model")) == 1
    )
