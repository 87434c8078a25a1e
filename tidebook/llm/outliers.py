"""Quality rules: robust multivariate outliers among text statistics.

Each text gets counts (words, their characters, symbols, repeated lines, words in
repeated five-word windows). Fixed rules fail texts that are too short or repeat
themselves. The others are judged by minimum-covariance-determinant estimates of
location and scatter per language and source: transformed rates of the counts, a
subset of about half the group with the smallest determinant found by concentration
steps from two deterministic starts (medians with quartile scales; mean with
covariance), one reweighting step, and a cut-off on the squared Mahalanobis distance.
A ridge of fixed scales is added to every scatter, as most groups have many texts
without any symbol or repeat and would have no determinant at all.

Scale: a concentration step is one partial aggregation. Rows fall into fine bins of
the logarithm of their distance; sums of moments per (group, bin) say both where
the subset ends and what its moments are, so no group is sorted or collected, and a
group that holds a third of all rows is a few hundred partial sums. The subset takes the
whole bin that fills it, and its scatter is made whole by the share that it really holds. Groups
step as long as their determinant falls, by a thousandth at least, so steps end; one that rises or goes round
between neighbouring bins keeps the smaller determinant. Groups that are done are left out of the next step.
Counts are computed inside the row, once. Estimates have one row per group; they are broadcast only if they are few,
else those of large groups are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import SPACE_CLASS, durable, join_counted, let, read_table, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: The relative fall of a determinant that counts as none, and the tail beyond the cut-off.
STILL, TAIL = 1e-3, 1e-6
#: Consistency factors are looked up by share in steps of one over this.
SHARES = 1000
#: Words by which rates of short texts are drawn to their group's.
PRIOR_WORDS = 50
#: Scale that every transformed statistic has at least: log word length, log symbols and repeated lines per 100 words, share of repeated words.
RIDGE = (0.03, 0.3, 0.25, 0.05)
BROADCAST_GROUPS, FEW_PARTS = 10_000, 8
_P = len(RIDGE)
_BINS_PER_OCTAVE = 16


def chi2_cdf(x: float, df: int) -> float:
    """For even df, in closed form."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, df // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return low


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the inner share of a normal sample whole again."""
    return share / chi2_cdf(chi2_quantile(share, _P), _P + 2)


def consistency(share: Column) -> Column:
    """The factor for a share from a half to the whole, to three digits."""
    table = [_consistency(max(k, SHARES // 2) / SHARES) if k < SHARES else 1.0 for k in range(SHARES // 2, SHARES + 1)]
    place = F.least(F.lit(SHARES // 2), F.greatest(F.lit(0), F.round(share * SHARES).cast("int") - SHARES // 2))
    return F.get(F.lit(table), place)


def text_counts(text: Column) -> Column:
    """Struct of the COUNTS (longs) of a whole text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def repeated(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]),
        )
        return let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_reached(h)),
        )

    def _reached(h: Column) -> Column:
        """Words under windows whose hash occurs twice: gaps between their sorted starts, cut at the window."""
        paired = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            paired,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])),
                    lambda e: e["i"],
                )
            ),
        )
        gaps = let(starts, lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(WINDOW), b - a)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated(w).alias("n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def group_key() -> Column:
    """Language and source as one string without nulls."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return F.concat_ws("\x01", part("lang"), part("source"))


def _vector() -> list[Column]:
    """The transformed statistics; needs the group's prior_length."""
    n = F.col("n_words") + PRIOR_WORDS
    return [
        F.log((F.col("word_chars") + PRIOR_WORDS * F.col("prior_length")) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]


_X = [f"x{j}" for j in range(_P)]
_PAIRS = [(j, k) for j in range(_P) for k in range(j + 1)]


def _moments(prefix: str = "") -> list[Column]:
    sums = [F.sum(x).alias(f"{prefix}{x}") for x in _X]
    return [F.count(F.lit(1)).alias("n"), *sums, *[F.sum(F.col(_X[j]) * F.col(_X[k])).alias(f"s{j}{k}") for j, k in _PAIRS]]


def _estimate(sums: DataFrame, factor: float | Column) -> DataFrame:
    """Sums of moments to means m*, the inverse i** of the ridged scatter, and its determinant."""
    out = sums.withColumns({f"m{j}": F.col(f"x{j}") / F.col("n") for j in range(_P)})

    def scatter(j: int, k: int) -> Column:
        value = factor * (F.col(f"s{j}{k}") / F.col("n") - F.col(f"m{j}") * F.col(f"m{k}"))
        return (F.greatest(value, F.lit(0.0)) + RIDGE[j] ** 2) if j == k else value

    return _invert(out.withColumns({f"c{j}{k}": scatter(j, k) for j, k in _PAIRS}))


def _invert(out: DataFrame) -> DataFrame:
    """Adds i** and det for the scatter c**, by its Cholesky factor (lower, l**); columns that need no other are added together."""
    keys = [c for c in ("key", "start", "all") if c in out.columns]
    means = [f"m{j}" for j in range(_P)]


    def rest(j: int, k: int) -> Column:
        return F.col(f"c{j}{k}") - sum((F.col(f"l{j}{t}") * F.col(f"l{k}{t}") for t in range(k)), F.lit(0.0))

    for k in range(_P):
        out = out.withColumn(f"l{k}{k}", F.sqrt(F.greatest(rest(k, k), F.lit(RIDGE[k] ** 2 * 1e-3))))
        out = out.withColumns({f"l{j}{k}": rest(j, k) / F.col(f"l{k}{k}") for j in range(k + 1, _P)}) if k + 1 < _P else out
    # the inverse of the factor, diagonal by diagonal
    out = out.withColumns({f"v{j}{j}": 1 / F.col(f"l{j}{j}") for j in range(_P)})
    for gap in range(1, _P):
        out = out.withColumns(
            {
                f"v{j}{j - gap}": -sum((F.col(f"l{j}{t}") * F.col(f"v{t}{j - gap}") for t in range(j - gap, j)), F.lit(0.0)) / F.col(f"l{j}{j}")
                for j in range(gap, _P)
            }
        )
    inverse = [
        sum((F.col(f"v{t}{j}") * F.col(f"v{t}{k}") for t in range(j, _P)), F.lit(0.0)).alias(f"i{j}{k}") for j, k in _PAIRS
    ]
    det = F.lit(1.0)
    for j in range(_P):
        det = det * F.col(f"l{j}{j}") * F.col(f"l{j}{j}")
    return out.select(*keys, *means, *inverse, det.alias("det"))


def _distance() -> Column:
    gap = [F.col(f"x{j}") - F.col(f"m{j}") for j in range(_P)]
    total = F.lit(0.0)
    for j, k in _PAIRS:
        total = total + (1 if j == k else 2) * F.col(f"i{j}{k}") * gap[j] * gap[k]
    return F.greatest(total, F.lit(0.0))


def is_small(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def with_groups(rows: DataFrame, groups: DataFrame, n: str, how: str = "inner", few: bool | None = None) -> DataFrame:
    """`rows` joined by key with facts of their groups; column n of `groups` counts a group's rows and goes.

    Few groups are broadcast. Of many, the large ones are, and only rows of the others move.
    """
    if is_small(groups) if few is None else few:
        return rows.join(F.broadcast(groups.drop(n)), "key", how)
    return join_counted(rows, groups, "key", n, how)


def estimates(counted: DataFrame) -> DataFrame:
    """One row per group: key, prior_length, means m*, inverse scatter i** and det.

    `counted` has key, failed and the COUNTS; failed rows take no part. Groups of any
    size have an estimate: the ridge stands in where rows are too few.
    """
    sound = counted.where(~F.col("failed"))
    prior = durable(
        sound.groupBy("key").agg(
            (F.sum("word_chars") / F.greatest(F.sum("n_words"), F.lit(1))).alias("prior_length"), F.count(F.lit(1)).alias("_rows")
        )
    )
    few = is_small(prior)
    rows = durable(
        with_groups(sound, prior, "_rows", few=few).select("key", *[v.alias(x) for v, x in zip(_vector(), _X, strict=True)])
    )
    quartiles = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(f"q{x}") for x in _X]
    first = durable(rows.groupBy("key").agg(*_moments(), *quartiles).withColumn("all", F.col("n")))
    diagonal = first.select(
        "key",
        "all",
        F.lit("quartiles").alias("start"),
        *[F.col(f"q{x}")[1].alias(f"m{j}") for j, x in enumerate(_X)],
        *[
            (F.pow((F.col(f"qx{j}")[2] - F.col(f"qx{j}")[0]) / 1.349, F.lit(2.0)) + RIDGE[j] ** 2 if j == k else F.lit(0.0)).alias(f"c{j}{k}")
            for j, k in _PAIRS
        ],
    )
    classical = _estimate(first.withColumn("start", F.lit("moments")), 1.0)
    starts = _invert(diagonal).unionByName(classical)
    going = durable(starts.coalesce(FEW_PARTS) if few else starts)
    bins = Window.partitionBy("key", "start").orderBy("bin")
    sums = [*_X, *[f"s{j}{k}" for j, k in _PAIRS]]
    now, fresh = going.limit(0), True
    while going.limit(1).count():
        held = going.withColumn("_rows", F.col("all"))
        binned = (
            with_groups(rows, held, "_rows", few=few)
            .withColumn("bin", F.floor(_BINS_PER_OCTAVE * F.log2(_distance() + 1e-6)).cast("int"))
            .groupBy("key", "start", "all", "bin")
            .agg(*_moments())
        )
        inner = (
            binned.withColumn("before", F.sum("n").over(bins) - F.col("n"))
            .where(F.col("before") < F.floor((F.col("all") + _P + 1) / 2))
            .groupBy("key", "start", "all")
            .agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
        )
        after = _estimate(inner, consistency(F.col("n") / F.col("all")))
        found = [c for c in after.columns if c not in ("key", "start")]
        was = going.select("key", "start", F.struct(*found).alias("was"))
        # the starts are no subsets, so their determinants say nothing
        fell = F.lit(fresh) | (F.col("det") < (1 - STILL) * F.col("was.det"))
        better = F.lit(fresh) | (F.col("det") <= F.col("was.det"))
        after = after.join(was, ["key", "start"]).select(
            "key", "start", fell.alias("fell"), F.when(better, F.struct(*found)).otherwise(F.col("was")).alias("e")
        ).select("key", "start", "fell", "e.*")
        # few groups need no more than few tasks, however many partitions a shuffle has
        moved = durable(after.coalesce(FEW_PARTS) if few else after)
        now = now.unionByName(moved.where("not fell").drop("fell"))
        going, fresh = moved.where("fell").drop("fell"), False
    now = durable(now.coalesce(FEW_PARTS) if few else now)
    best = now.groupBy("key").agg(F.min_by(F.struct(*[c for c in now.columns if c != "key"]), F.struct("det", "start")).alias("b"))
    raw = durable(best.select("key", "b.*"))
    share = 0.975
    reweighted = (
        with_groups(rows, raw.withColumn("_rows", F.col("all")), "_rows", few=few)
        .where(_distance() <= chi2_quantile(share, _P))
        .groupBy("key")
        .agg(*_moments())
    )
    # a group whose subset has no row within the cut keeps its raw estimate
    final = _estimate(reweighted, _consistency(share))
    names = [c for c in final.columns if c != "key"]
    merged = raw.select("key", F.struct(*names).alias("r")).join(final.select("key", F.struct(*names).alias("f")), "key", "left")
    return durable(merged.select("key", F.coalesce("f", "r").alias("e")).join(prior, "key").select("key", "prior_length", "_rows", "e.*"))


def judge(counted: DataFrame, found: DataFrame, tail: float = TAIL) -> DataFrame:
    """`counted` with distance2 and kept: sound by the fixed rules and within the cut-off of its group."""
    names = counted.columns
    joined = with_groups(counted, found, "_rows", "left")
    for v, x in zip(_vector(), _X, strict=True):
        joined = joined.withColumn(x, v)
    distance = F.when(~F.col("failed"), _distance())
    return joined.select(
        *[F.col(f"`{c}`") for c in names],
        distance.alias("distance2"),
        F.coalesce(distance <= chi2_quantile(1 - tail, _P), F.lit(False)).alias("kept"),
    )


def count_documents(docs: DataFrame) -> DataFrame:
    """`docs` with key, the COUNTS and failed."""
    own = [c for c in docs.columns if c not in (*COUNTS, "key", "failed")]
    return (
        docs.select(*[F.col(f"`{c}`") for c in own], group_key().alias("key"), text_counts(F.col("text")).alias("_to"))
        .select(*[F.col(f"`{c}`") for c in own], "key", *[F.col(f"_to.{c}") for c in COUNTS])
        .withColumn("failed", base_failed())
    )


def drop_outliers(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that fail the fixed rules or lie outside their group.

    Texts are read and counted once: rows go to a table in the shared folder with their counts,
    which the estimates read alone and the verdicts select from. Texts are not shuffled while
    groups are few. All columns stay as they are, whatever their names.
    """
    packed = docs.select(F.struct("*").alias("_to_row"), "lang", "source", "text")
    counted = stored(count_documents(packed).drop("lang", "source", "text"))
    return judge(counted, estimates(counted.drop("_to_row"))).where("kept").select("_to_row.*")


def op5_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts, the fixed rules' verdict and the operator's."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    slim = durable(count_documents(docs).drop("text", "lang", "source"))
    return judge(slim, estimates(slim)).select(
        "doc_id", *COUNTS, F.col("failed").alias("base_failed"), "kept", "distance2"
    )
