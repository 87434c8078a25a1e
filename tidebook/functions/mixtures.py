"""Predictive distributions as arrays of weighted Student-t components.

Moments and densities are array expressions; distribution functions and quantiles
need the incomplete beta function and run in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions import special
from tidebook.runtime import ship_package


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def mean(mixture: Column) -> Column:
    return _sum(F.transform(mixture, lambda c: c["w"] * c["loc"])) / _sum(F.transform(mixture, lambda c: c["w"]))


def component_variance(c: Column) -> Column:
    """Variance of one component: infinite up to two degrees of freedom."""
    return F.when(c["df"] > 2, c["scale"] * c["scale"] * c["df"] / (c["df"] - 2)).otherwise(F.lit(float("inf")))


def between_variance(mixture: Column) -> Column:
    """Spread of the component means: the disagreement of what was pooled."""
    weight = _sum(F.transform(mixture, lambda c: c["w"]))
    centre = mean(mixture)
    return _sum(F.transform(mixture, lambda c: c["w"] * F.pow(c["loc"] - centre, F.lit(2.0)))) / weight


def variance(mixture: Column) -> Column:
    """Law of total variance: mean of variances and variance of means; components of no weight are left out."""
    used = F.filter(mixture, lambda c: c["w"] > 0)
    weight = _sum(F.transform(used, lambda c: c["w"]))
    return _sum(F.transform(used, lambda c: c["w"] * component_variance(c))) / weight + between_variance(used)


def normalised(mixture: Column) -> Column:
    weight = _sum(F.transform(mixture, lambda c: c["w"]))
    return F.transform(
        mixture, lambda c: F.struct((c["w"] / weight).alias("w"), c["loc"].alias("loc"), c["scale"].alias("scale"), c["df"].alias("df"))
    )


def _arrays(mixtures: list) -> special.Mixture:
    """Rows of components, padded with components of no weight."""
    width = max(map(len, mixtures))
    out = tuple(np.full((len(mixtures), width), v) for v in (0.0, 0.0, 1.0, 1.0))
    for i, components in enumerate(mixtures):
        for j, c in enumerate(components):
            for array, key in zip(out, ("w", "loc", "scale", "df"), strict=True):
                array[i, j] = c[key]
    return out


def _batch(function):
    def run(mixtures: pd.Series, at: pd.Series) -> pd.Series:
        usable = [
            m is not None and len(m) > 0 and not pd.isna(x) and sum(c["w"] for c in m) > 0 for m, x in zip(mixtures, at, strict=True)
        ]
        out = pd.Series(np.nan, index=mixtures.index)
        if any(usable):
            rows = np.nonzero(usable)[0]
            out.iloc[rows] = function(at.to_numpy(float)[rows], _arrays([mixtures.iloc[k] for k in rows]))
        return out.astype(object).where(pd.Series(usable, index=out.index), None).astype("Float64")

    return run


def _column(function, mixture: Column, x: Column | float) -> Column:
    ship_package()
    return F.pandas_udf(_batch(function), "double")(mixture, F.lit(x).cast("double") if isinstance(x, (int, float)) else x)


def cdf(mixture: Column, x: Column | float) -> Column:
    """P(X <= x); null for an empty mixture or null x. At an outcome this is its PIT."""
    return _column(special.mixture_cdf, mixture, x)


def logpdf(mixture: Column, x: Column | float) -> Column:
    return _column(special.mixture_logpdf, mixture, x)


def quantile(mixture: Column, p: Column | float) -> Column:
    return _column(special.mixture_quantile, mixture, p)


def tails(mixture: Column, loss: float, tail: float) -> Column:
    """Struct of p_positive, p_below_loss, p_above_loss, q_low and q_high, in one pass over the batches."""
    ship_package()
    names = ["p_positive", "p_below_loss", "p_above_loss", "q_low", "q_high"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def read(mixtures: pd.Series) -> pd.DataFrame:
        usable = np.array([m is not None and len(m) > 0 and sum(c["w"] for c in m) > 0 for m in mixtures], bool)
        out = np.full((len(mixtures), len(names)), np.nan)
        if usable.any():
            m = _arrays([x for x, ok in zip(mixtures, usable, strict=True) if ok])
            n = int(usable.sum())
            at = lambda x: special.mixture_cdf(np.full(n, x), m)
            q = lambda p: special.mixture_quantile(np.full(n, p), m)
            out[usable] = np.column_stack([1 - at(0.0), at(-loss), 1 - at(loss), q(tail), q(1 - tail)])
        return pd.DataFrame(out, columns=names)

    return read(mixture)


def probability_above(mixture: Column, x: Column | float) -> Column:
    return 1 - cdf(mixture, x)


def entropy(weights: Column) -> Column:
    """Shannon entropy of an array of probabilities, in nats."""
    return -_sum(F.transform(weights, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0)))


def normalised_entropy(weights: Column) -> Column:
    return F.when(F.size(weights) > 1, entropy(weights) / F.ln(F.size(weights))).otherwise(0.0)


def pdf(mixture: Column, x: Column | float) -> Column:
    return F.exp(logpdf(mixture, x))


def ccdf(mixture: Column, x: Column | float) -> Column:
    """P(X > x)."""
    return 1 - cdf(mixture, x)


def credible_interval(mixture: Column, level: float = 0.9) -> Column:
    """Struct of lower, upper and level: the central interval."""
    if not 0 < level < 1:
        raise ValueError("a level lies between 0 and 1")
    lower, upper = quantile(mixture, (1 - level) / 2), quantile(mixture, (1 + level) / 2)
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(level).alias("level"))


def draw(mixture: Column, seed: int, *key: Column) -> Column:
    """One draw of the mixture, the same whenever it is asked with the same seed and key: the quantile of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return quantile(mixture, u)


def most_likely(labels: list[str], weights: Column) -> Column:
    """The label of the largest of an array of probabilities, the first on ties."""
    return F.element_at(F.lit(labels), F.array_position(weights, F.array_max(weights)).cast("int"))


def probability_of(labels: list[str], weights: Column, label: str) -> Column:
    """The probability of a label; zero for one that is not there."""
    return F.get(weights, F.lit(labels.index(label))) if label in labels else F.lit(0.0)
