"""The life cycle of the models: fit, update, predict, uncertainty, save and restore.

Rows are pandas frames (or mappings, for one) with as_of, forward_log_return, r and the
features; a column horizon_bars, where there is one, must agree with the model's. A model that a
window does not suit raises and stays as it was. Parameters are plain numbers and lists, so a
model goes through JSON, a bundle or the state of a stream unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd

from tidebook.functions import filters, special
from tidebook.functions.features import ANNUALISER
from tidebook.operators.provenance import stable_hash

Parts = list[tuple[float, float, float, float]]
#: Rows that each kind of model needs to be fitted.
LEAST_RETURN, LEAST_VOLATILITY, LEAST_REGIME = 30, 60, 120


class NotFitted(ValueError):
    """A model was asked before it was fitted."""


class HorizonMismatch(ValueError):
    """Labels or questions of another horizon than the model's."""


class TooEarly(ValueError):
    """Rows out of order, or a row that the model has moved past."""


@dataclass
class Answer:
    """A predictive mixture of Student-t components, the variance that evidence could remove, and figures to read."""

    mixture: Parts
    epistemic_variance: float
    figures: dict[str, float] = field(default_factory=dict)


@dataclass
class Span:
    """How many rows a model has absorbed, and from when to when."""

    n: int = 0
    start: str | None = None
    end: str | None = None


class Model:
    """What all models share; a kind of model says how to learn, absorb, answer and doubt."""

    kind, least = "", 0

    def __init__(self, horizon: int = 1, least: int | None = None):
        if horizon < 1:
            raise ValueError("the horizon must be at least one bar")
        self.horizon = horizon
        self.least = type(self).least if least is None else least
        self.span = Span()
        self.held: dict | None = None

    @property
    def fitted(self) -> bool:
        return self.held is not None

    def _checked_horizon(self, found: object) -> None:
        other = {int(h) for h in np.atleast_1d(found)} - {self.horizon}
        if other:
            raise HorizonMismatch(f"{self.kind} answers for {self.horizon} bars, not for {sorted(other)}")

    def _needed(self) -> None:
        if not self.fitted:
            raise NotFitted(f"{self.kind} is not fitted")

    def fit(self, rows: pd.DataFrame) -> Model:
        """Learns a window anew, in chronological order; what the window does not suit leaves the model as it was."""
        if len(rows) < self.least:
            raise ValueError(f"{self.kind} needs at least {self.least} rows, not {len(rows)}")
        if "horizon_bars" in rows:
            self._checked_horizon(rows.horizon_bars.unique())
        if not rows.as_of.is_monotonic_increasing:
            raise TooEarly("training rows must be in chronological order")
        held = self._learn(rows)
        self.held, self.span = held, Span(len(rows), str(rows.as_of.iloc[0]), str(rows.as_of.iloc[-1]))
        return self

    def update(self, row: Mapping) -> Model:
        """Absorbs one later row."""
        self._needed()
        if "horizon_bars" in row:
            self._checked_horizon(row["horizon_bars"])
        if self.span.end is not None and str(row["as_of"]) <= self.span.end:
            raise TooEarly(f"{self.kind} has absorbed up to {self.span.end}, not before {row['as_of']}")
        self._absorb(row)
        self.span.n, self.span.end = self.span.n + 1, str(row["as_of"])
        return self

    def predict(self, row: Mapping, horizon: int | None = None) -> Answer:
        self._needed()
        self._checked_horizon(self.horizon if horizon is None else horizon)
        return self._answer(row)

    def can_predict(self, row: Mapping) -> bool:
        return self.fitted

    def uncertainty(self) -> float:
        return self._doubt() if self.fitted else float("inf")

    def parameters(self) -> dict:
        self._needed()
        return {"horizon": self.horizon, "span": asdict(self.span), **self._dump()}

    def version(self) -> str:
        """Kind and the first digits of the hash of all parameters."""
        return f"{self.kind}-{stable_hash(self.parameters())[:12]}"

    def restore(self, parameters: Mapping) -> Model:
        """Adopts the parameters of a model of the same kind and horizon."""
        self._checked_horizon(parameters["horizon"])
        self.held = self._load(parameters)
        self.span = Span(**parameters["span"])
        return self


@dataclass(frozen=True)
class VolatilityScale:
    """Divides a response by the bar's volatility feature, brought back to one bar and held above a floor."""

    column: str = "volatility_20"
    floor: float = 1e-4
    annualised: bool = True

    def __post_init__(self) -> None:
        if not self.floor > 0:
            raise ValueError("the floor of a scale must be positive")

    def of(self, values: np.ndarray) -> np.ndarray:
        values = np.asarray(values, float)
        if not np.isfinite(values).all():
            raise ValueError(f"{self.column} is not a scale everywhere")
        return np.maximum(values / ANNUALISER if self.annualised else values, self.floor)


class ReturnModel(Model):
    """Bayesian regression of the forward return on standardised features, with a discount on older rows.

    Sums of products are all that it holds, so absorbing a row and fitting a longer window agree.
    """

    kind, least = "regression", LEAST_RETURN

    def __init__(
        self,
        features: list[str],
        horizon: int = 1,
        scale: VolatilityScale | None = None,
        forgetting: float = 1.0,
        coefficient_scale: float = 1.0,
        shape: float = 2.0,
        residual_scale: float | None = None,
        least: int | None = None,
    ):
        super().__init__(horizon, least)
        if not features or len(set(features)) != len(features) or not 0 < forgetting <= 1:
            raise ValueError("a regression needs distinct features and a forgetting factor up to 1")
        self.features, self.scale, self.forgetting = list(features), scale, forgetting
        # a scaled response lies near one, a return near a fiftieth
        self.prior = (coefficient_scale, shape, residual_scale or (1.0 if scale else 0.02))

    def _scales(self, values: object) -> np.ndarray:
        return np.ones(np.shape(values)) if self.scale is None else self.scale.of(values)

    def _column(self, rows: object) -> object:
        return rows[self.scale.column] if self.scale else rows[self.features[0]]

    def _learn(self, rows: pd.DataFrame) -> dict:
        x = rows[self.features].to_numpy(float)
        y = rows.forward_log_return.to_numpy(float) / self._scales(self._column(rows).to_numpy(float))
        if not np.isfinite(x).all() or not np.isfinite(y).all():
            raise ValueError("features and responses must be finite")
        centre, spread = x.mean(0), x.std(0, ddof=1)
        spread = np.where(spread > 0, spread, 1.0)
        design = np.column_stack([np.ones(len(x)), (x - centre) / spread])
        w = self.forgetting ** np.arange(len(x) - 1, -1, -1.0)
        return {
            "centre": centre, "spread": spread, "weight": float(w.sum()), "yy": float(w @ (y * y)), "xy": design.T @ (w * y), "xx": (design.T * w) @ design,
        }

    def _row(self, row: Mapping) -> np.ndarray:
        x = np.array([float(row[f]) for f in self.features])
        if not np.isfinite(x).all():
            raise ValueError(f"features are not all there: {dict(zip(self.features, x.tolist(), strict=True))}")
        return np.append(1.0, (x - self.held["centre"]) / self.held["spread"])

    def _absorb(self, row: Mapping) -> None:
        x, h, f = self._row(row), self.held, self.forgetting
        y = float(row["forward_log_return"]) / float(self._scales(float(self._column(row))))
        if not np.isfinite(y):
            raise ValueError("a response must be finite")
        h["weight"], h["yy"] = f * h["weight"] + 1, f * h["yy"] + y * y
        h["xy"], h["xx"] = f * h["xy"] + x * y, f * h["xx"] + np.outer(x, x)

    def posterior(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Mean and inverse precision of the coefficients, shape and rate of the noise."""
        self._needed()
        coefficient_scale, shape, residual_scale = self.prior
        precision = self.held["xx"] + np.eye(len(self.held["xy"])) / coefficient_scale**2
        try:
            inverse = np.linalg.inv(precision)
        except np.linalg.LinAlgError:
            inverse = np.linalg.pinv(precision)
        mean = inverse @ self.held["xy"]
        rate = max(residual_scale**2 * (shape - 1) + 0.5 * (self.held["yy"] - float(mean @ self.held["xy"])), 1e-12)
        return mean, inverse, shape + self.held["weight"] / 2, rate

    def coefficient_covariance(self) -> np.ndarray:
        _, inverse, a, b = self.posterior()
        return inverse * b / (a - 1)

    def coefficients(self) -> pd.DataFrame:
        """Per column of the design: standardised coefficient, its deviation, the coefficient of the raw feature, and their ratio."""
        mean, *_ = self.posterior()
        sd = np.sqrt(np.diag(self.coefficient_covariance()))
        slopes = mean[1:] / self.held["spread"]
        raw = np.append(mean[0] - slopes @ self.held["centre"], slopes)
        return pd.DataFrame({"column": ["intercept", *self.features], "standardised": mean, "sd": sd, "raw": raw, "z": mean / np.where(sd > 0, sd, np.inf)})

    def _answer(self, row: Mapping) -> Answer:
        mean, inverse, a, b = self.posterior()
        x = self._row(row)
        leverage, scale = float(x @ inverse @ x), float(self._scales(float(self._column(row))))
        df, width = 2 * a, float(np.sqrt(b / a * (1 + leverage)))
        epistemic = width**2 * df / (df - 2) * leverage / (1 + leverage)
        figures = {"residual_scale": float(np.sqrt(b / (a - 1))), "effective_n": self.held["weight"], "response_scale": scale}
        return Answer([(1.0, scale * float(mean @ x), scale * width, df)], epistemic * scale**2, figures)

    def can_predict(self, row: Mapping) -> bool:
        wanted = [*self.features, *([self.scale.column] if self.scale else [])]
        return self.fitted and all(c in row and row[c] is not None and np.isfinite(row[c]) for c in wanted)

    def _doubt(self) -> float:
        """Root mean square deviation of the coefficients, in units of the residual scale."""
        _, _, a, b = self.posterior()
        return float(np.sqrt(np.diag(self.coefficient_covariance()).mean()) / np.sqrt(b / (a - 1)))

    def _dump(self) -> dict:
        sums = {k: v if isinstance(v, float) else v.tolist() for k, v in self.held.items()}
        out = {"features": self.features, "forgetting": self.forgetting, "prior": list(self.prior), "sums": sums}
        return out | ({"scale": asdict(self.scale)} if self.scale else {})

    def _load(self, parameters: Mapping) -> dict:
        if parameters["features"] != self.features:
            raise ValueError(f"the parameters are of {parameters['features']}, not of {self.features}")
        if parameters.get("scale") != (asdict(self.scale) if self.scale else None):
            raise ValueError("the parameters are of another response scale")
        return {k: float(v) if np.isscalar(v) else np.array(v, float) for k, v in parameters["sums"].items()}


class VolatilityModel(Model):
    """The discounted variance filter over one-bar returns r."""

    kind, least = "variance", LEAST_VOLATILITY

    def __init__(self, horizon: int = 1, scale: float | None = 0.02, centre: float = 0.0, least: int | None = None):
        """Without a scale, the prior takes the window's own mean and deviation."""
        super().__init__(horizon, least)
        self.scale, self.centre = scale, centre

    def _learn(self, rows: pd.DataFrame) -> dict:
        r = rows.r.to_numpy(float)
        seen = r[np.isfinite(r)]
        if not len(seen):
            raise ValueError("no row has a return that can be read")
        centre, scale = (self.centre, self.scale) if self.scale else (float(seen.mean()), float(seen.std(ddof=1)) or 1e-4)
        found = filters.VarianceFilter(mu=centre, b0=scale**2)
        for v in r:
            found.observe(v)
        return {"filter": found}

    @property
    def filter(self) -> filters.VarianceFilter:
        self._needed()
        return self.held["filter"]

    def _absorb(self, row: Mapping) -> None:
        self.filter.observe(row["r"])

    def _answer(self, row: Mapping) -> Answer:
        f = self.filter
        parts, inflation = f.predictive(self.horizon)
        figures = {
            "effective_n": f.effective_n(), "expected_discount": f.expected_discount(), "entropy": f.entropy(), "predictive_df": f.predictive_df(),
            "epistemic_share": inflation / (f.plugin_variance(self.horizon) + inflation),
        }
        return Answer(parts, inflation, figures)

    def _doubt(self) -> float:
        return self.filter.uncertainty()

    def _dump(self) -> dict:
        return {"filter": self.filter.dump()}

    def _load(self, parameters: Mapping) -> dict:
        return {"filter": filters.VarianceFilter.load(parameters["filter"])}


def estimate_regime(returns: np.ndarray, strength: float = 250.0) -> filters.RegimeParameters:
    """The regime scalars of one series; the same estimators as stats.regime_scalars."""
    n, block, far = len(returns), filters.REGIME_BLOCK, filters.REGIME_FAR_LAG
    w, centre, total = n / (n + strength), float(returns.mean()), float(returns.var(ddof=1))
    k = n // block
    between = 0.0
    if k >= 2:
        means = returns[: k * block].reshape(k, block).mean(1)
        between = (means.var(ddof=1) - total / block) / (1 - 1 / block)
    drift = w * max(0.0, between) + (1 - w) * (0.25 / 252) ** 2
    d = (returns - centre) ** 2
    d = d - d.mean()
    lag = lambda m: float((d[:-m] * d[m:]).mean()) if n > m else 0.0
    near, later = lag(1), lag(far)
    measured = (later / near) ** (1 / (far - 1)) if near > 0 and later > 0 else 1 - 1 / 25
    held = min(0.99, max(0.5, w * measured + (1 - w) * (1 - 1 / 25)))
    mean_variance = max(total - drift, 1e-12)
    spread = w * max(0.0, near / held) + (1 - w) * (0.55 * mean_variance) ** 2
    return filters.RegimeParameters(centre, drift**0.5, held, mean_variance, spread**0.5 / mean_variance, n)


class RegimeModel(Model):
    """The three-state chain over one-bar returns r."""

    kind, least = "regime", LEAST_REGIME

    def _learn(self, rows: pd.DataFrame) -> dict:
        r = rows.r.to_numpy(float)
        seen = r[np.isfinite(r)]
        if len(seen) < self.least:
            raise ValueError(f"only {len(seen)} of {len(r)} rows have a return that can be read")
        found = filters.RegimeFilter(estimate_regime(seen))
        for v in r:
            found.observe(v)
        return {"filter": found}

    @property
    def filter(self) -> filters.RegimeFilter:
        self._needed()
        return self.held["filter"]

    def _absorb(self, row: Mapping) -> None:
        self.filter.observe(row["r"])

    def _answer(self, row: Mapping) -> Answer:
        f = self.filter
        parts, epistemic = f.predictive(self.horizon)
        aleatoric, state, _ = f.split(self.horizon)
        figures = dict(zip(("bullish", "bearish", "neutral"), f.belief.tolist(), strict=True))
        held = f.parameters.persistence
        figures |= {"persistence": held, "expected_duration": 1 / max(1 - held, 1e-12), "state_share": state / (aleatoric + epistemic)}
        return Answer(parts, epistemic, figures)

    def most_likely(self) -> str:
        return ("bullish", "bearish", "neutral")[int(np.argmax(self.filter.belief))]

    def _doubt(self) -> float:
        """Entropy of the belief, as a share of the most there can be."""
        b = self.filter.belief
        return float(-(b[b > 0] * np.log(b[b > 0])).sum() / np.log(len(b)))

    def _dump(self) -> dict:
        return {"filter": self.filter.dump()}

    def _load(self, parameters: Mapping) -> dict:
        return {"filter": filters.RegimeFilter.load(parameters["filter"])}


class Ensemble:
    """The three models that a replay and a session ask together."""

    names = ("momentum", "volatility", "regime")

    def __init__(self, feature: str, horizon: int, least: int | None = None):
        self.models: dict[str, Model] = {
            "momentum": ReturnModel([feature], horizon, least=least),
            "volatility": VolatilityModel(horizon, scale=None, least=least),
            "regime": RegimeModel(horizon, least=least),
        }

    @property
    def ready(self) -> bool:
        return all(m.fitted for m in self.models.values())

    def fit(self, rows: pd.DataFrame) -> None:
        """The filters read every return; the regression learns from rows whose outcome is finite."""
        known = rows[np.isfinite(rows.forward_log_return)]
        for name, m in self.models.items():
            m.fit(known if name == "momentum" else rows)

    def update(self, row: Mapping) -> None:
        for m in self.models.values():
            m.update(row)

    def predict(self, row: Mapping) -> dict[str, tuple[Parts, float]]:
        answers = {name: m.predict(row) for name, m in self.models.items()}
        return {name: (a.mixture, a.epistemic_variance) for name, a in answers.items()}

    def dump(self) -> dict | None:
        return {name: m.parameters() for name, m in self.models.items()} if self.ready else None

    def restore(self, held: Mapping | None) -> None:
        for name, parameters in (held or {}).items():
            self.models[name].restore(parameters)


def log_score(outcome: float, parts: Parts) -> float:
    return float(special.mixture_logpdf(outcome, tuple(np.array(v, float) for v in zip(*parts, strict=True))))
