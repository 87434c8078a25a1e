"""Sequential kernels: pure folds (state, row) -> (state, readout), shared by batch and stream."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidebook.functions.special import beta_inc, digamma, gamma_inc, lgamma, t_logpdf, trigamma

DISCOUNTS = (0.9, 0.95, 0.975, 0.99, 1.0)
FORGETTING, LOG_FLOOR = 0.98, -46.0
LEAST_RATE = 1e-18
RELIABILITY_FORGETTING = 0.99


def _softmax(logs: np.ndarray) -> np.ndarray:
    w = np.exp(logs - logs.max())
    return w / w.sum()


def reweight(logs: np.ndarray, gain: np.ndarray, forgetting: float) -> np.ndarray:
    """Discounts log weights, adds the gain, normalises, floors and normalises again."""
    moved = forgetting * logs + gain
    moved = moved - moved.max()
    moved = moved - np.log(np.exp(moved).sum())
    moved = np.maximum(moved, LOG_FLOOR)
    return moved - np.log(np.exp(moved).sum())


@dataclass
class VarianceFilter:
    """A grid of discounted inverse-gamma filters over the variance of returns about `mu`."""

    mu: float = 0.0
    a0: float = 2.0
    b0: float = 4e-4
    s: np.ndarray = field(default_factory=lambda: np.zeros(len(DISCOUNTS)))
    q: np.ndarray = field(default_factory=lambda: np.zeros(len(DISCOUNTS)))
    logs: np.ndarray = field(default_factory=lambda: np.full(len(DISCOUNTS), -np.log(len(DISCOUNTS))))
    n_seen: int = 0
    n_skipped: int = 0

    def posterior(self, evolved: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Shapes and rates of the grid, as of now or one step on."""
        d = np.array(DISCOUNTS) if evolved else 1.0
        return self.a0 + d * self.s / 2, np.maximum(self.b0 + d * self.q / 2, LEAST_RATE)

    def observe(self, value: float | None, weight: float = 1.0) -> VarianceFilter:
        """Absorbs one return; a missing one only ages the evidence."""
        d = np.array(DISCOUNTS)
        if value is None or not np.isfinite(value):
            self.s, self.q = d * self.s, d * self.q
            self.logs = reweight(self.logs, np.zeros(len(d)), FORGETTING)
            self.n_skipped += 1
            return self
        z = (value - self.mu) ** 2
        a, b = self.posterior(evolved=True)
        gain = a * np.log(b) + lgamma(a + weight / 2) - lgamma(a) - (a + weight / 2) * np.log(b + weight * z / 2)
        self.logs = reweight(self.logs, gain, FORGETTING)
        self.s, self.q = d * self.s + weight, d * self.q + weight * z
        self.n_seen += 1
        return self

    @property
    def weights(self) -> np.ndarray:
        return _softmax(self.logs)

    def noise_variance(self) -> float:
        a, b = self.posterior()
        return float((self.weights * b / (a - 1)).sum())

    def expected_log_volatility(self) -> float:
        a, b = self.posterior()
        return float((self.weights * 0.5 * (np.log(b) - digamma(a))).sum())

    def uncertainty(self) -> float:
        """Standard deviation of log volatility, within and between the grid."""
        a, b = self.posterior()
        each = 0.5 * (np.log(b) - digamma(a))
        centre = (self.weights * each).sum()
        return float(np.sqrt((self.weights * (trigamma(a) / 4 + (each - centre) ** 2)).sum()))

    def effective_n(self) -> float:
        return float((self.weights * self.s).sum())

    def expected_discount(self) -> float:
        return float((self.weights * np.array(DISCOUNTS)).sum())

    def entropy(self) -> float:
        w = self.weights
        return float(-(w * np.log(w)).sum())

    def predictive(self, horizon: int = 1) -> tuple[list[tuple[float, float, float, float]], float]:
        """Student-t mixture of the return over `horizon` bars, and its epistemic variance."""
        a, b = self.posterior(evolved=True)
        parts = [
            (float(w), horizon * self.mu, float(np.sqrt(horizon * bb / aa)), float(2 * aa))
            for w, aa, bb in zip(self.weights, a, b, strict=True)
        ]
        return parts, float((self.weights * horizon * b / (a * (a - 1))).sum())

    def plugin_variance(self, horizon: int = 1) -> float:
        """The part of the predictive variance that would stay if the variance were known."""
        a, b = self.posterior(evolved=True)
        return float((self.weights * horizon * b / a).sum())

    def predictive_df(self) -> float:
        return float((self.weights * 2 * self.posterior(evolved=True)[0]).sum())

    def expected_volatility(self) -> float:
        a, b = self.posterior()
        return float((self.weights * np.sqrt(b) * np.exp(lgamma(a - 0.5) - lgamma(a))).sum())

    def disagreement(self) -> float:
        """Spread of the grid's log volatilities about their mean."""
        a, b = self.posterior()
        each = 0.5 * (np.log(b) - digamma(a))
        return float(np.sqrt((self.weights * (each - (self.weights * each).sum()) ** 2).sum()))

    def variance_cdf(self, v: float) -> float:
        """P(variance of a bar <= v): a mixture of inverse gammas."""
        a, b = self.posterior()
        return float((self.weights * (1 - gamma_inc(a, b / v))).sum()) if v > 0 else 0.0

    def realised_cdf(self, v: float, horizon: int = 1) -> float:
        """P(sum of squared deviations over the next `horizon` bars <= v): a mixture of 2 b BetaPrime(horizon / 2, a)."""
        a, b = self.posterior(evolved=True)
        return float((self.weights * beta_inc(np.full_like(a, horizon / 2), a, v / (v + 2 * b))).sum()) if v > 0 else 0.0

    def realised_mean(self, horizon: int = 1) -> float:
        a, b = self.posterior(evolved=True)
        return float((self.weights * horizon * b / (a - 1)).sum())

    def volatility_interval(self, level: float = 0.9) -> tuple[float, float]:
        """Central interval of the volatility of a bar: roots of quantiles of its variance."""
        if not 0 < level < 1:
            raise ValueError("a level lies between 0 and 1")
        return tuple(float(np.sqrt(_positive_quantile(self.variance_cdf, p, self.noise_variance()))) for p in ((1 - level) / 2, (1 + level) / 2))

    def dump(self) -> list:
        return [self.mu, self.a0, self.b0, self.s.tolist(), self.q.tolist(), self.logs.tolist(), self.n_seen, self.n_skipped]

    @classmethod
    def load(cls, held: list) -> VarianceFilter:
        mu, a0, b0, s, q, logs, n_seen, n_skipped = held
        return cls(mu, a0, b0, np.array(s), np.array(q), np.array(logs), n_seen, n_skipped)


def _positive_quantile(cdf, p: float, near: float) -> float:
    """Where a distribution function on the positive numbers reaches p, by bisection of the logarithm."""
    low = high = np.log(near)
    while cdf(np.exp(low)) > p:
        low -= 1
    while cdf(np.exp(high)) < p:
        high += 1
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(np.exp(mid)) < p else (low, mid)
    return float(np.exp((low + high) / 2))


STATIONARY = (0.35, 0.25, 0.4)
_DRIFTS, _VARIANCES = (1.0, -1.0, 0.0), (-0.5, 1.5, 0.0)
REGIME_BLOCK, REGIME_FAR_LAG, VARIANCE_FLOOR = 21, 20, 0.15


def _standard(values: tuple[float, ...]) -> np.ndarray:
    """Mean zero and variance one under the stationary weights."""
    pi, v = np.array(STATIONARY), np.array(values)
    v = v - (pi * v).sum()
    return v / np.sqrt((pi * v * v).sum())


DRIFT_SHAPE, VARIANCE_SHAPE = _standard(_DRIFTS), _standard(_VARIANCES)


@dataclass
class RegimeParameters:
    """Scalars of a three-state chain and what they imply for each state."""

    centre: float
    drift_spread: float
    persistence: float
    mean_variance: float
    dispersion: float
    n_rows: int
    prior_shape: float = 2.0

    def __post_init__(self) -> None:
        pi = np.array(STATIONARY)
        widest = (1 - VARIANCE_FLOOR) / max(1e-12, -VARIANCE_SHAPE.min())
        self.dispersion = min(self.dispersion, widest)
        self.drifts = self.centre + self.drift_spread * DRIFT_SHAPE
        self.variances = self.mean_variance * (1 + self.dispersion * VARIANCE_SHAPE)
        self.concentrations = pi * self.n_rows + 1
        self.shapes = self.prior_shape + pi * self.n_rows / 2

    def emission(self, horizon: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """loc, scale and df of each state's Student-t over `horizon` bars."""
        scale = np.sqrt(self.variances * (self.shapes - 1) / self.shapes * (horizon + horizon**2 / self.concentrations))
        return horizon * self.drifts, scale, 2 * self.shapes


@dataclass
class RegimeFilter:
    """The forward recursion over regimes."""

    parameters: RegimeParameters
    belief: np.ndarray = field(default_factory=lambda: np.array(STATIONARY))
    log_likelihood: float = 0.0
    n_seen: int = 0
    n_skipped: int = 0

    def _moved(self) -> np.ndarray:
        held = self.parameters.persistence
        return held * self.belief + (1 - held) * np.array(STATIONARY) * self.belief.sum()

    def observe(self, value: float | None) -> RegimeFilter:
        moved = self._moved()
        if value is None or not np.isfinite(value):
            self.belief = moved
            self.n_skipped += 1
            return self
        density = t_logpdf(value, *self.parameters.emission())
        top = density.max()
        if not np.isfinite(top):
            raise ValueError(f"no regime can account for a return of {value}")
        joint = moved * np.exp(density - top)
        total = joint.sum()
        if not total > 0:
            raise ValueError(f"no regime can account for a return of {value}")
        self.belief = joint / total
        self.log_likelihood += float(np.log(total) + top)
        self.n_seen += 1
        return self

    def dump(self) -> list:
        p = self.parameters
        scalars = [p.centre, p.drift_spread, p.persistence, p.mean_variance, p.dispersion, p.n_rows, p.prior_shape]
        return [scalars, self.belief.tolist(), self.log_likelihood, self.n_seen, self.n_skipped]

    @classmethod
    def load(cls, held: list) -> RegimeFilter:
        scalars, belief, *rest = held
        return cls(RegimeParameters(*scalars), np.array(belief), *rest)

    def horizon_weights(self, horizon: int = 1) -> np.ndarray:
        held = self.parameters.persistence**horizon
        return held * self.belief + (1 - held) * np.array(STATIONARY)

    def split(self, horizon: int = 1) -> tuple[float, float, float]:
        """Predictive variance as aleatoric, state and parameter parts."""
        p, pi = self.parameters, np.array(STATIONARY)
        held = p.persistence**horizon
        step = held * np.eye(3) + (1 - held) * pi[None, :]
        means, noise = horizon * p.drifts, horizon * p.variances
        conditional = step @ means
        centre = self.belief @ conditional
        aleatoric = self.belief @ (step * (noise[None, :] + (means[None, :] - conditional[:, None]) ** 2)).sum(1)
        state = self.belief @ (conditional - centre) ** 2
        parameter = (self.horizon_weights(horizon) * p.variances * horizon**2 / p.concentrations).sum()
        return float(aleatoric), float(state), float(parameter)

    def predictive(self, horizon: int = 1) -> tuple[list[tuple[float, float, float, float]], float]:
        loc, scale, df = self.parameters.emission(horizon)
        _, state, parameter = self.split(horizon)
        weights = self.horizon_weights(horizon)
        return [tuple(map(float, c)) for c in zip(weights, loc, scale, df, strict=True)], state + parameter


@dataclass
class Reliability:
    """Discounted log scores of named models, and the weights that follow."""

    logs: dict[str, float] = field(default_factory=dict)
    scored: dict[str, tuple[float, int]] = field(default_factory=dict)

    def score(self, logpdfs: dict[str, float]) -> Reliability:
        if any(np.isnan(v) for v in logpdfs.values()):
            raise ValueError("a log score must not be NaN")
        if logpdfs and all(v == -np.inf for v in logpdfs.values()):
            raise ValueError("no model can account for the outcome")
        names = sorted({*self.logs, *logpdfs})
        logs = np.array([self.logs.get(n, 0.0) for n in names])
        gain = np.array([logpdfs.get(n, 0.0) for n in names])
        moved = RELIABILITY_FORGETTING * logs + gain
        moved = moved - moved.max()
        moved = moved - np.log(np.exp(moved).sum())
        moved = np.maximum(moved, LOG_FLOOR)
        moved = moved - np.log(np.exp(moved).sum())
        self.logs = dict(zip(names, moved.tolist(), strict=True))
        for n, v in logpdfs.items():
            total, k = self.scored.get(n, (0.0, 0))
            self.scored[n] = (total + v, k + 1)
        return self

    def weights(self) -> dict[str, float]:
        if not self.logs:
            return {}
        w = _softmax(np.array(list(self.logs.values())))
        return dict(zip(self.logs, w.tolist(), strict=True))


@dataclass
class Book:
    """Cash and positions under a sequence of fills."""

    cash: float
    positions: dict[str, tuple[float, float]] = field(default_factory=dict)

    def apply(self, symbol: str, side: str, quantity: float, price: float, fees: float) -> Book:
        """Averages on the way in only; crossing zero starts anew at the fill's price."""
        delta = quantity if side == "buy" else -quantity
        self.cash -= delta * price + fees
        held, average = self.positions.get(symbol, (0.0, 0.0))
        after = held + delta
        if abs(after) < 1e-9:
            self.positions.pop(symbol, None)
        elif held == 0 or (after > 0) != (held > 0):
            self.positions[symbol] = (after, price)
        elif abs(after) > abs(held):
            self.positions[symbol] = (after, (held * average + delta * price) / after)
        else:
            self.positions[symbol] = (after, average)
        return self
