"""Scalar forms of decision, review and execution for folds; the column forms are in operators/trading.py."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from tidebook.config import RiskLimits
from tidebook.functions import special
from tidebook.functions.filters import Book

Parts = list[tuple[float, float, float, float]]


def moments(parts: Parts) -> tuple[float, float, float]:
    """Mean, variance and spread of the component means of a mixture; components of no weight are left out."""
    used = np.array([p for p in parts if p[0] > 0], float)
    w, loc, scale, df = used.T
    w = w / w.sum()
    mean = float(w @ loc)
    each = np.where(df > 2, scale**2 * df / np.maximum(df - 2, 1e-12), np.inf)
    between = float(w @ (loc - mean) ** 2)
    return mean, float(w @ each) + between, between


def pool(answers: dict[str, tuple[Parts, float]], weights: dict[str, float]) -> tuple[Parts, float, float]:
    """The pooled mixture, its epistemic variance and the disagreement in it."""
    parts: Parts = []
    means, within = [], 0.0
    for name, (own, epistemic) in answers.items():
        total = sum(c[0] for c in own)
        parts += [(weights[name] * c[0] / total, *c[1:]) for c in own]
        means.append((weights[name], moments(own)[0]))
        within += weights[name] * epistemic
    centre = sum(w * m for w, m in means)
    between = sum(w * (m - centre) ** 2 for w, m in means)
    return parts, within + between, between


def decide(parts: Parts, epistemic: float, limits: RiskLimits, floor: float, tail: float) -> tuple[str, str | None, float]:
    """Action, reason and target weight; quantiles are computed only where a trade comes of it."""
    m = tuple(np.array(v, float) for v in zip(*parts, strict=True))
    below = lambda x: float(special.mixture_cdf(x, m))
    variance = moments(parts)[1]
    share = epistemic / variance if math.isfinite(variance) and variance > 0 else math.nan
    if not math.isfinite(variance) or variance <= 0 or not math.isfinite(share) or share > limits.max_model_uncertainty:
        return "no_trade", "uncertainty_too_high", 0.0
    if 1 - share < limits.min_confidence:
        return "no_trade", "model_disagreement", 0.0
    rise = 1 - below(0.0)
    buy, sell = rise >= limits.min_probability_positive, rise <= 1 - limits.min_probability_positive
    if not buy and not sell:
        return "no_trade", "edge_too_small", 0.0
    loss = below(-limits.large_loss_threshold) if buy else 1 - below(limits.large_loss_threshold)
    if loss > limits.max_probability_large_loss:
        return "no_trade", "loss_probability_too_high", 0.0
    q = float(special.mixture_quantile(np.array(tail if buy else 1 - tail), m))
    downside = max(-q if buy else q, 0.0, floor)
    return "buy" if buy else "sell", None, min(limits.risk_budget_per_trade / downside, limits.max_position_weight)


@dataclass
class Account:
    """Cash, one position and the equity figures that limits are measured against."""

    cash: float
    quantity: float = 0.0
    average: float = 0.0
    last: float | None = None
    peak: float = field(default=-math.inf)
    worst: float = 0.0
    day: str | None = None
    day_start: float = 0.0
    n_orders: int = 0

    @property
    def equity(self) -> float:
        return self.cash + (self.quantity * self.last if self.quantity else 0.0)

    @property
    def drawdown(self) -> float:
        return (self.peak - self.equity) / self.peak

    def roll(self, day: str) -> None:
        """Notices that the day changed; its limit is measured from the equity it opened at."""
        if day != self.day:
            self.day, self.day_start = day, self.equity

    def mark(self, price: float | None) -> None:
        self.last = self.last if price is None else price
        self.peak = max(self.peak, self.equity)
        self.worst = max(self.worst, self.drawdown)

    def review(self, action: str, target: float, volatility: float, turnover: float | None, limits: RiskLimits) -> tuple[float, list[str]]:
        """Approved weight and the names of the checks that failed."""
        if action not in ("buy", "sell") or target <= 0:
            return 0.0, []
        held = self.quantity
        exposure = abs(held * self.last) / self.equity if held else 0.0
        gates = (
            ("daily_loss", (self.day_start - self.equity) / self.day_start, limits.max_daily_loss),
            ("drawdown", self.drawdown, limits.max_drawdown),
            ("open_positions", 0 if held else 1, limits.max_open_positions),
            ("volatility", volatility, limits.max_annualised_volatility),
        )
        failed = [name for name, seen, allowed in gates if not seen <= allowed]
        if turnover is not None and not turnover >= limits.min_daily_turnover:
            failed.append("liquidity")
        if failed:
            return 0.0, failed
        reducing = (action == "sell" and held > 0) or (action == "buy" and held < 0)
        allowed = target
        # one symbol is its sector and its book
        for name, cap in (
            ("position_weight", limits.max_position_weight),
            ("sector_exposure", limits.max_sector_exposure),
            ("portfolio_exposure", limits.max_portfolio_exposure),
        ):
            room = max(0.0, cap - exposure) + (2 * exposure if reducing else 0.0)
            if room <= 0:
                failed.append(name)
            allowed = min(allowed, room)
        return (0.0, failed) if failed else (max(0.0, allowed), [])

    def fill(
        self, symbol: str, side: str, quantity: float, price: float, volume: float | None, commission: float, slippage: float, share: float
    ) -> tuple[float, float, float] | None:
        """Quantity, price and fees of a market order, booked; None where it is rejected."""
        worse = price * (1 + slippage) if side == "buy" else price * (1 - slippage)
        done = quantity if volume is None or volume <= 0 else min(quantity, share * volume)
        fees = done * worse * commission
        if done <= 0 or (side == "buy" and done * worse + fees > self.cash):
            return None
        book = Book(self.cash, {symbol: (self.quantity, self.average)} if self.quantity else {})
        book.apply(symbol, side, done, worse, fees)
        self.cash = book.cash
        self.quantity, self.average = book.positions.get(symbol, (0.0, 0.0))
        return done, worse, fees
