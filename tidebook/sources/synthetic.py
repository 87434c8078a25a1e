"""Simulated series with known truth: four return processes and bars around them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidebook.functions.filters import STATIONARY
from tidebook.operators.provenance import stable_hash
from tidebook.runtime import ship_package

YEAR = 252
SCHEMA = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, interval string"
PROCESSES = ("gaussian", "autoregressive", "regime", "stochastic_volatility")


@dataclass(frozen=True)
class Process:
    """One law of daily log returns and its parameters; yearly drift and volatility, as numbers of a year of 252 days."""

    kind: str = "gaussian"
    drift: float = 0.05
    volatility: float = 0.2
    phi: float = 0.35
    persistence: float = 1 - 1 / 25
    state_drifts: tuple[float, ...] = (0.1, -0.2, 0.0)
    state_volatilities: tuple[float, ...] = (0.7, 1.6, 0.9)
    reversion: float = 0.97
    volatility_of_volatility: float = 0.15

    def __post_init__(self) -> None:
        if self.kind not in PROCESSES:
            raise ValueError(f"unknown process {self.kind!r}")
        if self.volatility <= 0 or not -1 < self.phi < 1 or not 0 <= self.persistence < 1 or not -1 < self.reversion < 1:
            raise ValueError("volatility must be positive, phi and reversion within one, persistence below one")

    def path(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Returns, and the truth behind them: each bar's mean, state or volatility, by the kind."""
        mu, sigma = self.drift / YEAR, self.volatility / np.sqrt(YEAR)
        z = rng.standard_normal(n)
        if self.kind == "gaussian":
            return mu + sigma * z, np.full(n, mu)
        if self.kind == "autoregressive":
            levels, level = np.empty(n), sigma * rng.standard_normal()
            for k in range(n):  # innovations scaled so that the stationary volatility is sigma
                levels[k] = level = self.phi * level + sigma * np.sqrt(1 - self.phi**2) * z[k]
            return mu + levels, mu + self.phi * np.concatenate(([0.0], levels[:-1]))
        if self.kind == "regime":
            pi = np.array(STATIONARY)
            drawn, moves = rng.choice(len(pi), n, p=pi), rng.random(n) > self.persistence
            moves[0] = True
            states = drawn[np.maximum.accumulate(np.where(moves, np.arange(n), 0))]
            return mu + sigma * np.array(self.state_drifts)[states] + sigma * np.array(self.state_volatilities)[states] * z, states
        logs = np.empty(n)
        level = self.volatility_of_volatility / np.sqrt(1 - self.reversion**2) * rng.standard_normal()
        for k in range(n):
            logs[k] = level = self.reversion * level + self.volatility_of_volatility * rng.standard_normal()
        return mu + sigma * np.exp(logs) * z, sigma * np.exp(logs)


def returns(process: str, n: int, rng: np.random.Generator, **parameters: float) -> np.ndarray:
    """Daily log returns of one series."""
    return Process(process, **parameters).path(n, rng)[0]


def weekdays(start: datetime, n: int) -> pd.DatetimeIndex:
    return pd.bdate_range(start, periods=n)


#: Steps of the bridge within a bar, and how volume answers to the size of the move.
BRIDGE_STEPS, VOLUME_BETA = 26, 10.0


def bars_of(
    symbol: str, r: np.ndarray, rng: np.random.Generator, start: datetime, price: float = 100.0, gap: float = 0.25, volume_beta: float = VOLUME_BETA
) -> pd.DataFrame:
    """Daily bars around closes: a gap at the open, extremes of a Brownian bridge from open to close, volume that rises with the move."""
    close = np.round(price * np.exp(np.cumsum(r)), 2).clip(0.01)
    before = np.concatenate(([price], close[:-1]))
    open_ = np.round(before * np.exp(gap * r), 2).clip(0.01)
    scale = float(np.std(r)) * np.sqrt(1 - gap) if len(r) > 1 else 0.01
    walk = np.cumsum(rng.standard_normal((len(r), BRIDGE_STEPS)), axis=1) * scale / np.sqrt(BRIDGE_STEPS)
    along = np.arange(1, BRIDGE_STEPS + 1) / BRIDGE_STEPS
    bridge = np.log(open_)[:, None] + walk - along * (walk[:, -1:] - np.log(close / open_)[:, None])
    high, low = np.round(np.exp(bridge.max(1)), 2), np.round(np.exp(bridge.min(1)), 2).clip(0.01)
    volume = np.round(np.exp(13 + 0.4 * rng.standard_normal(len(r)) + volume_beta * np.abs(r)))
    return pd.DataFrame(
        {
            "symbol": symbol, "timestamp": weekdays(start, len(r)), "open": open_, "high": np.maximum(high, np.maximum(open_, close)),
            "low": np.minimum(low, np.minimum(open_, close)), "close": close, "volume": volume, "interval": "1d",
        }
    )


def simulate(
    symbols: DataFrame, n: int, process: str | Process = "gaussian", seed: int = 1, start: datetime = datetime(2020, 1, 1, 10), truth: bool = False
) -> DataFrame:
    """`n` bars for each row of column symbol; a symbol's stream depends on the seed and its name alone.

    With `truth` a column true_value tells the mean, state or volatility behind each bar.
    """
    law = Process(process) if isinstance(process, str) else process
    ship_package()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        symbol = pdf.symbol.iloc[0]
        rng = np.random.default_rng(int(stable_hash({"seed": seed, "symbol": symbol})[:8], 16))
        r, behind = law.path(n, rng)
        bars = bars_of(symbol, r, rng, start)
        return bars.assign(true_value=behind.astype(float)) if truth else bars

    schema = SCHEMA + ", true_value double" if truth else SCHEMA
    return symbols.select("symbol").distinct().groupBy("symbol").applyInPandas(run, schema)
