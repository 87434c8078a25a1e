"""Limits and settings: validated values that become literals of a plan."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


class Secret:
    """A string that does not show itself."""

    def __init__(self, value: str):
        self._value = value

    def reveal(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "Secret(****)"

    __str__ = __repr__


@dataclass(frozen=True)
class RiskLimits:
    version: str = "0.1.0"
    max_position_weight: float = 0.05
    max_sector_exposure: float = 0.25
    max_portfolio_exposure: float = 0.6
    max_open_positions: int = 10
    max_daily_loss: float = 0.02
    max_drawdown: float = 0.15
    risk_budget_per_trade: float = 0.005
    stop_loss_atr_multiple: float = 2.5
    min_probability_positive: float = 0.6
    max_probability_large_loss: float = 0.15
    large_loss_threshold: float = 0.05
    min_confidence: float = 0.55
    max_model_uncertainty: float = 0.6
    min_daily_turnover: float = 5.0e7
    max_participation_rate: float = 0.02
    max_annualised_volatility: float = 0.6

    def __post_init__(self) -> None:
        if not self.max_position_weight <= self.max_sector_exposure <= self.max_portfolio_exposure:
            raise ValueError("position, sector and portfolio ceilings must not fall")
        if not self.risk_budget_per_trade <= self.max_daily_loss <= self.max_drawdown:
            raise ValueError("trade budget, daily loss and drawdown must not fall")
        if not 0.5 < self.min_probability_positive < 1:
            raise ValueError("min_probability_positive must lie between 0.5 and 1")
        if self.max_open_positions < 1:
            raise ValueError("max_open_positions must be at least 1")

    @property
    def max_concurrent_position_weight(self) -> float:
        return min(1.0, self.max_position_weight * self.max_open_positions)

    @property
    def is_position_cap_binding(self) -> bool:
        return self.max_concurrent_position_weight >= self.max_portfolio_exposure

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "TIDEBOOK_LIMITS__") -> RiskLimits:
        """Every limit by name; what does not parse is an error."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            if (text := env.get(prefix + f.name.upper())) is not None:
                kind = type(getattr(cls(), f.name))
                try:
                    found[f.name] = kind(text)
                except ValueError as e:
                    raise ValueError(f"{prefix}{f.name.upper()} is not a valid {kind.__name__}: {text!r}") from e
        return replace(cls(), **found)


@dataclass(frozen=True)
class Settings:
    """Mode and costs; live trading needs both its mode and its confirmation."""

    mode: str = "paper"
    confirm_live: bool = False
    commission_rate: float = 3e-4
    slippage_rate: float = 5e-4
    api_key: Secret | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("backtest", "paper", "live"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode == "live" and not self.confirm_live:
            raise ValueError("live mode must be confirmed")

    @property
    def is_live(self) -> bool:
        return self.mode == "live" and self.confirm_live

    @property
    def total_cost_bps(self) -> float:
        return 1e4 * (self.commission_rate + self.slippage_rate)

    @property
    def round_trip_cost(self) -> float:
        return 2 * (self.commission_rate + self.slippage_rate)

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, prefix: str = "TIDEBOOK__") -> Settings:
        env = os.environ if env is None else env
        found: dict = {}
        for name, read in (
            ("mode", str),
            ("confirm_live", _boolean),
            ("commission_rate", float),
            ("slippage_rate", float),
            ("api_key", Secret),
        ):
            if (text := env.get(prefix + name.upper())) is not None:
                try:
                    found[name] = read(text)
                except ValueError as e:
                    raise ValueError(f"{prefix}{name.upper()} is not valid: {e}") from e
        return cls(**found)

    def describe(self) -> str:
        return "\n".join(f"{f.name}: {getattr(self, f.name)}" for f in fields(self))

    def doctor(self) -> list[str]:
        """What would keep a session from starting, in words."""
        problems = []
        if self.is_live and self.api_key is None:
            problems.append("live mode has no api_key")
        if self.commission_rate < 0 or self.slippage_rate < 0:
            problems.append("costs must not be negative")
        return problems


def _boolean(text: str) -> bool:
    if text.lower() in ("1", "true", "yes"):
        return True
    if text.lower() in ("0", "false", "no"):
        return False
    raise ValueError(f"{text!r} is neither true nor false")
