"""Whether a session may open positions: named checks that fail closed."""

from __future__ import annotations

from dataclasses import dataclass

PASS, FAIL = "pass", "fail"


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    detail: str


@dataclass(frozen=True)
class SessionState:
    """What is known of a session; None stands for not known, which never passes."""

    rebuild_consistent: bool | None = None
    reconciliation: str | None = None
    feed_age_seconds: float | None = None
    max_silence_seconds: float = 60.0
    models_fitted: bool | None = None
    models_healthy: bool | None = None
    equity: float | None = None
    drawdown: float | None = None
    max_drawdown: float = 0.15
    day_opened: bool | None = None
    journal_writes: bool | None = None
    pending: int | None = None
    horizon: int = 5


def checks(s: SessionState) -> list[Check]:
    """All checks, whether or not an earlier one fails."""
    known = lambda x: x is not None and x == x  # noqa: E731  neither None nor NaN
    verdicts = [
        ("rebuild", s.rebuild_consistent is True, f"rebuild consistent: {s.rebuild_consistent}"),
        ("reconciliation", s.reconciliation == "matched", f"books: {s.reconciliation}"),
        ("feed", known(s.feed_age_seconds) and 0 <= s.feed_age_seconds <= s.max_silence_seconds, f"last tick {s.feed_age_seconds} s ago"),
        ("models", s.models_fitted is True, f"models fitted: {s.models_fitted}"),
        ("model_state", s.models_healthy is True, f"models healthy: {s.models_healthy}"),
        ("account", known(s.equity) and s.equity > 0 and known(s.drawdown) and s.drawdown <= s.max_drawdown, f"equity {s.equity}, drawdown {s.drawdown}"),
        ("trading_day", s.day_opened is True, f"day opened: {s.day_opened}"),
        ("journal", s.journal_writes is True, f"journal writes: {s.journal_writes}"),
        ("settlement", known(s.pending) and s.pending <= 10 * s.horizon, f"{s.pending} predictions pending"),
    ]
    return [Check(name, PASS if ok else FAIL, detail) for name, ok, detail in verdicts]


def may_open_positions(s: SessionState) -> bool:
    return all(c.status == PASS for c in checks(s))
