"""Reports in text, from small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.health import SessionState, checks, may_open_positions

MOST_LINES = 200


def _table(df: DataFrame, order: list[str]) -> list[str]:
    """At most MOST_LINES rows in order, and how many more there are."""
    total = df.count()
    rows = df.orderBy(*order).limit(MOST_LINES).collect()
    lines = ["  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows]
    return [*lines, f"  ... {total - len(rows)} more"] if total > len(rows) else lines


def reconciliation_report(status: str, discrepancies: DataFrame) -> str:
    return "\n".join([f"reconciliation: {status}", *_table(discrepancies, ["kind", "symbol"])])


def rebuild_report(consistent: bool, problems: list[str], cash: DataFrame, positions: DataFrame) -> str:
    """Verdict, problems, cash after all fills and the positions left."""
    total = cash.agg(F.sum("cash_moved").alias("moved"), F.max("opening_cash").alias("opening")).first()
    money = "unknown" if total.opening is None else f"{total.opening + (total.moved or 0.0):.2f}"
    head = [f"rebuild: {'consistent' if consistent else 'inconsistent'}", *[f"  {p}" for p in problems], f"cash: {money}"]
    return "\n".join([*head, "positions:", *_table(positions, ["symbol"])])


def session_report(events: DataFrame, state: SessionState) -> str:
    """Counts of events, the checks, and whether positions may be opened."""
    counts = events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    health = [f"  {c.name}: {c.status} ({c.detail})" for c in checks(state)]
    verdict = "may open positions" if may_open_positions(state) else "must not open positions"
    return "\n".join(["events:", *_table(counts, ["event"]), "health:", *health, verdict])
