"""Reconciliation, account rebuilds and journals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.market import unrealised_pnl
from tidebook.operators import scans

QUANTITY_TOLERANCE, PRICE_TOLERANCE, MAX_AGE_SECONDS = 0.0, 1e-4, 300
MAX_TORN, EQUITY_TOLERANCE = 1, 0.01


def reconcile_positions(local: DataFrame, venue: DataFrame, quantity: float = QUANTITY_TOLERANCE, price: float = PRICE_TOLERANCE) -> DataFrame:
    """Discrepancies (kind, symbol, local, venue) of positions (symbol, quantity, average_price) by a full outer join."""
    a = local.select("symbol", F.col("quantity").alias("lq"), F.col("average_price").alias("lp"))
    b = venue.select("symbol", F.col("quantity").alias("vq"), F.col("average_price").alias("vp"))
    lq, vq, lp, vp = map(F.col, ("lq", "vq", "lp", "vp"))
    reference = F.greatest(F.abs(lp), F.abs(vp))
    found = F.array_compact(
        F.array(
            F.when(lq.isNull() & (vq != 0), _issue("unexpected_position", lq, vq)),
            F.when(vq.isNull(), _issue("missing_position", lq, vq)),
            F.when(F.abs(lq - vq) > quantity, _issue("quantity_mismatch", lq, vq)),
            F.when((lq != 0) & (vq != 0) & (reference > 0) & (F.abs(lp - vp) / reference > price), _issue("average_price_mismatch", lp, vp)),
        )
    )
    return a.join(b, "symbol", "full").select("symbol", F.inline(found))


def _issue(kind: str, local, venue):
    return F.struct(F.lit(kind).alias("kind"), local.cast("double").alias("local"), venue.cast("double").alias("venue"))


def reconcile_orders(local: DataFrame, venue: DataFrame) -> DataFrame:
    """Discrepancies (kind, id, local, venue) of live orders (id, side, quantity)."""
    a = local.select("id", F.col("side").alias("ls"), F.col("quantity").alias("lq"))
    b = venue.select("id", F.col("side").alias("vs"), F.col("quantity").alias("vq"))
    lq, vq = F.col("lq"), F.col("vq")
    kind = (
        F.when(lq.isNull(), "unexpected_order").when(vq.isNull(), "missing_order").when((lq != vq) | (F.col("ls") != F.col("vs")), "order_mismatch")
    )
    return a.join(b, "id", "full").withColumn("kind", kind).where("kind IS NOT NULL").select("id", "kind", lq.cast("double").alias("local"), vq.cast("double").alias("venue"))


def reconciliation_status(n_discrepancies: int, age_seconds: float | None, available: bool = True) -> str:
    """matched, mismatched or unavailable; a snapshot from the future or older than allowed never matches."""
    if not available:
        return "unavailable"
    stale = age_seconds is None or age_seconds < 0 or age_seconds > MAX_AGE_SECONDS
    return "mismatched" if n_discrepancies or stale else "matched"


def journal_state(entries: DataFrame) -> DataFrame:
    """Per symbol of journal lines (with their number as line): entries, last time, last equity, fills, orders, halts.

    Any event moves the last time, as a halt or a refit is handled like a bar. The last
    equity is that of the last bar line in the file.
    """
    bar = F.col("event") == "bar"
    return entries.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("entries"),
        F.max("as_of").alias("last_as_of"),
        F.max_by("equity", F.when(bar & F.col("equity").isNotNull(), F.col("line"))).alias("last_equity"),
        F.count_if(bar & (F.coalesce("filled", F.lit(0.0)) != 0)).alias("fills"),
        F.count_distinct(F.when(bar, F.col("order_id"))).alias("orders"),
        F.count_if(F.col("event") == "halted").alias("halted"),
    )


def after_restart(bars: DataFrame, entries: DataFrame) -> DataFrame:
    """Bars that a restarted session has not handled: later than the last journalled event of their symbol, whatever it is."""
    marks = entries.groupBy("symbol").agg(F.max(F.col("as_of").cast("timestamp_ntz")).alias("_mark"))
    return bars.join(marks, "symbol", "left").where("_mark IS NULL OR timestamp > _mark").drop("_mark")


def rebuilt_cash(entries: DataFrame, opening: float) -> DataFrame:
    """Cash and signed quantities per symbol from the fills of a journal: sums, no order needed."""
    fill = (F.col("event") == "bar") & (F.col("filled") > 0)
    delta = F.when(F.col("action") == "buy", F.col("filled")).otherwise(-F.col("filled"))
    fills = entries.where(fill).withColumn("delta", delta)
    return fills.groupBy("symbol").agg(
        F.sum("delta").alias("quantity"),
        F.sum(-F.col("delta") * F.col("fill_price") - F.col("fees")).alias("cash_moved"),
        F.count_if(F.col("fill_price").isNull()).alias("priceless"),
    ).withColumn("opening_cash", F.lit(float(opening)))


def mark_to_market(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """`positions` (symbol, quantity, average_price, last_price) at the latest quoted price of their symbol, with unrealised_pnl.

    Quotes have symbol, timestamp and last_price. A symbol without a quote keeps its last price.
    """
    latest = quotes.groupBy("symbol").agg(F.max_by("last_price", "timestamp").alias("_quoted"))
    marked = positions.join(latest, "symbol", "left").withColumn("last_price", F.coalesce("_quoted", "last_price")).drop("_quoted")
    return marked.withColumn("unrealised_pnl", unrealised_pnl())


def equity_of(positions: DataFrame, cash: DataFrame, key: str = "account") -> DataFrame:
    """Per account its cash, what its positions are worth, and their sum."""
    worth = positions.groupBy(key).agg(F.sum(F.col("quantity") * F.col("last_price")).alias("worth"))
    joined = cash.join(worth, key, "left").withColumn("worth", F.coalesce("worth", F.lit(0.0)))
    return joined.withColumn("equity", F.col("cash") + F.col("worth"))


def cancel_orders(receipts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Receipts (order_id, status) after cancelling the orders of `wanted` (order_id), with cancelled and note.

    Open orders are cancelled; others stay, and the note says why. Orders that are not known are an error.
    """
    asked = wanted.select("order_id").distinct().withColumn("_asked", F.lit(True))
    joined = receipts.join(asked, "order_id", "full")
    known = F.coalesce("status", F.raise_error(F.concat(F.lit("no order with id "), F.col("order_id"))).cast("string"))
    hit = F.col("_asked").isNotNull() & (F.col("status") == "open")
    note = F.when(hit, "cancelled").when(F.col("_asked").isNotNull(), F.concat(F.lit("cannot cancel an order that is "), F.col("status")))
    return joined.withColumn("status", known).withColumn("note", note).withColumn("cancelled", hit).withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("_asked")


def rebuild_positions(entries: DataFrame) -> DataFrame:
    """Quantity and average price per symbol after all fills in order; averages depend on the path, which is composed over chunks."""
    rows = entries.where("event = 'bar' AND filled > 0 AND fill_price IS NOT NULL").select(
        "symbol",
        "as_of",
        "order_id",
        F.when(F.col("action") == "buy", F.col("filled")).otherwise(-F.col("filled")).alias("delta"),
        F.col("fill_price").alias("price"),
    )
    # a stamp's first ten characters are its day
    return scans.position_scan(rows, ["as_of", "order_id"], F.substring(F.col("as_of").cast("string"), 1, 10))


def rebuilt_equity(entries: DataFrame, opening: float) -> DataFrame:
    """One row: cash and equity rebuilt from a journal's fills and closes, the last equity that it recorded, and their relative gap.

    Positions are marked at the last close of their symbol, or at their average price where
    there is none. Needs line, the place of an entry in the journal.
    """
    bar = entries.where("event = 'bar'")
    closes = bar.where("close IS NOT NULL").groupBy("symbol").agg(F.max_by("close", "line").alias("mark"))
    held = rebuild_positions(entries).join(closes, "symbol", "left")
    worth = held.agg(F.coalesce(F.sum(F.col("quantity") * F.coalesce("mark", "average_price")), F.lit(0.0)).alias("worth"))
    moved = rebuilt_cash(entries, opening).agg(F.coalesce(F.sum("cash_moved"), F.lit(0.0)).alias("moved"))
    recorded = bar.agg(F.max_by("equity", F.when(F.col("equity").isNotNull(), F.col("line"))).alias("recorded"))
    # one row each
    both = moved.crossJoin(worth).crossJoin(recorded).withColumn("cash", opening + F.col("moved"))
    equity = F.col("cash") + F.col("worth")
    gap = F.abs(equity - F.col("recorded")) / F.greatest(F.abs("recorded"), F.lit(1.0))
    return both.select("cash", equity.alias("equity"), "recorded", gap.alias("gap"))


def rebuild_verdict(entries: DataFrame, torn: int, opening: float | None) -> tuple[bool, list[str]]:
    """Whether an account can be rebuilt from a journal, and what stands against it."""
    problems = []
    if torn > MAX_TORN:
        problems.append(f"{torn} torn lines")
    if opening is None:
        problems.append("no opening cash")
    elif "line" in entries.columns:
        found = rebuilt_equity(entries, opening).first()
        if not math.isfinite(found.cash):
            problems.append("the rebuilt cash is not finite")
        elif found.gap is not None and found.gap > EQUITY_TOLERANCE:
            problems.append(f"rebuilt equity {found.equity:.2f} disagrees with the journalled {found.recorded:.2f}")
    priceless = entries.where("event = 'bar' AND filled > 0 AND fill_price IS NULL").limit(1).count()
    if priceless:
        problems.append("a fill has no price")
    return not problems, problems
