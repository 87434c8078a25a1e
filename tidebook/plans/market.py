"""Queries over ticks, bars and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook import schema
from tidebook.functions import market
from tidebook.operators import calendar, quality, store
from tidebook.operators.calendar import TradingCalendar
from tidebook.plans.registry import DAILY, HOURLY, SHIPMENTS, TICKS, query, r, rounded
from tidebook.sources import tables

AS_OF, SINCE = "2024-01-20 12:00:00", "2024-01-05 00:00:00"
OHLCV = "symbol, timestamp, " + ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))


@query("ohlcv_hourly", f"WITH {HOURLY} SELECT {OHLCV} FROM bars")
def ohlcv_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.hourly_bars(spark, sf_dir).drop("interval"))


@query("ohlcv_daily", f"WITH {DAILY} SELECT {OHLCV} FROM bars")
def ohlcv_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.daily_bars(spark, sf_dir).drop("interval"))


@query("ohlcv_shipments", f"WITH {SHIPMENTS} SELECT symbol, timestamp, open, high, low, close, volume FROM bars")
def ohlcv_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.shipment_bars(spark, sf_dir).drop("interval")


@query(
    "bar_derivations",
    f"""WITH {HOURLY} SELECT symbol, timestamp, {r("(high + low + close) / 3", "typical")},
        {r("(high + low + close) / 3 * volume", "turnover", 4)}, {r("high - low", "true_range")},
        {r("ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp))", "log_return")} FROM bars""",
)
def bar_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.functions.features import Frames

    bars = tables.hourly_bars(spark, sf_dir)
    out = bars.select(
        "symbol",
        "timestamp",
        market.typical_price().alias("typical"),
        F.round(market.turnover(), 4).alias("turnover"),
        market.bar_range().alias("true_range"),
        F.ln(F.try_divide("close", F.lag("close").over(Frames().ordered))).alias("log_return"),
    )
    return rounded(out)


@query(
    "bar_invariants",
    f"""WITH {TICKS}, raw AS (SELECT event_id, symbol, price AS open, price - (event_id % 7 = 0)::INT AS high, price AS low,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE price END AS close, CASE WHEN event_id % 13 = 0 THEN -volume - 1 ELSE volume END AS volume FROM ticks)
        SELECT symbol, coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND high >= low
               AND open BETWEEN low AND high AND close BETWEEN low AND high, false) AS valid, count(*) AS n FROM raw GROUP BY 1, 2""",
)
def bar_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.ticks(spark, sf_dir).select(
        "symbol",
        F.col("price").alias("open"),
        (F.col("price") - (F.col("event_id") % 7 == 0).cast("int")).alias("high"),
        F.col("price").alias("low"),
        F.when(F.col("event_id") % 11 != 0, F.col("price")).alias("close"),
        F.when(F.col("event_id") % 13 == 0, -F.col("volume") - 1).otherwise(F.col("volume")).alias("volume"),
    )
    return raw.groupBy("symbol", schema.bar_is_valid().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


QUOTES = f"""{TICKS}, quotes AS (
    SELECT event_id, symbol, ts, price AS last_price, CASE WHEN event_id % 5 <> 0 THEN price * 0.999 END AS bid,
           CASE WHEN event_id % 7 <> 0 THEN price * (CASE WHEN event_id % 17 = 0 THEN 0.99 ELSE 1.001 END) END AS ask, volume FROM ticks)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as quotes: sides are missing or crossed by rule, so that every branch is met."""
    price, n = F.col("price"), F.col("event_id")
    return tables.ticks(spark, sf_dir).select(
        "event_id",
        "symbol",
        "ts",
        price.alias("last_price"),
        F.when(n % 5 != 0, price * 0.999).alias("bid"),
        F.when(n % 7 != 0, price * F.when(n % 17 == 0, 0.99).otherwise(1.001)).alias("ask"),
        "volume",
        F.lit(None).cast("long").alias("bid_quantity"),
        F.lit(None).cast("long").alias("ask_quantity"),
    )


@query(
    "quote_spreads",
    f"""WITH {QUOTES} SELECT event_id, {r("(bid + ask) / 2", "mid")}, {r("ask - bid", "spread")},
        {r("10000 * (ask - bid) / ((bid + ask) / 2)", "spread_bps", 4)}, coalesce(bid <= ask, true) AS valid FROM quotes""",
)
def quote_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes(spark, sf_dir).select(
        "event_id",
        market.mid().alias("mid"),
        market.spread().alias("spread"),
        F.round(market.spread_bps(), 4).alias("spread_bps"),
        schema.quote_is_valid().alias("valid"),
    )
    return rounded(out)


@query(
    "tick_rounding",
    f"""WITH {TICKS} SELECT event_id, 'NSE:' || symbol AS key, {r("round(round_even(price / 0.05, 0) * 0.05, 4)", "price")} FROM ticks""",
)
def tick_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.ticks(spark, sf_dir).select(
        "event_id",
        market.instrument_key(F.lit("NSE"), F.col("symbol")).alias("key"),
        market.round_to_tick(F.col("price"), F.lit(0.05)).alias("price"),
    )
    return rounded(out)


@query(
    "pit_history",
    f"""WITH {HOURLY}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS n FROM bars
        WHERE timestamp <= TIMESTAMP '{AS_OF}' AND timestamp >= TIMESTAMP '{SINCE}') SELECT {OHLCV} FROM x WHERE n <= 50""",
)
def pit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.history(tables.hourly_bars(spark, sf_dir), AS_OF, SINCE, 50).drop("interval"))


@query(
    "pit_upcoming",
    f"""WITH {HOURLY}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS n FROM bars
        WHERE timestamp > TIMESTAMP '{AS_OF}') SELECT {OHLCV} FROM x WHERE n <= 5""",
)
def pit_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.upcoming(tables.hourly_bars(spark, sf_dir), AS_OF, 5).drop("interval"))


@query(
    "load_range",
    f"""WITH {HOURLY} SELECT {OHLCV} FROM bars WHERE timestamp BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{AS_OF}'""",
)
def load_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.load_range(tables.hourly_bars(spark, sf_dir), SINCE, AS_OF).drop("interval"))


@query(
    "asof_align",
    f"""WITH {HOURLY} SELECT symbol, max(timestamp) AS timestamp, {r("arg_max(close, timestamp)", "close")}
        FROM bars WHERE timestamp <= TIMESTAMP '{AS_OF}' GROUP BY symbol""",
)
def asof_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.align(tables.hourly_bars(spark, sf_dir), AS_OF).select("symbol", "timestamp", "close"))


@query(
    "asof_join",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
        v AS (SELECT user_id, ts, max(value) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT p.event_id, p.user_id, p.ts, round(v.view_value, 6) + 0.0 AS view_value
        FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return rounded(store.as_of_join(bought, seen, "user_id", "ts", "ts", "view_value"))


@query(
    "upsert_latest",
    f"""WITH {HOURLY}, late AS (SELECT symbol, timestamp, close * 2 AS close, 1 AS arrival FROM bars WHERE hour(timestamp) % 3 = 0),
        every AS (SELECT symbol, timestamp, close, 0 AS arrival FROM bars UNION ALL SELECT * FROM late)
        SELECT symbol, timestamp, {r("arg_max(close, arrival)", "close")}, max(arrival)::INT AS arrival FROM every GROUP BY 1, 2""",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.hourly_bars(spark, sf_dir).select("symbol", "timestamp", "close", "interval", F.lit(0).alias("arrival"))
    late = bars.where(F.hour("timestamp") % 3 == 0).withColumn("close", F.col("close") * 2).withColumn("arrival", F.lit(1))
    return rounded(store.upsert_latest(bars, late, "arrival").select("symbol", "timestamp", "close", "arrival"))


@query(
    "coverage",
    f"WITH {HOURLY} SELECT symbol, min(timestamp) AS first_bar, max(timestamp) AS last_bar, count(*) AS n_bars FROM bars GROUP BY symbol",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.coverage(tables.hourly_bars(spark, sf_dir)).drop("interval")


@query(
    "known_at",
    "SELECT o_orderkey, o_orderdate::TIMESTAMP AS known FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30 00:00:00'",
)
def known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("known"))
    return store.known_at(rows, "known", "1997-06-30 00:00:00")


# --- calendars -------------------------------------------------------------------------------------------------------
DAYS = """days AS (SELECT (DATE '2025-01-01' + CAST(range AS INT))::DATE AS day FROM range(730)),
    o AS (SELECT o_orderkey, DATE '2025-01-01' + ((o_orderdate::DATE - DATE '1992-01-01') % 700)::INT AS day FROM orders)"""


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date moved into the years that the exchange's calendar covers."""
    since = F.pmod(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")), F.lit(700))
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.lit("2025-01-01").cast("date"), since).alias("day"))


def _list(days: list[str]) -> str:
    return ", ".join(f"DATE '{d}'" for d in days)


TRADES = f"""CASE WHEN day IN ({_list(list(calendar.SPECIAL_SESSIONS))}) THEN true
    WHEN day IN ({_list(calendar.HOLIDAYS)}) THEN false ELSE isodow(day) <= 5 END"""


@query(
    "trading_days",
    f"""WITH {DAYS} SELECT o_orderkey, day, {TRADES} AS trades, ({TRADES}) AND day NOT IN ({_list(list(calendar.SPECIAL_SESSIONS))}) AS full_session FROM o""",
)
def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exchange trades, and in full, on the day of each order."""
    exchange, day = TradingCalendar.exchange(), F.col("day")
    return order_days(spark, sf_dir).select("o_orderkey", "day", exchange.trading_day(day).alias("trades"), exchange.full_session(day).alias("full_session"))


@query(
    "first_trading_days",
    f"""WITH {DAYS}, t AS (SELECT day AS session FROM days WHERE {TRADES}),
    f AS (SELECT day, list(session ORDER BY session)[1:3] AS l FROM (SELECT DISTINCT day FROM o) JOIN t ON session >= day AND session <= day + 30 GROUP BY day)
    SELECT o_orderkey, day, l[1] AS trades_on, l[3] AS settles_on FROM o JOIN f USING (day)""",
)
def first_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day on which each order can trade, and the second trading day after it, on which it settles."""
    found = calendar.sessions_from(order_days(spark, sf_dir), "day", TradingCalendar.exchange(), 3)
    return found.select("o_orderkey", "day", F.get("sessions", F.lit(0)).alias("trades_on"), F.get("sessions", F.lit(2)).alias("settles_on"))


@query(
    "session_volatility",
    f"""WITH {HOURLY}, x AS (SELECT symbol, timestamp + INTERVAL 330 MINUTE AS local, close FROM bars),
    y AS (SELECT symbol, local, ln(close / lag(close) OVER w) AS r, lag(local) OVER w AS before FROM x WINDOW w AS (PARTITION BY symbol, local::DATE ORDER BY local))
    SELECT symbol, count(r) AS n, {r("stddev_samp(r) * sqrt(252)", "annual")}, {r("stddev_samp(r)", "daily")},
           count(*) FILTER (isodow(local) <= 5 AND local::TIME BETWEEN TIME '09:15:00' AND TIME '15:30:00') AS n_open FROM y GROUP BY symbol""",
)
def session_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of returns within a session of exchange time, annualised and back, and bars while the exchange is open."""
    local = tables.hourly_bars(spark, sf_dir).select("symbol", market.exchange_time(F.col("timestamp")).alias("local"), "close")
    session = Window.partitionBy("symbol", F.to_date("local")).orderBy("local")
    steps = local.select("symbol", "local", F.lag("local").over(session).alias("before"), F.ln(F.try_divide("close", F.lag("close").over(session))).alias("step"))
    within = F.when(market.same_session(F.col("before"), F.col("local")), F.col("step"))
    annual = market.annualise(F.stddev_samp(within))
    return rounded(
        steps.groupBy("symbol").agg(
            F.count(within).alias("n"), annual.alias("annual"), market.deannualise(annual).alias("daily"), F.count(F.when(market.is_open(F.col("local")), 1)).alias("n_open")
        )
    )


@query(
    "market_hours",
    f"""WITH {TICKS}, x AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS local FROM ticks)
        SELECT event_id, local, isodow(local) <= 5 AND local::TIME BETWEEN TIME '09:15:00' AND TIME '15:30:00' AS open,
               date_trunc('day', local) + INTERVAL '15 hours 30 minutes' AS session_close FROM x""",
)
def market_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = tables.ticks(spark, sf_dir).select("event_id", market.exchange_time(F.col("ts")).alias("local"))
    return local.select("event_id", "local", market.is_open(F.col("local")).alias("open"), market.period_end(F.col("local"), F.lit("1d")).alias("session_close"))


@query(
    "period_ends",
    f"""WITH {HOURLY}, x AS (SELECT symbol, timestamp, ['15m', '1h', '4h', '1d', '1w', '1mo', '90m'][(hour(timestamp) % 7 + 1)::INT] AS interval FROM bars)
        SELECT symbol, timestamp, interval, CASE interval WHEN '15m' THEN timestamp + INTERVAL 15 MINUTE WHEN '90m' THEN timestamp + INTERVAL 90 MINUTE
               WHEN '1h' THEN timestamp + INTERVAL 1 HOUR WHEN '4h' THEN timestamp + INTERVAL 4 HOUR WHEN '1w' THEN timestamp + INTERVAL 7 DAY
               WHEN '1mo' THEN timestamp + INTERVAL 1 MONTH ELSE date_trunc('day', timestamp) + INTERVAL '15 hours 30 minutes' END AS complete_at FROM x""",
)
def period_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When bars of every interval are complete."""
    kinds = F.array(*map(F.lit, ("15m", "1h", "4h", "1d", "1w", "1mo", "90m")))
    rows = tables.hourly_bars(spark, sf_dir).select("symbol", "timestamp", F.element_at(kinds, F.hour("timestamp") % 7 + 1).alias("interval"))
    return rows.withColumn("complete_at", market.period_end(F.col("timestamp"), F.col("interval")))


# --- quality ---------------------------------------------------------------------------------------------------------
def _gap_sql(most: int) -> str:
    return f"""WITH {SHIPMENTS}, g AS (SELECT symbol, timestamp AS "at", lag(timestamp::DATE) OVER (PARTITION BY symbol ORDER BY timestamp) AS a,
        timestamp::DATE AS b FROM bars),
        n AS (SELECT symbol, "at", len(list_filter(range(1, b - a), lambda i: isodow(a + i::INT) <= 5)) AS observed FROM g WHERE a IS NOT NULL)
        SELECT 'calendar_gap' AS check, 'warning' AS severity, symbol, "at", observed::DOUBLE AS observed FROM n WHERE observed > {most}"""


@query("quality_calendar_gap", _gap_sql(0))
def quality_calendar_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weekday that a part type shipped nothing on, between two days that it did."""
    return quality.calendar_gaps(tables.shipment_bars(spark, sf_dir), most=0)


@query(
    "quality_calendar_gap_all",
    _gap_sql(5),
)
def quality_calendar_gap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the default of more than five missing days."""
    return quality.calendar_gaps(tables.shipment_bars(spark, sf_dir))


@query(
    "quality_zero_volume",
    f"""WITH {HOURLY}, x AS (SELECT symbol, count(*) FILTER (volume = 0) AS z, count(*) AS n FROM bars GROUP BY symbol)
        SELECT 'zero_volume' AS check, CASE WHEN z > n // 10 THEN 'error' ELSE 'warning' END AS severity, symbol,
               NULL::TIMESTAMP AS at, z::DOUBLE AS observed FROM x WHERE z > 0""",
)
def quality_zero_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.zero_volume(tables.hourly_bars(spark, sf_dir))


@query(
    "quality_stale_price",
    f"""WITH {HOURLY}, b AS (SELECT symbol, timestamp, floor(close / 20) AS c FROM bars),
        s AS (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY symbol ORDER BY timestamp) THEN 0 ELSE 1 END AS new FROM b),
        i AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY timestamp) AS island FROM s)
        SELECT 'stale_price' AS check, 'warning' AS severity, symbol, max(timestamp) AS at, count(*)::DOUBLE AS observed
        FROM i GROUP BY symbol, island HAVING count(*) >= 5""",
)
def quality_stale_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes in coarse steps, so that runs exist."""
    bars = tables.hourly_bars(spark, sf_dir).withColumn("close", F.floor(F.col("close") / 20).cast("double"))
    return quality.stale_prices(bars)


@query(
    "quality_price_jumps",
    f"""WITH {HOURLY}, x AS (SELECT symbol, timestamp, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp)) AS r FROM bars),
        y AS (SELECT * FROM x WHERE r IS NOT NULL), m AS (SELECT symbol, median(r) AS med, count(*) AS n FROM y GROUP BY 1),
        a AS (SELECT y.*, abs(r - med) AS away, n FROM y JOIN m USING (symbol)), d AS (SELECT symbol, median(away) AS mad FROM a GROUP BY 1),
        s AS (SELECT a.*, away / (1.4826 * mad) AS score FROM a JOIN d USING (symbol) WHERE mad > 0 AND n + 1 >= 3)
        SELECT CASE WHEN k THEN 'suspected_split' ELSE 'price_spike' END AS check, CASE WHEN k THEN 'error' ELSE 'warning' END AS severity,
               symbol, timestamp AS at, round(score, 6) + 0.0 AS observed
        FROM (SELECT *, list_any_value([v FOR v IN [2.0, 3.0, 4.0, 5.0, 10.0, 1.5, 2.5] IF abs(abs(r) - ln(v)) <= 0.08]) IS NOT NULL AS k
              FROM s WHERE score >= 3)""",
)
def quality_price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At three deviations, so that findings exist."""
    return rounded(quality.price_jumps(tables.hourly_bars(spark, sf_dir), sigmas=3.0))


@query(
    "quality_duplicates",
    f"""WITH {TICKS}, x AS (SELECT symbol, date_trunc('hour', ts) AS timestamp FROM ticks)
        SELECT 'duplicate_timestamp' AS check, 'error' AS severity, symbol, timestamp AS at, count(*)::DOUBLE AS observed
        FROM x GROUP BY 3, 4 HAVING count(*) > 1""",
)
def quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(tables.ticks(spark, sf_dir).select("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp")))


@query(
    "quality_unordered",
    f"""WITH {TICKS}, x AS (SELECT symbol, ts, (event_id * 7919) % 10007 AS arrival, event_id FROM ticks),
        y AS (SELECT symbol, ts < lag(ts) OVER (PARTITION BY symbol ORDER BY arrival, event_id) AS back FROM x)
        SELECT 'unordered_series' AS check, 'info' AS severity, symbol, NULL::TIMESTAMP AS at, count(*) FILTER (back)::DOUBLE AS observed
        FROM y GROUP BY symbol HAVING count(*) FILTER (back) > 0""",
)
def quality_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.ticks(spark, sf_dir).select(
        "symbol", F.col("ts").alias("timestamp"), F.struct((F.col("event_id") * 7919 % 10007).alias("a"), "event_id").alias("arrival")
    )
    return quality.unordered(rows, "arrival")


@query(
    "quality_summary",
    f"""WITH {DAILY}, n AS (SELECT symbol, count(*) AS n, count(*) FILTER (volume = 0) AS z FROM bars GROUP BY 1)
        SELECT symbol, (n < 31)::INT::BIGINT + (z > n // 10)::INT::BIGINT AS n_error, (z > 0 AND z <= n // 10)::INT::BIGINT AS n_warning,
               0::BIGINT AS n_info, NOT (n < 31 OR z > n // 10) AS is_usable FROM n""",
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two checks, as its SQL has them; quality_verdict unites all seven."""
    bars = tables.daily_bars(spark, sf_dir)
    findings = quality.insufficient_history(bars, 31).unionByName(quality.zero_volume(bars))
    return quality.summary(findings, bars)


@query(
    "quality_verdict",
    f"""WITH {HOURLY}, o AS (SELECT *, timestamp AS arrival, row_number() OVER w AS i, lag(timestamp) OVER w AS before,
            lag(close) OVER w AS last, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
        dup AS (SELECT symbol, 'error' AS severity FROM bars GROUP BY symbol, timestamp HAVING count(*) > 1),
        back AS (SELECT symbol, timestamp < lag(timestamp) OVER (PARTITION BY symbol ORDER BY arrival) AS back FROM o),
        uno AS (SELECT symbol, 'info' AS severity FROM back GROUP BY symbol HAVING count(*) FILTER (back) > 0),
        few AS (SELECT symbol, 'error' AS severity FROM bars GROUP BY symbol HAVING count(*) < 30),
        gap AS (SELECT symbol, 'warning' AS severity FROM o WHERE before IS NOT NULL
            AND len(list_filter(range(1, timestamp::DATE - before::DATE), lambda k: isodow(before::DATE + k::INT) <= 5)) > 5),
        vol AS (SELECT symbol, CASE WHEN count(*) FILTER (volume = 0) > count(*) // 10 THEN 'error' ELSE 'warning' END AS severity
            FROM bars GROUP BY symbol HAVING count(*) FILTER (volume = 0) > 0),
        isl AS (SELECT symbol, sum(CASE WHEN close = last THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY timestamp) AS island FROM o),
        sta AS (SELECT symbol, 'warning' AS severity FROM isl GROUP BY symbol, island HAVING count(*) >= 5),
        med AS (SELECT symbol, median(r) AS m, count(r) AS n FROM o GROUP BY symbol),
        mad AS (SELECT symbol, median(abs(r - m)) AS d FROM o JOIN med USING (symbol) GROUP BY symbol),
        jmp AS (SELECT symbol, CASE WHEN len(list_filter([1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0], lambda v: abs(abs(r) - ln(v)) <= 0.08)) > 0
            THEN 'error' ELSE 'warning' END AS severity
            FROM o JOIN med USING (symbol) JOIN mad USING (symbol) WHERE d > 0 AND n >= 2 AND abs(r - m) / (1.4826 * d) >= 12),
        f AS (SELECT * FROM dup UNION ALL SELECT * FROM uno UNION ALL SELECT * FROM few UNION ALL SELECT * FROM gap UNION ALL SELECT * FROM vol
            UNION ALL SELECT * FROM sta UNION ALL SELECT * FROM jmp)
        SELECT s.symbol, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning,
               count(*) FILTER (severity = 'info') AS n_info, count(*) FILTER (severity = 'error') = 0 AS is_usable
        FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN f USING (symbol) GROUP BY s.symbol""",
)
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks over all hourly bars; aggregated bars arrive in the order of their stamps."""
    bars = tables.hourly_bars(spark, sf_dir).withColumn("arrival", F.col("timestamp"))
    return quality.summary(quality.report(bars, "arrival"), bars)
