"""Queries over features, labels and training sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import features as f
from tidebook.operators import series
from tidebook.plans.registry import HOURLY, SHIPMENTS, query, r, rounded
from tidebook.sources import tables

W = "PARTITION BY symbol ORDER BY timestamp"
#: Helper columns of every feature, in SQL.
BASE = f"""WITH {HOURLY}, h AS (SELECT *, row_number() OVER ({W}) AS n, ln(close) AS lc, lag(close) OVER ({W}) AS pc,
    ln(close) - lag(ln(close)) OVER ({W}) AS r, (high + low + close) / 3 * volume AS tv FROM bars),
    b AS (SELECT *, close - pc AS ch, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
          CASE WHEN volume > 0 THEN ln(volume) END AS lv FROM h)"""


def over(expression: str, n: int) -> str:
    return f"{expression} OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({W})" if n else x


def flat(x: str, n: int) -> str:
    size = f"greatest({over(f'max(abs({x}))', n)}, 1.0)"
    return f"({over(f'max({x})', n)} - {over(f'min({x})', n)} <= {2.0**-52!r} * {size} * {n})"


def ema(x: str, n: int) -> str:
    values, alpha = over(f"list({x})", 3 * n), 2 / (n + 1)
    return f"list_reduce(list_prepend(list_avg(({values})[1:{n}]), ({values})[{n + 1}:{3 * n}]), lambda a, y: a + {alpha!r} * (y - a))"


A = "15.874507866387544"  # root of 252
LN2 = "0.6931471805599453"

def _ratio(x: str, y: str) -> str:
    return f"CASE WHEN {x} > 0 AND {y} > 0 THEN ln({x} / {y}) END"


def _rsi(n: int) -> str:
    up, down = over("avg(greatest(ch, 0))", n), over("avg(greatest(-ch, 0))", n)
    return f"CASE WHEN {up} = 0 AND {down} = 0 THEN 50.0 WHEN {down} = 0 THEN 100.0 ELSE 100 - 100 / (1 + {up} / {down}) END"


def _zscore(n: int) -> str:
    return f"CASE WHEN NOT {flat('lc', n)} THEN (lc - {over('avg(lc)', n)}) / {over('stddev_samp(lc)', n)} END"


def _parkinson(n: int) -> str:
    x = over("avg(ln(high / low) ** 2)", n)
    return f"CASE WHEN {x} > 0 THEN sqrt({x} / (4 * {LN2})) * {A} END"


def _garman_klass(n: int) -> str:
    x = over(f"avg(0.5 * ln(high / low) ** 2 - (2 * {LN2} - 1) * ln(close / open) ** 2)", n)
    return f"CASE WHEN {x} > 0 THEN sqrt(greatest({x}, 0)) * {A} END"


def _volume_zscore(n: int) -> str:
    sd = over("stddev_samp(lv)", n)
    return f"CASE WHEN {over('min(volume)', n)} > 0 AND {sd} > 0 THEN (lv - {over('avg(lv)', n)}) / {sd} END"


def _relative_volume(n: int) -> str:
    x = over("median(volume)", n)
    return f"CASE WHEN {x} > 0 AND volume > 0 THEN ln(volume / {x}) END"


#: Lookback and SQL of a feature by the stem of its name and its parameters.
BUILDERS: dict[str, Callable[..., tuple[int, str]]] = {
    "log_return": lambda n: (n, f"lc - {lag('lc', n)}"),
    "return": lambda n: (n, f"close / {lag('close', n)} - 1"),
    "sma": lambda n: (n - 1, over("avg(close)", n)),
    "ema": lambda n: (3 * n - 1, ema("close", n)),
    "close_to_sma": lambda n: (n - 1, f"lc - ln({over('avg(close)', n)})"),
    "close_to_ema": lambda n: (3 * n - 1, f"lc - ln({ema('close', n)})"),
    "ema_spread": lambda a, b: (3 * b - 1, f"ln({ema('close', a)} / {ema('close', b)})"),
    "sma_spread": lambda a, b: (b - 1, f"ln({over('avg(close)', a)} / {over('avg(close)', b)})"),
    "momentum": lambda n, skip=0: (n + skip, f"{lag('lc', skip)} - {lag('lc', n + skip)}"),
    "rsi": lambda n: (n, _rsi(n)),
    "price_zscore": lambda n: (n - 1, _zscore(n)),
    "drawdown": lambda n: (n - 1, f"ln(close / {over('max(high)', n)})"),
    "trend_slope": lambda n: (n - 1, f"CASE WHEN {flat('lc', n)} THEN 0.0 ELSE {over('regr_slope(lc, n::DOUBLE)', n)} END"),
    "trend_quality": lambda n: (n - 1, f"CASE WHEN NOT {flat('lc', n)} THEN least(1.0, {over('regr_r2(lc, n::DOUBLE)', n)}) END"),
    "volatility": lambda n: (n, f"{over('stddev_samp(r)', n)} * {A}"),
    "ewma_volatility": lambda n: (3 * n, f"sqrt({ema('r * r', n)}) * {A}"),
    "parkinson_volatility": lambda n: (n - 1, _parkinson(n)),
    "garman_klass_volatility": lambda n: (n - 1, _garman_klass(n)),
    "downside_volatility": lambda n: (n, f"sqrt({over('avg(least(r, 0) ** 2)', n)}) * {A}"),
    "volatility_ratio": lambda a, b: (b, _ratio(over("stddev_samp(r)", a), over("stddev_samp(r)", b))),
    "atr_pct": lambda n: (n, f"{over('avg(tr)', n)} / close"),
    "relative_volume": lambda n: (n - 1, _relative_volume(n)),
    "volume_zscore": lambda n: (n - 1, _volume_zscore(n)),
    "turnover_median": lambda n: (n - 1, over("median(tv)", n)),
    "amihud": lambda n: (n, f"{over('avg(CASE WHEN tv > 0 THEN abs(r) / tv END)', n)} * 1e6"),
}


def sql_for(name: str) -> tuple[int, str]:
    parts = name.split("_")
    numbers = [int(x) for x in parts if x.isdigit()]
    return BUILDERS["_".join(x for x in parts if not x.isdigit())](*numbers)


def sql_of(found: list[f.Feature], base: str = BASE) -> str:
    need = f.lookback(found) + 1
    columns = ", ".join(r(f"CASE WHEN n >= {sql_for(x.name)[0] + 1} THEN {sql_for(x.name)[1]} END", x.name) for x in found)
    return f"{base} SELECT symbol, timestamp, least(n, {need})::INT AS n_bars, {columns} FROM b"


def _walk(spark: SparkSession, sf_dir: str, found: list[f.Feature], chunk: int | None = None) -> DataFrame:
    return rounded(series.feature_walk(tables.hourly_bars(spark, sf_dir), found, chunk=chunk))


GROUPS: dict[str, list[f.Feature]] = {
    "features_price": [f.log_return(1), f.log_return(5), f.simple_return(1)],
    "features_averages": [f.moving_average(20), f.moving_average(20, True), f.price_to_moving_average(20), f.price_to_moving_average(20, True)],
    "features_spreads": [f.moving_average_spread(12, 26), f.moving_average_spread(12, 26, False)],
    "features_momentum": [f.momentum(20, 1), f.momentum(60, 5), f.momentum(10, 0), f.relative_strength_index(14), f.price_z_score(20), f.drawdown_from_high(60)],
    "features_trend": [f.trend_slope(20), f.trend_quality(20)],
    "features_volatility": [f.realised_volatility(20), f.ewma_volatility(20), f.downside_volatility(20), f.volatility_ratio(5, 60)],
    "features_range": [f.parkinson_volatility(20), f.garman_klass_volatility(20), f.average_true_range(14)],
    "features_volume": [f.relative_volume(20), f.volume_z_score(20), f.median_turnover(20), f.amihud_illiquidity(20)],
}


def _register(name: str, found: list[f.Feature]) -> None:
    @query(name, sql_of(found))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _walk(spark, sf_dir, found, chunk=512)


for _name, _found in GROUPS.items():
    _register(_name, _found)


#: Every family once more with other parameters.
OTHER = [
    f.log_return(3), f.simple_return(7), f.moving_average(7), f.moving_average(7, True), f.price_to_moving_average(35), f.price_to_moving_average(9, True),
    f.moving_average_spread(5, 17), f.moving_average_spread(5, 17, False), f.momentum(30, 3), f.momentum(8, 0), f.relative_strength_index(9),
    f.price_z_score(45), f.drawdown_from_high(30), f.trend_slope(33), f.trend_quality(33), f.realised_volatility(10), f.ewma_volatility(11),
    f.parkinson_volatility(8), f.garman_klass_volatility(12), f.downside_volatility(31), f.volatility_ratio(7, 40), f.average_true_range(5),
    f.relative_volume(9), f.volume_z_score(13), f.median_turnover(6), f.amihud_illiquidity(15),
]
_register("features_other_parameters", OTHER)
SHIPMENT_BASE = BASE.replace(HOURLY, SHIPMENTS)


@query("features_shipments", sql_of(f.default_set(), SHIPMENT_BASE))
def features_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard set over daily bars with gaps, of one long series per part type."""
    return rounded(series.feature_walk(tables.shipment_bars(spark, sf_dir), f.default_set(), chunk=512))


@query("features_default", sql_of(f.default_set()))
def features_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: twenty-one features at every hourly bar, each symbol spread over chunks of 512 bars."""
    return _walk(spark, sf_dir, f.default_set(), chunk=512)


@query(
    "features_at",
    f"""WITH w AS ({sql_of(f.minimal_set())} WHERE timestamp <= TIMESTAMP '2024-01-15 00:00:00')
        SELECT symbol, TIMESTAMP '2024-01-15 00:00:00' AS as_of, timestamp AS data_as_of, n_bars, log_return_1, momentum_20_1, volatility_20
        FROM w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""",
)
def features_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.features_at(tables.hourly_bars(spark, sf_dir), f.minimal_set(), "2024-01-15 00:00:00"))


@query(
    "feature_staleness",
    f"""WITH {HOURLY} SELECT symbol, max(timestamp) AS data_as_of,
        {r("epoch(TIMESTAMP '2024-01-15 00:20:00') - epoch(max(timestamp))", "stale_seconds")} FROM bars WHERE timestamp <= TIMESTAMP '2024-01-15 00:20:00' GROUP BY symbol""",
)
def feature_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the latest vector of each symbol lies behind a moment."""
    vectors = series.features_at(tables.hourly_bars(spark, sf_dir), f.minimal_set(), "2024-01-15 00:20:00")
    return rounded(series.staleness(vectors).select("symbol", "data_as_of", "stale_seconds"))


@query(
    "design_faults",
    f"""WITH w AS ({sql_of([f.relative_volume(20), f.momentum(20, 1)])}), x AS (SELECT symbol, timestamp, concat_ws('; ',
            CASE WHEN n_bars < 20 THEN 'relative_volume_20: warming up' WHEN relative_volume_20 IS NULL THEN 'relative_volume_20: undefined' END,
            CASE WHEN n_bars < 22 THEN 'momentum_20_1: warming up' WHEN momentum_20_1 IS NULL THEN 'momentum_20_1: undefined' END) AS faults FROM w)
        SELECT * FROM x WHERE faults <> ''""",
)
def design_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows cannot enter a design: features that warm up or are undefined."""
    found = [f.relative_volume(20), f.momentum(20, 1)]
    walked = series.feature_walk(tables.hourly_bars(spark, sf_dir), found)
    faults = series.design_faults(walked, found, ["relative_volume_20", "momentum_20_1"])
    return faults.select("symbol", "timestamp", F.array_join("faults", "; ").alias("faults"))


@query(
    "first_complete",
    f"""WITH w AS ({sql_of(f.minimal_set())}) SELECT symbol, min(timestamp) AS first_complete FROM w
        WHERE log_return_1 IS NOT NULL AND momentum_20_1 IS NOT NULL AND volatility_20 IS NOT NULL GROUP BY symbol""",
)
def first_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = f.minimal_set()
    return series.first_complete(series.feature_walk(tables.hourly_bars(spark, sf_dir), found), found)


@query(
    "completeness",
    f"""WITH w AS ({sql_of([f.relative_volume(20), f.momentum(20, 1)])})
        SELECT symbol, timestamp, (n_bars < 20)::INT + (n_bars < 22)::INT AS n_missing,
               (n_bars >= 20 AND relative_volume_20 IS NULL)::INT AS n_undefined FROM w""",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [f.relative_volume(20), f.momentum(20, 1)]
    walked = series.feature_walk(tables.hourly_bars(spark, sf_dir), found)
    return series.completeness(walked, found).select(
        "symbol", "timestamp", F.size("missing").alias("n_missing"), F.size("undefined").alias("n_undefined")
    )


LABELS = f"""WITH {HOURLY}, l AS (SELECT symbol, timestamp AS as_of, lead(timestamp, 5) OVER ({W}) AS realised_at,
    ln(lead(close, 5) OVER ({W}) / close) AS fwd, ln(min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / close) AS worst,
    ln(max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / close) AS best FROM bars)"""


@query(
    "label_fwd5",
    f"""{LABELS} SELECT symbol, as_of, realised_at, {r("fwd", "forward_log_return")}, {r("least(0, worst)", "mae")}, {r("greatest(0, best)", "mfe")},
        5 AS horizon_bars, fwd > 0 AS went_up FROM l WHERE realised_at IS NOT NULL""",
)
def label_fwd5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.forward_labels(tables.hourly_bars(spark, sf_dir), 5, chunk=512))


@query(
    "train_set",
    f"""WITH w AS ({sql_of(f.minimal_set())}), y AS ({LABELS} SELECT symbol, as_of AS timestamp, realised_at, {r("fwd", "forward_log_return")},
        {r("least(0, worst)", "mae")}, {r("greatest(0, best)", "mfe")} FROM l WHERE realised_at IS NOT NULL)
        SELECT * FROM w JOIN y USING (symbol, timestamp)
        WHERE log_return_1 IS NOT NULL AND momentum_20_1 IS NOT NULL AND volatility_20 IS NOT NULL""",
)
def train_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.training_set(tables.hourly_bars(spark, sf_dir), f.minimal_set(), 5, chunk=512))


@query(
    "design_rows",
    f"""WITH w AS ({sql_of(f.minimal_set())}) SELECT symbol, timestamp, round(log_return_1 + momentum_20_1 + volatility_20, 6) + 0.0 AS total
        FROM w WHERE log_return_1 IS NOT NULL AND momentum_20_1 IS NOT NULL AND volatility_20 IS NOT NULL""",
)
def design_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [x.name for x in f.minimal_set()]
    rows = series.design_rows(rounded(series.feature_walk(tables.hourly_bars(spark, sf_dir), f.minimal_set())), found)
    return rounded(rows.select("symbol", "timestamp", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total")))
