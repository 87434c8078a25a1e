"""A paper session as a stream: bars in, decisions, fills and settlements out, one state per symbol.

A bar passes these steps in order. Bars at or before the last one handled are skipped,
so that a restart from a checkpoint or a replayed source changes nothing. The day rolls, the
account is marked, and every prediction that is due is settled: it scores the
reliability weights and is absorbed by the models. On schedule the models (regression on
momentum, variance filter, regime filter) are refitted on all settled examples, which end
a horizon before the present. Then the models predict, their answers are fused, and the
decision is reviewed, ordered and filled in the account of the symbol.

Before the first fit the variance filter alone predicts and nothing is decided. A bar
without a usable close neither trades nor settles: what is due waits for the next usable
bar. A bar after a longer silence than allowed is marked and settled, and then halts.

Scale: one symbol is one fold over batches of bars. Refits read all settled examples, four values a bar,
and a series of n bars costs n / refit_every passes over them. A stream keeps them in a list state to which a
batch adds what it settled and which only a refit reads; pending predictions, at most a horizon of them, are
a second list, and all else is one value of fixed size. So a batch writes what it changed,
however long the series.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebook.config import RiskLimits
from tidebook.functions import account, filters, special
from tidebook.functions.features import ANNUALISER
from tidebook.operators import trading
from tidebook.operators.folds import fold
from tidebook.operators.life_cycle import Ensemble
from tidebook.runtime import ship_package

OUTPUT = (
    "symbol string, bar_end timestamp, event string, close double, predicted_mean double, predicted_sd double, "
    "settled_bar timestamp, outcome double, u double, n_seen long, n_rows long, "
    "w_momentum double, w_volatility double, w_regime double, disagreement double, epistemic_variance double, "
    "action string, reason string, target_weight double, approved_weight double, failing string, "
    "order_id string, filled double, fill_price double, slippage double, fees double, "
    "cash double, position double, equity double, day_start_equity double, drawdown double"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
MODELS = ("momentum", "volatility", "regime")
X, LAGS = "momentum_20_1", 21


@dataclass(frozen=True)
class Config:
    """What a session runs under; the limits, costs and models are those of the batch operators."""

    horizon: int = 5
    scale: float = 0.02
    warmup: int = 300
    refit_every: int = 50
    starting_cash: float = 1e6
    max_silence_days: float = 3.0
    limits: RiskLimits = field(default_factory=RiskLimits)

    def __post_init__(self) -> None:
        if self.horizon < 1 or self.warmup < 3 or self.refit_every < 1 or self.starting_cash <= 0:
            raise ValueError("horizon, warmup, refit_every and starting cash are too small")


class Examples:
    """Settled examples (bar, momentum, outcome, return): those of earlier batches, which are read when all are asked for, and new ones."""

    def __init__(self, n_earlier: int = 0, earlier: Callable[[], Iterable[tuple]] = tuple):
        self.n_earlier, self.earlier, self.new = n_earlier, earlier, []

    def __len__(self) -> int:
        return self.n_earlier + len(self.new)

    def append(self, example: tuple[str, float, float, float]) -> None:
        self.new.append(example)

    def rows(self) -> list[tuple]:
        return [*map(tuple, self.earlier()), *self.new]


class State:
    """What one symbol has absorbed, its account and its pending predictions; round-trips through JSON, whole or with its lists apart."""

    def __init__(self, symbol: str, config: Config):
        self.symbol, self.config = symbol, config
        self.filter = filters.VarianceFilter(b0=config.scale**2)
        self.models = Ensemble(X, config.horizon, least=config.warmup)
        self.reliability = filters.Reliability({m: float(-np.log(len(MODELS))) for m in MODELS})
        self.account = account.Account(config.starting_cash)
        self.last_close: float | None = None
        self.last_bar: str | None = None
        self.closes: list[float | None] = []
        self.examples = Examples()
        self.pending: list[dict] = []
        self.since_refit = 0

    def core(self) -> str:
        """All but the examples and the pending predictions; its size does not grow with the series."""
        held = {
            "filter": self.filter.dump(), "account": asdict(self.account),
            "reliability": [self.reliability.logs, self.reliability.scored], "models": self.models.dump(),
            "last_close": self.last_close, "last_bar": self.last_bar, "closes": self.closes,
            "since_refit": self.since_refit, "n_examples": len(self.examples),
        }
        return json.dumps(held)

    def dump(self) -> str:
        return json.dumps({"core": self.core(), "examples": self.examples.rows(), "pending": self.pending})

    @classmethod
    def of(cls, core: str | None, pending: list[dict], earlier: Callable[[], Iterable[tuple]], symbol: str, config: Config) -> State:
        out = cls(symbol, config)
        if core:
            held = json.loads(core)
            out.filter = filters.VarianceFilter.load(held["filter"])
            out.account = account.Account(**held["account"])
            logs, scored = held["reliability"]
            out.reliability = filters.Reliability(logs, {k: tuple(v) for k, v in scored.items()})
            out.models.restore(held["models"])
            for name in ("last_close", "last_bar", "closes", "since_refit"):
                setattr(out, name, held[name])
            out.pending, out.examples = pending, Examples(held["n_examples"], earlier)
        return out

    @classmethod
    def restore(cls, text: str | None, symbol: str, config: Config) -> State:
        held = json.loads(text) if text else {"core": None, "examples": [], "pending": []}
        return cls.of(held["core"], held["pending"], lambda: held["examples"], symbol, config)

    def _row(self, event: str, close: float | None, **values: object) -> tuple:
        a = self.account
        known = {"n_seen": self.filter.n_seen, "cash": a.cash, "position": a.quantity, "equity": a.equity, "day_start_equity": a.day_start}
        known |= {"drawdown": a.drawdown if math.isfinite(a.peak) else None}
        values = known | values | {"event": event, "close": close}
        return tuple(values.get(c) for c in COLUMNS[2:])

    def on_bar(self, moment: pd.Timestamp, close: float | None, volume: float | None = None) -> list[tuple]:
        """Rows of COLUMNS from the event on that a bar gives rise to."""
        stamp = moment.isoformat()
        if self.last_bar is not None and stamp <= self.last_bar:
            return [self._row("already_handled", close)]
        rows: list[tuple] = []
        usable = close is not None and math.isfinite(close) and close > 0
        volume = None if volume is None or not math.isfinite(volume) else float(volume)
        first = self.last_bar is None
        silence = 0.0 if first else (moment - pd.Timestamp(self.last_bar)).total_seconds() / 86_400
        self.last_bar = stamp
        self.account.roll(stamp[:10])
        self.account.mark(close if usable else None)
        if first:
            rows.append(self._row("session_started", close))
        rows += self._settle(close if usable else None)
        r = math.log(close / self.last_close) if usable and self.last_close else None
        self.filter.observe(r)
        self.closes = [*self.closes, close if usable else None][-LAGS - 1 :]
        if not usable:
            return [*rows, self._row("halted", close, failing="price")]
        self.last_close = close
        rows += self._refit(close)
        asked = {"bar": stamp, "close": close, "left": self.config.horizon, "r": r, "x": self._momentum(), "answers": None}
        self.pending.append(asked)
        halted = ["feed"] * (silence > self.config.max_silence_days) + ["account"] * (self.account.equity <= 0)
        if halted:
            return [*rows, self._row("halted", close, failing=",".join(halted))]
        return [*rows, self._act(asked, volume)]

    def _momentum(self) -> float | None:
        if len(self.closes) <= LAGS or self.closes[-2] is None or self.closes[0] is None:
            return None
        return math.log(self.closes[-2] / self.closes[0])

    def _settle(self, close: float | None) -> list[tuple]:
        """Scores and absorbs every prediction that is due; without a usable close they wait."""
        rows = []
        for p in self.pending:
            p["left"] -= 1
        while close is not None and self.pending and self.pending[0]["left"] <= 0:
            due = self.pending.pop(0)
            outcome = math.log(close / due["close"])
            if due["r"] is not None and due["x"] is not None:
                self.examples.append((due["bar"], due["x"], outcome, due["r"]))
                if self.models.ready:
                    self.models.update({"as_of": due["bar"], "forward_log_return": outcome, "r": due["r"], X: due["x"]})
            if due["answers"] is None:
                continue
            answers = {m: parts for m, (parts, _) in due["answers"].items()}
            weights = due["weights"]
            if set(answers) == set(MODELS):
                self.reliability.score({m: float(special.mixture_logpdf(outcome, _mixture(parts))) for m, parts in answers.items()})
            pooled, _, _ = account.pool(due["answers"], weights)
            u = float(special.mixture_cdf(outcome, _mixture(pooled)))
            rows.append(self._row("settled", close, settled_bar=pd.Timestamp(due["bar"]), outcome=outcome, u=u))
        return rows

    def _refit(self, close: float) -> list[tuple]:
        self.since_refit += 1
        if (self.models.ready and self.since_refit < self.config.refit_every) or len(self.examples) < self.config.warmup:
            return []
        table = pd.DataFrame(self.examples.rows(), columns=["as_of", X, "forward_log_return", "r"])
        self.models.fit(table)
        self.since_refit = 0
        return [self._row("refit", close, n_rows=len(table))]

    def _act(self, asked: dict, volume: float | None) -> tuple:
        """Predicts, fuses, decides, reviews and fills; the row holds what each step said."""
        c, close = self.config, asked["close"]
        if not self.models.ready:
            asked["answers"], asked["weights"] = {"volatility": self.filter.predictive(c.horizon)}, {"volatility": 1.0}
        elif asked["x"] is None:
            return self._row("bar", close, reason="no_features")
        else:
            asked["answers"] = self.models.predict({X: asked["x"]})
            asked["weights"] = self.reliability.weights()
        parts, epistemic, disagreement = account.pool(asked["answers"], asked["weights"])
        mean, variance, _ = account.moments(parts)
        sd = math.sqrt(variance)
        said = {"predicted_mean": mean, "predicted_sd": sd if math.isfinite(sd) else None}
        said |= {f"w_{m}": w for m, w in asked["weights"].items()}
        if not self.models.ready:
            return self._row("bar", close, **said)
        action, reason, target = account.decide(parts, epistemic, c.limits, trading.FLOOR_DOWNSIDE, trading.TAIL)
        a = self.account
        approved, failed = a.review(action, target, sd * ANNUALISER, None if volume is None else volume * close, c.limits)
        said |= {"disagreement": disagreement, "epistemic_variance": epistemic, "action": action, "reason": reason}
        said |= {"target_weight": target, "approved_weight": approved, "failing": ",".join(failed) or None, "filled": 0.0}
        if approved > 0:
            a.n_orders += 1
            said["order_id"] = f"{self.symbol}-{a.n_orders:08d}"
            done = a.fill(
                self.symbol, action, approved * a.equity / close, close, volume, trading.COMMISSION, trading.SLIPPAGE, trading.PARTICIPATION
            )
            if done is None:
                said["failing"] = "rejected"
            else:
                quantity, price, fees = done
                said |= {"filled": quantity if action == "buy" else -quantity, "fill_price": price, "slippage": price - close, "fees": fees}
        return self._row("bar", close, **said)


def _mixture(parts: list) -> special.Mixture:
    return tuple(np.array(v, float) for v in zip(*parts, strict=True))


def _events(state: State, bars: pd.DataFrame) -> pd.DataFrame:
    ordered = bars.sort_values("bar_end", kind="stable")
    volumes = [None if pd.isna(v) else v for v in ordered.volume]
    closes = [None if pd.isna(v) else v for v in ordered.close]
    out = [
        (state.symbol, moment, *row)
        for moment, close, volume in zip(ordered.bar_end, closes, volumes, strict=True)
        for row in state.on_bar(moment, close, volume)
    ]
    return pd.DataFrame(out, columns=COLUMNS)


class Session(StatefulProcessor):
    def __init__(self, config: Config):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("session", "state string")
        self.pending = handle.getListState("pending", "prediction string")
        self.examples = handle.getListState("examples", "bar string, x double, outcome double, r double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        core = self.held.get()[0] if self.held.exists() else None
        pending = [json.loads(p) for (p,) in self.pending.get()] if core else []
        state = State.of(core, pending, self.examples.get, key[0], self.config)
        events = _events(state, pd.concat(list(rows)))
        if state.examples.new:
            self.examples.appendList(state.examples.new)
        if state.pending:
            self.pending.put([(json.dumps(p),) for p in state.pending])
        else:
            self.pending.clear()
        self.held.update((state.core(),))
        yield events

    def close(self) -> None:
        pass


def _slim(bars: DataFrame) -> DataFrame:
    """Bars without a volume column have no turnover to check and none that bounds a fill."""
    volume = F.col("volume").cast("double") if "volume" in bars.columns else F.lit(None).cast("double").alias("volume")
    return bars.select("symbol", "bar_end", "close", volume.alias("volume"))


def session_stream(bars: DataFrame, horizon: int = 5, scale: float = 0.02, **config: object) -> DataFrame:
    """Events of a stream of bars (symbol, bar_end, close and, where known, volume)."""
    ship_package()
    processor = Session(Config(horizon, scale, **config))
    return _slim(bars).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="append", timeMode="None"
    )


def session_batch(bars: DataFrame, horizon: int = 5, scale: float = 0.02, **config: object) -> DataFrame:
    """The same events from a table of bars, by the same state."""
    held = Config(horizon, scale, **config)

    def step(state: State, bar) -> list[tuple]:
        close, volume = (None if pd.isna(v) else v for v in (bar.close, bar.volume))
        return [(state.symbol, bar.bar_end, *row) for row in state.on_bar(bar.bar_end, close, volume)]

    return fold(_slim(bars), "symbol", ["bar_end"], lambda first: State(first.symbol, held), step, OUTPUT)
