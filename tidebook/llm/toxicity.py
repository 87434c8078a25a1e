"""Toxicity categories by a classifier chain.

Categories are predicted one after another. The model of a category is a logistic
regression over words that are associated with it, a few figures of style, and the
probabilities of the categories before it. During training those probabilities are
out-of-fold: a row's are predicted by models that never saw it, so that later models
learn how far earlier ones can be trusted. In use, the chain feeds its own
probabilities forward. The decision threshold of each category is the one with the best
F1 out of fold at a precision of LEAST_PRECISION.

Scale: the models are fitted in one task on a bounded sample of labelled rows
(SAMPLE_ROWS, drawn by a hash of the id). Scoring reads every text once, in place,
with a model of at most MOST_WORDS words a category.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import read_table
from tidebook.runtime import ship_package

#: Labelled rows that the models are fitted on, at most.
SAMPLE_ROWS = 20_000
FOLDS, RIDGE, LEAST_ROOT, LEAST_ROWS, MOST_WORDS = 5, 0.1, 4.5, 4, 500
#: Share of flagged rows that must be right, out of fold.
LEAST_PRECISION = 0.9
CATEGORIES = ("low_quality", "toxic")
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#*$%&|<>"
_STYLE = 5


def text_features(text: bytes | None) -> tuple[set[bytes], list[float]]:
    """Distinct folded words, and figures of style, of a UTF-8 text; null counts as empty."""
    text = text or b""
    words = text.translate(_FOLD).split()
    n = len(words)
    distinct = set(words)
    size = max(len(text), 1)
    style = [
        (len(text) - len(text.translate(None, _UPPER))) / size,
        (len(text) - len(text.translate(None, _SYMBOLS))) / size,
        len(text) / max(n, 1) / 10,
        len(distinct) / np.sqrt(max(n, 1)) / 10,
        np.log1p(n) / 10,
    ]
    return distinct, style


@dataclass
class Step:
    """The fitted model of one category."""

    category: str
    words: dict[str, float] = field(default_factory=dict)
    style: list[float] = field(default_factory=lambda: [0.0] * _STYLE)
    earlier: list[float] = field(default_factory=list)
    bias: float = 0.0
    threshold: float = 2.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def associated_words(rows: list[np.ndarray], y: np.ndarray, n_words: int) -> np.ndarray:
    """Indices of the words whose presence depends on y, strongest first.

    Strength is the root of the likelihood-ratio statistic of presence against y,
    which holds up for words that one class never uses.
    """
    hits = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    per = np.repeat(y, [len(r) for r in rows])
    both = np.bincount(hits, minlength=n_words).astype(float)
    a = np.bincount(hits, weights=per, minlength=n_words)
    pos, n = y.sum(), len(y)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.where(seen > 0, seen, 1) / np.where(expected > 0, expected, 1))

    g = part(a, both * pos / n) + part(both - a, both * (n - pos) / n)
    g += part(pos - a, (n - both) * pos / n) + part(n - pos - both + a, (n - both) * (n - pos) / n)
    root = np.sqrt(np.maximum(2 * g, 0))
    root[both < LEAST_ROWS] = 0
    order = np.argsort(-root, kind="stable")[:MOST_WORDS]
    return order[root[order] >= LEAST_ROOT]


def _design(rows: list[np.ndarray], dense: np.ndarray, chosen: np.ndarray, n_words: int) -> np.ndarray:
    place = np.full(n_words, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen) + dense.shape[1] + 1))
    for k, r in enumerate(rows):
        at = place[r]
        x[k, at[at >= 0]] = 1
    x[:, len(chosen) : -1] = dense
    x[:, -1] = 1
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Newton steps with a ridge on all weights but the last (the bias)."""
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = _logit(np.array([y.mean()]))[0]
    for _ in range(steps):
        p = _sigmoid(x @ w)
        s = np.maximum(p * (1 - p), 1e-9)
        change = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += change * min(1.0, 4 / max(np.abs(change).max(), 1e-12))
        if np.abs(change).max() < 1e-6:
            break
    return w


def best_threshold(p: np.ndarray, y: np.ndarray, least_precision: float = LEAST_PRECISION) -> float:
    """The probability with the best F1 among those that are precise enough; above 1 (nothing is flagged) if none is."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits, flagged = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(np.diff(p[order]) != 0, True)  # equal probabilities go together
    f1 = np.where(last & (hits >= least_precision * flagged), 2 * hits / (flagged + y.sum()), -1)
    k = int(np.argmax(f1))
    if f1[k] <= 0:
        return 2.0
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def train_chain(texts: list[bytes | None], labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...] = CATEGORIES) -> list[Step]:
    """Fits the chain. `labels` is rows x categories of 0 and 1, `folds` numbers from 0 to FOLDS - 1.

    A category with one class only gets its rate as a constant; without rows nothing is flagged.
    """
    vocabulary: dict[bytes, int] = {}
    rows, style = [], []
    for text in texts:
        distinct, figures = text_features(text)
        rows.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in distinct], np.int64))
        style.append(figures)
    names = list(vocabulary)
    dense = np.array(style).reshape(len(texts), _STYLE)
    chain: list[Step] = []
    for c, category in enumerate(categories):
        y = labels[:, c].astype(float) if len(texts) else np.zeros(0)
        step = Step(category, earlier=[0.0] * c)
        chain.append(step)
        if len(texts) == 0 or y.min() == y.max():
            rate = float(y.mean()) if len(y) else 0.0
            step.bias = float(_logit(np.array([rate]))[0])
            step.threshold = 2.0 if rate == 0 else 0.5
            dense = np.column_stack([dense, np.full(len(texts), step.bias)])
            continue

        def fitted(mine: np.ndarray, y: np.ndarray = y, dense: np.ndarray = dense) -> tuple[np.ndarray, np.ndarray]:
            own = [rows[k] for k in mine]
            chosen = associated_words(own, y[mine], len(names))
            return chosen, fit_logistic(_design(own, dense[mine], chosen, len(names)), y[mine])

        out_of_fold = np.full(len(texts), y.mean())
        for k in range(FOLDS):
            mine, rest = np.nonzero(folds != k)[0], np.nonzero(folds == k)[0]
            if len(rest) and len(mine) and 0 < y[mine].sum() < len(mine):
                chosen, w = fitted(mine)
                out_of_fold[rest] = _sigmoid(_design([rows[r] for r in rest], dense[rest], chosen, len(names)) @ w)
        chosen, w = fitted(np.arange(len(texts)))
        step.words = {names[j].decode("utf-8", "surrogateescape"): float(v) for j, v in zip(chosen, w, strict=False)}
        rest = w[len(chosen) :]
        step.style, step.earlier, step.bias = rest[:_STYLE].tolist(), rest[_STYLE:-1].tolist(), float(rest[-1])
        step.threshold = best_threshold(out_of_fold, y)
        dense = np.column_stack([dense, _logit(out_of_fold)])
    return chain


class Chain:
    """Scores texts with a trained chain."""

    def __init__(self, steps: list[Step]):
        self.steps = steps
        self.words = [{w.encode("utf-8", "surrogateescape"): v for w, v in s.words.items()} for s in steps]

    def scores(self, text: bytes | None) -> list[float]:
        distinct, style = text_features(text)
        before: list[float] = []
        out = []
        for step, words in zip(self.steps, self.words, strict=True):
            x = step.bias + sum(a * b for a, b in zip(step.style, style, strict=True))
            x += sum(a * b for a, b in zip(step.earlier, before, strict=True))
            x += sum(words[w] for w in sorted(words.keys() & distinct))
            p = float(_sigmoid(np.float64(x)))
            before.append(float(_logit(np.float64(p))))
            out.append(p)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` labelled ids, by a hash of the id, with text, low_quality, toxic and fold.

    Labels that repeat an id count as one: toxic or low in quality if any of them is.
    """
    each = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0).cast("int")).alias("low_quality"), F.max("toxic").alias("toxic")
    )
    drawn = each.na.drop().orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(rows)
    # `rows` ids at most, so the broadcast is bounded
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(drawn.withColumn("fold", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(FOLDS)).cast("int"))), "doc_id"
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Step]:
    """The chain, fitted in one task on the sample of at most `rows` labelled rows.

    Labelled ids that documents repeat give as many rows; in order of id, rows beyond the
    bound are left out of the fit (never of the scoring). Texts count whole, null as empty.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes | None] = []
        labelled: list[tuple[int, int]] = []
        folds: list[int] = []
        for batch in batches:
            room = rows - len(texts)
            part = batch.slice(0, room)
            texts += part.column("text").to_pylist()
            labelled += list(zip(part.column("low_quality").to_pylist(), part.column("toxic").to_pylist(), strict=True))
            folds += part.column("fold").to_pylist()
        chain = train_chain(texts, np.array(labelled).reshape(-1, 2), np.array(folds))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([asdict(s) for s in chain])])], ["model"])

    ship_package()
    sample = labelled_sample(docs, labels, rows).repartition(1).sortWithinPartitions("doc_id")
    model = sample.mapInArrow(train, "model string").first()
    return [Step(**s) for s in json.loads(model.model)] if model else train_chain([], np.zeros((0, 2)), np.zeros(0))


def chain_scores(text: Column, steps: list[Step]) -> Column:
    """Struct of the probabilities p_<category> of whole texts."""
    names = [f"p_{s.category}" for s in steps]
    chain = Chain(steps)

    ship_package()

    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def scored(texts: pa.Array) -> pa.Array:
        found = np.array([chain.scores(t.as_py()) for t in texts]).reshape(-1, len(names))
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(names))], names)

    return scored(text.cast("binary"))


def score_documents(docs: DataFrame, steps: list[Step]) -> DataFrame:
    """`docs` with p_<category> and the decision of each category as a boolean column of its name.

    Every row is scored in place from its whole text, however long; null and empty texts
    have no words, equal texts equal scores, no rows give no rows. Columns of these names
    are replaced.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in {x for s in steps for x in (s.category, f"p_{s.category}")}]
    out = docs.withColumn("_tt", chain_scores(F.col("text"), steps))
    return out.select(
        *own,
        *[F.col(f"_tt.p_{s.category}") for s in steps],
        *[(F.col(f"_tt.p_{s.category}") >= s.threshold).alias(s.category) for s in steps],
    )


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the chain finds toxic, with the probabilities of its categories.

    Every document is scored; the result is those over the threshold of `toxic`.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    steps = fit(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, steps).where("toxic").drop("text", "low_quality")
