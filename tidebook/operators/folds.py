"""Folds over sorted rows: one carried state per key, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidebook.runtime import ship_package


def names_of(schema: str) -> list[str]:
    """Column names of a schema in DDL; commas within types do not count."""
    out, depth, word = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


def fold(
    rows: DataFrame,
    key: str,
    order: list[str],
    start: Callable[[object], object],
    step: Callable[[object, object], Iterable[tuple]],
    schema: str,
    finish: Callable[[object], Iterable[tuple]] | None = None,
) -> DataFrame:
    """Output tuples of `step(state, row)` over the rows of each key in order, and of `finish(state)` at its end.

    `start(row)` makes the state of a key from its first row. Rows are sorted in Spark, which
    spills, and reach Python in Arrow batches; a task holds one batch and one state, so the
    length of a series is bounded by what its state keeps alone.
    """
    names = names_of(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            out: list[tuple] = []
            for first, last in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                part = pdf.iloc[first:last].itertuples(index=False)
                if state is None or keys[first] != held:
                    if state is not None and finish is not None:
                        out += finish(state)
                    held, state = keys[first], start(pdf.iloc[first])
                for row in part:
                    out += step(state, row)
            yield pd.DataFrame(out, columns=names)
        if state is not None and finish is not None:
            yield pd.DataFrame(list(finish(state)), columns=names)

    ship_package()
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
