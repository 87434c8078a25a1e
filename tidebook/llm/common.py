"""Helpers that every training-data operator shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tidebook.runtime import shared_dir

__all__ = ["count_words", "durable", "join_counted", "lane_bits", "let", "read_table", "releasing", "row_digest", "shared_dir", "stored", "unit", "words_of"]

#: Keys that a join may treat as hot, at most, and rows from which a key can be one.
MOST_HOT, LEAST_HOT = 10_000, 1_000
ROWS_PER_LANE = 100_000

#: One white-space character of the word rule `[^\x20\x09-\x0D]+`.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: One character of a word under that rule.
WORD_CLASS = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which later reads take by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """`left` joined with the one row that `right` has for a key; no task meets all rows of a hot key.

    `right` counts in column n the rows of `left` with its key. Keys above a share of
    1/MOST_HOT of all counted rows are hot: at most MOST_HOT rows, so their side is broadcast, and
    their rows of `left` stay where they are. The others are joined as usual. `left` is
    read twice if there are hot keys, and should be cheap to read.
    """
    right = durable(right)
    total = right.agg(F.sum(n)).first()[0] or 0
    least = max(LEAST_HOT, total // MOST_HOT + 1)
    hot, cold = right.where(F.col(n) >= least).drop(n), right.where(F.col(n) < least).drop(n)
    if not hot.limit(1).count():
        return left.join(cold, key, how)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rest.unionByName(left.join(F.broadcast(hot), key))


def lane_bits(rows: DataFrame, least: int, most: int = 16) -> int:
    """Bits of a lane number, so that a third of the rows spread over 2^bits lanes leave about ROWS_PER_LANE in each.

    Lanes are ranges of a hash, so their number changes no order and no result.
    """
    return max(least, min(most, (rows.count() // (3 * ROWS_PER_LANE)).bit_length()))


def row_digest(df: DataFrame, names: tuple[str, str], columns: list[str] | None = None) -> list[Column]:
    """A digest of 128 bits over the columns (default: all), as two longs: rows that share it are equal in all of them.

    Hashes pass over nulls, so each column is hashed with whether it is null; columns of nested
    types, within which nulls could move too, are hashed as JSON.
    """
    parts = []
    for c in df.columns if columns is None else columns:
        own = F.col(f"`{c}`")
        nested = isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType))
        parts += [own.isNull(), F.to_json(F.struct(own.alias("v"))) if nested else own]
    return [F.xxhash64(F.lit(k), *parts).alias(n) for k, n in enumerate(names, 1)]


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text (null: none), in order, as an array."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != F.lit("")
    )


def count_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` of a text (null: 0), as a long.

    A split leaves an empty string only before a leading and after a trailing
    separator, so two looks at the ends replace a pass over the array.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE_CLASS}+", "")
    parts = F.split(body, SPACE_CLASS + "+")
    return let(
        parts,
        lambda p: (F.size(p) - F.when(F.element_at(p, -1) == F.lit(""), 1).otherwise(0)).cast("long"),
    )


def unit(*parts: Column) -> Column:
    """A uniform number in (0, 1) that depends on the parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)
