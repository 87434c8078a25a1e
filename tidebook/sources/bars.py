"""Bar files: CSV scans with a reject table, and directory stores partitioned by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook import schema

COLUMNS = [f.name for f in schema.BAR]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: path, line (from 1), value, and the file's first line as header.

    A file is read in splits. Within a split lines come in order, so each has its number there; counts of
    lines per split, summed over the splits before, carry the number on. No file is read in one task, and a row moves
    only to meet the few numbers of its split, which Spark broadcasts while they are small.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    splits = lines.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_lines"), F.min("_at").alias("_first"), F.min_by("value", "_at").alias("_top"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    top = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = splits.select("path", "_start", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"), F.first("_top").over(top).alias("header"))
    line = (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line")
    return lines.join(places, ["path", "_start"]).select("path", line, "value", "header")


def read_bars(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bars of CSV files with a header in any column order, and the rows that are malformed or break the invariant.

    Rejects carry the path, the line and the text of their row, and a place written path:line. Blank lines are skipped
    and counted. A header without one of the eight columns is an error; so are the rows of a file whose header is not that
    of the others. Folders within the path are read too. A row is one line.
    """
    header = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).columns
    missing = [c for c in COLUMNS if c not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in schema.BAR}
    fields = T.StructType([*[T.StructField(c, kinds.get(c, T.StringType())) for c in header], T.StructField("_malformed", T.StringType())])
    names = F.transform(F.split(F.regexp_replace("header", "[\"\r\ufeff]", ""), ","), F.trim)
    body = numbered_lines(spark, path).where((F.col("line") > 1) & (F.trim(F.regexp_replace("value", "\r", "")) != ""))
    parsed = F.from_csv("value", fields.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    raw = body.select(F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("value").alias("_text"), (names == F.lit(header)).alias("_own"), parsed.alias("_row"))
    raw = raw.select("_path", "_line", "_text", "_own", "_row.*")
    good = F.col("_own") & F.col("_malformed").isNull() & schema.bar_is_valid() & F.col("timestamp").isNotNull()
    ok, bad = schema.route(raw, F.coalesce(good, F.lit(False)))
    place = F.concat("_path", F.lit(":"), F.col("_line").cast("string")).alias("_place")
    return ok.select(*COLUMNS), bad.select("_path", "_line", place, "_text", "_malformed", *COLUMNS)


def write_bars(bars: DataFrame, path: str) -> None:
    """CSV files with a header, in order of symbol and time across files."""
    bars.select(*COLUMNS).orderBy("symbol", "timestamp").write.mode("overwrite").option("header", True).csv(path)


def save_store(bars: DataFrame, path: str) -> None:
    """A Parquet store partitioned by symbol; names that a file system refuses are escaped by Spark."""
    bars.repartition("symbol", F.date_trunc("month", "timestamp")).sortWithinPartitions("symbol", "timestamp").write.mode("overwrite").partitionBy("symbol").parquet(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.BAR).parquet(path).select(*COLUMNS)
