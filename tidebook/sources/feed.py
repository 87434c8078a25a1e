"""Feeds that land in files: a table as a stream whose micro-batches are bounded and come in order."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows of a landed file, about; one file is one micro-batch.
FILE_ROWS = 1 << 20


def land(rows: DataFrame, order: Column, path: str, file_rows: int | None = None) -> None:
    """Writes `rows` as files of about so many rows, each file's rows before those of the next by `order`, nulls last.

    Files hold ranges of `order`, so rows of equal order share a file. File streams take
    files by their times, which are set to the order of the ranges; a store that keeps no
    times is an error, as a stream would take its files in any order there.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // (file_rows or FILE_ROWS)))
    rows.repartitionByRange(parts, order.asc_nulls_last()).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")]
    files.sort(key=lambda file: int(re.match(r"part-(\d+)", file.getName()).group(1)))
    start = int(time.time() * 1000) - len(files)
    for k, file in enumerate(files):
        system.setTimes(file, start + k, -1)
    if any(system.getFileStatus(file).getModificationTime() != start + k for k, file in enumerate(files)):
        raise OSError(f"{path} keeps no times of files, so a stream would not read them in order")


def landed(spark: SparkSession, schema, path: str) -> DataFrame:
    """The files that `land` wrote as a stream, one a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
