"""Journals: append-only JSON lines, read back with tolerance for torn ones."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import schema


@dataclass
class JournalSink:
    """Appends one line per event as it happens; a failed write is remembered, never thrown."""

    path: str
    problems: list[str] = field(default_factory=list)

    def record(self, **event) -> None:
        try:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps(event, default=str) + "\n")
        except OSError as e:
            self.problems.append(str(e))


@dataclass
class StreamJournal:
    """The body of a foreachBatch sink: appends the events of a stream as JSON lines, each batch once.

    A batch is a folder named by its number and is written over when the stream repeats it, as it
    does after a crash between the write and its commit. What fails while a batch is
    written is remembered with its number, never thrown, and the stream goes on; `lost_batches`
    finds such batches later, in any process. With `strict` it is thrown as well, so
    that the stream stops and its next start repeats the batch. A symbol's lines of a batch stand in one
    file in the order of `order`; without an order they stay as they come.
    """

    path: str
    order: tuple[str, ...] = ()
    strict: bool = False
    problems: list[tuple[int, str]] = field(default_factory=list)

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        if self.order:
            events = events.repartition("symbol").sortWithinPartitions("symbol", *self.order)
        lines = events.select(F.to_json(F.struct("*")).alias("value"))
        try:
            lines.write.mode("overwrite").text(f"{self.path}/batch={batch_id:012d}")
        except (PySparkException, Py4JJavaError, OSError) as e:
            self.problems.append((batch_id, str(e).split("\n")[0]))
            if self.strict:
                raise


def lost_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of batches of a stream's journal that were not written whole, up to the last one that was.

    A whole batch has a marker file, even if it has no lines. This lists folders and reads no lines;
    batches lost after the last whole one are known to the running sink alone.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "batch=*/_SUCCESS"))
    whole = {int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found or ()}
    return [k for k in range(max(whole, default=-1)) if k not in whole]


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Entries of a journal with their fields and place (line: file, block, number in it), and the number of lines that are torn."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", place.alias("line")).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}
    kind = schema.T.StructType([*schema.JOURNAL.fields, schema.T.StructField("_torn", schema.T.StringType())])
    parsed = lines.select(F.from_json("value", kind, options).alias("e"), "line").select("e.*", "line")
    torn = F.col("_torn").isNotNull() | F.col("event").isNull()
    return parsed.where(~torn).drop("_torn"), parsed.where(torn).count()
