"""Candles of a vendor as a Spark data source: one partition for each symbol and request window.

A request runs in a task, with its retries; what fails is a row, not an end of the job. The vendor's client is
a function (symbol, start, stop, interval) that gives rows of stamp, open, high, low, close and volume; it is
sent to the tasks. A task that is run again asks the vendor again, so an ingestion run writes what it was told once and
works on that.
"""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import date

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidebook.runtime import ship_package
from tidebook.sources.vendors import Retrying, TransientError, candles_to_bars, windows

Client = Callable[[str, date, date, str], Iterable[tuple]]
FORMAT = "tidebook_candles"
#: A request's answer is a row with seq 0, and the error where it failed; its candles follow with seq from 1.
ROW = "symbol string, start date, stop date, seq int, stamp string, open double, high double, low double, close double, volume double, error string"


class Request(InputPartition):
    def __init__(self, symbol: str, start: date, stop: date):
        self.symbol, self.start, self.stop = symbol, start, stop


class CandleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.symbols = json.loads(options["symbols"])
        self.start, self.stop = (date.fromisoformat(options[k]) for k in ("start", "stop"))
        self.interval = options["interval"]
        self.client, self.retry = options["client"], json.loads(options["retry"])

    def partitions(self) -> list[Request]:
        return [Request(s, a, b) for s in self.symbols for a, b in windows(self.start, self.stop, self.interval)]

    def read(self, request: Request) -> Iterator[tuple]:
        client = cloudpickle.loads(base64.b64decode(self.client))
        again = Retrying(**self.retry, sleep=time.sleep)
        key = (request.symbol, request.start, request.stop)
        nothing = (None,) * 6
        try:
            found = again(lambda: list(client(*key, self.interval)))
            rows = [(*key, k, None if c[0] is None else str(c[0]), *[None if x is None else float(x) for x in c[1:6]], None) for k, c in enumerate(found, 1)]
        except (TransientError, LookupError, PermissionError, ValueError, RuntimeError, OSError) as e:
            yield (*key, 0, *nothing, str(e) or type(e).__name__)
        else:
            yield (*key, 0, *nothing, None)
            yield from rows


class CandleSource(DataSource):
    """Options: symbols and retry (JSON), start, stop, interval, client (pickled, base64)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> CandleReader:
        return CandleReader(self.options)


def candles(
    spark: SparkSession, client: Client, symbols: list[str], start: date, stop: date, interval: str = "1d", attempts: int = 3, backoff: float = 0.5
) -> DataFrame:
    """Answers and candles of all symbols over a window, both ends included; each read asks the vendor."""
    if start > stop:
        raise ValueError(f"window starts {start} after it stops {stop}")
    ship_package(spark)
    spark.dataSource.register(CandleSource)
    options = {
        "symbols": json.dumps(sorted(set(symbols))),
        "start": start.isoformat(),
        "stop": stop.isoformat(),
        "interval": interval,
        "client": base64.b64encode(cloudpickle.dumps(client)).decode(),
        "retry": json.dumps({"attempts": attempts, "backoff": backoff}),
    }
    return spark.read.format(FORMAT).options(**options).load()


def ingest(fetched: DataFrame, path: str, interval: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, rejects and a report of fetched candles, which are written to `path` by one job, however many symbols there are.

    The report has a row per symbol: rows, requests, failed requests and the first failure, which is 'vendor returned no
    bars' where all requests were answered by nothing. A symbol with a failure gives no bars.
    """
    spark = fetched.sparkSession
    fetched.write.parquet(path)
    held = spark.read.schema(fetched.schema).parquet(path)
    told = held.groupBy("symbol").agg(
        F.count(F.when(F.col("seq") > 0, 1)).alias("rows"),
        F.count(F.when(F.col("seq") == 0, 1)).alias("requests"),
        F.count("error").alias("failed"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("start"))).alias("failure"),
    )
    report = told.withColumn("failure", F.when((F.col("rows") == 0) & F.col("failure").isNull(), "vendor returned no bars").otherwise(F.col("failure")))
    sound = held.where("seq > 0").join(report.where("failure IS NULL").select("symbol"), "symbol", "left_semi")
    rank = F.struct("start", "seq").alias("seq")
    bars, bad = candles_to_bars(sound.select("symbol", rank, "stamp", "open", "high", "low", "close", "volume"), interval, now)
    return bars, bad, report
