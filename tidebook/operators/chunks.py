"""Cutting long series into overlapping chunks, so that one symbol is not one task.

Bars are numbered without a sort of the whole series: counts per (symbol, time
bucket) give each bucket its offset, and a row number within the bucket the rest.
Chunk k holds bars k x size + 1 ... (k + 1) x size and, flagged as halo, the
`reach` bars before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(bars: DataFrame, bucket: Column) -> DataFrame:
    """`bars` with _n, the number of the bar in its symbol from 1; `bucket` must rise with time."""
    marked = bars.withColumn("_bucket", bucket)
    counts = marked.groupBy("symbol", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("symbol", "_bucket").orderBy("timestamp")
    return (
        marked.withColumn("_place", F.row_number().over(within))
        .join(offsets, ["symbol", "_bucket"])
        .withColumn("_n", (F.col("_offset") + F.col("_place")).cast("long"))
        .drop("_bucket", "_offset", "_place")
    )


def chunked(bars: DataFrame, reach: int, size: int, ahead: int = 0) -> DataFrame:
    """Numbered bars with _chunk and _halo: each chunk with `reach` bars before and `ahead` bars after it."""
    if max(reach, ahead) > size:
        raise ValueError("a halo must fit in one neighbouring chunk")
    own = F.floor((F.col("_n") - 1) / size)
    place = (F.col("_n") - 1) % size
    copies = F.array_compact(
        F.array(
            F.struct(own.alias("_chunk"), F.lit(False).alias("_halo")),
            F.when(place >= size - reach, F.struct((own + 1).alias("_chunk"), F.lit(True).alias("_halo"))),
            F.when((place < ahead) & (own > 0), F.struct((own - 1).alias("_chunk"), F.lit(True).alias("_halo"))),
        )
    )
    return bars.select("*", F.inline(copies))
