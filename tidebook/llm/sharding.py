"""Uniform shuffle into shards through a hypergeometric communication matrix.

A uniform permutation of N rows, cut into shards of fixed sizes, sends from each
partition p to each shard s a count A[p, s]; these counts follow the multivariate
hypergeometric law with the partition sizes as row sums and the shard sizes as
column sums. The operator draws that matrix first, then

1. permutes each partition locally (a rank by a seeded hash),
2. sends the first A[p, 0] ranks to shard 0, the next A[p, 1] to shard 1, ...,
3. permutes each shard (a rank by a second hash), which gives the slots.

Shard sizes are exact, at most one apart, before any row moves. Everything is
DataFrame functions; randomness comes from hashes of the seed, so reruns and
recomputed tasks agree.

Scale: neither rank sorts a whole partition or shard in one task. Both are split
into lanes, ranges of the hash whose number grows with the rows (up to 4096), and a table of lane
counts (partitions x lanes, shards x lanes rows) turns ranks within lanes into ranks
within the whole. The matrix has partitions x shards cells; one draw walks about 16 standard
deviations of its law, so the work for it grows as the square root of the rows: about
2 x 10^8 steps, well under a minute, for 2 x 10^10 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import lane_bits, let, read_table, row_digest, unit

PARTITIONS, LANE_BITS, MOST_LANE_BITS, SHARDS, SEED = 64, 6, 12, 40, 20_240_611


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """One draw of how many of `draws` rows out of `total` fall among `good`, by inversion.

    Weights follow the ratio of neighbouring probabilities, starting with 1 at the
    lower end of mean -+ 8 deviations; their sum normalises them, so no factorials
    are needed and rounding does not grow with the counts.
    """
    n, k, t = draws.cast("double"), good.cast("double"), total.cast("double")
    mean = n * k / F.greatest(t, F.lit(1.0))
    variance = mean * (1 - k / F.greatest(t, F.lit(1.0))) * (t - n) / F.greatest(t - 1, F.lit(1.0))
    reach = 8 * F.sqrt(F.greatest(variance, F.lit(0.0))) + 8
    first = F.greatest(F.lit(0), draws + good - total, F.floor(mean - reach)).cast("long")
    last = F.least(draws, good, F.ceil(mean + reach)).cast("long")

    def walk(b: Column) -> Column:
        lo, hi = b["lo"], b["hi"]
        steps = F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(F.array().cast("array<bigint>"))

        def next_weight(w: Column, x: Column) -> Column:
            x = x.cast("double")
            return w * ((b["k"] - x + 1) * (b["n"] - x + 1)) / (x * (b["t"] - b["k"] - b["n"] + x))

        summed = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("all")),
            lambda acc, x: let(
                next_weight(acc["w"], x),
                lambda w: F.struct(w.alias("w"), (acc["all"] + w).alias("all")),
            ),
        )
        return F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("w"), (summed["all"] * b["u"] - 1.0).alias("left"), lo.alias("x")),
            lambda acc, x: F.when(acc["left"] <= 0, acc).otherwise(
                let(
                    next_weight(acc["w"], x),
                    lambda w: F.struct(w.alias("w"), (acc["left"] - w).alias("left"), x.alias("x")),
                )
            ),
            lambda acc: acc["x"],
        )

    bound = F.struct(first.alias("lo"), last.alias("hi"), n.alias("n"), k.alias("k"), t.alias("t"), u.alias("u"))
    return let(bound, walk)


def communication_matrix(counts: Column, shard_sizes: Column, seed: int) -> Column:
    """Array over partitions of arrays over shards: exact counts to send.

    `counts` (rows of each partition) and `shard_sizes` are arrays of longs with
    equal sums. Each row of the matrix is a multivariate hypergeometric draw from
    what the shards still miss.
    """

    def draw_row(rest: Column, n: Column, p: Column) -> Column:
        start = F.struct(
            n.alias("draws"),
            F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
            F.array().cast("array<bigint>").alias("row"),
        )
        return F.aggregate(
            rest,
            start,
            lambda acc, good: let(
                F.when(acc["draws"] == 0, F.lit(0).cast("long"))
                .when(acc["total"] == good, acc["draws"])
                .otherwise(
                    _hypergeometric(
                        acc["total"], good, acc["draws"], unit(F.lit(seed), p, F.size(acc["row"]))
                    )
                ),
                lambda x: F.struct(
                    (acc["draws"] - x).alias("draws"),
                    (acc["total"] - good).alias("total"),
                    F.concat(acc["row"], F.array(x)).alias("row"),
                ),
            ),
            lambda acc: acc["row"],
        )

    empty = F.array().cast("array<array<bigint>>")
    return F.aggregate(
        counts,
        F.struct(shard_sizes.alias("rest"), empty.alias("rows")),
        lambda acc, n: let(
            draw_row(acc["rest"], n, F.size(acc["rows"])),
            lambda row: F.struct(
                F.zip_with(acc["rest"], row, lambda a, b: a - b).alias("rest"),
                F.concat(acc["rows"], F.array(row)).alias("rows"),
            ),
        ),
        lambda acc: acc["rows"],
    )


def _running(counts: Column) -> Column:
    """Exclusive running sums of an array of longs."""
    return F.aggregate(
        counts,
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def _dense(entries: Column, n: int) -> Column:
    """Array of n longs from a list of structs (k, n); keys without entry count 0."""
    return let(
        F.map_from_entries(entries),
        lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at(m, k), F.lit(0).cast("long"))
        ),
    )


def assign_shards(
    rows: DataFrame,
    key: list[str],
    n_shards: int = SHARDS,
    seed: int = SEED,
    partitions: int = PARTITIONS,
    bits: int | None = None,
) -> DataFrame:
    """`rows` with columns shard (int) and slot (long, gapless from 0 in each shard).

    `key` names columns that tell rows apart. Rows equal in all of them are
    interchangeable, and rows that are null there are rows like any other. An empty
    input gives an empty result. Columns of the input keep their names and values;
    its own columns named shard or slot are replaced, and names that start with
    `_ts_` are reserved. A partition has 2^bits lanes, by default by the number of rows.
    """
    bits = lane_bits(rows, LANE_BITS, MOST_LANE_BITS) if bits is None else bits
    lanes = 1 << bits
    rows = rows.drop("shard", "slot")
    named = [F.col(f"`{c}`") for c in key]
    kept = [F.col(f"`{c}`") for c in rows.columns]
    dealt = rows.select(
        *kept,
        F.pmod(F.xxhash64(F.lit(seed), *named), F.lit(partitions)).cast("int").alias("_ts_p"),
        F.xxhash64(F.lit(seed + 1), *named).alias("_ts_h"),
        F.xxhash64(F.lit(seed + 2), *named).alias("_ts_g"),
    ).withColumn("_ts_lane", F.shiftrightunsigned("_ts_h", 64 - bits).cast("int"))

    per_lane = dealt.groupBy("_ts_p", "_ts_lane").agg(F.count(F.lit(1)).alias("n"))
    per_partition = per_lane.groupBy("_ts_p").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct(F.col("_ts_lane").alias("k"), "n")).alias("by_lane")
    )
    whole = per_partition.groupBy().agg(
        F.collect_list(F.struct(F.col("_ts_p").alias("k"), "n")).alias("by_p"), F.sum("n").alias("rows")
    )
    sizes = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda s: F.floor(F.col("rows") / n_shards) + F.when(s < F.col("rows") % n_shards, 1).otherwise(0),
    )
    matrix = (
        whole.where(F.col("rows") > 0)
        .select(communication_matrix(_dense(F.col("by_p"), partitions), sizes, seed + 3).alias("m"))
        .select(F.posexplode("m").alias("_ts_p", "row"))
        .select("_ts_p", F.transform(_running(F.col("row")), lambda x: x).alias("_ts_from"))
    )
    starts = per_partition.select("_ts_p", _running(_dense(F.col("by_lane"), lanes)).alias("_ts_start"))
    # partitions rows each, a fixed parameter: bounded whatever the input
    plan = F.broadcast(matrix.join(F.broadcast(starts), "_ts_p"))

    local = Window.partitionBy("_ts_p", "_ts_lane").orderBy("_ts_h", *named)
    sent = (
        dealt.withColumn("_ts_rank", F.row_number().over(local).cast("long") - 1)
        .join(plan, "_ts_p")
        .withColumn("_ts_rank", F.col("_ts_rank") + F.element_at("_ts_start", F.col("_ts_lane") + 1))
        .withColumn("_ts_shard", F.size(F.filter("_ts_from", lambda c: c <= F.col("_ts_rank"))) - 1)
        .withColumn("_ts_lane", F.shiftrightunsigned("_ts_g", 64 - bits).cast("int"))
        .drop("_ts_from", "_ts_start", "_ts_rank", "_ts_h", "_ts_p")
    )
    offsets = (
        sent.groupBy("_ts_shard", "_ts_lane")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("_ts_shard")
        .agg(_running(_dense(F.collect_list(F.struct(F.col("_ts_lane").alias("k"), "n")), lanes)).alias("_ts_start"))
    )
    final = Window.partitionBy("_ts_shard", "_ts_lane").orderBy("_ts_g", *named)
    return (
        sent.withColumn("_ts_rank", F.row_number().over(final).cast("long") - 1)
        .join(F.broadcast(offsets), "_ts_shard")
        .select(
            *kept,
            F.col("_ts_shard").cast("int").alias("shard"),
            (F.col("_ts_rank") + F.element_at("_ts_start", F.col("_ts_lane") + 1)).alias("slot"),
        )
    )


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size and text_crc32 of documents; a null text has no bytes and the CRC-32 of the empty string."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *more,
    )


_KEY = ["doc_id", "text_crc32", "size", "source"]


def shard_documents(docs: DataFrame) -> DataFrame:
    """`docs` with shard and slot, which replace columns of these names; texts move twice, to their lane and shard.

    Rows are told apart by all their columns, so reruns and recomputed tasks agree.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = _sized(docs, F.struct(*[F.col(f"`{c}`") for c in own]).alias("_ts_row"), *row_digest(docs, ("_ts_a", "_ts_b"), own))
    return assign_shards(packed, [*_KEY, "_ts_a", "_ts_b"]).select("_ts_row.*", "shard", "slot")


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`: counts at most one apart."""
    return assign_shards(_sized(read_table(spark, sf_dir, "documents")), _KEY).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
