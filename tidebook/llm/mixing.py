"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

Words are dealt in blocks of equal size. The blocks of the mix are seats, the
targets of the sources are votes, and seats go to the highest quotients
target / (2k + 1). The method is house-monotone, so the seats of the first j
output shards are the apportionment of a smaller house and differences between
neighbouring houses are integer quotas per shard.

Each source then lays its documents in a seeded order on a circle of words and its
blocks are the next arcs from a seeded start. Because the order is random, an arc
is a random choice of documents, all but the documents at its two ends are taken
whole, and a source that must be repeated simply goes round again.

Scale: seats are not listed. A lower bound on every quota comes from the divisor
(seats - sources/2) / votes, and only the at most 2 x sources seats above the
bounds compete by quotient; one task holds a few numbers a source, which some ten million
sources fit. Places on the circle are running sums within (source, lane) groups plus a table
of lane totals; lanes are ranges of the seeded hash and their number grows with the
rows, so that no task ever sees a whole source and the result does not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import SPACE_CLASS, WORD_CLASS, count_words, durable, lane_bits, let, read_table, row_digest, unit

WEIGHTS, SHARE, CEILING = (5, 2, 1), 1.5, 2
LANE_BITS, SHARDS, SEED = 8, 8, 7_130_417
#: A block is a power of two of words, at most so many, and at most 1/128 of the smallest target.
BLOCK, FINENESS = 1024, 128


def source_targets(
    totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING
) -> DataFrame:
    """Target words of each source, from columns source and source_size.

    Sources in code-point order, null last, get the weights in turn. `share` of all
    words is dealt by weight; a target stops at `ceiling` times its source's size
    and the excess goes to the others by weight until none is above. In the
    end every target is min(ceiling x size, level x weight), and the level follows
    from one pass over the sources in order of ceiling x size / weight.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = totals.withColumn("n", F.row_number().over(ordered) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    )
    rising = Window.orderBy("fill", "n")
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("cap", F.col("source_size") * float(ceiling))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(everything) * float(share))
        .withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    )
    # the water level stands at the first source that does not fill up
    level = F.coalesce(
        F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "n", "level"))).over(everything)["level"],
        F.max("fill").over(everything),
    )
    return levels.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select(
        "source", "source_size", "weight", "n", "target"
    )


def apportion(targets: DataFrame, n_shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """Adds block (words) and edges: blocks of the source that end with each shard, from 0."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    fine = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(least / FINENESS, F.lit(1.0)))))
    blocks = targets.withColumn("block", F.least(F.coalesce(fine, F.lit(1.0)), F.lit(float(block))).cast("long"))
    votes = F.sum("target").over(everything)
    seats = F.round(votes / F.col("block"))
    house = (
        blocks.withColumn("votes", votes)
        .withColumn("seats", seats)
        .withColumn("sources", F.count(F.lit(1)).over(everything))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
        .withColumn("house", F.floor(F.col("seats") * F.col("shard") / n_shards))
    )

    def quota(slack: Column) -> Column:
        """Quotients above a divisor's: seats that are certain for a house smaller by slack."""
        at = F.col("target") * F.greatest(F.col("house") + slack, F.lit(0.0)) / F.col("votes")
        return F.when(F.col("votes") > 0, F.floor(at + 0.5)).otherwise(F.lit(0)).cast("long")

    of_shard = Window.partitionBy("shard")
    bounds = (
        house.withColumn("low", quota(-F.col("sources") / 2.0))
        .withColumn("high", quota(F.col("sources") / 2.0 + 1))
        .withColumn("missing", F.col("house") - F.sum("low").over(of_shard))
    )
    by_quotient = Window.partitionBy("shard").orderBy(F.desc("quotient"), "n", "seat")
    won = (
        bounds.where("high > low")
        .withColumn("seat", F.explode(F.sequence(F.col("low"), F.col("high") - 1)))
        .withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1))
        .withColumn("place", F.row_number().over(by_quotient))
        .where("place <= missing")
        .groupBy("shard", "n")
        .agg(F.count(F.lit(1)).alias("more"))
    )
    return (
        bounds.join(won, ["shard", "n"], "left")
        .withColumn("blocks", F.col("low") + F.coalesce("more", F.lit(0)))
        .groupBy("n", "source", "source_size", "weight", "target", "block")
        .agg(F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("e"))
        .withColumn("edges", F.transform("e", lambda x: x["blocks"]))
        .drop("e")
    )


def _covered(reach: Column, at: Column, size: Column, circle: Column) -> Column:
    """Words of [at, at + size) under the first `reach` words round the circle, laps counted."""
    rest = reach % circle
    over = F.greatest(at + size - circle, F.lit(0))
    lap = F.least(rest, F.least(at + size, circle)) - F.least(rest, at) + F.least(rest, over)
    return F.floor(reach / circle) * size + lap


def mix(
    docs: DataFrame,
    size: Column,
    key: list[str],
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
    n_shards: int = SHARDS,
    block: int = BLOCK,
    bits: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """`docs` with size, source_size, target, taken, shard_words, offset and reach.

    taken counts the words of the document in the mix, repeats included, and never
    exceeds `ceiling` x size; shard_words splits it by output shard. offset is the
    document's place after its source's start and reach the words the source takes,
    both on the source's circle. Null sources are a source of their own; documents
    without words take none; no rows give no rows. `key` tells rows apart, rows
    equal in it are interchangeable. A source has 2^bits lanes, by default by the number of
    rows. Input columns of the added names are replaced.
    """
    bits = lane_bits(docs, LANE_BITS) if bits is None else bits
    added = ["size", "source_size", "target", "taken", "shard_words", "offset", "reach"]
    columns = [c for c in docs.columns if c not in added]
    named = [F.col(f"`{c}`") for c in key]
    # a key without nulls, so that lanes, sums and joins share one partitioning
    source_key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    laid = docs.withColumn("size", size.cast("long")).select(
        *[F.col(f"`{c}`") for c in columns],
        "size",
        source_key.alias("_tm_key"),
        F.xxhash64(F.lit(seed), *named).alias("_tm_h"),
    ).withColumn("_tm_lane", F.shiftrightunsigned("_tm_h", 64 - bits).cast("int"))

    per_lane = durable(
        laid.groupBy("_tm_key", "source", "_tm_lane").agg(F.sum("size").alias("lane_size"))
    )
    totals = per_lane.groupBy("_tm_key", "source").agg(F.sum("lane_size").alias("source_size"))
    seats = apportion(source_targets(totals.drop("_tm_key"), weights, share, ceiling), n_shards, block)
    circle = F.greatest(F.col("source_size"), F.lit(1))
    cap = F.col("source_size") * ceiling
    by_source = seats.select(
        source_key.alias("_tm_key"),
        "source_size",
        "target",
        F.transform("edges", lambda e: F.least(e * F.col("block"), cap.cast("long"))).alias("_tm_edges"),
        F.floor(unit(F.lit(seed + 1), source_key) * circle).alias("_tm_start"),
    )
    before = Window.partitionBy("_tm_key").orderBy("_tm_lane").rowsBetween(Window.unboundedPreceding, -1)
    lane_plan = (
        per_lane.select("_tm_key", "_tm_lane", F.coalesce(F.sum("lane_size").over(before), F.lit(0)).alias("_tm_before"))
        .join(by_source, "_tm_key")
    )
    within = (
        Window.partitionBy("_tm_key", "_tm_lane")
        .orderBy("_tm_h", *named)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        laid.withColumn("_tm_at", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(lane_plan, ["_tm_key", "_tm_lane"])
        .withColumn(
            "offset", F.pmod(F.col("_tm_at") + F.col("_tm_before") - F.col("_tm_start"), circle).cast("long")
        )
        .withColumn("reach", F.element_at("_tm_edges", -1))
    )
    here = [F.col("offset"), F.col("size"), circle]
    until = F.transform("_tm_edges", lambda e: _covered(e, *here).cast("long"))
    return placed.withColumn("_tm_until", until).select(
        *[F.col(f"`{c}`") for c in columns],
        "size",
        "source_size",
        "target",
        F.element_at("_tm_until", -1).alias("taken"),
        F.zip_with(
            "_tm_until",
            F.concat(F.array(F.lit(0).cast("long")), F.slice("_tm_until", 1, n_shards - 1)),
            lambda b, a: b - a,
        ).alias("shard_words"),
        "offset",
        "reach",
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: one row for each lap that takes words of a document.

    A lap that takes all words repeats the row as it is. The lap that ends within a
    document takes its leading or trailing words, or both, with the white space around
    them, and n_chars follows where it exists. At most two documents of a source are cut.
    Columns keep their names, whatever those are. Rows are told apart by all their
    columns, so reruns and recomputed tasks cut the same ones.
    """
    packed = docs.select(
        F.struct("*").alias("_tm_row"),
        "doc_id",
        "source",
        count_words(F.col("text")).alias("n"),
        *row_digest(docs, ("_tm_a", "_tm_b")),
    )
    mixed = mix(packed, F.col("n"), ["doc_id", "n", "_tm_a", "_tm_b"])
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("reach") - 1) / F.col("source_size")).cast("int")),
        lambda lap: F.least(F.col("reach") - lap * F.col("source_size"), F.col("source_size")),
    )
    at, size, circle, rest = F.col("offset"), F.col("size"), F.col("source_size"), F.col("rest")
    head = F.greatest(F.least(rest, F.least(at + size, circle)) - at, F.lit(0))
    front = F.least(circle - at, size)  # words before the circle closes
    tail = F.least(rest, F.greatest(at + size - circle, F.lit(0)))
    words = F.regexp_extract_all("_tm_row.text", F.lit(f"{SPACE_CLASS}*{WORD_CLASS}+{SPACE_CLASS}*"), F.lit(0))
    cut = let(
        words,
        lambda w: F.array_join(
            F.concat(
                F.slice(w, F.lit(1), F.col("head").cast("int")),
                F.slice(w, (front + 1).cast("int"), F.col("tail").cast("int")),
            ),
            "",
        ),
    )
    taken = (
        mixed.where("taken > 0")
        .withColumn("rest", F.explode(pieces))
        .withColumn("head", head)
        .withColumn("tail", tail)
        .where("head + tail > 0")
        .withColumn("cut", F.when(F.col("head") + F.col("tail") < size, cut))
    )
    values = {c: F.col(f"_tm_row.`{c}`") for c in docs.columns}
    values["text"] = F.coalesce("cut", values["text"])
    if "n_chars" in values:
        values["n_chars"] = F.coalesce(F.char_length("cut").cast("long"), values["n_chars"])
    return taken.select(*[v.alias(c) for c, v in values.items()])


def op2_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", count_words(F.col("text")).alias("n")
    )
    return mix(docs, F.col("n"), ["doc_id", "n"]).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "shard_words"
    )
