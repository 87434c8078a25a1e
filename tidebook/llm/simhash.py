"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits, and its embedding is
the vector of bit counts per segment. A differing bit changes one count by at most
one, so the Manhattan distance of two embeddings is never above the Hamming
distance of the fingerprints. The range join runs on a grid: the 32 dimensions form 8
groups of 4, embeddings within 3 differ in at most 3 groups, and so agree in at least 5.
Every fingerprint lies in one cell for each choice of 5 groups (56 of them), two
fingerprints that may link share a cell, and pairs that meet are verified on the
fingerprints themselves, in the join.

Only distinct fingerprints are joined: exact copies are one point however many
there are. A fingerprint has at most 43,744 others within 3 bits, so links grow with
the fingerprints, not with their square. Of pairs of unrelated fingerprints with even
bits some 56 x (3/8)^20, one in six million, meet in a cell: about 10^11 comparisons for
10^9 fingerprints.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import durable, join_counted, read_table, row_digest
from tidebook.llm.components import connected_components
from tidebook.runtime import ship_package

WIDTH, HASH_SEED, MAX_BITS = 3, 42, 3
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles hashed at a time, so that memory for a text stays bounded.
SLICE = 1 << 15
_ODD_BITS = 0x5555555555555555
GROUPS, AGREEING = 8, 5
#: One mask over the packed counts (a byte a group) for each choice of groups.
MASKS = tuple(sum(0xFF << (8 * g) for g in chosen) for chosen in combinations(range(GROUPS), AGREEING))


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = HASH_SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text, as a signed 64-bit number.

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, shingles keep repeats. A text
    of fewer words than `width` is one shingle; one without words (or null) has
    fingerprint zero. A bit is set if it is set in over half the shingles' XXH64.
    """
    words = (text or b"").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    hash_one = partial(xxh64, seed=seed)
    if n < width:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(width)), strict=False))
        total = n - width + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, total, SLICE):
        h = np.fromiter(map(hash_one, islice(shingles, SLICE)), np.uint64, min(SLICE, total - start))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def xxh64(data: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def fingerprints(text: Column, width: int = WIDTH, seed: int = HASH_SEED) -> Column:
    """Fingerprints (long) of whole texts."""

    ship_package()

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), width, seed) for t in texts], pa.int64())

    return prints(text.cast("binary"))


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, two bits each, packed in a long."""
    low, high = fp.bitwiseAND(F.lit(_ODD_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def fingerprint_links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in column fp that differ in at most 3 bits; a pair may come more than once."""
    if not 0 <= max_bits <= GROUPS - AGREEING:
        raise ValueError(f"{AGREEING} of {GROUPS} groups prove the range join for at most {GROUPS - AGREEING} bits")
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    # cells of two choices may look alike; that only adds pairs to verify
    placed = points.select("fp", embedding(F.col("fp")).alias("e")).select(
        "fp", F.explode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in signed])).alias("cell")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    one, other = placed.select(F.col("fp").alias("a"), "cell"), placed.select(F.col("fp").alias("b"), "cell")
    return one.join(other, "cell").where((F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, the `key` columns, fp (long), component_id and group.

    component_id is the smallest doc_id reachable over links of at most 3 bits, the
    document's own included; null ids count only where a component has no other.
    Texts without words share fingerprint zero and link like any other. Rows that
    repeat stay rows. group is a fingerprint that names the component.
    """
    key = key or []
    slim = durable(docs.select("doc_id", *key, fingerprints(F.col("text")).alias("fp")))
    points = durable(slim.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = connected_components(fingerprint_links(points)).withColumnRenamed("node", "fp")
    linked = points.join(found, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_counted(linked.select("fp", "component"), least, "component").select(
        "fp", "component_id", F.col("component").alias("group")
    )
    by_print = points.join(named, "fp", "left").select(
        "fp",
        F.when(F.col("group").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("group", "fp").alias("group"),
        "n",
    )
    # common texts share a fingerprint
    return join_counted(slim, by_print, "fp").select("doc_id", *key, "fp", "component_id", "group")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: the smallest doc_id, null ids last, then the smallest digest of all columns.

    Rows are told apart by a digest of 128 bits over all columns, so that a row goes only
    if another of its component stays, and reruns and recomputed tasks keep the same
    one. Columns stay as they are; names that start with `_td_` are reserved. Texts move
    once, to meet the kept keys.
    """
    digest = ["_td_a", "_td_b"]
    keyed = docs.select("*", *row_digest(docs, ("_td_a", "_td_b")))
    kept = near_duplicates(keyed, digest).groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *digest)).alias("k")
    )
    keys = kept.select("k._td_a", "k._td_b")
    return keyed.join(keys, digest, "left_semi").dropDuplicates(digest).drop(*digest)


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint (16 hex digits) and component_id."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
