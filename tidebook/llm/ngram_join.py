"""Exact Jaccard join of word shingle sets by adaptive multi-match prefixes.

Shingles get one global order, rare first. Of two sets with enough in common, the prefix of
n - t + l shingles of either (n: its size, t: the least overlap with any partner) holds the first l
common ones, for every l: so a set may lengthen its prefix by l - 1 and ask for l shared
shingles. Each set chooses its own l by an estimate of cost: a longer prefix meets more
rows of the index, but each candidate must use up l of them, and candidates are what is
dear, as their texts must come together. A pair is a candidate at the smaller l of the two, counted over
shingles within both prefixes of that l. A shingle that no other prefix has is in no pair, so a place in a prefix
also knows how many earlier ones can be shared at all: the j-th common shingle, j at most that number plus one,
leaves at most j and what follows it in the shorter rest. The first l common ones of a pair that links pass this
bound, so they alone count; sets with many edits of their own fail it before they meet.

The order needs no join of shingles with their frequencies: a sketch of 2^20 counters over
all texts, summed in Spark, ranks a shingle by its counter and then by its hash. Any order gives
exact results; counters only make it a good one. Equal sets are one point however many documents have
them. Candidates meet in two rounds. In the first every set of a posting list faces only the
list's set with fewest shingles that no other has, the middle of a group of near copies, which so costs as many pairs as it has
members; components follow. The second joins the lists of all shingles that still hold more than one component, and leaves
out pairs within one, which can add no link that matters. Long lists are joined in blocks.
Candidates whose sets differ too much in 256 classes of hashes, which bounds what they share, go; the others are verified
on the shingles of their whole texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidebook.llm.common import durable, join_counted, read_table, releasing
from tidebook.llm.components import connected_components
from tidebook.runtime import discard, shared_dir, ship_package

WIDTH, PER_CENT = 3, 90
MOST_MATCHES = 4
#: Bits of a counter's number; the counters' classes are broadcast, one byte each.
SKETCH_BITS = 20
#: Counters that are summed together, and the most that one of them counts in a task.
CHUNK, MOST_COUNTED = 1 << 14, (1 << 16) - 1
#: Classes per doubling of a counter.
CLASSES = 4
#: What it costs to verify a pair, in rows of the index: so much and one for as many shingles.
VERIFY_ROWS, SHINGLES_PER_ROW = 8, 16
#: Texts are split so many bytes at a time, and sets seen in a task are remembered up to a number.
SLICE_BYTES, MOST_SEEN = 1 << 19, 1 << 18
#: Rows of a posting list in one block of the second round, and pairs of one set that share a copy of its text.
BLOCK_ROWS = 2_000
#: Bits of the hash by which texts are told apart before they are joined; at most so many slots are broadcast.
SLOT_BITS = 22
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Longest word whose hash is a polynomial.
LONG_WORD = 256
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: A random number for each byte.
_BYTES = np.random.Generator(np.random.PCG64(13)).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about SLICE_BYTES, cut before white space."""
    start = 0
    while start < len(text):
        found = _SPACE.search(text, start + SLICE_BYTES)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for base in (int(_MIX[0]), pow(int(_MIX[0]), -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, lower-cased, and where they start.

    A word's hash is a polynomial in its bytes, each replaced by a random number, read off
    running sums over the block; long words, in which such a hash could be forced, have one of their own.
    """
    import xxhash

    lower = block.translate(_LOWER)
    bytes_ = np.frombuffer(lower, np.uint8)
    edge = np.ones(len(bytes_) + 2, np.int8)
    edge[1:-1] = _IS_SPACE[bytes_]
    edges = np.flatnonzero(np.diff(edge))
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(SLICE_BYTES.bit_length(), len(bytes_).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(bytes_) + 1, np.uint64)
    np.cumsum(_BYTES[bytes_] * up[: len(bytes_)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    out ^= out >> np.uint64(29)
    out *= _MIX[1]
    out ^= out >> np.uint64(32)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(lower[starts[k] : ends[k]])
    return out, starts


def _mixed(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, in order."""
    out = np.full(max(len(words) - size + 1, 0), size, np.uint64)
    for k in range(size):
        out = (out + words[k : len(words) - size + 1 + k]) * _MIX[k % 3]
        out ^= out >> np.uint64(31)
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingles_of(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct hashes (uint64) of the word shingles of each text; a text of fewer words is one shingle, no words are none.

    Short texts are hashed together, long ones in pieces.
    """
    start = 0
    while start < len(texts):
        end, size = start + 1, len(texts[start])
        while end < len(texts) and size + len(texts[end]) < SLICE_BYTES:
            size += len(texts[end]) + 1
            end += 1
        if size > SLICE_BYTES:
            words = np.concatenate([word_hashes(piece)[0] for piece in _pieces(texts[start])])
            cuts = np.array([0, len(words)])
        else:
            words, at = word_hashes(b" ".join(texts[start:end]))
            begins = np.cumsum([0] + [len(t) + 1 for t in texts[start:end]])
            cuts = np.searchsorted(at, begins)
        runs = _mixed(words, width)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield _distinct(runs[a : b - width + 1]) if b - a >= width else _mixed(words[a:b], max(b - a, 1))
        start = end


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    return next(shingles_of([text or b""], width))


def shingle_set(text: bytes | None, width: int = WIDTH) -> frozenset[bytes]:
    """The shingles themselves."""
    words = (text or b"").translate(_LOWER).split()
    if len(words) < width:
        return frozenset([b" ".join(words)] if words else [])
    return frozenset(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


@lru_cache(maxsize=4)
def _held_set(text: bytes, width: int) -> frozenset[bytes]:
    """The same, for sets with many partners, whose text stands beside each of them."""
    return shingle_set(text, width)


def least_overlap(n: int, per_cent: int = PER_CENT) -> int:
    """Shingles that a set of n has in common with any partner, at least."""
    return -(-per_cent * n // 100)


def matches_asked(partners: np.ndarray, base: int, n: int, most: int = MOST_MATCHES) -> int:
    """How many shared shingles make a candidate cheapest, from the estimated partners of the shingles in order.

    With l matches the index rows met are those of the first base + l - 1 shingles, and at most one in l
    of them is a candidate.
    """
    met = np.cumsum(partners[: base + most - 1])[base - 1 :]
    if not len(met) or met[0] == 0:
        return 1
    l = np.arange(1, len(met) + 1)
    return int(np.argmin(met * (1 + (VERIFY_ROWS + n / SHINGLES_PER_ROW) / l))) + 1


def _class_of(counts: np.ndarray) -> np.ndarray:
    return np.ceil(CLASSES * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """Per document: doc_id, tkey (of its text), n, hi, lo and spread (of its set); and rows of counters: chunk, and its counts as packed 16-bit numbers.

    spread counts a set's shingles in 256 classes of their hash, a byte each; it is null where one has more than 255.
    """
    kind = docs.schema["doc_id"].dataType
    schema = StructType(
        [StructField("doc_id", kind), StructField("tkey", StringType())]
        + [StructField(c, LongType()) for c in ("n", "hi", "lo", "chunk")]
        + [StructField(c, BinaryType()) for c in ("counts", "spread")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, digests, buckets, spreads = [], [], [], []
            for h in shingles_of(batch.column("text").to_pylist(), width):
                n.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                buckets.append(h >> np.uint64(64 - SKETCH_BITS))
                spread = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256)
                spreads.append(spread.astype(np.uint8).tobytes() if spread.max() < 256 else None)
            if not n:
                continue
            counts += np.bincount(np.concatenate(buckets).astype(np.int64), minlength=len(counts))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            nothing = (pa.nulls(len(n), t) for t in (pa.int64(), pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), *nothing, pa.array(spreads, pa.binary())],
                names=schema.names,
            )
        chunks = np.minimum(counts, MOST_COUNTED).astype("<u2").reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(1))
        packed = pa.array([zlib.compress(chunks[k].tobytes(), 1) for k in used], pa.binary())
        ids, keys, nothing, spreads = (pa.nulls(len(used), t) for t in (_arrow(kind), pa.string(), pa.int64(), pa.binary()))
        yield pa.RecordBatch.from_arrays([ids, keys, nothing, nothing, nothing, pa.array(used), packed, spreads], names=schema.names)

    return docs.mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _classes(survey: DataFrame) -> tuple[np.ndarray, float]:
    """The class of each counter, and the mean of the counters. One byte for each of 2^SKETCH_BITS counters reaches the driver."""

    def total(rows: pa.Table) -> pa.Table:
        sums = np.zeros(CHUNK, np.int64)
        for packed in rows.column("counts"):
            sums += np.frombuffer(zlib.decompress(packed.as_py()), "<u2")
        return pa.table({"chunk": rows.column("chunk")[:1], "classes": [_class_of(sums).tobytes()], "total": [int(sums.sum())]})

    rows = survey.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(total, "chunk long, classes binary, total long").collect()
    classes = np.zeros((-(-(1 << SKETCH_BITS) // CHUNK), CHUNK), np.uint8)
    for row in rows:
        classes[row.chunk] = np.frombuffer(row.classes, np.uint8)
    return classes.ravel(), sum(row.total for row in rows) / classes.size


def _postings(docs: DataFrame, classes: Broadcast, mean: float, width: int, per_cent: int, most: int) -> DataFrame:
    """Prefix shingles of sets that can have a partner: token, hi, lo, fact. A set may come more than once.

    fact packs n (from bit 32), the place in the prefix (28 bits from bit 4) and the matches asked (4 bits).
    """
    if most > 15:
        raise ValueError("at most 15 matches can be asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held, seen = classes.value, set()
        expect = np.maximum(2.0 ** (np.arange(256) / CLASSES) - mean - 1, 0)
        for batch in batches:
            tokens, facts, digests = [], [], []
            for h in shingles_of(batch.column("text").to_pylist(), width):
                n = len(h)
                # a set that no other size can join is linked with equal ones alone
                if 100 * n < per_cent * (n + 1) and least_overlap(n, per_cent) == n:
                    continue
                digest = xxhash.xxh3_128_digest(h.tobytes())
                if digest in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(digest)
                rank = held[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                base = n - least_overlap(n, per_cent) + 1
                upto = min(n, base + most - 1)
                order = np.lexsort((h, rank))[:upto]
                asked = matches_asked(expect[rank[order]], base, n, min(most, least_overlap(n, per_cent)))
                order = order[: base + asked - 1]
                tokens.append(h[order].view(np.int64))
                facts.append((n, asked, len(order)))
                digests.append(digest)
            if not tokens:
                continue
            repeats = np.array([f[2] for f in facts])
            both = np.repeat(np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), repeats, axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens)),
                    *[pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)],
                    pa.array(
                        (np.repeat(np.array([f[0] << 32 | f[1] for f in facts], np.int64), repeats))
                        | np.concatenate([np.arange(1, r + 1, dtype=np.int64) << 4 for r in repeats])
                    ),
                ],
                names=["token", "hi", "lo", "fact"],
            )

    return docs.mapInArrow(run, "token long, hi long, lo long, fact long")


def _set_id() -> Column:
    return F.unhex(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))).alias("d")


def _may_match(per_cent: int) -> Column:
    """Of a shingle that sets a and b share: whether it counts, by length, position, and the matches asked.

    It is their j-th in common for a j of at most the matches asked, if it counts, and at most
    one more than the earlier ones of either that any other prefix has.
    """

    def level(side: str) -> Column:
        base = F.floor((F.lit(100 - per_cent) * F.col(f"{side}.n")) / 100)
        return F.greatest(F.lit(1), F.col(f"{side}.pos") - base)

    both = F.col("a.n") + F.col("b.n")
    needed = F.ceil(F.lit(per_cent) * both / (100 + per_cent))
    asked = F.least("a.asked", "b.asked")
    common = F.least(asked, F.col("a.earlier") + 1, F.col("b.earlier") + 1)
    reach = common + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (reach >= needed) & (F.greatest(level("a"), level("b")) <= asked)


def _candidates(met: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of set ids (a, b) with as many counting shingles as asked, from rows with structs a and b."""
    return (
        met.where(_may_match(per_cent))
        .groupBy(F.col("a.d").alias("a"), F.col("b.d").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("a.asked", "b.asked")).alias("asked"))
        .where("shared >= asked")
        .select("a", "b")
    )


class Scratch:
    """Tables of one run in a folder of their own that all executors share; what is not needed any more goes at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, f"{self.folder}/{name}")


_CARRIED = ("d", "n", "pos", "asked", "earlier")


def _placed(hits: DataFrame) -> DataFrame:
    """Rows of the index with `earlier`, their set's rows before them, and `own`, its prefix shingles before the last row that no other prefix has."""
    of_set = Window.partitionBy("d")
    return hits.withColumns({"earlier": F.row_number().over(of_set.orderBy("pos")) - 1, "own": F.max("pos").over(of_set) - F.count(F.lit(1)).over(of_set)})


def _star(hits: DataFrame, per_cent: int) -> DataFrame:
    """Candidates between each set and the set of a posting list that has fewest shingles of its own."""
    centres = hits.groupBy("token").agg(F.min(F.struct("own", *_CARRIED)).alias("a"), F.count(F.lit(1)).alias("n"))
    met = join_counted(hits.select("token", F.struct(*_CARRIED).alias("b")), centres, "token")
    return _candidates(met.where("a.d <> b.d"), per_cent)


def _others(hits: DataFrame, labels: DataFrame, per_cent: int, block_rows: int, scratch: Scratch) -> DataFrame:
    """Candidates between sets of different components."""
    named = scratch.put(
        "named",
        hits.join(labels.select(F.col("node").alias("d"), "component"), "d", "left").withColumn(
            "component", F.coalesce("component", "d")
        ),
    )
    open_ = named.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("first"), F.max("component").alias("last")
    ).where("first <> last")
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    rows = scratch.put(
        "open",
        join_counted(named, open_.select("token", "n", parts.alias("parts")), "token").select(
            "token", "parts", F.struct(*_CARRIED, "component").alias("row")
        ),
    )
    own = F.pmod(F.xxhash64("row.d"), F.col("parts")).cast("int")
    one = rows.select("token", own.alias("block"), F.col("row").alias("a"))
    other = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.col("row").alias("b"))
    met = one.join(other, ["token", "block"]).where((F.col("a.d") < F.col("b.d")) & (F.col("a.component") != F.col("b.component")))
    return _candidates(met, per_cent)


def most_in_common(one: pa.Array, other: pa.Array) -> pa.Array:
    """An upper bound of the shingles that two sets share, from their spreads; null where one is null."""
    known = pc.and_(pc.is_valid(one), pc.is_valid(other))
    a, b = (np.frombuffer(b"".join(x.filter(known).to_pylist()), np.uint8).reshape(-1, 256) for x in (one, other))
    out = np.zeros(len(one), np.int64)
    out[known.to_numpy(zero_copy_only=False)] = np.minimum(a, b).sum(1, dtype=np.int64)
    return pc.if_else(known, pa.array(out), pa.nulls(len(one), pa.int64()))


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, width: int, per_cent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose whole texts link."""

    @F.arrow_udf("boolean")
    def linked(one: pa.Array, other: pa.Array) -> pa.Array:
        hashes = map(shingles_of, (one.to_pylist(), other.to_pylist()), (width, width))
        out = []
        for x, y, a, b in zip(one, other, *hashes, strict=True):
            common = len(a) + len(b) - len(_distinct(np.concatenate([a, b])))
            if 100 * common >= per_cent * (len(a) + len(b) - common):
                a, b = _held_set(x.as_py(), width), _held_set(y.as_py(), width)
                common = len(a & b)
            out.append(100 * common >= per_cent * (len(a) + len(b) - common))
        return pa.array(out, pa.bool_())

    @F.arrow_udf("long")
    def most(one: pa.Array, other: pa.Array) -> pa.Array:
        return most_in_common(one, other)

    # sets have in common at most what their classes have, so most pairs need no texts
    pairs = scratch.put(f"{name}-met", pairs)
    facts = members.select("d", F.col("n_shingles").alias("size"), "spread")
    one = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(facts.withColumnsRenamed({"d": "a", "size": "na", "spread": "sa"}), "a")
    both = join_counted(pairs, one, "a").join(facts.withColumnsRenamed({"d": "b", "size": "nb", "spread": "sb"}), "b")
    needed = F.ceil(F.lit(per_cent) * (F.col("na") + F.col("nb")) / (100 + per_cent))
    pairs = scratch.put(f"{name}-pairs", both.where(F.coalesce(most("sa", "sb") >= needed, F.lit(True))).select("a", "b"))
    ids = pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))).distinct()
    wanted = scratch.put(f"{name}-wanted", ids.join(members.select("d", "tkey"), "d"))
    # of the texts that nothing asks for, all but a few stay where they are
    slot = F.pmod(F.xxhash64("tkey"), F.lit(1 << SLOT_BITS)).alias("slot")
    near = docs.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")
    texts = scratch.put(f"{name}-texts", near.join(wanted, "tkey").select("d", "text").dropDuplicates(["d"]))
    # a set with many candidates has its text on several tasks
    shares = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    shares = durable(shares)
    dealt = join_counted(pairs, shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    copies = texts.withColumnsRenamed({"d": "a", "text": "one"}).join(shares.select("a", "parts"), "a").select(
        "a", "one", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    held = dealt.join(texts.withColumnsRenamed({"d": "b", "text": "other"}), "b").join(copies, ["a", "part"])
    found = durable(held.where(linked("one", "other")).select("a", "b"))
    scratch.drop(f"{name}-met", f"{name}-pairs", f"{name}-wanted", f"{name}-texts")
    return found


def _similar_sets(
    docs: DataFrame, width: int, per_cent: int, most_matches: int, block_rows: int
) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    body = F.coalesce("text", F.lit("")).cast("binary")
    read = docs.select("doc_id", body.alias("text"), F.md5(body).alias("tkey"))
    scratch = Scratch(spark)
    survey = scratch.put("survey", _survey(read, width))
    slim = survey.where("n is not null").select("doc_id", "tkey", F.col("n").alias("n_shingles"), "spread", F.when(F.col("n") > 0, _set_id()).alias("d"))
    members = scratch.put(
        "members",
        slim.where("d is not null").groupBy("d").agg(
            F.min("doc_id").alias("least"), F.min("tkey").alias("tkey"), F.count(F.lit(1)).alias("n"),
            F.min("n_shingles").alias("n_shingles"), F.min("spread").alias("spread"),
        ),
    )
    classes, mean = _classes(survey)
    held = spark.sparkContext.broadcast(classes)
    postings = scratch.put("postings", _postings(read.select("text"), held, mean, width, per_cent, most_matches))
    # one half of a set's digest tells lists of one set from others, but once in 2^64
    shared = postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("rows"), F.min("hi").alias("first"), F.max("hi").alias("last")
    ).where("first <> last")
    fact = F.col("fact")
    hits = (
        join_counted(postings, shared.select("token", "rows"), "token", "rows")
        .select(
            "token",
            _set_id(),
            F.shiftright(fact, 32).alias("n"),
            F.shiftright(fact, 4).bitwiseAND(F.lit((1 << 28) - 1)).cast("int").alias("pos"),
            fact.bitwiseAND(F.lit(15)).cast("int").alias("asked"),
        )
        .dropDuplicates(["token", "d"])
    )
    hits = scratch.put("hits", _placed(hits))
    scratch.drop("postings")
    texts = read.select("tkey", "text")
    near = _verified(_star(hits, per_cent), members, texts, width, per_cent, scratch, "near")
    labels = connected_components(near)
    rest = _verified(_others(hits, labels, per_cent, block_rows, scratch), members, texts, width, per_cent, scratch, "rest")
    scratch.drop("hits", "named", "open")
    # what is new joins components, so the smaller graph of their labels is enough
    named = labels.withColumnRenamed("node", "d")
    links = rest
    for side in ("a", "b"):
        links = links.join(named.withColumnsRenamed({"d": side, "component": "to"}), side, "left").withColumn(
            side, F.coalesce("to", side)
        ).drop("to")
    joined = connected_components(links.select("a", "b")).withColumnsRenamed({"node": "inner", "component": "outer"})
    group = members.join(named, "d", "left").withColumn("inner", F.coalesce("component", "d")).join(joined, "inner", "left")
    group = durable(group.select("d", "least", "n", F.coalesce("outer", "inner").alias("group")))
    smallest = group.groupBy("group").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_set = join_counted(group.select("d", "group", F.col("n").alias("rows")), smallest, "group").select("d", "component_id", "rows")
    found = join_counted(slim.where("d is not null"), by_set, "d", "rows").select(
        "doc_id", "n_shingles", "component_id", F.hex("d").alias("set_id")
    )
    alone = slim.where("d is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.hex("d").alias("set_id"))
    return found.unionByName(alone)


def similar_sets(
    docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT, most_matches: int = MOST_MATCHES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, set_id.

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, a set holds the distinct shingles of `width`
    words (fewer words: all as one), and sets link from `per_cent` per cent of their union. component_id
    is the smallest doc_id reachable over links; null ids count only where a component
    has no other. Null and empty texts have no shingles, no set_id and no links. Repeated rows stay; other
    columns are not read.
    """
    if not 1 <= width <= 3 or not 50 <= per_cent <= 100 or most_matches < 1:
        raise ValueError("shingles have 1 to 3 words, sets link from 50 to 100 per cent, and a match is asked at least")
    with releasing(docs.sparkSession):
        return _similar_sets(docs, width, per_cent, most_matches, block_rows)


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their set and their component."""
    return similar_sets(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def oracle() -> str:
    """All pairs that share a shingle, counted, and components by a recursion over links of distinct sets."""
    return r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
            FROM w
        ), d AS (
            SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS k FROM s
        ), u AS (SELECT doc_id AS k, len(s) AS n, unnest(s) AS g FROM s WHERE doc_id IN (SELECT k FROM d)),
        r AS (SELECT u.* FROM u JOIN (SELECT g FROM u GROUP BY g HAVING count(*) > 1) USING (g)),
        l AS (
            SELECT a.k AS a, b.k AS b
            FROM r a JOIN r b ON a.g = b.g AND a.k <> b.k AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY a.k, b.k, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
        ), c AS (
            SELECT DISTINCT k, k AS m FROM d
            UNION
            SELECT l.b, c.m FROM c JOIN l ON l.a = c.k WHERE c.m < l.b
        )
        SELECT d.doc_id, d.n::BIGINT AS n_shingles, least(min(c.m), min(d.k)) AS component_id
        FROM d JOIN c USING (k) GROUP BY d.doc_id, d.n
    """
