"""Benchmark decontamination by greedy string tiling.

Words are compared without case, punctuation and marks, by Unicode category. A text is joined to the benchmark
on shared seeds: Karp-Rabin hashes over runs of `least` words. For each item that it
shares seeds with, tiles are marked greedily: the longest match of unmarked words
first, then the next, with marked words never used twice, until no match of `least`
words is left. Coverage is the share of the item's words under tiles; it does not
depend on the order of the tiles in the text, so a passage whose sentences were
moved is caught like one copied in order. An item of fewer than `least` words is found
where all its words stand in a row.

Scale: documents stay where they are, there is no shuffle, and one pass over them meets
the whole benchmark. It travels to the workers as broadcasts of bounded bytes each (its
size is summed first; a larger benchmark means more of them), which the driver makes one
after another from a partition at a time; a worker holds at most HELD_BLOCKS of them ready,
and makes each of the others once for every GROUP_BYTES of texts.
Within a text, everything but the
matches themselves is vectorised; matches of one (text, item) are kept as diagonal
runs, and where their seeds would outgrow memory the runs come from a scan of the item
that holds one row of positions at a time.
"""

from __future__ import annotations

import heapq
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import read_table
from tidebook.runtime import ship_package

LEAST_WORDS, COVERAGE = 5, 0.5
#: UTF-8 bytes of the items of one block; seeds of one (text, item) that are held at once.
BLOCK_BYTES, MOST_SEEDS = 16 << 20, 2_000_000
#: Blocks that a worker process keeps ready.
HELD_BLOCKS = 4
#: Bytes of texts that meet a block together where there are more.
GROUP_BYTES = 128 << 20
#: Words of documents that are looked up together.
BATCH_WORDS = 1 << 18
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15

Runs = list[tuple[int, int, int]]


class _Folded(dict):
    """What a character becomes in words: itself if it is a letter or digit, nothing if it is a mark, else a space."""

    def __missing__(self, code: int) -> int | str | None:
        kind = unicodedata.category(chr(code))[0]
        self[code] = code if kind in "LN" else None if kind == "M" else " "
        return self[code]


_KINDS = _Folded()


def words_of_bytes(text: bytes | None) -> list[bytes]:
    """Words of letters and digits of a UTF-8 text, with case and accents folded; bytes that are no UTF-8 separate words."""
    text = text or b""
    if text.isascii():
        return text.translate(_FOLD).split()
    # letters come apart from their marks, and the marks go
    plain = unicodedata.normalize("NFKD", text.decode("utf-8", "replace")).casefold()
    return plain.translate(_KINDS).encode().split()


@dataclass
class Cover:
    item: int
    covered: int
    words: int
    tiles: Runs


def tile(runs: Runs, least: int, item_words: int) -> Runs:
    """Greedy tiling: (length, item position, text position) of tiles, in the order marked.

    `runs` are the maximal diagonal matches. The longest goes first, ties by
    position. A match that meets marked words is cut to its unmarked parts, which
    wait for their turn by their own length.
    """
    heap = [(-n, i, d) for n, i, d in runs if n >= least]
    heapq.heapify(heap)
    item_marked, text_marked = np.zeros(item_words, bool), set()
    tiles: Runs = []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = [not item_marked[i + k] and (d + k) not in text_marked for k in range(n)]
        if all(free):
            item_marked[i : i + n] = True
            text_marked.update(range(d, d + n))
            tiles.append((n, i, d))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= least:
                    heapq.heappush(heap, (start - k, i + start, d + start))
                start = None
    return tiles


def _runs_from_seeds(text_at: np.ndarray, item_at: np.ndarray, least: int) -> Runs:
    """Maximal diagonal runs from the start positions of matches of `least` words."""
    diagonal = text_at - item_at
    order = np.lexsort((item_at, diagonal))
    diagonal, i, d = diagonal[order], item_at[order], text_at[order]
    first = np.ones(len(i), bool)
    first[1:] = (np.diff(diagonal) != 0) | (np.diff(i) != 1)
    starts = np.nonzero(first)[0]
    lengths = np.diff(np.append(starts, len(i))) + least - 1
    return list(zip(lengths.tolist(), i[starts].tolist(), d[starts].tolist(), strict=True))


def _runs_by_scan(text: np.ndarray, item: np.ndarray, least: int) -> Runs:
    """The same runs, from one row of match lengths at a time."""
    out: Runs = []
    before = np.zeros(len(text) + 1, np.int64)
    for i in range(len(item) + 1):
        now = np.zeros(len(text) + 1, np.int64)
        if i < len(item):
            same = text == item[i]
            now[1:][same] = before[:-1][same] + 1
        ended = np.nonzero((before >= least) & (np.append(now[1:], 0) == 0))[0]
        out += [(int(before[e]), i - int(before[e]), int(e) - int(before[e])) for e in ended]
        before = now
    return out


def _all_known(ids: np.ndarray, n: int) -> np.ndarray:
    """Where n known words stand in a row."""
    size = max(len(ids) - n + 1, 0)
    known = np.ones(size, bool)
    for k in range(n):
        known &= ids[k : k + size] > 0
    return known


class Benchmark:
    """One block of items, ready to be met by texts."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], least: int = LEAST_WORDS):
        self.least = least
        self.ids: list[object] = []
        self.items: list[np.ndarray] = []
        self.vocabulary: dict[bytes, int] = {}
        for item_id, text in items:
            self.ids.append(item_id)
            self.items.append(
                np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of_bytes(text)], np.int64)
            )
        hashes, owner, at = [], [], []
        #: Items of fewer words than a seed, by their words.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for k, item in enumerate(self.items):
            if 0 < len(item) < least:
                self.short.setdefault(len(item), {}).setdefault(tuple(item.tolist()), []).append(k)
            h, ok = self._hashes(item)
            hashes.append(h[ok])
            at.append(np.nonzero(ok)[0])
            owner.append(np.full(len(at[-1]), k, np.int64))
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owner, at)]
        order = np.argsort(joined[0], kind="stable")
        self.hashes, self.owner, self.at = (x[order] for x in joined)

    def _hashes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Karp-Rabin hash of each run of words, and where all of them are known words."""
        n = len(ids) - self.least + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n, np.uint64)
        for k in range(self.least):
            h = h * np.uint64(_BASE) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        return h ^ (h >> np.uint64(29)), _all_known(ids, self.least)

    def covers(self, texts: list[bytes | None], threshold: float) -> list[list[Cover]]:
        """For each text the items that it covers to at least `threshold`."""
        out: list[list[Cover]] = [[] for _ in texts]
        batch: list[int] = []
        words: list[list[bytes]] = []
        held = 0
        for n, text in enumerate(texts):
            own = words_of_bytes(text)
            if len(own) >= min([self.least, *self.short]):
                batch.append(n)
                words.append(own)
                held += len(own)
            if held >= BATCH_WORDS:
                self._meet(batch, words, threshold, out)
                batch, words, held = [], [], 0
        if batch:
            self._meet(batch, words, threshold, out)
        return out

    def _meet(self, batch: list[int], words: list[list[bytes]], threshold: float, out: list[list[Cover]]) -> None:
        lengths = np.array([len(w) for w in words])
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # an unknown word between texts
        ids = np.zeros(starts[-1], np.int64)
        find = self.vocabulary.get
        for start, own in zip(starts, words, strict=False):
            ids[start : start + len(own)] = [find(w, 0) for w in own]
        for k, start in enumerate(starts[:-1] if self.short else []):
            out[batch[k]] += self._short(ids[start : start + lengths[k]])
        h, known = self._hashes(ids)
        candidates = np.nonzero(known)[0]
        first = np.searchsorted(self.hashes, h[candidates], "left")
        hit = first < len(self.hashes)
        hit[hit] = self.hashes[first[hit]] == h[candidates][hit]
        candidates, first = candidates[hit], first[hit]
        if not len(candidates):
            return
        counts = np.searchsorted(self.hashes, h[candidates], "right") - first
        text_of = np.searchsorted(starts, candidates, "right") - 1
        for k in np.unique(text_of):
            mine = text_of == k
            own = ids[starts[k] : starts[k] + lengths[k]]
            out[batch[k]] += self._cover(own, candidates[mine] - starts[k], first[mine], counts[mine], threshold)

    def _short(self, text: np.ndarray) -> list[Cover]:
        """Short items that stand in the text as a whole, at their first place."""
        found = []
        for n, items in self.short.items():
            seen: set[tuple[int, ...]] = set()
            for start in np.nonzero(_all_known(text, n))[0].tolist():
                words = tuple(text[start : start + n].tolist())
                if words in items and words not in seen:
                    seen.add(words)
                    found += [Cover(k, n, n, [(n, 0, start)]) for k in items[words]]
        return found

    def _cover(self, text: np.ndarray, at: np.ndarray, first: np.ndarray, counts: np.ndarray, threshold: float) -> list[Cover]:
        seeds: dict[int, int] = defaultdict(int)
        if counts.sum() <= MOST_SEEDS:
            places = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            owners, item_at, text_at = self.owner[places], self.at[places], np.repeat(at, counts)
            for k, n in zip(*np.unique(owners, return_counts=True), strict=True):
                seeds[int(k)] = int(n)
        else:
            owners = None
            for f, c in zip(first.tolist(), counts.tolist(), strict=True):
                for k in self.owner[f : f + c].tolist():
                    seeds[k] += 1
        found = []
        for k in seeds:
            item = self.items[k]
            if owners is None:
                runs = _runs_by_scan(text, item, self.least)
            else:
                mine = owners == k
                t, i = text_at[mine], item_at[mine]
                same = np.ones(len(t), bool)
                for j in range(self.least):  # equal hashes are checked word by word
                    same &= text[t + j] == item[i + j]
                t, i = t[same], i[same]
                reached = np.zeros(len(item), bool)
                for j in range(self.least):
                    reached[i + j] = True
                if reached.sum() < threshold * len(item):
                    continue
                runs = _runs_from_seeds(t, i, self.least)
            tiles = tile(runs, self.least, len(item))
            covered = sum(n for n, _, _ in tiles)
            if tiles and covered >= threshold * len(item):
                found.append(Cover(k, covered, len(item), tiles))
        return sorted(found, key=lambda c: c.item)


@dataclass
class Blocks:
    """The benchmark as broadcasts of (item_id, text), the words of a seed, and a name that no other has."""

    parts: list[Broadcast]
    least: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def benchmark_blocks(benchmark: DataFrame, least: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """The benchmark in broadcasts of about `block_bytes`; the driver holds one partition at a time."""
    spark = benchmark.sparkSession
    sized = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    dealt = sized.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    # a block lies in one partition, and partitions reach the driver in turn
    rows = dealt.repartition(blocks, "b").sortWithinPartitions("b", F.col("item_id").asc_nulls_last(), "text").toLocalIterator()
    parts = [spark.sparkContext.broadcast([(r.item_id, r.text) for r in part]) for _, part in groupby(rows, lambda r: r.b)]
    return Blocks(parts or [spark.sparkContext.broadcast([])], least)


#: Blocks that this process holds ready, by the name of their benchmark.
_READY: dict[str, dict[int, Benchmark]] = {}


def _ready(blocks: Blocks, k: int) -> Benchmark:
    """The k-th block. The first HELD_BLOCKS stay; others are made for the texts at hand and go."""
    if blocks.name not in _READY:
        _READY.clear()
    held = _READY.setdefault(blocks.name, {})
    if k in held:
        return held[k]
    made = Benchmark(blocks.parts[k].value, blocks.least)
    if k < HELD_BLOCKS:
        held[k] = made
    return made


def _groups(batches: Iterator[pa.Array], most: int) -> Iterator[list[pa.Array]]:
    """Batches of texts, together up to about `most` bytes."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


_COVER = "array<struct<item_id bigint, covered int, item_words int, tiles int, longest int>>"


def matches(blocks: Blocks, threshold: float) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """What runs in a task: batches of texts to arrays of the items that each covers."""
    kind = pa.list_(
        pa.struct(
            [("item_id", pa.int64()), ("covered", pa.int32()), ("item_words", pa.int32()), ("tiles", pa.int32()), ("longest", pa.int32())]
        )
    )
    # texts wait for one another only where some blocks must be made anew for them
    most = GROUP_BYTES if len(blocks.parts) > HELD_BLOCKS else 0

    def met(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for group in _groups(batches, most):
            out: list[list[list[dict]]] = [[[] for _ in range(len(texts))] for texts in group]
            for k in range(len(blocks.parts)):
                block = _ready(blocks, k)
                for texts, rows in zip(group, out, strict=True):
                    for start in range(0, len(texts), 256):
                        for n, found in enumerate(block.covers(texts.slice(start, 256).to_pylist(), threshold), start):
                            rows[n] += [
                                {"item_id": block.ids[c.item], "covered": c.covered, "item_words": c.words, "tiles": len(c.tiles), "longest": c.tiles[0][0]}
                                for c in found
                            ]
            for rows in out:
                yield pa.array(rows, kind)

    return met


def covers(text: Column, blocks: Blocks, threshold: float = COVERAGE) -> Column:
    """Array of the items that each text covers, by block and item."""
    ship_package()
    run = matches(blocks, threshold)

    @F.arrow_udf(_COVER)
    def met(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return met(text.cast("binary"))


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, least: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Rows (doc_id, item_id, covered, item_words, tiles, longest, coverage) of documents that hold test items.

    An item counts if tiles of at least `least` words cover at least `threshold` of
    its words; items of fewer words count if they stand in the text whole. Items
    without words and null texts never match. Rows that repeat on either side give
    rows that repeat.
    """
    blocks = benchmark_blocks(benchmark, least, block_bytes)
    found = docs.select("doc_id", F.inline(covers(F.col("text"), blocks, threshold)))
    return found.withColumn("coverage", F.col("covered") / F.col("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, least: int = LEAST_WORDS) -> DataFrame:
    """`docs` without the documents that hold a test item; rows stay in place and whole."""
    return docs.where(F.size(covers(F.col("text"), benchmark_blocks(benchmark, least), threshold)) == 0)


def op10_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
