"""Repair of conversation structure by a dynamic program over time-major tensors.

A repaired conversation has role initials `(s?(ua)+)?`, with the initials of its messages
read from left to right by an automaton of four states. Edits move through it: Keep
and Rerole emit a message, Delete emits none, Insert emits an empty one
without reading. Conversations are bucketed by length, a bucket is a tensor of row codes
with time first, and one step updates the costs of all its conversations and
states at once. Backward costs are stored, and the forward trace, vectorised as well,
takes at each place the edit of the least letter that is still cheapest: a
letter and a state decide the next state, so that is the least string.

Only one letter a row goes to Python; texts stay in the JVM. A conversation of more than
`segment_rows` rows or `SHORT_BYTES` bytes is never one group: its rows are numbered
over a range-partitioned table and cut in segments, a segment's cost matrix (entry by exit
state) comes from the same tensors, matrices compose along the conversation, and
segments are traced side by side from all four entry states. The scan over a conversation
reads 16 numbers per segment, at most 2^19 segments, as its audit, one cell, has
under 2^31 letters. Its hash reads the texts in order, in Arrow batches: SHA-256 of one
conversation has no parallel form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import SPACE_CLASS, WORD_CLASS, durable, join_counted, let, read_table, stored
from tidebook.runtime import ship_package

#: Rows of a conversation that is handled as one group, and of a segment of a longer one.
SEGMENT_ROWS = 4096
SHORT_BYTES = 16 << 20
#: Long conversations of which a list may be broadcast.
MOST_LISTED = 10_000
#: Bytes of backward costs held at a time.
TENSOR_BYTES = 16 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = ("", "user", "assistant")
#: State after an inserted or reroled message, and which of _ROLES that has.
_MADE = np.array([USER, USER, ASSISTANT, USER])
_FILL = np.array([1, 1, 2, 1], np.uint8)
#: State after keeping a message whose initial is s, u, a or another, by state; -1: not allowed.
_KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
_NEVER = 1 << 50
_FIRST_CODE, _NO_ROW = ord("A"), 255
#: Faults of a row, in the order in which the first counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass(frozen=True)
class Costs:
    """Costs of the edits; `truncated` is added for each truncated row that is not deleted."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert < 1:
            raise ValueError("costs must not be negative, and an insertion must cost something")


def _with_inserts(costs: np.ndarray, insert: int) -> np.ndarray:
    """Costs by state (first axis) when any number of insertions may come first."""
    out = costs.copy()
    for _ in range(3):
        out = np.minimum(out, insert + out[_MADE])
    return out


def final_costs(insert: int, n: int = 1) -> np.ndarray:
    """Costs after the last row, by state and conversation."""
    ends = np.full((4, n), _NEVER)
    ends[[START, ASSISTANT]] = 0
    return _with_inserts(ends, insert)


def _options(codes: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of codes: initials, extra cost of staying, and whether there is a row."""
    there = codes != _NO_ROW
    code = np.where(there, codes, 0)
    fault = code // 4
    stay = np.where((fault == BLANK) | (fault == DUPLICATE), _NEVER, np.where(fault == TRUNCATED, costs.truncated, 0))
    return code % 4, stay, there


def backward(codes: np.ndarray, exits: np.ndarray, costs: Costs) -> np.ndarray:
    """Costs to go (time + 1, state, conversation); codes are (time, conversation), exits (state, conversation)."""
    steps, n = codes.shape
    out = np.empty((steps + 1, 4, n), np.int64)
    out[steps] = exits
    for t in range(steps - 1, -1, -1):
        after = out[t + 1]
        initial, stay, there = _options(codes[t], costs)
        to = _KEPT[initial].T
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 0), _NEVER) + stay
        made = after[_MADE] + costs.rerole + stay
        best = _with_inserts(np.minimum(np.minimum(kept, made), after + costs.delete), costs.insert)
        out[t] = np.where(there, np.minimum(best, _NEVER), after)
    return out


@dataclass
class Traced:
    """Edits of a bucket: letters by slot and conversation (0: none), the row and the role of what they emit."""

    letters: np.ndarray
    rows: np.ndarray
    fills: np.ndarray
    state: np.ndarray


def trace(codes: np.ndarray, ahead: np.ndarray, entry: np.ndarray, costs: Costs, last: bool) -> Traced:
    """Cheapest edits from the entry states, least letters first; `last` adds insertions after the last row."""
    steps, n = codes.shape
    state, each = entry.copy(), np.arange(n)
    letters, rows, fills = [], [], []

    def emit(letter: np.ndarray, row: int, fill: np.ndarray) -> None:
        if letter.any():
            letters.append(letter)
            rows.append(row)
            fills.append(fill)

    def insert(where: np.ndarray) -> None:
        nonlocal state
        emit(np.where(where, ord("I"), 0).astype(np.uint8), -1, np.where(where, _FILL[state], 0))
        state = np.where(where, _MADE[state], state)

    for t in range(steps):
        now, after = ahead[t], ahead[t + 1]
        initial, stay, there = _options(codes[t], costs)
        for _ in range(3):
            drop = after[state, each] + costs.delete == now[state, each]
            more = there & ~drop & (now[_MADE[state], each] + costs.insert == now[state, each])
            if not more.any():
                break
            insert(more)
        drop = there & (after[state, each] + costs.delete == now[state, each])
        to = _KEPT[initial, state]
        keep = there & ~drop & (to >= 0) & (after[np.maximum(to, 0), each] + stay == now[state, each])
        make = there & ~drop & ~keep
        emit(
            np.select([drop, keep, make], [ord("D"), ord("K"), ord("R")], 0).astype(np.uint8),
            t,
            np.where(make, _FILL[state], 0),
        )
        state = np.select([keep, make], [to, _MADE[state]], state)
    if last:
        for _ in range(3):
            insert((state == SYSTEM) | (state == USER))
    blank = np.zeros((0, n), np.uint8)
    return Traced(
        np.stack(letters) if letters else blank, np.array(rows, np.int32), np.stack(fills) if fills else blank, state
    )


def _buckets(codes: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes with time first) of texts of codes, bucketed by length and bounded in bytes."""
    codes = codes.cast(pa.large_binary())
    ends = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1]
    flat = np.frombuffer(codes.buffers()[2] or b"", np.uint8)
    lengths = np.diff(ends)
    # lengths 0, 1, 2, 3-4, 5-8, ...
    level = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int) + (lengths > 0)
    for bucket in np.unique(level):
        members = np.flatnonzero(level == bucket)
        most = max(1, TENSOR_BYTES // (32 * (int(lengths[members].max()) + 1)))
        for start in range(0, len(members), most):
            part = members[start : start + most]
            time = np.arange(int(lengths[part].max()))[:, None]
            inside = time < lengths[part]
            held = np.full(inside.shape, _NO_ROW, np.uint8)
            held[inside] = flat[(ends[part] + time)[inside]] - _FIRST_CODE
            yield part, held


def _strings(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the non-zero marks, conversation by conversation, and where each begins."""
    by_row = marks.T
    set_ = by_row != 0
    return by_row[set_], np.concatenate([[0], np.cumsum(set_.sum(1))])


_LINES = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))
_SOLVED = pa.struct([
    *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("lines", _LINES),
])


def _edits(traced: Traced) -> tuple[list[str], pa.Array]:
    """Audits, and the emitted lines with row (-1: inserted) and role (empty: the row's own)."""
    flat, cut = _strings(traced.letters)
    letters = flat.tobytes().decode("ascii")
    audits = [letters[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    out = (traced.letters != 0) & (traced.letters != ord("D"))
    where = out.T
    counts = np.concatenate([[0], np.cumsum(where.sum(1))]).astype(np.int32)
    rows = np.broadcast_to(traced.rows, where.shape)[where] if where.size else np.zeros(0, np.int32)
    fills = traced.fills.T[where] if where.size else np.zeros(0, np.uint8)
    roles = pa.DictionaryArray.from_arrays(pa.array(fills.astype(np.int8)), pa.array(_ROLES)).cast(pa.string())
    lines = pa.StructArray.from_arrays([pa.array(rows, pa.int32()), roles], ["row", "role"])
    return audits, pa.ListArray.from_arrays(pa.array(counts), lines)


def _faults(codes: np.ndarray) -> dict[str, np.ndarray]:
    there = codes != _NO_ROW
    fault = np.where(there, codes // 4, SOUND)
    initial = np.where(there, codes % 4, 3)
    pairs = there[1:]
    before, own = initial[:-1], initial[1:]
    legal = ((before == 0) & (own == 1)) | ((before == 1) & (own == 2)) | ((before == 2) & (own == 1))
    found = {name: (fault == k).sum(0) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    return found | {"illegal": (pairs & ~legal).sum(0)}


def solve(codes: pa.Array, costs: Costs) -> pa.Array:
    """Counts, cost, audit and lines of whole conversations, from one code letter a row."""
    n = len(codes)
    numbers = {c: np.zeros(n, np.int64) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    places, audits, lines = [], [], []
    for part, held in _buckets(codes):
        ahead = backward(held, final_costs(costs.insert, len(part)), costs)
        numbers["cost"][part] = ahead[0, START]
        for name, values in _faults(held).items():
            numbers[name][part] = values
        audit, line = _edits(trace(held, ahead, np.full(len(part), START), costs, True))
        places.append(part)
        audits += audit
        lines.append(line)
    back = pa.array(np.argsort(np.concatenate(places)) if places else np.zeros(0, np.int64))
    return pa.StructArray.from_arrays(
        [
            *[pa.array(v) for v in numbers.values()],
            pa.array(audits, pa.string()).take(back),
            (pa.concat_arrays(lines) if lines else pa.array([], _LINES)).cast(_LINES).take(back),
        ],
        fields=list(_SOLVED),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with the planted damage: conv_id, turn, role, text and _copies (0: dropped, 2: repeated).

    crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes out `[.!?]`,
    3 repeats it, 4 makes its role user. Nulls count as one space.
    """
    kind = F.crc32(
        F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")
    ) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_copies"),
    )


def _letter(initial: Column, fault: Column) -> Column:
    """A row's code as a letter."""
    return F.substring(F.lit("ABCDEFGHIJKLMNOP"), F.lit(1) + initial + 4 * fault, F.lit(1))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with _key of the conversation, _initial and _own, the fault that needs no other row."""
    if "_copies" not in rows.columns:
        rows = rows.withColumn("_copies", F.lit(1))
    first = F.substring("role", 1, 1)
    tail = let(
        F.regexp_replace("text", f"{SPACE_CLASS}++$", ""),
        lambda t: F.when(t == "", BLANK).when(F.substring(t, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED),
    )
    return rows.select(
        F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))).alias("_key"),
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.col("_copies").cast("long").alias("_copies"),
    ).select(
        "*",
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("_initial"),
        tail.alias("_own"),
    )


def _gaps(least: Column, most: Column, n: Column) -> Column:
    return F.coalesce(most - least + 1 - n, F.lit(0)).cast("long")


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_short(rows: DataFrame, costs: Costs) -> DataFrame:
    """conv_id, counts, audit and `messages` (role, text) of conversations that fit in one group each."""
    ship_package()

    @F.arrow_udf(_ddl(_SOLVED))
    def solved(codes: pa.Array) -> pa.Array:
        return solve(codes, costs)

    held = F.sort_array(F.collect_list(F.when(F.col("_copies") > 0, F.struct("turn", "role", "text", "_initial", "_own", "_copies"))))
    one = rows.groupBy("_key").agg(F.max("conv_id").alias("conv_id"), held.alias("held")).select(
        "conv_id",
        F.flatten(
            F.transform("held", lambda r: F.transform(F.sequence(F.lit(1), r["_copies"].cast("int")), lambda _: r))
        ).alias("rows"),
    )
    one = one.withColumn("said", F.transform("rows", lambda r: F.struct(r["role"], r["text"])))
    codes = F.transform(
        "rows",
        lambda r, i: _letter(
            r["_initial"],
            F.when(r["_own"] == BLANK, BLANK)
            .when(F.array_position("said", F.get("said", i)) <= i, DUPLICATE)
            .otherwise(r["_own"]),
        ),
    )
    turns = F.array_compact(F.transform("rows", lambda r: r["turn"]))

    def message(line: Column) -> Column:
        own = F.get("rows", line["row"])
        role = F.when(line["role"] != "", line["role"]).otherwise(own["role"])
        return F.struct(role.alias("role"), F.when(line["row"] < 0, "").otherwise(own["text"]).alias("text"))

    out = one.withColumn("codes", F.array_join(codes, "")).withColumn("_s", solved("codes"))
    return out.select(
        "conv_id",
        let(turns, lambda t: _gaps(F.array_min(t), F.array_max(t), F.size(F.array_distinct(t)))).alias("gaps"),
        *[F.col(f"_s.{c}").alias(c) for c in _NUMBERS[1:]],
        "_s.audit",
        F.col("_s.lines").alias("lines"),
        "rows",
    ).select("*", F.transform("lines", message).alias("messages")).drop("lines", "rows")


def _ddl(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of long conversations, equal ones together with their number _m, and _pos from 0 in their conversation.

    Rows are dealt by ranges of their order and written; counts per part give each part
    its offset, so no conversation is sorted in one task.
    """
    same = ["_key", "turn", "role", "text", "_initial", "_own"]
    whole = rows.groupBy(*same).agg(F.sum("_copies").alias("_m")).where("_m > 0")
    order = [F.col("_key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = stored(whole.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(sizes.select("_key", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")))
    within = Window.partitionBy("_part", "_key").orderBy(*order[1:])
    return dealt.withColumn("_place", F.row_number().over(within)).join(offsets, ["_key", "_part"]).select(
        *same, "_m", (F.col("_offset") + F.col("_place") - 1).alias("_pos")
    )


def _matrices(codes: pa.Array, costs: Costs) -> pa.Array:
    """16 costs per segment: entry by exit state."""
    out = np.zeros((len(codes), 4, 4), np.int64)
    for part, held in _buckets(codes):
        for leave in range(4):
            exits = np.full((4, len(part)), _NEVER)
            exits[leave] = 0
            out[part, :, leave] = backward(held, exits, costs)[0].T
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(codes) + 1, 16, dtype=np.int32)), pa.array(out.ravel()))


_PATH = pa.struct([("audit", pa.string()), ("lines", _LINES), ("leave", pa.int32())])


def _paths(codes: pa.Array, exits: pa.Array, last: pa.Array, costs: Costs) -> pa.Array:
    """For each segment its edits from each of the four entry states."""
    ends = np.array(exits.to_pylist(), np.int64).reshape(-1, 4)
    closes = last.to_numpy(zero_copy_only=False).astype(bool)
    found: list[list | None] = [None] * len(codes)
    for part, held in _buckets(codes):
        ahead = backward(held, ends[part].T, costs)
        for closing in (False, True):
            some = np.flatnonzero(closes[part] == closing)
            if not len(some):
                continue
            by_entry = []
            for entry in range(4):
                t = trace(held[:, some], ahead[:, :, some], np.full(len(some), entry), costs, closing)
                audits, lines = _edits(t)
                by_entry.append((audits, lines.to_pylist(), t.state.tolist()))
            for k, p in enumerate(part[some]):
                found[p] = [{"audit": a[k], "lines": b[k], "leave": c[k]} for a, b, c in by_entry]
    return pa.array(found, pa.list_(_PATH))


def _exits(pdf: pd.DataFrame, insert: int) -> pd.DataFrame:
    """Costs at the exit of each segment of one conversation, from its matrices."""
    pdf = pdf.sort_values("_seg")
    m = np.stack(pdf["matrix"].to_numpy()).reshape(-1, 4, 4)
    exits = np.empty((len(m), 4), np.int64)
    now = final_costs(insert)[:, 0]
    for k in range(len(m) - 1, -1, -1):
        exits[k] = now
        now = (m[k] + now).min(1)
    return pd.DataFrame({
        "_key": pdf["_key"].to_numpy(), "_seg": pdf["_seg"].to_numpy(), "exits": list(exits),
        "last": np.arange(len(m)) == len(m) - 1, "cost": int(now[START]),
    })


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry state of each segment of one conversation."""
    pdf = pdf.sort_values("_seg")
    state, entry = START, []
    for leaves in pdf["leaves"]:
        entry.append(state)
        state = int(leaves[state])
    return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "_seg": pdf["_seg"].to_numpy(), "entry": np.array(entry, np.int32)})


@dataclass
class LongRepair:
    """Summaries of long conversations, and their repaired messages as rows in order of _seg and place."""

    summary: DataFrame
    messages: DataFrame


def repair_long(rows: DataFrame, costs: Costs, segment_rows: int) -> LongRepair:
    """The same for conversations of any length, none of which is ever one group."""
    ship_package()

    @F.arrow_udf("array<long>")
    def matrices(codes: pa.Array) -> pa.Array:
        return _matrices(codes, costs)

    @F.arrow_udf(_ddl(pa.list_(_PATH)))
    def paths(codes: pa.Array, exits: pa.Array, last: pa.Array) -> pa.Array:
        return _paths(codes, exits, last, costs)

    rows = rows.where("_copies > 0")
    said = F.sha2(F.concat_ws(":", "_key", F.length("role").cast("string"), "role", "text"), 256)
    placed = stored(_numbered(rows).withColumn("_said", said))
    firsts = placed.groupBy("_said").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("n"))
    fault = F.when(F.col("_own") == BLANK, BLANK).when(F.col("_pos") > F.col("_first"), DUPLICATE).otherwise(F.col("_own"))
    judged = stored(
        join_counted(placed, firsts, "_said").select(
            "_key", "turn", "role", "text", "_initial", fault.alias("_fault"), "_m", "_pos",
            F.floor(F.col("_pos") / segment_rows).alias("_seg"),
        )
    )
    cells = F.sort_array(F.collect_list(F.struct("_pos", _letter(F.col("_initial"), F.col("_fault")).alias("c"), "_m")))
    segments = stored(
        judged.groupBy("_key", "_seg").agg(cells.alias("cells")).select(
            "_key", "_seg",
            F.array_join(F.transform("cells", lambda c: c["c"]), "").alias("codes"),
            F.transform("cells", lambda c: c["_m"]).alias("ms"),
        )
    )
    exits = segments.select("_key", "_seg", matrices("codes").alias("matrix")).groupBy("_key").applyInPandas(
        lambda pdf: _exits(pdf, costs.insert), "_key string, _seg long, exits array<long>, last boolean, cost long"
    )
    walked = stored(segments.join(durable(exits), ["_key", "_seg"]).withColumn("paths", paths("codes", "exits", "last")))
    entries = walked.select("_key", "_seg", F.transform("paths", lambda p: p["leave"]).alias("leaves")).groupBy(
        "_key"
    ).applyInPandas(_entries, "_key string, _seg long, entry int")
    taken = stored(
        walked.join(durable(entries), ["_key", "_seg"]).select("*", F.get("paths", F.col("entry")).alias("path")).select(
            "_key", "_seg", "ms", "cost", "path.audit", "path.lines"
        )
    )
    # equal rows stand together: the first has its edit, the others are deleted
    letters = F.zip_with(
        F.regexp_extract_all("audit", F.lit("(I*[DKR])"), 1), "ms",
        lambda a, m: F.concat(a, F.repeat(F.lit("D"), (m - 1).cast("int"))),
    )
    audits = taken.select("_key", "_seg", "cost", F.concat(F.array_join(letters, ""), F.regexp_extract("audit", "(I*)$", 1)).alias("a")).groupBy(
        "_key"
    ).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_seg", "a"))), lambda s: s["a"]), "").alias("audit"),
        F.max("cost").alias("cost"),
    )
    last_of = judged.select("_key", (F.col("_pos") + 1).alias("_pos"), F.col("_initial").alias("_before"))
    pair = F.struct("_before", "_initial")
    legal = pair.isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in ((0, 1), (1, 2), (2, 1))])
    one = F.col("_m") - 1
    blank = F.col("_fault") == BLANK
    counts = judged.join(last_of, ["_key", "_pos"], "left").groupBy("_key").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_distinct("turn").alias("turns"),
        F.sum(F.when(blank, F.col("_m")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(F.col("_fault") == DUPLICATE, F.col("_m")).otherwise(one)).alias("duplicate"),
        F.sum(F.when(F.col("_fault") == TRUNCATED, 1).otherwise(0)).alias("truncated"),
        F.sum(one + F.when(F.col("_before").isNull() | legal, 0).otherwise(1)).alias("illegal"),
        F.sum(one * costs.delete).alias("extra"),
    )
    summary = counts.join(audits, "_key").select(
        "_key", _gaps(F.col("least"), F.col("most"), F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated",
        "illegal", (F.col("cost") + F.col("extra")).alias("cost"), "audit",
    )
    lines = taken.select("_key", "_seg", F.posexplode("lines").alias("_place", "line")).select(
        "_key", "_seg", "_place", F.col("line.role").alias("_fill"),
        F.when(F.col("line.row") >= 0, F.col("_seg") * segment_rows + F.col("line.row")).alias("_pos"),
    )
    texts = judged.select("_key", "_pos", "role", "text")
    messages = lines.join(texts, ["_key", "_pos"], "left").select(
        "_key", "_seg", "_place",
        F.when(F.col("_fill") != "", F.col("_fill")).otherwise(F.col("role")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return LongRepair(summary, messages)


def _hash_in_order(messages: DataFrame) -> DataFrame:
    """_key and sha of `role:text` joined by line breaks, read in order in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, hashlib.sha256()
        for batch in batches:
            done = []
            for own, line in zip(batch.column("_key"), batch.column("line"), strict=True):
                own = own.as_py()
                if own != key:
                    if key is not None:
                        done.append((key, held.hexdigest()))
                    key, held = own, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(line.as_buffer())
            yield pa.RecordBatch.from_pydict({"_key": [k for k, _ in done], "sha": [h for _, h in done]}, schema=out)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"_key": [key], "sha": [held.hexdigest()]}, schema=out)

    out = pa.schema([("_key", pa.string()), ("sha", pa.string())])
    line = F.concat_ws(":", "role", "text").cast("binary").alias("line")
    return messages.select("_key", "_seg", "_place", line).repartition("_key").sortWithinPartitions(
        "_key", "_seg", "_place"
    ).mapInArrow(run, "_key string, sha string")


def _parted(rows: DataFrame, segment_rows: int, short_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Marked rows of the short conversations, and of the long ones if there are any."""
    marked = _marked(rows)
    sizes = marked.groupBy("_key").agg(
        F.sum(F.greatest("_copies", F.lit(1))).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")
    )
    long_ones = durable(sizes.where((F.col("n") > segment_rows) | (F.col("bytes") > short_bytes)).select("_key", "n"))
    listed = long_ones.limit(MOST_LISTED + 1).count()
    if not listed:
        return marked, None
    if listed <= MOST_LISTED:
        keys = F.broadcast(long_ones.select("_key"))
        return marked.join(keys, "_key", "left_anti"), marked.join(keys, "_key", "left_semi")
    told = join_counted(
        marked, sizes.select("_key", "n", ((F.col("n") > segment_rows) | (F.col("bytes") > short_bytes)).alias("_long")), "_key"
    )
    return told.where("not _long").drop("_long"), told.where("_long").drop("_long")


def repaired_messages(
    conversations: DataFrame, costs: Costs = Costs(), segment_rows: int = SEGMENT_ROWS, short_bytes: int = SHORT_BYTES
) -> DataFrame:
    """The repaired conversations as rows: conv_id (as a string where long ones are cut), role, text and their order.

    Order is by _seg and _place within a conversation.
    """
    short, long_ = _parted(conversations, segment_rows, short_bytes)
    out = repair_short(short, costs).select(
        F.col("conv_id").cast("string").alias("conv_id"), F.lit(0).cast("long").alias("_seg"),
        F.posexplode("messages").alias("_place", "m"),
    ).select("conv_id", "_seg", "_place", "m.role", "m.text")
    if long_ is None:
        return out
    own = F.when(F.col("_key") != "-", F.substring("_key", 2, 1 << 30)).alias("conv_id")
    return out.unionByName(repair_long(long_, costs, segment_rows).messages.select(own, "_seg", "_place", "role", "text"))


def repair(
    conversations: DataFrame, costs: Costs = Costs(), segment_rows: int = SEGMENT_ROWS, short_bytes: int = SHORT_BYTES
) -> DataFrame:
    """One row per conversation of `conversations` (conv_id, turn, role, text, optionally _copies): counts, cost, audit, hash.

    Rows are taken by turn (nulls first), then role and text, which places repeated rows
    together; null roles and texts are one space, rows of null conv_id are one
    conversation, and other columns are not read. A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (its last character
    that is no space is none of `.!?`). Blank and duplicate rows must be deleted. A role whose initial is
    not s, u or a (also an empty one) can only be reroled or deleted. `_copies` repeats a
    row that often; 0 leaves its conversation without it. A conversation without rows has zeros, an empty
    audit and the hash of the empty string.
    """
    short, long_ = _parted(conversations, segment_rows, short_bytes)
    line = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["text"])), "\n")
    out = repair_short(short, costs).select("conv_id", *_NUMBERS, "audit", F.sha2(line, 256).alias("repaired_sha256"))
    if long_ is None:
        return out
    done = repair_long(long_, costs, segment_rows)
    ids = long_.groupBy("_key").agg(F.max("conv_id").alias("conv_id"))
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in _NUMBERS]
    rest = ids.join(done.summary, "_key", "left").join(_hash_in_order(done.messages), "_key", "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
    return out.unionByName(rest)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the rule of the query, with its faults, cheapest edits and the hash of its repair."""
    return repair(damage(read_table(spark, sf_dir, "conversations")))


def oracle() -> str:
    """The same by a recursion over rows from the last to the first, carrying cost and edits of each state."""
    crc = """4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def edit(state: str, cost: str, letter: str, emitted: str) -> str:
        return (
            f"{{'c': p.{state}.c + {cost}, 'a': '{letter}' || p.{state}.a, "
            f"'o': list_concat({emitted}, p.{state}.o)}}"
        )

    def stay(state: str, initial: str) -> str:
        return f"CASE WHEN must OR i <> '{initial}' THEN NULL ELSE {edit(state, 'extra', 'K', '[r.role || chr(58) || r.text]')} END"

    def made(state: str, role: str) -> str:
        return f"CASE WHEN must THEN NULL ELSE {edit(state, '1 + extra', 'R', f'[{role!r} || chr(58) || r.text]')} END"

    none = "[]::VARCHAR[]"
    e = least(edit("e", "2", "D", none), stay("s", "s"), stay("u", "u"), made("u", "user"))
    s = least(edit("s", "2", "D", none), stay("u", "u"), made("u", "user"))
    u = least(edit("u", "2", "D", none), stay("a", "a"), made("a", "assistant"))
    a = least(edit("a", "2", "D", none), stay("u", "u"), made("u", "user"))

    def put(own: str, then: str, role: str) -> str:
        return least(own, f"{{'c': {then}.c + 5, 'a': 'I' || {then}.a, 'o': list_concat(['{role}:'], {then}.o)}}")

    return f"""
        WITH RECURSIVE k AS (
            SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
        ), d AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({crc}) % 20 AS kind FROM k
        ), w AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM d
        ), n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
                   regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tail
            FROM w
        ), r AS (
            SELECT conv_id, turn, role, text, n, left(role, 1) AS i, tail = '' AS is_blank, tail <> '' AND again > 1 AS is_dup,
                   tail <> '' AND again = 1 AND tail NOT IN ('.', '!', '?') AS is_cut,
                   tail = '' OR again > 1 AS must, CASE WHEN tail NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
            FROM n
        ), f AS (
            SELECT conv_id, max(n) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_dup) AS duplicate,
                   count(*) FILTER (is_cut) AS truncated,
                   count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM r GROUP BY conv_id
        ), p AS (
            SELECT conv_id, last AS t, {{'c': 0, 'a': '', 'o': {none}}} AS e, {{'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']}} AS s,
                   {{'c': 5, 'a': 'I', 'o': ['assistant:']}} AS u, {{'c': 0, 'a': '', 'o': {none}}} AS a
            FROM f
            UNION ALL
            SELECT conv_id, t, {put("e", "u1", "user")}, {put("s", "u1", "user")}, {put("u", "a1", "assistant")}, {put("a", "u1", "user")}
            FROM (
                SELECT *, {put("u", "a", "assistant")} AS u1, {put("a", "u", "user")} AS a1
                FROM (
                    SELECT p.conv_id, p.t - 1 AS t, {e} AS e, {s} AS s, {u} AS u, {a} AS a
                    FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = p.t
                )
            )
        ), o AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(p.e.c, 0)::BIGINT AS cost, coalesce(p.e.a, '') AS audit,
               sha256(coalesce(array_to_string(p.e.o, chr(10)), '')) AS repaired_sha256
        FROM o LEFT JOIN f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
        LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.t = 0
    """
