"""Conversation repair against a search over edit strings, short and cut in segments, and on odd rows."""

import hashlib
import random
import sys
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tidebook.llm import repair
from tidebook.llm.repair import Costs

ROWS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
SPACE = " \t\n\x0b\x0c\r"


def expected(rows, costs):
    """Counts, cost, audit and repaired text of rows (role, text) in order."""
    faults, seen = [], set()
    for role, text in rows:
        tail = text.rstrip(SPACE)
        faults.append("b" if not tail else "d" if (role, text) in seen else "t" if tail[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(n, state, made):
        """(cost, edits, lines) from row n on; state: what has been emitted last; made: insertions in a row."""
        found = [(0, "", ())] if n == len(rows) and state in ("", "a") else []
        role = "assistant" if state == "u" else "user"
        if made < 3:
            cost, edits, lines = best(n, role[0], made + 1)
            found.append((cost + costs.insert, "I" + edits, (f"{role}:", *lines)))
        if n < len(rows):
            own, text = rows[n]
            cost, edits, lines = best(n + 1, state, 0)
            found.append((cost + costs.delete, "D" + edits, lines))
            if faults[n] not in ("b", "d"):
                extra = costs.truncated * (faults[n] == "t")
                if own and state + own[:1] in ("s", "u", "su", "ua", "au"):
                    cost, edits, lines = best(n + 1, own[:1], 0)
                    found.append((cost + extra, "K" + edits, (f"{own}:{text}", *lines)))
                cost, edits, lines = best(n + 1, role[0], 0)
                found.append((cost + extra + costs.rerole, "R" + edits, (f"{role}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())

    sys.setrecursionlimit(20_000)
    cost, edits, lines = best(0, "", 0)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return (
        *[faults.count(k) for k in "bdt"],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        edits,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["yes.", "no!", "why", " ", "", "a:b?", "so\nit is. ", "x"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    return {c: [(rng.choice(roles), rng.choice(texts) + (str(k) + "." if rng.random() < 0.6 else "")) for k in range(rng.randint(1, most))] for c in range(n)}


@pytest.mark.parametrize("costs", [Costs(), Costs(rerole=9, delete=7, insert=1, truncated=2), Costs(rerole=3, delete=3, insert=3, truncated=1)])
@pytest.mark.parametrize("segment", [4096, 2])
def test_edits_are_the_least_of_the_cheapest(spark, costs, segment):
    talks = conversations(7, 60, 9)
    rows = spark.createDataFrame([(c, k, r, t) for c, talk in talks.items() for k, (r, t) in enumerate(talk)], ROWS)
    out = repair.repair(rows, costs, segment_rows=segment).collect()
    assert len(out) == 60
    for r in out:
        assert tuple(r)[2:] == expected(talks[r.conv_id], costs), talks[r.conv_id]
        assert r.gaps == 0


def test_insertions_stand_where_they_are_cheapest(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Yes."), (1, 1, "user", "And?"), (2, 0, "system", "Be kind.")], ROWS)
    costs = Costs(rerole=9, delete=9, insert=1)
    out = {r.conv_id: r.audit for r in repair.repair(rows, costs).collect()}
    assert out == {1: "IKKI", 2: "KII"}
    lines = repair.repaired_messages(rows, costs).orderBy("conv_id", "_place").collect()
    assert [(r.role, r.text) for r in lines] == [
        ("user", ""), ("assistant", "Yes."), ("user", "And?"), ("assistant", ""),
        ("system", "Be kind."), ("user", ""), ("assistant", ""),
    ]


def odd(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, None, "Null role."),
        (2, None, "user", None), (2, None, "user", "So?"), (2, 3, "assistant", "word " * 50_000 + "."),
        (None, 1, "user", "Lost?"), (None, 2, "assistant", "Lost."), (None, None, None, None),
        (4, 7, "user", "x"), (5, None, "user", "Ties."), (5, None, "user", "Ties!"),
    ]
    return spark.createDataFrame(rows, ROWS).withColumn("audit", F.lit("mine")).withColumn("n", F.lit(0)).withColumn("cost", F.lit(1))


@pytest.mark.parametrize("segment", [4096, 1])
def test_nulls_ties_repeated_rows_and_clashing_names(spark, segment):
    out = {r.conv_id: r for r in repair.repair(odd(spark), segment_rows=segment).collect()}
    assert set(out) == {1, 2, None, 4, 5}
    # a null role can be made user, which costs more than leaving its row out would with no answer to it
    assert (out[1].gaps, out[1].duplicate, out[1].illegal, out[1].audit) == (3, 1, 2, "KKDD")
    assert (out[2].blank, out[2].audit, out[2].gaps) == (1, "DKK", 0)
    assert (out[None].blank, out[None].audit) == (1, "DKK")
    assert (out[4].audit, out[4].cost, out[4].truncated, out[4].repaired_sha256) == ("D", 2, 1, EMPTY)
    assert out[5].audit == "KR" and out[5].gaps == 0


def test_hot_rows_and_long_conversations(spark):
    """A third of all rows in one conversation, most of them equal; all routes agree."""
    rows = [(0, k // 2, "user", "Again.") for k in range(600)] + [(0, 1000 + k, ("user", "assistant")[k % 2], f"{k}.") for k in range(101)]
    rows += [(c, k, ("user", "assistant")[k % 2], f"{k}!") for c in range(1, 300) for k in range(4)]
    df = spark.createDataFrame(rows, ROWS)
    short = sorted(map(tuple, repair.repair(df).collect()))
    assert sorted(map(tuple, repair.repair(df, segment_rows=16).collect())) == short
    assert sorted(map(tuple, repair.repair(df, short_bytes=100).collect())) == short
    assert short[0][2:] == expected([(r, t) for _, _, r, t in rows[:701]], Costs())


def test_damage_and_query(spark, sf, tmp_path):
    rows = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)], ROWS)
    found = {}
    for r in repair.damage(rows).collect():
        found[r.conv_id, r.turn] = (r.role, r.text, r._copies)
    for (c, t), got in found.items():
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        plain = ("assistant", "One. Two!", 1)
        assert got == {0: (*plain[:2], 0), 1: ("assistant", "", 1), 2: ("assistant", "One Two", 1), 3: (*plain[:2], 2), 4: ("user", "One. Two!", 1)}.get(kind, plain)
    gone = next(k for k in found if found[k][2] == 0)
    one = repair.repair(repair.damage(rows.where((F.col("conv_id") == gone[0]) & (F.col("turn") == gone[1])))).first()
    assert tuple(one)[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert repair.repair(rows.limit(0)).count() == 0
    nulls = repair.damage(spark.createDataFrame([(None, None, None, None)], ROWS)).first()
    kind = zlib.crc32(b" : ") % 20
    assert (nulls.role, nulls.text) == ("user" if kind == 4 else " ", "" if kind == 1 else " ")
