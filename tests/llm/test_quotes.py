"""Quotations that do not keep the lines of their originals."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidebook.llm import quotes

SAID = "The disk of the second node filled up on Sunday night. Nobody saw it before the morning. We should move the logs to another volume, and soon."


def replies(spark, rows):
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.turn): r for r in quotes.reply_order(chats).collect()}


def test_rewrapped_and_partial_quotations(spark):
    out = replies(
        spark,
        [
            (1, 0, "user", SAID),
            (1, 1, "assistant", "Something else."),
            (1, 2, "user", "> The disk of the second node filled\n> up on Sunday night. Nobody saw it before\n> the morning.\nWhy?"),
            (1, 3, "user", "> nobody saw it before the morning\nI did."),
            (1, 4, "user", "> Nobody saw it before the evening\nNo."),
            (2, 0, "user", "thanks\nI will look at it tonight"),
            (2, 1, "assistant", "thanks"),
            (2, 2, "user", "> thanks\n> I will look\n> at it tonight\nGood."),
            (2, 3, "user", "> thanks\nDone."),
            (3, 0, "user", "It was wrapped\nby the first client\nand not by the second."),
            (3, 1, "user", "no"),
            (3, 2, "user", "> It was wrapped by the first client and not by the second.\nyes"),
            (3, 3, "user", ">> It was wrapped by\n>> the first\n> no\nboth"),
            (4, 0, "user", "other disk of the second node filled upon"),
            (4, 1, "user", "x"),
            (4, 2, "user", "> disk of the second node filled up\ny"),
        ],
    )
    of = lambda c, t: (out[c, t].parent_turn, out[c, t].quoted_lines, out[c, t].linked_lines)
    assert of(1, 2) == (0, 3, 3) and out[1, 2].reply_path == [0, 2]
    assert of(1, 3) == (0, 1, 1)
    assert of(1, 4) == (3, 1, 0)
    assert of(2, 2) == (0, 3, 3) and of(2, 3) == (1, 1, 1)
    assert of(3, 2) == (0, 1, 1) and of(3, 3) == (1, 3, 3)
    # words count whole
    assert of(4, 2) == (1, 1, 0)


def test_passages_against_brute_force(spark):
    rng = random.Random(11)
    own, rows, want = {}, [], {}
    for conv in range(6):
        for turn in range(12):
            words = [rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(8, 40))]
            text = " ".join(words)
            if turn > 3:
                source = own[conv, rng.randrange(turn)].split()
                at, n = rng.randrange(len(source) - 6), rng.randint(5, 20)
                picked = source[at : at + n]
                passage = " ".join(picked)
                cut = rng.randint(1, len(picked) - 1)
                quoted = "> " + " ".join(picked[:cut]) + "\n> " + " ".join(picked[cut:])
                want[conv, turn] = max(t for t in range(turn) if f" {passage} " in f" {own[conv, t]} ")
                rows.append((conv, turn, "user", quoted + "\n" + text))
            else:
                rows.append((conv, turn, "user", text))
            own[conv, turn] = text
    out = replies(spark, rows)
    assert all(out[k].linked_lines == out[k].quoted_lines == 2 and out[k].parent_turn == t for k, t in want.items())


# --- thousands of generated threads against a version without Spark -------------------------------------------------------
MARKS = re.compile(r"^[ \t]*>[> \t]*")


def plain(line):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", MARKS.sub("", line).lower()))


def brute_message(text):
    """Own text, quoted lines as (line, level, words)."""
    lines = text.split("\n")
    level = [m.group(0).count(">") if (m := MARKS.match(x)) else 0 for x in lines]
    kept = [
        k for k, x in enumerate(lines)
        if not (re.search(r"(?i)\bwrote:[ \t]*$", x) and k + 1 < len(lines) and level[k + 1] == level[k] + 1)
    ]
    quoted = [(k, level[k], plain(lines[k])) for k in kept if level[k] > 0]
    own = text if not quoted else "\n".join(lines[k] for k in kept if level[k] == 0).strip("\n\r\t ")
    return own, quoted


def runs_of(entries):
    out = []
    for e in entries:
        if out and out[-1][-1][0] + 1 == e[0] and out[-1][-1][1] == e[1]:
            out[-1].append(e)
        else:
            out.append([e])
    return out


def brute_thread(texts):
    """For the turns of a conversation (turn: text) parent, quoted and linked lines, and reply path."""
    parsed = {t: brute_message(x) for t, x in texts.items()}
    bodies = {t: f" {plain(' '.join(own.split(chr(10))))} " for t, (own, _) in parsed.items()}
    whole = {t: {plain(x) for x in own.split("\n")} for t, (own, _) in parsed.items()}
    latest = lambda t, holds: max((u for u in texts if u < t and holds(u)), default=None)
    parent, counts, before = {}, {}, None
    for t in sorted(texts):
        entries = parsed[t][1]
        worded = [e for e in entries if e[2]]
        found = {}
        for wide in (runs_of(entries), runs_of(worded), None):
            for run in wide if wide is not None else [[e] for e in worded]:
                words = " ".join(e[2] for e in run if e[2])
                if wide is None:  # a whole own line first, else words inside a text
                    origin = latest(t, lambda u: words in whole[u])
                    if origin is None and len(words.split()) >= quotes.LEAST:
                        origin = latest(t, lambda u: f" {words} " in bodies[u])
                else:
                    origin = latest(t, lambda u: f" {words} " in bodies[u]) if len(words.split()) >= quotes.LEAST else None
                for e in run:
                    if origin is not None and e[2]:
                        found.setdefault(e[0], origin)
        votes = Counter(found[e[0]] for e in worded if e[1] == 1 and e[0] in found)
        best = max(votes, key=lambda u: (votes[u], u)) if votes else before
        parent[t], counts[t], before = best, (len(worded), len(found)), t
    path, branch, last, open_branch = {}, {None: []}, None, None
    for t in sorted(texts):
        if last is not None and parent[t] != last:
            branch[t] = [*branch[path[parent[t]]], parent[t]]
            open_branch = t
        path[t], last = open_branch, t
    return {t: (parent[t], *counts[t], [*branch[path[t]], t]) for t in texts}


def generated(rng, turns):
    """A thread whose messages quote lines, re-wrapped passages, nested quotations and things that nobody said."""
    word = lambda: rng.choice(["alpha", "beta", "Gamma,", "delta.", "eps", "zeta", "eta", "x"])
    texts, t = {}, 0
    for _ in range(turns):
        t += rng.choice([1, 1, 1, 2, 40])
        lines = []
        for _ in range(rng.randint(0, 3)):
            source = rng.choice(list(texts.values())) if texts and rng.random() < 0.85 else " ".join(word() for _ in range(7))
            picked = [x for x in source.split("\n") if rng.random() < 0.8][:3]
            if rng.random() < 0.4:
                flat = " ".join(MARKS.sub("", x) for x in picked).split()
                at = rng.randint(0, max(len(flat) - 5, 0))
                flat = flat[at : at + rng.randint(3, 14)]
                cut = rng.randint(0, len(flat))
                picked = [" ".join(flat[:cut]), " ".join(flat[cut:])]
            if rng.random() < 0.3:
                lines.append("On Monday they wrote:")
            lines += ["> " + x for x in picked]
        lines += [" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 3))]
        texts[t] = "\n".join(lines)
    return texts


def test_generated_threads_against_brute_force(spark):
    rng = random.Random(23)
    threads = {c: generated(rng, rng.randint(1, 14)) for c in range(2000)}
    threads[5000] = generated(rng, 300)  # several lanes of turns
    threads[5001] = {k: "same line\n" + (f"> same line\nagain {k}" if k % 3 else "") for k in range(700)}  # a hot line
    threads[5002] = {k: f"step number {k} of many" + (f"\n> step number {k - 2} of many" if k > 1 else "") for k in range(40)}  # deep nesting
    rows = [(c, t, "user", x, c * 7) for c, texts in threads.items() for t, x in texts.items()]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth_of_field long")
    out = quotes.reply_order(chats.repartition(5))
    assert out.columns == ["conv_id", "turn", "role", "text", "depth_of_field", "parent_turn", "quoted_lines", "linked_lines", "depth", "reply_path"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.depth_of_field == 7 * r.conv_id for r in got)
    linked = 0
    by = {(r.conv_id, r.turn): r for r in got}
    for c, texts in threads.items():
        for t, w in brute_thread(texts).items():
            r = by[c, t]
            assert (r.parent_turn, r.quoted_lines, r.linked_lines, r.reply_path) == w, (c, t, texts)
            assert r.text == brute_message(texts[t])[0]
            linked += r.linked_lines
    assert linked > 3000 and max(r.depth for r in got) > 10


def test_long_text_clashing_columns_and_no_rows(spark):
    long = "many words here in a row\n" * 20_000
    rows = [(1, 0, long, 5), (1, 1, "> many words here in a row\nyes", 6), (1, 1, "> many words here in a row\nyes", 6)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, text string, depth long").withColumn("s", F.lit("mine")).withColumn("branch", F.lit("mine"))
    got = quotes.reply_order(chats).collect()
    # rows that repeat a turn share their links
    assert [(r.turn, r.linked_lines, r.depth, r.s, r.branch) for r in got] == [(0, 0, 0, "mine", "mine"), (1, 2, 0, "mine", "mine"), (1, 2, 0, "mine", "mine")]
    assert got[0].text == long and quotes.reply_order(chats.limit(0)).collect() == []
