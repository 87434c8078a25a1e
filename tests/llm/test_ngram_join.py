"""The Jaccard join against all pairs, on groups of near copies, long lists, odd rows and any number of matches asked."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebook.llm import ngram_join
from tidebook.llm.ngram_join import least_overlap, matches_asked, shingle_hashes, shingle_set, similar_sets

DOCS = "doc_id long, text string"


def plain_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if len(words) < 3:
        return frozenset([" ".join(words)]) if words else frozenset()
    return frozenset(" ".join(words[k : k + 3]) for k in range(len(words) - 2))


def expected(rows, per_cent=90):
    """(doc_id, n_shingles, component_id) by all pairs and a search."""
    sets = [plain_set(t) for _, t in rows]
    link = [[j for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= per_cent * len(a | b)] for a in sets]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc_id, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, n):
    """Chains of edits, groups of near copies, a passage that all share, and words of a small vocabulary."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    shared = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for k in range(n):
        kind = rng.random()
        base = rows[rng.randrange(len(rows))][1] if rows and kind < 0.6 else None
        if base:
            held = base.split(" ")
            for _ in range(rng.randint(0, 2)):
                held[rng.randrange(len(held))] = rng.choice(words)
            text = " ".join(held)
        elif kind < 0.8:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        else:
            text = shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        rows.append((n - k, text))
    return rows


@pytest.mark.parametrize("per_cent,most", [(90, 4), (90, 1), (80, 3)])
def test_all_links_are_found(spark, per_cent, most):
    rows = corpus(5, 160)
    out = similar_sets(spark.createDataFrame(rows, DOCS), per_cent=per_cent, most_matches=most, block_rows=7).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    assert found == expected(rows, per_cent)
    assert 20 < len({r.component_id for r in out}) < 150


def test_prefixes_of_any_length_meet():
    """Whatever two linked sets ask for, that many of their common shingles lie in both prefixes."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(9, 80))
        a = set(rng.choice(200, n, replace=False).tolist())
        b = set(a)
        for x in rng.choice(sorted(a), int(rng.integers(0, 3)), replace=False).tolist():
            b.discard(x)
        for x in rng.integers(0, 200, int(rng.integers(0, 3))).tolist():
            b.add(x)
        if 100 * len(a & b) < 90 * len(a | b):
            continue
        for asked in (1, 2, 3, 4):
            one, other = (sorted(s)[: len(s) - least_overlap(len(s)) + asked] for s in (a, b))
            assert len(set(one) & set(other)) >= asked


def test_longer_prefixes_where_candidates_are_many():
    assert matches_asked(np.zeros(10), 5, 50) == 1
    assert matches_asked(np.array([100.0, 100, 0, 0, 0, 0]), 2, 50) == 4
    assert matches_asked(np.array([1.0, 1, 10_000, 10_000, 10_000]), 2, 50) == 1


def test_hashes_follow_the_sets(monkeypatch):
    texts = ["A b\tc d", "a b c\n\nD", "a b", "a b a b a b", "", None, " \n", "x" * 9, "é ß ü É", "\x1c \x85 a"]
    for t in texts:
        raw = None if t is None else t.encode()
        assert len(shingle_hashes(raw)) == len(shingle_set(raw)) == len(plain_set(t))
    long_text = " ".join(f"v{k % 977}x{k % 13}" for k in range(20_000)).encode()
    whole = shingle_hashes(long_text)
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 100)
    assert (shingle_hashes(long_text) == whole).all() and len(whole) == len(shingle_set(long_text))


def test_odd_rows(spark):
    rows = [(None, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "ONE"), (None, "one"), (None, "two words"), (None, "Two  Words"), (7, "long " * 30_000), (2, "long long long"), (8, "x" * 100_000), (5, "one")]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("mine").alias(c) for c in ("n", "d", "tkey", "token", "group", "component_id")])
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_sets(docs).collect()), key=str)
    assert out == expected(rows)
    assert similar_sets(docs.limit(0)).count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    """Copies and near copies of one text: pairs grow with the rows, and every document gets its component."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(400):
        held = list(base)
        held[rng.randrange(300)] = f"n{rng.randrange(200)}"
        rows.append((k + 10, " ".join(held)))
    rows += [(1000 + k, " ".join(base)) for k in range(400)] + [(5000 + k, " ".join(f"u{k}a{j}" for j in range(30))) for k in range(800)]
    out = {r.doc_id: r.component_id for r in similar_sets(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(out) == 1600 and {out[k + 10] for k in range(400)} == {10} and {out[1000 + k] for k in range(400)} == {10}
    assert all(out[5000 + k] == 5000 + k for k in range(800))


def test_the_bound_is_never_below_what_sets_share():
    rng = random.Random(8)
    sets = [shingle_hashes(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 400))).encode()) for _ in range(60)]
    spreads = [np.bincount((h >> np.uint64(56)).astype(int), minlength=256).astype(np.uint8).tobytes() for h in sets]
    pairs = [(i, j) for i in range(60) for j in range(60)]
    one, other = (pa.array([None if p[k] == 7 else spreads[p[k]] for p in pairs], pa.binary()) for k in (0, 1))
    for (i, j), most in zip(pairs, ngram_join.most_in_common(one, other).to_pylist(), strict=True):
        assert (most is None) == (7 in (i, j))
        assert most is None or most >= len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_near_copies_that_do_not_link_do_not_meet_in_pairs(spark, monkeypatch):
    """Copies of one text with one to four edits each, of which few pairs link: rows that meet grow with the rows, and no link is lost."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = [(500, " ".join(base))]
    for k in range(200):
        held = list(base)
        for at in rng.sample(range(2, 148), 1 + k % 4):
            held[at] = f"n{k}x{at}"
        rows.append((k, " ".join(held)))
    met = []
    candidates = ngram_join._candidates
    monkeypatch.setattr(
        ngram_join, "_candidates", lambda df, per_cent: met.append(df.where(ngram_join._may_match(per_cent)).count()) or candidates(df, per_cent)
    )
    out = similar_sets(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == expected(rows)
    assert len({r.component_id for r in out}) > 50
    assert len(met) == 2 and max(met) < 20 * len(rows)


def test_counters_of_many_tasks_sum_to_their_classes(spark):
    """The classes of the sketch are those of all shingles, however many tasks counted them."""
    rows = corpus(6, 60)
    survey = ngram_join._survey(spark.createDataFrame(rows, DOCS).select("doc_id", F.col("text").cast("binary").alias("text"), F.md5("text").alias("tkey")).repartition(7), 3)
    classes, mean = ngram_join._classes(survey)
    hashes = np.concatenate([shingle_hashes(t.encode()) for _, t in rows])
    counts = np.bincount((hashes >> np.uint64(64 - ngram_join.SKETCH_BITS)).astype(int), minlength=1 << ngram_join.SKETCH_BITS)
    assert (classes == ngram_join._class_of(counts)).all() and mean == counts.mean()
