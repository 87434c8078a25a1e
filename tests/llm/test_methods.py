"""Operators against brute force, exact round trips, and held-out accuracy."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebook.llm import components, license_scan, mixing, outliers, sharding, simhash, tiling, token_counts, toxicity, warc
from tidebook.llm.common import read_table


# --- sharding --------------------------------------------------------------------------------------------------------
def test_communication_matrix_has_exact_margins_and_the_right_law(spark):
    counts, sizes = [30, 0, 12, 8], [20, 20, 10]
    one = spark.range(300).select(
        sharding.communication_matrix(F.array(*map(lambda x: F.lit(x).cast("long"), counts)), F.array(*map(lambda x: F.lit(x).cast("long"), sizes)), 5).alias("m")
    )
    m = np.array(one.first().m)
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()
    draws = []
    for seed in range(60):
        row = spark.range(1).select(
            sharding._hypergeometric(F.lit(1000).cast("long"), F.lit(300).cast("long"), F.lit(200).cast("long"), F.lit((seed + 0.5) / 60)).alias("x")
        )
        draws.append(row.first().x)
    assert abs(np.mean(draws) - 60) < 1 and 4 < np.std(draws) < 7 and draws == sorted(draws)


def test_shards_rerun_alike_and_are_whole(spark, sf):
    a = sharding.op3_hypergeometric_shards(spark, sf).toPandas().set_index("doc_id")
    b = sharding.op3_hypergeometric_shards(spark, sf).toPandas().set_index("doc_id")
    assert (a.shard.sort_index() == b.shard.sort_index()).all() and (a.slot.sort_index() == b.slot.sort_index()).all()
    counts = a.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 40 and len(a) == 200
    for _, part in a.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


# --- mixing ------------------------------------------------------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1), share=1.5, ceiling=2):
    """Water-filling by rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > ceiling * sizes[s]]
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = ceiling * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(v for s, v in target.items())
    return target


def test_targets_match_rounds_of_filling(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = {s: rng.choice([0, 3, 50, 1000, 9000]) for s in ["a", "B", "", "é", "z", None, "Z", "zz"]}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        want = brute_targets(sizes)
        assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_quotas_are_sainte_lague(spark):
    rows = spark.createDataFrame([("a", 1000, 310.0, 0), ("b", 1000, 95.0, 1), ("c", 1000, 95.0, 2), ("d", 10, 20.0, 3)], "source string, source_size long, target double, n int")
    out = mixing.apportion(rows.withColumn("weight", F.lit(1.0)), n_shards=4, block=8).collect()
    block = out[0].block
    seats = round(520 / block)
    targets = {0: 310.0, 1: 95.0, 2: 95.0, 3: 20.0}
    for k in range(4):
        won = Counter()
        for _ in range(seats * (k + 1) // 4):
            won[max(targets, key=lambda s: (targets[s] / (2 * won[s] + 1), -s))] += 1
        assert {r.n: r.edges[k] for r in out} == {s: won[s] for s in targets}


def test_mix_is_near_its_targets(spark, sf):
    rows = mixing.op2_sainte_lague_mix(spark, sf).toPandas()
    assert len(rows) == 200 and (rows.taken <= 2 * rows["size"]).all()
    by = rows.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first", "size": "sum"})
    assert (by.source_size == by["size"]).all()
    assert ((by.taken - by.target).abs() <= np.maximum(0.02 * by.target, 16)).all()


# --- SimHash -----------------------------------------------------------------------------------------------------------
def test_fingerprints_bit_by_bit(spark, sf):
    for text in [None, "", "one", "one two", "A b C d", "x " * 40, "Ünï cödé wörds hère\nand\tmore"]:
        words = (text or "").encode().translate(simhash._LOWER).split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
        assert simhash.fingerprint(text.encode() if text is not None else None) & (2**64 - 1) == want


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(7)
    points = {0, 2**64 - 1}
    for _ in range(150):
        p = rng.getrandbits(64)
        points.add(p)
        for _ in range(4):
            q = p
            for _ in range(rng.randint(1, 5)):
                q ^= 1 << rng.randrange(64)
            points.add(q)
    points = sorted(points)
    want = {(a, b) for i, a in enumerate(points) for b in points[i + 1 :] if (a ^ b).bit_count() <= 3}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in points]
    got = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()
    assert {tuple(sorted((r.a & (2**64 - 1), r.b & (2**64 - 1)))) for r in got} == want


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}


# --- quality -------------------------------------------------------------------------------------------------------------
def brute_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    reached = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(reached)


def test_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a b c d e a b c d e", "a b c d e f\n\na b c d e f\n  \n#x|", "z " * 50]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "é#", "  ", "\t", " "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", outliers.text_counts(F.col("text")).alias("c"))
    for r in rows.collect():
        assert tuple(r.c) == brute_counts(texts[r.k]), texts[r.k]


def test_estimates_resist_a_third_of_junk(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        junk = k % 3 == 0
        words = [("x" * int(rng.integers(8, 12)) + "$$$") if junk else "a" * int(rng.integers(3, 7)) + str(k) for _ in range(80)]
        rows.append((k, " ".join(f"{w}{i}" for i, w in enumerate(words)), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in outliers.drop_outliers(docs).collect()}
    assert kept == {k for k in range(300) if k % 3}


def test_chi_square():
    assert outliers.chi2_cdf(outliers.chi2_quantile(0.975, 4), 4) == pytest.approx(0.975)
    assert outliers.chi2_quantile(0.5, 4) == pytest.approx(3.3567, abs=1e-4)


# --- token counts -------------------------------------------------------------------------------------------------------
COUNTER = token_counts.PieceCounter(token_counts.model_path(token_counts.MODEL), memo_bytes=500, batch_bytes=200, long=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", " ", "\n", "é", "▁", "  ", "\t", "<s>", "</s>", "the", "\r\n", " \n", "\n ", "①", "x", "　", "日本"]), max_size=14))
def test_safe_pieces_count_like_the_whole(parts):
    text = "".join(parts)
    assert COUNTER.count([text]) == [len(COUNTER.encoder.encode(text))]


def test_texts_are_counted_together_and_long_runs_in_parts(monkeypatch):
    rng = random.Random(5)
    runs = ["".join(rng.choice(alphabet) for _ in range(3000)) for alphabet in ("abcXYZ09+/", "日本語学校", "é\u0301ßx", "x")]
    texts = [None, "", *runs, " ".join(runs), "\n" + runs[0] + "\n\n" + runs[1], "the " * 5000, *(" ".join(rng.choice(["the", "cat", "Öl", "x\ny"]) for _ in range(40)) for _ in range(200))]
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 3000)
    counter = token_counts.PieceCounter(token_counts.model_path(token_counts.MODEL), memo_bytes=200, batch_bytes=1000, long=64)
    sizes = []
    encode = counter.encoder.encode
    monkeypatch.setattr(counter, "encoder", type("Seen", (), {"encode": lambda self, batch, **k: sizes.append(sum(len(x.encode()) for x in batch)) or encode(batch, **k)})())
    assert counter.count(texts) == [len(encode(t or "")) for t in texts]
    # a run of one letter has no safe place; other batches are near the bound
    assert sum(s >= 3000 for s in sizes) <= 2 and len(sizes) > 30
    assert all(sum(map(len, counter.segments(r))) == len(r) for r in runs) and len(counter.segments(runs[1])) > 20


def test_token_counts_match_the_library(spark, sf):
    encoder = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path(token_counts.MODEL))
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    for r in token_counts.op6_token_counts(spark, sf).collect():
        text = texts[r.doc_id] or ""
        assert r.n_bytes == len(text.encode()) and r.n_tokens == len(encoder.encode(text)) and r.over_limit == (r.n_tokens > 4096)


# --- tiling --------------------------------------------------------------------------------------------------------------
def brute_cover(text, item, least):
    used, marked, total = [False] * len(text), [False] * len(item), 0
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(text)):
                k = 0
                while a + k < len(item) and b + k < len(text) and item[a + k] == text[b + k] and not marked[a + k] and not used[b + k]:
                    k += 1
                if k >= least and (best is None or (-k, a, b) < best):
                    best = (-k, a, b)
        if best is None:
            return total
        k, a, b = -best[0], best[1], best[2]
        for j in range(k):
            marked[a + j] = used[b + j] = True
        total += k


@pytest.mark.parametrize("most_seeds", [0, 1_000_000])
def test_tiles_match_brute_force(monkeypatch, most_seeds):
    monkeypatch.setattr(tiling, "MOST_SEEDS", most_seeds)
    rng = random.Random(3)
    for _ in range(120):
        v, least = rng.choice([2, 3, 6]), rng.choice([2, 3, 5])
        items = [" ".join(rng.choice("abcdef"[:v]) for _ in range(rng.randint(0, 14))) for _ in range(3)]
        texts = [" ".join(rng.choice("abcdef"[:v] + "z") for _ in range(rng.randint(0, 30))) for _ in range(3)]
        block = tiling.Benchmark([(k, x.encode()) for k, x in enumerate(items)], least)
        for t, found in zip(texts, block.covers([t.encode() for t in texts], 0.01), strict=True):
            # items of fewer words than a seed count whole
            want = {k: brute_cover(t.split(), x.split(), min(least, max(len(x.split()), 1))) for k, x in enumerate(items)}
            assert {c.item: c.covered for c in found} == {k: c for k, c in want.items() if c}


def test_words_are_compared_without_case_marks_and_punctuation_of_any_script():
    plain = ["l", "ecole", "est", "finie", "strasse", "2"]
    assert [w.decode() for w in tiling.words_of_bytes("L’ÉCOLE est — «finie»… STRASSE 2".encode())] == plain
    assert [w.decode() for w in tiling.words_of_bytes("l'école est finie, straße 2!".encode())] == plain
    assert tiling.words_of_bytes(b"L'ecole\xff est") == [b"l", b"ecole", b"est"] and tiling.words_of_bytes(None) == []


def test_reordered_passages_are_caught_in_any_number_of_blocks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "so: Eta theta, iota kappa lambda mu -- and then Alpha, beta gamma delta epsilon zeta!"
    docs = spark.createDataFrame([(1, moved), (2, "alpha beta gamma nothing else here at all")], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"{item} {k}") for k in range(4)], "item_id long, text string")
    for block in (1 << 24, 60):
        rows = tiling.contaminated_pairs(docs, items, block_bytes=block).collect()
        assert sorted((r.doc_id, r.item_id, r.tiles, r.covered) for r in rows) == [(1, k, 2, 12) for k in range(4)]


# --- toxicity ------------------------------------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = read_table(spark, sf, "labels").where("doc_id % 4 <> 0")
    held = {r.doc_id: r.toxic for r in read_table(spark, sf, "labels").where("doc_id % 4 = 0").collect()}
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    steps = toxicity.fit(docs, labels)
    found = {r.doc_id for r in toxicity.score_documents(docs.where("doc_id % 4 = 0"), steps).where("toxic").collect()} & set(held)
    toxic = {k for k, v in held.items() if v}
    assert len(found & toxic) >= 0.85 * len(toxic) and len(found - toxic) <= 0.05 * len(found)
    assert [s.category for s in steps] == ["low_quality", "toxic"] and len(steps[1].earlier) == 1


def brute_chain(texts, labels, folds):
    """The chain from its definition: word sets, plain Newton steps, a fold at a time; per category weights, threshold and probabilities out of fold."""
    sets = [set("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in texts]

    def style(t, n_words, n_distinct):
        size = max(len(t), 1)
        return [
            sum("A" <= c <= "Z" for c in t) / size, sum(c in "#*$%&|<>" for c in t) / size, len(t) / max(n_words, 1) / 10,
            n_distinct / max(n_words, 1) ** 0.5 / 10, np.log1p(n_words) / 10,
        ]

    dense = [style(t, len("".join(c if c.isalnum() else " " for c in t.lower()).split()), len(s)) for t, s in zip(texts, sets, strict=True)]

    def chosen_words(mine, y):
        strength = {}
        for w in set().union(*(sets[k] for k in mine)):
            cells = Counter((w in sets[k], y[k]) for k in mine)
            g = 0.0
            for (a, b), seen in cells.items():
                row, col = sum(v for (x, _), v in cells.items() if x == a), sum(v for (_, x), v in cells.items() if x == b)
                g += seen * np.log(seen * len(mine) / (row * col))
            if sum(v for (x, _), v in cells.items() if x) >= toxicity.LEAST_ROWS:
                strength[w] = max(2 * g, 0) ** 0.5
        return sorted(w for w, v in strength.items() if v >= toxicity.LEAST_ROOT)

    def fit(mine, y, dense):
        words = chosen_words(mine, y)
        x = np.array([[float(w in sets[k]) for w in words] + dense[k] + [1.0] for k in mine])
        target = np.array([float(y[k]) for k in mine])
        penalty = np.full(x.shape[1], toxicity.RIDGE)
        penalty[-1] = 1e-6
        w = np.zeros(x.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (target - p) - penalty * w)
            w += step * min(1.0, 1 / np.abs(step).max())
        return words, w

    def predict(k, words, w, dense):
        return 1 / (1 + np.exp(-(sum(v for word, v in zip(words, w, strict=False) if word in sets[k]) + np.dot(w[len(words) :], [*dense[k], 1.0]))))

    out = []
    for c in range(2):
        y = [int(row[c]) for row in labels]
        oof = [0.0] * len(texts)
        for f in range(toxicity.FOLDS):
            words, w = fit([k for k in range(len(texts)) if folds[k] != f], y, dense)
            for k in range(len(texts)):
                if folds[k] == f:
                    oof[k] = predict(k, words, w, dense)
        words, w = fit(list(range(len(texts))), y, dense)
        cut = [(sum(y[k] for k in range(len(y)) if oof[k] >= p), sum(q >= p for q in oof), p) for p in sorted(set(oof))]
        best = max(((2 * h / (n + sum(y)), p) for h, n, p in cut if h >= 0.9 * n and h), default=None)
        out.append((dict(zip(words, w, strict=False)), w[len(words) :], best, oof))
        dense = [[*d, float(np.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4))))] for d, p in zip(dense, oof, strict=True)]
    return out


def test_chain_against_its_definition():
    """Weights, what later models get of earlier ones out of fold, thresholds and scores, on texts whose categories depend on each other."""
    rng = random.Random(8)
    texts, labels = [], []
    for _ in range(240):
        low = rng.random() < 0.4
        toxic = rng.random() < (0.6 if low else 0.1)
        words = [rng.choice(["calm", "day", "tree", "river", "Stone", "bread"]) for _ in range(rng.randint(4, 25))]
        words += [rng.choice(["spam", "BUY", "now$"])] * (2 * low) if rng.random() < 0.9 else []
        words += [rng.choice(["vile", "awful"])] if toxic and rng.random() < 0.8 else []
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((int(low), int(toxic)))
    folds = np.array([k % toxicity.FOLDS for k in range(len(texts))])
    steps = toxicity.train_chain([t.encode() for t in texts], np.array(labels), folds)
    want = brute_chain(texts, labels, folds)
    for step, (words, rest, best, oof) in zip(steps, want, strict=True):
        assert set(step.words) == set(words) and all(step.words[k] == pytest.approx(v, abs=1e-4) for k, v in words.items())
        assert [*step.style, *step.earlier, step.bias] == pytest.approx(rest.tolist(), abs=2e-3)
        below = max((p for p in oof if p < best[1] - 1e-6), default=0.0)
        assert step.threshold == pytest.approx((best[1] + below) / 2, abs=1e-4)
    assert abs(steps[1].earlier[0]) > 0.1
    chain = toxicity.Chain(steps)
    for text in texts[:40]:
        features, before = toxicity.text_features(text.encode()), []
        for (words, rest, _, _), p in zip(want, chain.scores(text.encode()), strict=True):
            x = sum(v for k, v in words.items() if k.encode() in features[0]) + np.dot(rest, [*features[1], *before, 1.0])
            assert p == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-3)
            before.append(float(np.log(p / (1 - p))))


def test_threshold_needs_precision():
    assert toxicity.best_threshold(np.array([0.5, 0.5, 0.5]), np.array([0.0, 1.0, 0.0])) > 1
    assert 0.4 < toxicity.best_threshold(np.array([0.9, 0.8, 0.1]), np.array([1.0, 1.0, 0.0])) < 0.5


# --- WARC ----------------------------------------------------------------------------------------------------------------
def archive(n=6):
    parts = []
    for k in range(n):
        payload = f"<html>{k} {'x' * 150}</html>".encode()
        digest = hashlib.sha256(payload).hexdigest()
        parts.append(warc.build_record("response", str(k), 1, "http://u", payload, len(payload), digest, None))
    return parts


@pytest.mark.parametrize("squeeze", [True, False])
def test_salvage_goes_on_after_damage(squeeze):
    parts = [warc._member(p) if squeeze else p for p in archive()]
    whole = b"".join(parts)
    assert [f.page_id for f in warc.salvage(whole)] == list("012345")
    start = len(parts[0]) + len(parts[1])
    bad = bytearray(whole)
    bad[start + 30 : start + 36] = b"\0\0\0\0\0\0"
    bad[start + 60 + len(parts[2]) // 2 :][:1] = b"!"
    bad[start + len(parts[2]) // 2] ^= 0xFF
    found = list(warc.salvage(bytes(bad)))
    assert [f.page_id for f in found if f.fault is None] == list("01345")
    gap = next(f for f in found if f.fault)
    assert gap.offset == start and gap.length == len(parts[2])
    cut = list(warc.salvage(whole[: -len(parts[5]) // 2]))
    assert [f.page_id for f in cut if f.fault is None] == list("01234") and cut[-1].fault
    assert sum(f.length for f in found) == len(whole)


def foreign(kind, name, block, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", *more]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("squeeze", ["each", "together", "none"])
def test_salvage_reads_archives_of_others(squeeze):
    """Any type and id, SHA-1 in base 32, HTTP without a length; a wrong digest is a gap, and what follows is read."""
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>text</p>"
    digest = "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"<p>text</p>").digest()).decode()
    http = "Content-Type: application/http; msgtype=response"
    parts = [
        foreign("warcinfo", "a", b"software: x\r\n"),
        foreign("request", "b", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        foreign("response", "c", page, http, digest),
        foreign("response", "d", page.replace(b"text", b"tent"), http, digest),
        foreign("metadata", "e", b"fetchTimeMs: 3"),
        foreign("revisit", "f", page[:30], http, digest, "WARC-Refers-To: <urn:uuid:c>"),
    ]
    whole = {"each": b"".join(map(warc._member, parts)), "together": warc._member(b"".join(parts)), "none": b"".join(parts)}[squeeze]
    found = list(warc.salvage(whole))
    assert [(f.record_type, f.record_id) for f in found if not f.fault] == [
        (k, f"<urn:uuid:{n}>") for k, n in zip(("warcinfo", "request", "response", "metadata", "revisit"), "abcef", strict=True)
    ]
    gaps = [f for f in found if f.fault]
    assert len(gaps) == 1 and "digest" in gaps[0].fault and sum(f.length for f in found) == len(whole)
    response = next(f for f in found if f.record_type == "response")
    assert response.payload == b"<p>text</p>" and found[-1].refers_to == "<urn:uuid:c>" and found[-1].payload is None


def test_gaps_are_logged_and_files_are_bounded(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"{k}" * 300) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"), file_bytes=400)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 5 and max(f.stat().st_size for f in files) < 1000
    data = bytearray(files[0].read_bytes())
    data[len(data) // 3] ^= 0xFF
    files[0].write_bytes(data)
    for crc in (tmp_path / "a").glob(".*.crc"):
        crc.unlink()
    records, gaps = warc.recover(spark, str(tmp_path / "a"), str(tmp_path / "r"))
    assert 27 <= records.count() < 30 and gaps.count() >= 1 and spark.read.json(str(tmp_path / "r/quarantine")).count() == gaps.count()


def test_query_matches_its_sql(spark, sf):
    import duckdb

    from tidebook.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, run in (("op9_warc_salvage", warc.op9_warc_salvage), ("op1_license_scan", license_scan.op1_license_scan)):
        got, want = run(spark, sf).toPandas(), con.sql(ORACLE_SQL[name]).df()
        key = [got.columns[0]]
        a, b = got.sort_values(key)[sorted(got)].astype(str).values.tolist(), want.sort_values(key)[sorted(want)].astype(str).values.tolist()
        assert [[v.removesuffix(".0").replace("<NA>", "nan") for v in r] for r in a] == [[v.removesuffix(".0").replace("<NA>", "nan") for v in r] for r in b]


# --- license scan ---------------------------------------------------------------------------------------------------------
def test_block_join_is_exact(spark):
    rng = random.Random(2)
    vocabulary = [w for t, _ in license_scan.TEMPLATES for w in license_scan.template_words(t)] + ["foo", "bar"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 130))) for _ in range(60)] + [t for t, _ in license_scan.TEMPLATES]
    rows = license_scan.scan(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), threshold=0.6).collect()
    import re

    for r in rows:
        words = re.findall(r"[a-z0-9]+", texts[r.k])
        blocks = [set(words[s : s + 48]) for s in range(0, max(len(words) - 24, 1), 24)]
        want = set()
        for template, label in license_scan.TEMPLATES:
            tokens = license_scan.template_words(template)
            if any(len(b & set(tokens)) >= license_scan.need(len(tokens), 0.6) for b in blocks):
                want.add(label)
        joined = " " + " ".join(words) + " "
        want |= {label for phrase, label in license_scan.PHRASES if f" {phrase} " in joined}
        assert set(filter(None, r.labels.split(","))) == want


def test_templates_of_any_length(spark):
    """A template of 300 words, at any place of a long text, whole or with a twentieth of it left out."""
    rng = random.Random(9)
    template = " ".join(f"law{k}" for k in range(300))
    short = "released under the mit license"
    texts = []
    for k in range(12):
        words = template.split()
        for _ in range(15 * (k % 3)):
            words.pop(rng.randrange(len(words)))
        texts.append(" ".join(["pad"] * rng.randint(0, 900) + words + ["pad"] * rng.randint(0, 900)))
    texts += [" ".join(template.split()[:200]), short, template + " " + short]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ((template, "law"), (short, "mit"))).orderBy("k").collect()
    assert [r.labels for r in rows] == ["law"] * 12 + ["", "mit", "law,mit"]
