"""The pipeline's stages, each against a brute-force version of it on its own input."""

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

import corpus_pipeline
from tidebook.llm import mixing, outliers, simhash
from tidebook.llm.common import read_table
from tidebook.llm.tiling import COVERAGE, words_of_bytes

from .test_methods import brute_counts, brute_cover, brute_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows of documents and of each stage's result, written and read again as the tool does."""
    docs = read_table(spark, sf, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return {k: v.collect() for k, v in out.items()}


def chi2_cdf(x, df):
    """By integration of the density."""
    t = np.linspace(0, x, 20_001)[1:]
    density = t ** (df / 2 - 1) * np.exp(-t / 2) / (2 ** (df / 2) * math.gamma(df / 2))
    return float(density.sum() * x / 20_000)


@lru_cache(None)
def quantile(q, df=4):
    low, high = 0.0, 80.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return low


@lru_cache(None)
def whole_again(share):
    return 1.0 if share >= 1 else share / chi2_cdf(quantile(share), 6)


def sorted_mcd(rows):
    """Verdicts by concentration on sorted distances until the subset stays, from the same two starts, group by group."""
    groups = defaultdict(list)
    for r in rows:
        groups[(r.lang, r.source)].append(r)
    kept = set()
    for part in groups.values():
        counts = [brute_counts(r.text) for r in part]
        sound = [k for k, c in enumerate(counts) if c[0] >= 10 and 100 * c[4] <= 20 * c[0]]
        if not sound:
            continue
        length = sum(counts[k][1] for k in sound) / sum(counts[k][0] for k in sound)
        x = np.array([vector(counts[k], length) for k in sound])
        ridge = np.diag(np.array(outliers.RIDGE) ** 2)
        n = len(x)
        h = min(n, (n + 4 + 1) // 2)
        q = np.percentile(x, [25, 50, 75], axis=0, method="inverted_cdf")
        found = []
        for centre, scatter in [(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + ridge), (x.mean(0), np.cov(x.T, ddof=0) + ridge)]:
            before = None
            for _ in range(100):
                d = distances(x, centre, scatter)
                inner = d <= np.sort(d)[h - 1]  # ties go together
                if before is not None and (inner == before).all():
                    break
                before = inner
                centre = x[inner].mean(0)
                scatter = whole_again(round(inner.mean(), 3)) * np.cov(x[inner].T, ddof=0) + ridge
            found.append((np.linalg.det(scatter), centre, scatter))
        _, centre, scatter = min(found, key=lambda f: f[0])
        inner = x[distances(x, centre, scatter) <= quantile(0.975)]
        if len(inner):
            centre, scatter = inner.mean(0), whole_again(0.975) * np.cov(inner.T, ddof=0) + ridge
        d = distances(x, centre, scatter)
        kept |= {part[k].doc_id for k, v in zip(sound, d, strict=True) if v <= quantile(1 - outliers.TAIL)}
    return kept


def vector(c, length):
    n = c[0] + outliers.PRIOR_WORDS
    return [np.log((c[1] + outliers.PRIOR_WORDS * length) / n), np.log1p(100 * c[2] / n), np.log1p(100 * c[3] / n), c[4] / n]


def distances(x, centre, scatter):
    gap = x - centre
    return np.einsum("ij,jk,ik->i", gap, np.linalg.inv(np.atleast_2d(scatter)), gap)


def test_quality(stages):
    kept = {r.doc_id for r in stages["quality_rules"]}
    want = sorted_mcd(stages["documents"])
    assert len(kept ^ want) <= 0.02 * len(want)
    failed = {r.doc_id for r in stages["documents"] if (c := brute_counts(r.text))[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert not kept & failed
    texts = {r.doc_id: r.text for r in stages["documents"]}
    assert all(r.text == texts[r.doc_id] for r in stages["quality_rules"])


def test_near_dedup(stages):
    rows = stages["quality_rules"]
    prints = [simhash.fingerprint(r.text.encode()) & (2**64 - 1) for r in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[top(k)].append(r.doc_id)
    assert sorted(r.doc_id for r in stages["simhash_near_dedup"]) == sorted(min(g) for g in groups.values())


def test_decontamination(stages, spark, sf):
    items = [words_of_bytes(r.text.encode()) for r in read_table(spark, sf, "benchmark").collect()]
    want = []
    for r in stages["simhash_near_dedup"]:
        words = words_of_bytes(r.text.encode())
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        near = [i for i in items if any(tuple(i[k : k + 5]) in runs for k in range(len(i) - 4))]
        if not any(brute_cover(words, i, 5) >= COVERAGE * len(i) for i in near):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in stages["decontamination"]) == sorted(want)


def test_mixing(stages):
    words = lambda rows: Counter({s: sum(len(WORD.findall(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}})
    before, after = words(stages["decontamination"]), words(stages["mixing"])
    for source, target in brute_targets(before).items():
        assert abs(after[source] - target) <= mixing.BLOCK and abs(after[source] - target) <= max(0.02 * target, 2)
    whole = {r.doc_id: r for r in stages["decontamination"]}
    cut = [r for r in stages["mixing"] if r.text != whole[r.doc_id].text]
    assert len(cut) <= 2 * len(before) and all(r.text in whole[r.doc_id].text or len(WORD.findall(r.text)) for r in cut)
    assert all(n <= 3 for n in Counter(r.doc_id for r in stages["mixing"]).values())
    assert all(r.n_chars == len(r.text) for r in cut)


def test_sharding(stages):
    rows = stages["sharding"]
    plain = lambda part: sorted((r.doc_id, r.text) for r in part)
    assert plain(rows) == plain(stages["mixing"])
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in counts.items())


def test_run_is_its_stages(stages, spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.text, r.shard, r.slot) for r in stages["sharding"])


def test_stage_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(stages[name][0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_on_no_rows_and_on_null_texts(spark, sf, tmp_path):
    for name, rows in (("none", []), ("nulls", [(1, None, None, None, None), (None, None, "en", "a", 0), (2, "", "en", None, 0)])):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
        read_table(spark, sf, "benchmark").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.collect() == [] and out.columns[-2:] == ["shard", "slot"]
