"""Fill-in-the-middle: the rule written out in plain Python, exact round trips, odd rows and cut batches."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidebook.llm import infill
from tidebook.llm.infill import Recipe

DOCS = "doc_id long, text string"
TEXTS = [
    "one\ntwo\nthree\n", "one line", "\n", "\n\n\n", None, "", "é\nÜber 🤦🏼‍♂️\nnul\0l\n", "a <S> b\n", "<P", "S>\n<\nM>", "<M>",
    "\r\nx\r\n", "<\n" * 5, "quote ' and \\n\n%", "word\n" * 40_000, "x" * 200_000,
]


def expected(doc_id, text, recipe):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{recipe.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:first], units[first:second], units[second:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= recipe.rate:
        return n, "plain", None, None, text
    if h[3] % 100 < recipe.spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("recipe", [Recipe(), Recipe(seed=-3, rate=60, spm=20)])
def test_rule_and_round_trip(spark, recipe):
    rows = [(k if k % 11 else None, TEXTS[k % len(TEXTS)]) for k in range(12 * len(TEXTS))]
    docs = spark.createDataFrame(rows, DOCS)
    out = infill.fill_in_middle(docs, recipe, slice_bytes=100_000).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, recipe)
        assert r.back == (r.text or "")


def test_batches_are_cut_by_bytes(spark):
    assert list(infill.slices(infill.np.array([5, 5, 20, 1, 1, 1]), 10)) == [(0, 2), (2, 1), (3, 3)]
    assert list(infill.slices(infill.np.array([], int), 10)) == []


def test_other_columns_stay_and_names_clash(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc")], DOCS).select(
        "*", F.lit("mine").alias("n"), F.lit(2).alias("p"), F.array(F.lit(1)).alias("a.b"), F.lit("x").alias("place")
    )
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "p", "a.b", "place", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.collect()
    assert rows[0] == rows[1] and rows[0].n == 3 and rows[0]["a.b"] == [1] and rows[0].place == "x"
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = infill.op12_fill_in_middle(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, output = expected(r.doc_id, docs[r.doc_id], Recipe())
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
