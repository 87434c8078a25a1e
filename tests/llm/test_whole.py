"""Nothing is lost: digests that see nulls, blocks that stay ready, groups beyond the broadcast bound."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebook.llm import common, outliers, simhash, tiling
from tidebook.llm.common import row_digest
from tidebook.llm.mixing import mixed_documents
from tidebook.llm.sharding import shard_documents

DOCS = "doc_id long, text string, lang string, source string"
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_a_null_that_moves_between_columns_is_seen(spark):
    rows = [(1, None, PROSE, "x"), (1, PROSE, None, "x"), (1, PROSE, "x", None), (1, PROSE, None, "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tags", F.array(F.lit(None).cast("string"), F.lit("a")))
    other = docs.limit(1).withColumn("tags", F.array(F.lit("a"), F.lit(None).cast("string")))
    both = docs.unionByName(other).withColumn("facts", F.create_map(F.lit("k"), F.col("source")))
    digests = both.select(*row_digest(both, ("a", "b"))).collect()
    assert len({(r.a, r.b) for r in digests}) == 4


def test_no_document_goes_with_one_that_only_looks_alike(spark):
    rows = [(1, None, PROSE, "x"), (1, PROSE, None, "x"), (2, PROSE, None, "x"), (2, None, None, "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("facts", F.create_map(F.lit("k"), F.lit(1)))
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(1, PROSE)] and len(kept) == 2
    assert shard_documents(docs).count() == 4
    assert mixed_documents(docs).count() >= 2


@pytest.mark.parametrize("n_blocks", [2, 7])
def test_each_block_is_made_once_for_a_group_of_batches(monkeypatch, n_blocks):
    made = []

    class Counted(tiling.Benchmark):
        def __init__(self, *a):
            made.append(1)
            super().__init__(*a)

    class Part:
        def __init__(self, rows):
            self.value = rows

    monkeypatch.setattr(tiling, "Benchmark", Counted)
    tiling._READY.clear()
    blocks = tiling.Blocks([Part([(k, f"item number {k} has some words of its own here".encode())]) for k in range(n_blocks)], 5)
    batches = [pa.array([b"nothing", b"item number 1 has some words of its own here"], pa.binary())] * 10
    met = tiling.matches(blocks, 0.9)
    out = [r for part in met(iter(batches)) for r in part.to_pylist()]
    assert len(out) == 20 and [[c["item_id"] for c in r] for r in out] == [[], [1]] * 10
    assert len(made) == n_blocks


def test_groups_beyond_the_bound_are_judged_alike(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text")
    slim = common.durable(outliers.count_documents(docs).drop("text", "lang", "source"))
    few = {r.doc_id: r.kept for r in outliers.judge(slim, outliers.estimates(slim)).collect()}
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    many = {r.doc_id: r.kept for r in outliers.judge(slim, outliers.estimates(slim)).collect()}
    assert many == few and len(few) == docs.count()
