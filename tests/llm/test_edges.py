"""Every operator on nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from tidebook.llm import license_scan, mixing, outliers, quotes, sharding, simhash, tiling, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, PROSE, "en", "a", 1),
        (1, PROSE, "en", "a", 1),  # a repeated row
        (2, PROSE, None, None, None),
        (3, None, "en", "a", 0),
        (4, "", None, "b", 0),
        (None, " \n\t ", "en", None, 3),
        (None, "all rights reserved. CC BY. General\nPublic-License", "en", "a", 9),
        (7, "word " * 30_000, "en", "b", 150_000),
        (8, "x" * 50_000, "de", "b", 50_000),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Columns with the names that operators add or use."""
    for c in ("size", "shard", "slot", "key", "n", "fp", "taken", "n_words", "labels", "failed", "reach", "cut", "toxic"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def test_license_scan(docs):
    rows = license_scan.scan(clashing(docs)).collect()
    assert len(rows) == 9
    hit = next(r for r in rows if r.text and r.text.startswith("all rights"))
    assert (hit.n_words, hit.n_base, hit.first_word, hit.last_word) == (8, 3, 0, 5)
    assert hit.base_labels == hit.labels == "cc-by,gpl,reserved" and hit.score == 1.0 and hit.size == "mine"
    empty = next(r for r in rows if r.doc_id == 3)
    assert (empty.n_words, empty.n_base, empty.first_word, empty.labels, empty.score) == (0, 0, None, "", 0.0)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mixed_documents(clashing(docs))
    assert out.columns == clashing(docs).columns
    assert {r.key for r in out.select("key").distinct().collect()} == {"mine"}
    sized = mixing.mix(docs, mixing.count_words(F.col("text")), ["doc_id"])
    rows = sized.collect()
    assert len(rows) == 9 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(sum(r.shard_words) == r.taken for r in rows)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.op2_sainte_lague_mix.__doc__ and [r.taken for r in mixing.mix(docs, mixing.count_words(F.col("text")), ["doc_id"], bits=3).orderBy("doc_id", "size").collect()] == [
        r.taken for r in sized.orderBy("doc_id", "size").collect()
    ]
    words = out.select(mixing.count_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == sum(r.taken for r in rows)


def test_rows_that_tie_are_cut_and_placed_alike_however_they_lie(spark):
    """Null ids and equal sizes: only the text tells the rows apart."""
    rows = spark.createDataFrame([(None, " ".join(f"w{k}" for _ in range(40)), "en", "a", 1) for k in range(40)], DOCS)
    ways = (rows.orderBy("text").coalesce(1), rows.repartition(7, "text"))
    for stage in (mixing.mixed_documents, sharding.shard_documents, simhash.drop_near_duplicates):
        a, b = (sorted(map(str, stage(w).collect())) for w in ways)
        assert a == b


def test_sharding(docs):
    out = sharding.shard_documents(clashing(docs))
    rows = out.collect()
    assert len(rows) == 9 and {r.key for r in rows} == {"mine"}
    assert sorted((r.shard, r.slot) for r in rows) == [(k, 0) for k in range(9)]
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    sized = sharding.assign_shards(docs, ["doc_id", "text"], n_shards=4, partitions=3, bits=1).collect()
    counts = [sum(r.shard == k for r in sized) for k in range(4)]
    assert sorted(counts) == [2, 2, 2, 3]
    assert all(sorted(r.slot for r in sized if r.shard == k) == list(range(n)) for k, n in enumerate(counts))


def test_simhash(docs):
    rows = simhash.near_duplicates(clashing(docs)).collect()
    assert len(rows) == 9
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in rows if r.fp == 0} == {3}  # null, empty and blank texts share one component
    kept = simhash.drop_near_duplicates(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_outliers(docs):
    kept = outliers.drop_outliers(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 2]
    assert {r.failed for r in kept.select("failed").collect()} == {"mine"}
    assert outliers.drop_outliers(docs.limit(0)).count() == 0


def test_token_counts(docs):
    rows = docs.select("doc_id", token_counts.token_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows if r.doc_id in (3, 4)] == [0, 0]
    assert docs.limit(0).select(token_counts.token_count(F.col("text"))).count() == 0


def test_tiling(spark, docs):
    items = spark.createDataFrame([(5, PROSE), (5, PROSE), (6, None), (None, ""), (7, "too short"), (8, "Public license")], "item_id long, text string")
    rows = tiling.contaminated_pairs(clashing(docs), items).collect()
    assert sorted(((r.doc_id or 0), r.item_id) for r in rows) == [(0, 8)] + [(1, 5)] * 4 + [(2, 5)] * 2
    kept = tiling.drop_contaminated(clashing(docs), items)
    assert kept.columns == clashing(docs).columns and kept.count() == 5
    assert tiling.contaminated_pairs(docs, items.limit(0)).count() == 0
    assert tiling.contaminated_pairs(docs.limit(0), items).count() == 0


def test_toxicity(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(clashing(docs), toxicity.fit(docs, none)).where("toxic").count() == 0
    one_class = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    steps = toxicity.fit(docs, one_class)
    assert toxicity.score_documents(docs, steps).where("toxic").count() == 0
    assert toxicity.score_documents(docs.limit(0), steps).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "u\r\nv", "p" * 200), (1, "u\r\nv", "p" * 200), (2, None, "p" * 200), (3, "u", None), (4, "u", ""), (None, "u", "q" * 100), (None, "u", "q" * 100)],
        "page_id long, url string, html string",
    ).withColumn("record_type", F.lit("mine"))
    warc.write_archives(pages, str(tmp_path / "a"))
    rows = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(r.fault is None for r in rows) and len(rows) == 7
    kinds = sorted((r.page_id, r.record_type, r.payload_bytes) for r in rows)
    assert kinds == [("1", "response", 200), ("1", "revisit", 200), ("2", "revisit", 200), ("3", "response", 0), ("4", "response", 0), ("null", "response", 100), ("null", "revisit", 100)]
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).where("fault IS NULL").count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"),
        (1, 1, "assistant", "Fine thanks.\nAnd you today?"),
        (1, 2, "user", "> Fine thanks.\n>> How are you?\nGood."),
        (1, 3, "assistant", "On Monday, A wrote:\n> hello THERE\n> how are you\n\nLate reply."),
        (1, 4, "user", "going on"),
        (1, 6, "user", None),
        (1, 6, "user", "repeated turn"),
        (1, 7, None, "> going on\nnested"),
        (None, 3, "user", "> lost\nq"),
        (2, None, "user", "y"),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn, r.text): r for r in quotes.reply_order(chats).collect()}
    assert len(out) == 10
    late = out[(1, 3, "Late reply.")]
    assert (late.parent_turn, late.quoted_lines, late.linked_lines, late.depth, late.reply_path) == (0, 2, 2, 1, [0, 3])
    assert out[(1, 7, "nested")].reply_path == [0, 4, 7] and out[(1, 4, "going on")].reply_path == [0, 4]
    assert out[(1, 2, "Good.")].parent_turn == 1 and out[(1, 0, "Hello there.\nHow are you?")].parent_turn is None
    assert out[(None, 3, "q")].parent_turn is None and (1, 6, None) in out
    assert quotes.reply_order(chats.limit(0)).count() == 0
