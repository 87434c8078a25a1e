"""Fill-in-the-middle rewriting with DuckDB inside Arrow batches.

A text is cut into lines, two cut points come from a hash of its id, and prefix, middle and
suffix are put in one of two orders behind sentinels. Every task has one in-memory DuckDB connection of one thread;
it registers a batch, runs one statement and hands Arrow back, so no row is touched by Python. A
text depends on its own row alone: there is no shuffle, and a task that is run again gives the same rows.
Batches come bounded by records; they are cut again so that a statement sees at most `SLICE_BYTES` of
text (or one row), as lists of lines and the parts take several times the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidebook.llm.common import read_table
from tidebook.runtime import ship_package

SLICE_BYTES = 4 << 20
MEMORY = "512MB"
#: A line with its break, or a last line without one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_ADDED = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


@dataclass(frozen=True)
class Recipe:
    """`rate` per cent of the texts are rewritten, `spm` per cent of those with the suffix first; `seed` moves all choices."""

    seed: int = 7
    rate: int = 100
    spm: int = 50


def statement(recipe: Recipe, rows: str) -> str:
    """The DuckDB statement over a relation with columns id (decimal string or null) and text, in the order of its rows.

    Lists of lines are joined once each: the parts are the output's own pieces.
    """
    h = [f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS UBIGINT)" for k in range(4)]
    return f"""
        WITH lined AS (
            SELECT place, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{LINES}') AS u,
                   sha256('{recipe.seed}:' || coalesce(id, '')) AS h
            FROM {rows}
        ), cut AS (
            SELECT place, t, u, len(u) AS n, {h[0]} % (len(u) + 1) AS a, {h[1]} % (len(u) + 1) AS b,
                   CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                             OR {h[2]} % 100 >= {recipe.rate} THEN '{PLAIN}'
                        WHEN {h[3]} % 100 < {recipe.spm} THEN '{SPM}' ELSE '{PSM}' END AS form
            FROM lined
        ), parts AS (
            SELECT place, t, n, form,
                   array_to_string(list_slice(u, 1, CAST(least(a, b) AS BIGINT)), '') AS p,
                   array_to_string(list_slice(u, CAST(least(a, b) AS BIGINT) + 1, CAST(greatest(a, b) AS BIGINT)), '') AS m,
                   array_to_string(list_slice(u, CAST(greatest(a, b) AS BIGINT) + 1, n), '') AS s
            FROM cut
        )
        SELECT CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> '{PLAIN}' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> '{PLAIN}' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               CASE form WHEN '{PLAIN}' THEN t
                         WHEN '{PSM}' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                         ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output
        FROM parts ORDER BY place
    """


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of at most `most` bytes, or of one row."""
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > most:
            yield start, k - start
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def fill_in_middle(
    docs: DataFrame, recipe: Recipe = Recipe(), doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """`docs` with n (lines), form, prefix_chars, middle_chars and output of each whole text.

    A null text is empty; a null id is hashed as no digits. Empty texts and texts with a
    sentinel stay plain, with null counts of characters. Rows with one id are
    cut at places that depend on their own numbers of lines. Columns of docs with the
    names of the results give way to them; all others stay.
    """
    ship_package()
    added = [name for name, _ in _ADDED]
    kept = [c for c in docs.columns if c not in added]
    held = docs.select(
        *[F.col(f"`{c}`").alias(f"_fim_{k}") for k, c in enumerate(kept)],
        F.col(f"`{doc_id}`").cast("string").alias("_fim_id"),
        F.col(f"`{text}`").alias("_fim_text"),
    )
    schema = StructType(
        [docs.schema[c] for c in kept]
        + [StructField(name, LongType() if kind == "long" else StringType()) for name, kind in _ADDED]
    )
    sql = statement(recipe, "batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as base:
            for batch in batches:
                whole = batch.column("_fim_text")
                sizes = pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False)
                for start, length in slices(sizes, slice_bytes):
                    part = batch.slice(start, length)
                    source = pa.table({
                        "place": pa.array(np.arange(length)), "id": part.column("_fim_id"), "text": part.column("_fim_text"),
                    })
                    base.register("batch", source)
                    made = base.sql(sql).to_arrow_table()
                    base.unregister("batch")
                    columns = [pa.chunked_array([part.column(f"_fim_{k}")]) for k in range(len(kept))]
                    columns += [made.column(c).cast(pa.int64() if kind == "long" else pa.string()) for c, kind in _ADDED]
                    yield from pa.table(columns, names=[*kept, *added]).combine_chunks().to_batches()

    return held.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a sentinel stays plain, so sentinels part the others uniquely."""
    part = F.split(output, "<[PSM]>")
    order = F.when(form == PSM, F.array(*[F.lit(k) for k in (2, 4, 3)])).otherwise(F.array(*[F.lit(k) for k in (3, 4, 2)]))
    return F.when(form == PLAIN, output).otherwise(F.array_join(F.transform(order, lambda k: F.element_at(part, k)), ""))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, sizes of its parts, and hashes of its output and of the text restored from it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """The same with line ends found by position, instead of lists of lines."""
    return """
        WITH h AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), l AS (
            SELECT *, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN 0 ELSE 1 END AS n
            FROM h
        ), c AS (
            SELECT *, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS b,
                   CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM l
        ), s AS (
            SELECT *, string_split(t, chr(10)) AS lines FROM c
        ), k AS (
            SELECT *, length(array_to_string(lines[1:least(a, b)::BIGINT], chr(10)))
                      + CASE WHEN least(a, b) BETWEEN 1 AND len(lines) - 1 THEN 1 ELSE 0 END AS x,
                   length(array_to_string(lines[1:greatest(a, b)::BIGINT], chr(10)))
                      + CASE WHEN greatest(a, b) BETWEEN 1 AND len(lines) - 1 THEN 1 ELSE 0 END AS y
            FROM s
        ), o AS (
            SELECT *, substring(t, 1, x) AS p, substring(t, x + 1, y - x) AS m, substring(t, y + 1) AS z FROM k
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
                                ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM o
    """
