"""Queries of the training-data operators, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm.infill import op12_fill_in_middle, oracle as infill_oracle
from tidebook.llm.license_scan import op1_license_scan, oracle as license_oracle
from tidebook.llm.mixing import op2_sainte_lague_mix
from tidebook.llm.ngram_join import op13_ngram_jaccard, oracle as ngram_oracle
from tidebook.llm.outliers import op5_mcd_quality
from tidebook.llm.quotes import op7_quotation_linking
from tidebook.llm.repair import op11_conversation_repair, oracle as repair_oracle
from tidebook.llm.sharding import op3_hypergeometric_shards
from tidebook.llm.simhash import op4_simhash_components
from tidebook.llm.tiling import op10_tiling_decontamination
from tidebook.llm.token_counts import op6_token_counts
from tidebook.llm.toxicity import op8_toxicity_chain
from tidebook.llm.warc import op9_warc_salvage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sainte_lague_mix": op2_sainte_lague_mix,
    "op3_hypergeometric_shards": op3_hypergeometric_shards,
    "op4_simhash_components": op4_simhash_components,
    "op5_mcd_quality": op5_mcd_quality,
    "op6_token_counts": op6_token_counts,
    "op7_quotation_linking": op7_quotation_linking,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op10_tiling_decontamination": op10_tiling_decontamination,
    "op9_warc_salvage": op9_warc_salvage,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_oracle(),
    "op11_conversation_repair": repair_oracle(),
    "op12_fill_in_middle": infill_oracle(),
    "op13_ngram_jaccard": ngram_oracle(),
    "op9_warc_salvage": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), w AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN w USING (payload_digest)
    """,
}
