"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilframe.llm import embedding_dedup, fingerprints, hard_negatives, jaccard_join, language_id, license_scan, line_dedup, packing, secret_scan, sentencepiece_codec, spelling, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        line_dedup.op1_site_line_dedup,
        fingerprints.op2_prefix_fingerprints,
        embedding_dedup.op3_cross_polytope_dedup,
        secret_scan.op4_secret_scan,
        language_id.op5_string_kernel_language,
        jaccard_join.op6_partenum_jaccard,
        sentencepiece_codec.op7_sentencepiece_codec,
        packing.op8_harmonic_packing,
        toxicity.op9_toxicity_trees,
        license_scan.op10_license_scan,
        url_filter.op11_url_filter,
        spelling.op12_spelling_variants,
        hard_negatives.op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_site_line_dedup": line_dedup.OP1_SQL,
    "op3_cross_polytope_dedup": embedding_dedup.OP3_SQL,
    "op6_partenum_jaccard": jaccard_join.OP6_SQL,
    "op11_url_filter": url_filter.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
