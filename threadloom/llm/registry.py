"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import conversation_repair, language_id, license_scan, line_crf, mixing, near_pairs, near_vectors, packing, quality_rules, quality_sql, sharding, source_divergence, warc, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.query,
    "op2_best_fit_packing": packing.query,
    "op3_license_scan": license_scan.query,
    "op4_source_mixing": mixing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_jaccard_join": near_pairs.query,
    "op7_winnowing": winnowing.query,
    "op8_rendezvous_sharding": sharding.query,
    "op9_line_crf": line_crf.query,
    "op10_language_bitmask": language_id.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_source_divergence": source_divergence.query,
    "op13_embedding_graph": near_vectors.query,
}
SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op4_source_mixing": mixing.SQL,
    "op5_quality_rules": quality_sql.SQL,
    "op6_jaccard_join": near_pairs.SQL,
    "op8_rendezvous_sharding": sharding.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_source_divergence": source_divergence.SQL,
    "op13_embedding_graph": near_vectors.SQL,
}
