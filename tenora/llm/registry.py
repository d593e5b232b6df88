"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenora.llm import bpe, collocations, exact_dedup, jaccard_join, language_id, packing, pii, prefix_trie, substring_dedup, suffix_sort, token_files, url_filter, vector_join


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_pii_pseudonyms": pii.op2_pii_pseudonyms,
        "op3_bpe_round_trip": bpe.op3_bpe_round_trip,
        "op4_vector_components": vector_join.op4_vector_components,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_token_files": token_files.op7_token_files,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_language_id": language_id.op9_language_id,
        "op10_repeated_passages": substring_dedup.op10_repeated_passages,
        "op11_collocations": collocations.op11_collocations,
        "op12_repeated_bytes": suffix_sort.op12_repeated_bytes,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op4_vector_components": vector_join.ORACLE_SQL, "op5_jaccard_join": jaccard_join.ORACLE_SQL, "op6_url_filter": url_filter.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}
