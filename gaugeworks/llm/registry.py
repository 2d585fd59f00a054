"""The operators' queries and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, lexical, media, merkle, mixing, packing, quality, shards, simhash, suffixes, token_counts, token_files, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_media_columns": media.op2_media_columns,
    "op3_sharding": shards.op3_sharding,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_token_id_files": token_files.op6_token_id_files,
    "op7_suffix_array_dedup": suffixes.op7_suffix_array_dedup,
    "op8_mixing_sources": mixing.op8_mixing_sources,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_ranked_lexical_search": lexical.op12_ranked_lexical_search,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op8_mixing_sources": mixing.oracle_sql(),
    "op10_quality_rules": quality.oracle_sql(),
    "op11_merkle_manifest": merkle.oracle_sql(),
    "op12_ranked_lexical_search": lexical.oracle_sql(),
}
