"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from . import decontamination, language, mixing, oracles, pii, quality, sharding, simhash, substring, suffixes, tokens

QUERIES = {
    "op1_benchmark_decontamination": decontamination.op1_benchmark_decontamination,
    "op2_feistel_pseudonyms": pii.op2_feistel_pseudonyms,
    "op3_label_propagation_shards": sharding.op3_label_propagation_shards,
    "op4_pfair_mix": mixing.op4_pfair_mix,
    "op5_simhash_near_duplicates": simhash.op5_simhash_near_duplicates,
    "op6_compression_language": language.op6_compression_language,
    "op7_context_mixing_tokens": tokens.op7_context_mixing_tokens,
    "op8_repeated_phrase_automata": substring.op8_repeated_phrase_automata,
    "op9_induced_suffix_sorting": suffixes.op9_induced_suffix_sorting,
    "op10_isolation_forest_quality": quality.op10_isolation_forest_quality,
}
ORACLES = {"op1_benchmark_decontamination": oracles.OP1, "op8_repeated_phrase_automata": oracles.OP8, "op9_induced_suffix_sorting": oracles.OP9}
