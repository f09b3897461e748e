"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from squall.llm import chat_format, collocations, decontaminate, jaccard_join, language, licenses, line_quality, mixing, near_dedup, oracles, pii, prefix_trie, substring_dedup, toxicity



def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_line_quality": line_quality.op4_line_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_collocations": collocations.op12_collocations,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": oracles.CHAT,
    "op4_line_quality": oracles.QUALITY,
    "op8_substring_dedup": oracles.SUBSTRINGS,
    "op9_near_dedup": oracles.NEAR,
    "op10_decontaminate": oracles.LEAKS,
    "op11_prefix_trie": oracles.TRIE,
    "op12_collocations": oracles.PHRASES,
    "op13_jaccard_join": oracles.JACCARD,
}
