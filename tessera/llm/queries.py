"""The registered queries of this subpackage and their SQL."""

from . import ann, brown, collocations, divergence, langid, mixing, ngram_join, packing, quality_rules, substring_dedup, token_counts, toxicity, warc

QUERIES = {
    "op5_hnsw": ann.op5_hnsw,
    "op9_token_attribution": token_counts.op9_token_attribution,
    "op10_arc_to_warc": warc.op10_arc_to_warc,
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op3_language_id": langid.op3_language_id,
    "op4_toxicity_crf": toxicity.op4_toxicity_crf,
    "op2_entropy_balancing": mixing.op2_entropy_balancing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_brown_scores": brown.op13_brown_scores,
}

ORACLES = {
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op10_arc_to_warc": warc.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op7_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
}
