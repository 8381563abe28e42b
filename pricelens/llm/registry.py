"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, fingerprints, jaccard_join, language_id, lm_scores, mixing, periodic_runs, quality, suffix_dedup, token_counts, toxicity, url_rules, whitening

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_language_id": language_id.op2_language_id,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_lm_scores": lm_scores.op5_lm_scores,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filters": url_rules.op8_url_filters,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_whitening": whitening.op12_whitening,
    "op13_quality": quality.op13_quality,
}
SQL = {"op3_jaccard_join": jaccard_join.OP3_SQL, "op4_decontamination": decontamination.OP4_SQL, "op5_lm_scores": lm_scores.OP5_SQL, "op6_suffix_dedup": suffix_dedup.OP6_SQL, "op8_url_filters": url_rules.OP8_SQL, "op11_periodic_runs": periodic_runs.OP11_SQL}
