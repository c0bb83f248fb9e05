"""The registered queries of the text operators and their SQL."""

from strandex.llm import bpe, decontamination, kneser_ney, quality, repeats, secret_scan, simhash, token_counts, toxicity, weighted_sampling

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_fingerprints": weighted_sampling.op4_fingerprints,
    "op5_simhash": simhash.op5_simhash,
    "op6_lm_scoring": kneser_ney.op6_lm_scoring,
    "op7_quality": quality.op7_quality,
    "op8_suffix_dedup": repeats.op8_suffix_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
}
#: Where SQL can express the operator.
ORACLES = {
    "op2_decontamination": decontamination.ORACLE_SQL,
}
