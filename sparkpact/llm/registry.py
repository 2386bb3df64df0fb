"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontam, jaccard, neardup, packing, pii, quality, substring, toxicity, warc, wordpiece

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_embedding_neardup": neardup.op4_embedding_neardup,
    "op5_warc": warc.op5_warc,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_pii": pii.op7_pii,
    "op8_token_counts": wordpiece.op8_token_counts,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
}

#: Trained models, alignment, tokenizers and automata can't be written in SQL; tests hold those queries against brute force.
SQL: dict[str, str] = {
    "op2_substring_dedup": substring.OP2_SQL,
    "op4_embedding_neardup": neardup.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
}
