"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from keyloom.llm import chaining, decontaminate, embedding_dedup, jaccard, mixing, pii, quality, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_pii": pii.op4_pii,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_chaining": chaining.op9_chaining,
    "op10_jaccard": jaccard.op10_jaccard,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_embedding_dedup": embedding_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
}
