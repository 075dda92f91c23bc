"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, binary, langid, mixing, packing, quality, simhash, substrings, toxicity, vector_dups

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_embedding_dups": vector_dups.op2_embedding_dups,
    "op3_language_id": langid.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_token_ids": binary.op6_token_ids,
    "op7_packing": packing.op7_packing,
    "op8_nearest": ann.op8_nearest,
    "op9_simhash": simhash.op9_simhash,
    "op10_substrings": substrings.op10_substrings,
}

ORACLES: dict[str, str] = {
    "op2_embedding_dups": vector_dups.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
}
