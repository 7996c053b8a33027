"""Registry of this subpackage's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from . import line_dedup, media, mixing, ngram_join, packing, quality, secrets, token_ids, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_ids": token_ids.op2_token_ids,
    "op3_top_k": topk.op3_top_k,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_media": media.op5_media,
    "op6_secrets": secrets.op6_secrets,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op3_top_k": topk.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
