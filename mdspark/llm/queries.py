"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, conversations, exact_dedup, language_id, minhash, mixing, pii, quality, suffix_dedup, topk_search, toxicity, vector_dedup, whitening

QUERIES = {
    "op1_topk": topk_search.op1_topk,
    "op2_language_id": language_id.op2_language_id,
    "language_id_pages": language_id.language_id_pages,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_pii": pii.op4_pii,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_minhash": minhash.op8_minhash,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "mixing_balance": mixing.mixing_balance,
    "op11_conversations": conversations.op11_conversations,
    "op12_whitening": whitening.op12_whitening,
    "op13_near_vectors": vector_dedup.op13_near_vectors,
}
ORACLE: dict[str, str] = {
    "op1_topk": topk_search.OP1_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op11_conversations": conversations.OP11_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
