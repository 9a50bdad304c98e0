"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from grove.llm import ann, bpe, exact_dedup, lm, mixing, near_dedup, pii, token_store, toxicity, warc


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_lm_score": lm.op2_lm_score,
        "op3_ann": ann.op3_ann,
        "op4_pii": pii.op4_pii,
        "op5_warc": warc.op5_warc,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_mixing": mixing.op8_mixing,
        "op9_bpe": bpe.op9_bpe,
        "op10_token_store": token_store.op10_token_store,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.QUERY_SQL, "op6_near_dedup": near_dedup.QUERY_SQL}
