"""One query per operator, over its whole table with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from taskloom.llm import bpe, chat, collocations, jaccard, lm_scores, merkle, mixing, near_vectors, passages, quality, repeats, top_k, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_mixing": mixing.op2_mixing,
    "op3_near_vectors": near_vectors.op3_near_vectors,
    "op4_quality": quality.op4_quality,
    "op5_lm_scores": lm_scores.op5_lm_scores,
    "op5_lm_scores_order3": lm_scores.op5_lm_scores_order3,
    "op6_top_k": top_k.op6_top_k,
    "op7_warc": warc.op7_warc,
    "op8_repeats": repeats.op8_repeats,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_chat": chat.op10_chat,
    "op11_merkle": merkle.op11_merkle,
    "op12_passages": passages.op12_passages,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE = {
    "op2_mixing": mixing.SQL,
    "op5_lm_scores": lm_scores.SQL,
    "op5_lm_scores_order3": lm_scores.SQL_ORDER3,
    "op6_top_k": top_k.SQL,
    "op7_warc": warc.SQL,
    "op11_merkle": merkle.SQL,
    "op12_passages": passages.SQL,
    "op13_collocations": collocations.SQL,
}
