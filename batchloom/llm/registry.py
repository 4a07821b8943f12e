"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from batchloom.llm import (
    brown, chat, codes, decontaminate, importance, mixing, passages, quality, rules, secrets, simhash, tokens, toxicity,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_simhash": simhash.op3_simhash,
    "op4_prefix_targets": chat.op4_prefix_targets,
    "op5_co_training": quality.op5_co_training,
    "op6_token_ids": tokens.op6_token_ids,
    "op7_markov_secrets": secrets.op7_markov_secrets,
    "op8_winnowing": decontaminate.op8_winnowing,
    "op9_chained_passages": passages.op9_chained_passages,
    "op10_rule_cascade": rules.op10_rule_cascade,
    "op11_norm_bounds": codes.op11_norm_bounds,
    "op12_class_ngrams": brown.op12_class_ngrams,
    "op13_importance": importance.op13_importance,
}
ORACLES = {
    "op4_prefix_targets": chat.OP4_SQL,
    "op8_winnowing": decontaminate.OP8_SQL,
    "op10_rule_cascade": rules.OP10_SQL,
    "op11_norm_bounds": codes.OP11_SQL,
    "op13_importance": importance.OP13_SQL,
}
