"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from . import conversations, decontaminate, divergence, line_dedup, line_rules, mixing, ngram_join, packing, quality, secrets, sharding, token_counts, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality": quality.op2_quality,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_warc": warc.op6_warc,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_quality_rules": line_rules.op8_quality_rules,
    "op9_mix": mixing.op9_mix,
    "op10_secrets": secrets.op10_secrets,
    "op11_divergence": divergence.op11_divergence,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_packing": packing.op13_packing,
}

ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_quality_rules": line_rules.OP8_SQL,
    "op10_secrets": secrets.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_conversation_repair": conversations.OP12_SQL,
}
