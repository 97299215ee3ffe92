"""The training-data queries and their SQL, added to the entry module where this package exists."""

from . import chat, decontaminate, mixing, negatives, packing, quality, repair, scoring, secrets, sharding, simhash, sstable, substrings

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_chat_windows": chat.op2_chat_windows,
    "op3_token_shards": sstable.op3_token_shards,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_lm_scores": scoring.op5_lm_scores,
    "op6_simhash": simhash.op6_simhash,
    "op7_substrings": substrings.op7_substrings,
    "op8_interleaved_shards": sharding.op8_interleaved_shards,
    "op9_mix": mixing.op9_mix,
    "op10_secrets": secrets.op10_secrets,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_repair": repair.op12_repair,
    "op13_pack": packing.op13_pack,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op7_substrings": substrings.OP7_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
}
