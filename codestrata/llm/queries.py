"""The queries of this folder and, where SQL can state them, their SQL."""

from __future__ import annotations

from . import chat, chunkdedup, hardneg, linededup, mixing, neighbours, ordermin, packing, quality, repair, sharding, simhash, toxicity

QUERIES = {f.__name__: f for f in (
    mixing.op1_mixing, packing.op2_packing, linededup.op3_line_dedup, toxicity.op4_toxicity, simhash.op5_simhash,
    quality.op6_quality, ordermin.op7_fingerprints, chunkdedup.op8_substring_dedup, sharding.op9_sharding, chat.op10_chat,
    repair.op11_conversation_repair, neighbours.op12_neighbour_quality, hardneg.op13_hard_negatives)}

ORACLES = {"op3_line_dedup": linededup.OP3_SQL, "op10_chat": chat.OP10_SQL, "op11_conversation_repair": repair.OP11_SQL, "op13_hard_negatives": hardneg.OP13_SQL}
