"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from marginalia.llm import conversations, decontamination, golay_simhash, jaccard_join, line_dedup, merkle, metric_tree, pii, ppm, quality, suffix_dedup, wavelet
from marginalia.llm.packing import op10_packing

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op8_metric_tree": metric_tree.op8_metric_tree,
    "op5_wavelet": wavelet.op5_wavelet,
    "op2_ppm": ppm.op2_ppm,
    "op4_pii": pii.op4_pii,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op7_quality": quality.op7_quality,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op10_packing": op10_packing,
    "op11_golay_simhash": golay_simhash.op11_golay_simhash,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op8_metric_tree": metric_tree.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op3_decontamination": decontamination.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
    "op13_conversation_repair": conversations.ORACLE_SQL,
}
