"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, collocations, conversation_trie, decontamination, license_scan, line_dedup, lm, mixing, near_dedup, quality, repeat_removal, search, secret_scan

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_search": search.query,
    "op3_mixing": mixing.query,
    "op4_lm": lm.query,
    "op5_quality_rules": quality.query,
    "op6_secret_scan": secret_scan.query,
    "op8_repeat_removal": repeat_removal.query,
    "op7_near_dedup": near_dedup.query,
    "op9_line_dedup": line_dedup.level_query,
    "op10_bpe": bpe.query,
    "op11_decontamination": decontamination.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_collocations": collocations.query,
}
ORACLES = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op5_quality_rules": quality.ORACLE_SQL,
    "op11_decontamination": decontamination.ORACLE_SQL,
    "op12_conversation_trie": conversation_trie.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
