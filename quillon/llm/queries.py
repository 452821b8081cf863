"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quillon.llm import chat_format, decontaminate, filter_audit, lang_id, line_dedup, near_dedup, packing, quality_rules, resample, substring_dedup, token_count, token_files, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_near_dedup": near_dedup.query,
    "op3_packing": packing.query,
    "op4_warc": warc.query,
    "op5_language_id": lang_id.query,
    "op6_token_files": token_files.query,
    "op7_line_dedup": line_dedup.query,
    "op8_chat_format": chat_format.query,
    "op9_decontaminate": decontaminate.query,
    "op10_token_counts": token_count.query,
    "op11_filter_audit": filter_audit.query,
    "op12_substring_dedup": substring_dedup.query,
    "op13_resample": resample.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(),
    "op2_near_dedup": near_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_substring_dedup": substring_dedup.ORACLE,
    "op13_resample": resample.ORACLE,
}
