"""The subpackage's queries, and SQL for those that SQL can state."""

from termloom.llm import decontaminate, html_text, language_id, license_scan, mixing, near_dedup, phrase_dedup, quality_rules, suffix_dedup, token_output

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_phrase_dedup": phrase_dedup.op3_phrase_dedup,
    "op4_token_output": token_output.op4_token_output,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES = {
    "op3_phrase_dedup": phrase_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
