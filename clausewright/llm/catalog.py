"""The queries of this folder and the SQL for those that SQL can express."""

from __future__ import annotations

from clausewright.llm import classifier, exact_dedup, html_text, line_dedup, mixing, near_dedup, packing, quality_rules, substring_dedup, warc

QUERIES = {"op1_quality_rules": quality_rules, "op2_html_text": html_text, "op3_near_dedup": near_dedup, "op4_exact_dedup": exact_dedup, "op5_packing": packing, "op6_substring_dedup": substring_dedup, "op7_quality_classifier": classifier, "op8_warc": warc, "op9_line_dedup": line_dedup, "op10_mix_sources": mixing}


def queries() -> dict:
    return {name: m.query for name, m in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in QUERIES.items() if getattr(m, "ORACLE", None)}
