"""All queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, html_text, language_id, lm_scoring, mixing, near_dup, packing, quality_rules, warc

MODULES = [warc, near_dup, packing, ann, quality_rules, mixing, chat, language_id, html_text, lm_scoring]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
