"""The queries of the operators, by name, and the SQL of those that SQL can state."""

from . import decontaminate, language_id, line_dedup, mixing, pii, quality_classifier, quality_rules, simhash, substring_dedup, url_filter

MODULES = (quality_rules, language_id, decontaminate, substring_dedup, line_dedup, url_filter, mixing, quality_classifier, pii, simhash)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
