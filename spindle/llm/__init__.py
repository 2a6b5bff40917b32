"""Training-data operators: quality, language, dedup, decontamination, PII and mixing.

Nothing outside this subpackage imports it; each module holds one operator, the
thin query that applies it to a whole table and, where SQL can say it, its SQL.
"""
