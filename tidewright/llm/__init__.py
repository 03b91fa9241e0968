"""Training-data operators: dedup, decontamination, sharding, token counts,
mixing, toxicity, nearest neighbours, WARC, language ID and quality.

Nothing outside this subpackage imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list the queries that apply the operators.
"""
