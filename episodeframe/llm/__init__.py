"""Training-data operators: deduplication, decontamination, tokenisation, filters.

Nothing outside this folder imports it; ``queries.py`` lists the registered
queries and ``oracles.py`` their SQL.
"""
