"""Training-data operators: scoring, deduplication, filtering, packing and sharding of document corpora.

Nothing outside this subpackage imports it; see ``queries.py`` for the registered queries.
"""
