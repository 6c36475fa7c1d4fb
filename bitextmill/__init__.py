"""Bilingual-text analytics on Spark DataFrames.

Documents and bilingual exchange files become DataFrames of files, translation units and segments; translation memories
are tables; lookups, leverage reports, quality checks and reviews are joins and aggregations.
"""

__version__ = "0.1.0"
