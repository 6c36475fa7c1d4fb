"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next; what a
stage staged for itself is deleted when its rows are written.

Near-dedup links texts whose sets of five-word shingles have a similarity of 0.8 or more.

Nulls: null and empty texts have too few words for the quality rules and go there; a null id, language or source is kept
as it is. Empty tables give empty tables, and no pieces. Rows that repeat an id and a text are copies: one of them stays.
Very long texts are read whole by every stage and cut into pieces of a whole sequence by the last. Ties: of equal texts
the least id stays. Further columns, whatever their names, pass all stages but the last, which returns the columns of
``packing.pack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitextmill.llm import decontamination, near_dedup, packing, pii, quality_rules
from bitextmill.llm.common import clean, mark, staged, table
from bitextmill.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, per_cent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), capacity=2048)


STAGES = [("quality rules", quality), ("near-dedup", dedup), ("decontamination", decontaminate), ("personal data", private), ("packing", pack)]

#: Robust estimates, sketches and subword ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        began = mark()
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clean(spark, began, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
