"""Python workers that hold a few rows at a time: batches of bounded size in, batches of bounded size out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of the batches that Python workers are sent, and of those that they give back.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
ROWS, BYTES = 256, 4 << 20


def bounded(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to ``BATCH`` where they are higher."""
    for name, most in BATCH.items():
        now = re.match(r"-?\d+", spark.conf.get(name, None) or "0")
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(name, str(most))


def mapped(df: DataFrame, use: Callable[..., Iterator[tuple]], schema: str | StructType, size: Callable[[tuple], int] | None = None) -> DataFrame:
    """The rows (tuples of ``schema``) that ``use`` yields for each row of ``df``, called with its columns' values in order.

    Rows are turned into Python values one at a time, and what is yielded is sent on as soon as it is ROWS rows or about
    BYTES bytes by ``size`` (rows count nothing without it), so a worker holds one row and a small batch.
    """
    bounded(df.sparkSession)
    made = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0

        def sent() -> pa.RecordBatch:
            columns = zip(*held) if held else ((),) * len(made)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, made)], schema=made)

        for batch in batches:
            for i in range(batch.num_rows):
                for row in use(*(c[i].as_py() for c in batch.columns)):
                    held.append(row)
                    weight += size(row) if size else 0
                    if len(held) >= ROWS or weight >= BYTES:
                        yield sent()
                        held, weight = [], 0
        if held:
            yield sent()

    return df.mapInArrow(run, schema)


def sorted_groups(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with each file_id in one partition, its rows one after the other in ``order`` (nulls first), for workers that
    write files row by row."""
    bounded(rows.sparkSession)
    return rows.repartition("file_id").sortWithinPartitions("file_id", *order)
