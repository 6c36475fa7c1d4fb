"""What the training-data operators share: table access, written stages, distributed ranks, bounded samples.

Every helper works on DataFrames only and holds no corpus-sized data on the driver.
"""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, which separates words in every operator here: space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of the batches that Python workers are sent, so that long texts are few at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to ``BATCH`` where they are higher."""
    for name, most in BATCH.items():
        now = re.match(r"-?\d+", spark.conf.get(name, None) or "0")
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a folder of our own, which only a
    session of a single machine can have; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='bitextmill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs only the tasks it ran: later stages read the written files.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/bitextmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def mark() -> int:
    """How many tables this process has staged and not deleted."""
    return len(_STAGED)


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete tables that this process has staged, but the first ``since`` and the last ``keep``; call it when the results
    that read them are written. Returns how many."""
    jvm, gone = spark.sparkContext._jvm, 0
    doomed = _STAGED[since : len(_STAGED) - keep]
    del _STAGED[since : len(_STAGED) - keep]
    for path in map(jvm.org.apache.hadoop.fs.Path, doomed):
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


@contextlib.contextmanager
def shared(spark: SparkSession, value):
    """A broadcast of ``value`` for jobs that run inside the block; its copies go when the block ends."""
    given = spark.sparkContext.broadcast(value)
    try:
        yield given
    finally:
        given.unpersist()


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids: null)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % modulus


def ranked(df: DataFrame, parts: list[str], order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """0-based gapless rank within ``parts``, in the order (bucket, order), without one task per part.

    Rows are numbered inside (parts, bucket) and shifted by the rows of the earlier buckets, so a part that holds
    a third of all rows is spread over all its buckets. ``bucket`` must be an integer that depends on the row only.
    The table of bucket sizes has parts x buckets rows.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*parts, "_bucket"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*parts).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.join(sizes, keys).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before")


def bucket_count(rows: int, per_bucket: int = 20_000) -> int:
    """Buckets for ``ranked``: they grow with the input, so one bucket stays the work of one task."""
    return int(max(8, -(-rows // per_bucket)))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows and about ``chars`` characters of text (or one row), to bound memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index("text")
        sizes = pc.fill_null(pc.binary_length(batch.column(k)), 0).to_pylist() if k >= 0 else [0] * batch.num_rows
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= rows or total + n > chars):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def _trim() -> None:
    """Give freed memory back to the system; a Python worker that idles would keep it."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A batch function that leaves its worker as small as it found it."""

    def wrapped(batches):
        yield from run(batches)
        _trim()

    return wrapped


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """A bounded sample of labelled training rows: (doc_id, text, label), one row for each of at most ``rows`` labelled ids.

    Ids are ordered by a hash, so the sample is the same for any partitioning. Held-out ids never enter. Of rows that
    repeat an id the least text counts, of its labels the least.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # the limit bounds what is broadcast
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
