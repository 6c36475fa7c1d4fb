"""Views of the driver's tables as bilingual data: lines as segments, turns as pairs, events as remarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workers import bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files of a table are fewer, for work that a core does long on a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, doc_id, pos, entry): every line that is not blank; the file is the document's source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "entry"))
    return docs.where(F.trim("entry") != "").select("file", "doc_id", "pos", "entry")


def ordinal() -> F.Column:
    return F.struct("file", "doc_id", "pos").alias("ordinal")


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of odd documents, as the segments of a project with one file a source."""
    return lines(spark, sf_dir).where("doc_id % 2 = 1").select("file", "entry", ordinal())


def memory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of even documents, as a memory's entries."""
    return lines(spark, sf_dir).where("doc_id % 2 = 0").select("entry")


def memory(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """TM_MAIN rows: the lines of even (0) or odd (1) documents; the target is the source after a mark."""
    rows = lines(spark, sf_dir).where(F.col("doc_id") % 2 == part)
    return rows.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("id"), F.col("entry").alias("source"), F.concat(F.lit("> "), "entry").alias("target"), F.lit("translated").alias("state"), F.lit(None).cast("string").alias("time"), F.col("file").alias("submitted_by"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_id, conv_id, turn, source, target): a user's turn and the assistant's answer, empty if there is none."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"_role": F.lead("role").over(order), "_text": F.lead("text").over(order)})
    target = F.when(F.col("_role") == "assistant", F.col("_text")).otherwise(F.lit(""))
    return turns.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), "conv_id", "turn", F.col("text").alias("source"), target.alias("target"))


#: The same views for DuckDB.
SQL_LINES = """lines AS (
  SELECT source AS file, doc_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS entry
  FROM (SELECT source, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE trim(parts[i], ' ') <> '')"""
SQL_PAIRS = """pairs AS (
  SELECT conv_id * 1000 + turn AS segment_id, conv_id, turn, text AS source, CASE WHEN r2 = 'assistant' THEN t2 ELSE '' END AS target
  FROM (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user')"""


def sql_memory(name: str, part: int) -> str:
    return f"{name} AS (SELECT doc_id * 100000 + pos AS id, entry AS source, '> ' || entry AS target, 'translated' AS state, CAST(NULL AS VARCHAR) AS time, file AS submitted_by FROM lines WHERE doc_id % 2 = {part})"


SQL_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
SQL_QA_WORDS = "list_filter(regexp_split_to_array(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}\\s''-]', '', 'g'), '\\s+'), lambda w: length(w) > 1 AND regexp_full_match(w, '[\\p{{L}}''-]+'))"


def sql_ratios(pairs: str) -> str:
    """CTEs that end in ``ratios`` (a, b, ratio), for ``pairs``: a query of distinct texts a and b. Both must not hold chr(1).

    The longest common stretch splits both texts; what is left and right of it is split again. In texts b of 200 characters
    and more, characters of over one in a hundred cannot begin a stretch, only prolong one. To be put after WITH RECURSIVE.
    """
    frequent = "list_filter(list_distinct(string_split(b, '')), lambda x: length(b) >= 200 AND length(b) - length(replace(b, x, '')) > length(b) // 100 + 1)"
    longest = """coalesce(list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(list_filter(range(1, length(x) - i + 2), lambda n: strpos(z, substr(x, i, n)) > 0),
lambda n: {'n': n, 'i': -i, 'j': -strpos(z, substr(x, i, n))})))), {'n': 0, 'i': -1, 'j': -1})"""
    before = "coalesce(list_min(list_filter(range(1, least(i, j)), lambda k: substr(x, i - k, 1) <> substr(y, j - k, 1))), least(i, j)) - 1"
    room = "least(length(x) - i - n + 1, length(y) - j - n + 1)"
    after = f"coalesce(list_min(list_filter(range(0, {room}), lambda k: substr(x, i + n + k, 1) <> substr(y, j + n + k, 1))), {room})"
    return f"""asked AS ({pairs}), part AS (SELECT a, b, a AS x, b AS y, translate(b, array_to_string({frequent}, ''), repeat(chr(1), len({frequent}))) AS z, CAST(0 AS BIGINT) AS m FROM asked UNION ALL
SELECT a, b, unnest([substr(x, 1, i - l - 1), substr(x, i + n + r, 100000), '']), unnest([substr(y, 1, j - l - 1), substr(y, j + n + r, 100000), '']), unnest([substr(z, 1, j - l - 1), substr(z, j + n + r, 100000), '']), unnest([0, 0, n + l + r])
FROM (SELECT *, {before} AS l, {after} AS r FROM (SELECT a, b, x, y, z, best.n AS n, -best.i AS i, -best.j AS j FROM (SELECT a, b, x, y, z, {longest} AS best FROM part WHERE x <> '' AND y <> ''))) WHERE n + r > 0),
ratios AS (SELECT a, b, CASE WHEN a = '' AND b = '' THEN 1.0 ELSE 2.0 * sum(m) / (length(a) + length(b)) END AS ratio FROM part GROUP BY a, b)"""


def sql_could_reach(a: str, b: str, least: float) -> str:
    """Whether the counts of letters and digits let a ratio of ``least`` be."""
    shared = f"list_sum(list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', ''), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, '')))))"
    rest = "length(regexp_replace({0}, '[a-z0-9 ]', '', 'g'))"
    return f"2 * ({shared} + least({rest.format(a)}, {rest.format(b)})) >= {least} * (length({a}) + length({b}))"
