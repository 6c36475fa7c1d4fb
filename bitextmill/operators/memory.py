"""Translation memories and termbases as tables: imports, upserts, deletes, migration, exact and fuzzy lookups.

A memory is a DataFrame of ``TM_MAIN``. Mutations give the next version; writing it is the caller's (see sources.kdb and
``save_version``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.ranking import ranked
from ..functions.similarity import diff_spans, ratio
from ..functions.text import both_sides, strip_tags, words
from ..schemas import TM_MAIN, TM_METADATA
from .fuzzy import fuzzy_join, shared_characters, signature

COLUMNS = ["id", "source", "target", "state", "time", "submitted_by"]


def _entries(batch: DataFrame) -> DataFrame:
    for c, kind in (("state", "string"), ("time", "string"), ("submitted_by", "string")):
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast(kind))
    return batch.where(both_sides(F.col("source"), F.col("target")))


def upsert(memory: DataFrame, batch: DataFrame, order: list[str], bucket: Column, overwrite: bool = True, high_water: int | None = None) -> DataFrame:
    """Next version: rows of the batch's sources go (if ``overwrite``), then the whole batch is added.

    Repeated sources inside a batch all stay. New ids continue above ``high_water`` in the batch's ``order``; ``bucket``
    rises with it (see ``ranked``). Pass the persisted mark so that deleted ids are not used again; without it, the
    greatest id is joined as one row when the plan runs.
    """
    batch = _entries(batch)
    kept = memory.join(batch.select("source"), "source", "left_anti") if overwrite else memory
    added = ranked(batch, bucket, order, "_id")
    if high_water is None:
        added = added.crossJoin(F.broadcast(memory.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_mark")))).withColumn("id", F.col("_id") + F.col("_mark"))
    else:
        added = added.withColumn("id", F.col("_id") + F.lit(high_water))
    return kept.select(*COLUMNS).unionByName(added.select(*COLUMNS))


def remove(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids.select("id"), "id", "left_anti").select(*COLUMNS)


def migrate(legacy: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """The six current columns from a table that lacks id or state."""
    if "id" not in legacy.columns:
        legacy = ranked(legacy, bucket, order, "id")
    for c in COLUMNS:
        if c not in legacy.columns:
            legacy = legacy.withColumn(c, F.lit(None).cast("string"))
    return legacy.select(*COLUMNS)


def entries(memory: DataFrame, first: int, last: int, bucket: int = 100_000) -> DataFrame:
    """Rows first..last - 1 in id order, from 0; negative places count from the end."""
    n = memory.count() if first < 0 or last < 0 else 0
    lo, hi = (max(0, i + n) if i < 0 else i for i in (first, last))
    rows = ranked(memory, F.floor(F.col("id") / bucket), ["id"], "_place")
    return rows.where(F.col("_place").between(lo + 1, hi)).select(*memory.columns).orderBy("id")


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with columns source and target; rows with an empty side are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select("source", "target", F.lit("imported").alias("state"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("submitted_by")).where(both_sides(F.col("source"), F.col("target")))


def from_units(units: DataFrame, src: str, trg: str, plain: bool = False) -> DataFrame:
    """TMX units (tuv: array of struct lang, text, full) to pairs: the first variant of exactly each language."""
    text = "text" if plain else "full"
    of = lambda lang: F.try_element_at(F.filter("tuv", lambda v: v["lang"] == lang), F.lit(1))[text]
    pairs = units.select(of(src).alias("source"), of(trg).alias("target"))
    return pairs.withColumn("state", F.lit("imported")).where(both_sides(F.col("source"), F.col("target")))


def from_segments(segments: DataFrame) -> DataFrame:
    """Segments with tokens to entries with shared tag numbers; ignorables and empty targets are left out."""
    pair = segments.where("kind = 'segment' and target is not null").withColumn("_e", T.entry_pair("source", "target"))
    return pair.select(F.col("_e.entry").alias("source"), F.col("_e.other").alias("target"), "state", F.col("modified_on").alias("time"), F.col("modified_by").alias("submitted_by")).where(both_sides(F.col("source"), F.col("target")))


def _similar(entries: DataFrame, memory: DataFrame, least: float, autojunk: bool) -> DataFrame:
    """Rows of the memory that are similar to an entry, with ``entry`` and ``ratio``: however often a text is asked or held, it is
    compared once. Joins build their tables from pairs: files tell little of the size of what is asked and held."""
    pairs = fuzzy_join(entries.select("entry").distinct(), memory.select("source").distinct(), "entry", "source", least, autojunk)
    return memory.join(pairs.hint("shuffle_hash"), "source")


def lookup_segments(queries: DataFrame, memory: DataFrame, least: float = 0.5, autojunk: bool = True) -> DataFrame:
    """Fuzzy hits of ``queries`` (query_id, entry): ratio, character differences, both sides, in memory order by id."""
    hits = queries.select("query_id", "entry").join(_similar(queries, memory, least, autojunk).hint("shuffle_hash"), "entry")
    return hits.select("query_id", "id", "ratio", diff_spans(F.col("source"), F.col("entry")).alias("diff"), "source", "target", "state", "time", "submitted_by")


def lookup_hits(queries: DataFrame, memory: DataFrame, least: float = 0.5, autojunk: bool = True) -> DataFrame:
    """Fuzzy hits of segments (query_id, tokens) as segments: source and target as tokens with the query's own tags; tags that
    the query lacks are left out. Hits are numbered by similarity, then id (``rank``)."""
    # an entry is never null, which Spark does not know of a function in Python and would call it once more for
    asked = queries.select("query_id", "tokens", F.coalesce(T.entry(F.col("tokens")), F.lit("")).alias("entry"))
    hits = asked.join(_similar(asked, memory, least, autojunk).hint("shuffle_hash"), "entry")
    hits = hits.select("query_id", "id", "ratio", diff_spans(F.col("source"), F.col("entry")).alias("diff"), "source", "target", "state", "time", "submitted_by", "tokens")
    sides = {c: T.tokens(F.col(c), F.col("tokens"), safe=True) for c in ("source", "target")}
    best = Window.partitionBy("query_id").orderBy(F.desc("ratio"), "id")
    return hits.withColumns(sides).drop("tokens").withColumn("rank", F.row_number().over(best))


def exact_hits(queries: DataFrame, memory: DataFrame) -> DataFrame:
    return queries.join(memory.select("source").distinct(), queries["entry"] == F.col("source"), "left_semi")


def _terms(memory: DataFrame, fold: bool) -> DataFrame:
    """(id, place, term_word) of every word of every term."""
    text = F.lower("source") if fold else F.col("source")
    return memory.select("id", F.posexplode(words(text)).alias("place", "term_word"))


def lookup_terms(queries: DataFrame, termbase: DataFrame, least: float = 0.7, case_sensitive: bool = False) -> DataFrame:
    """Terms in queries (query_id, entry): per term word the best ratio to a query word, weighted by word length.

    A weighted mean reaches ``least`` only if some word does, so terms and queries meet by words of that ratio; only then
    are the terms' other words compared with the query's, each distinct pair of words once. A term of one word is scored
    by the first step alone.
    """
    text = strip_tags(F.col("entry"))
    asked = queries.select("query_id", F.explode(F.array_distinct(words(text if case_sensitive else F.lower(text)))).alias("query_word"))
    terms = _terms(termbase, not case_sensitive)
    # the term's word is the second sequence
    close = fuzzy_join(terms.select("term_word").distinct(), asked.select("query_word").distinct(), "term_word", "query_word", min(max(least, 0.02), 0.999))
    near = asked.join(close, "query_word").groupBy("query_id", "term_word").agg(F.max("ratio").alias("best"))
    met = near.join(terms.select("id", "term_word").distinct(), "term_word").select("query_id", "id").distinct()
    wanted = met.join(terms, "id").join(near, ["query_id", "term_word"], "left")
    far = wanted.where("best is null").select("query_id", "term_word").distinct()
    pairs = far.join(asked, "query_id").select("term_word", "query_word").distinct()
    likely = pairs.where(shared_characters(signature(F.col("term_word")), signature(F.col("query_word"))) > 0)
    scored = likely.withColumn("ratio", ratio(F.col("query_word"), F.col("term_word")))
    rest = far.join(asked, "query_id").join(scored, ["term_word", "query_word"]).groupBy("query_id", "term_word").agg(F.max("ratio").alias("rest"))
    size = F.length("term_word")
    each = wanted.join(rest, ["query_id", "term_word"], "left").withColumn("best", F.coalesce("best", "rest", F.lit(0.0)))
    total = each.groupBy("query_id", "id").agg((F.sum(size * F.col("best")) / F.sum(size)).alias("score"))
    return total.where(F.col("score") >= least).join(termbase, "id").select("query_id", "score", "source", "target", "state", "time", "submitted_by").orderBy("query_id", F.desc("score"), F.asc_nulls_last("source"), F.asc_nulls_last("target"))


def ranked_terms(hits: DataFrame) -> DataFrame:
    """Hits of ``lookup_terms`` with their place for the query (``rank``): by score, then source and target."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("source"), F.asc_nulls_last("target"))
    return hits.withColumn("rank", F.row_number().over(best))


def exact_terms(queries: DataFrame, termbase: DataFrame) -> DataFrame:
    """Terms all of whose words a query holds (score one), by equi-join on words."""
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.lower(strip_tags(F.col("entry")))))).alias("word"))
    terms = termbase.select("id", F.array_distinct(words(F.lower("source"))).alias("_words")).where(F.size("_words") > 0)
    each = terms.select("id", F.size("_words").alias("_need"), F.explode("_words").alias("word"))
    return asked.join(each, "word").groupBy("query_id", "id", "_need").agg(F.count(F.lit(1)).alias("_has")).where("_has = _need").select("query_id", "id")


def create(spark: SparkSession, path: str, src: str, trg: str, version: str = "0.16.0") -> None:
    """An empty memory at ``path``: the tables metadata and main. Where there is one already, nothing is written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise ValueError(f"{path} exists already")
    spark.createDataFrame([], TM_MAIN).write.mode("errorifexists").parquet(f"{path}/main")
    spark.createDataFrame([(src, trg, version)], TM_METADATA).write.mode("errorifexists").parquet(f"{path}/metadata")


def save_version(memory: DataFrame, root: str) -> str:
    """Write an immutable version under ``root`` and return its path; readers take the path they were given."""
    path = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    memory.write.parquet(path)
    return path
