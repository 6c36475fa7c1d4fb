"""Checks of translations: word model of a corpus, capital, punctuation and spelling findings, ranked corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capital_mismatch, closing_marks, is_blank, qa_words

FINDING = "struct<level:string,type:string,message:string,word:string,suggestions:array<string>>"


def word_model(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) of every checked word."""
    return texts.select(F.explode(qa_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def letter_set(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("letter")).distinct().where(F.col("letter").rlike(r"^\p{L}$"))


def shares(model: DataFrame) -> DataFrame:
    """(word, count, share): relative frequency; the total is one row that joins every partition."""
    total = model.agg(F.sum("count").alias("_all"))
    return model.crossJoin(F.broadcast(total)).select("word", "count", (F.col("count") / F.col("_all")).alias("share"))


def unknown_words(rows: DataFrame, model: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, word) of words that the model lacks; a word that repeats is found each time."""
    found = rows.select(*key, F.posexplode(qa_words(F.col(text))).alias("pos", "word"))
    return found.join(model.select("word"), "word", "left_anti").select(*key, "pos", "word")


def _deletions(word: str) -> Column:
    """The word itself and the word without each of its characters."""
    w = F.col(word)
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(w), F.when(F.length(w) > 0, cut).otherwise(F.array().cast("array<string>"))))


def one_edit(a: Column, b: Column) -> Column:
    """One deletion, insertion, replacement or swap of neighbours apart, or equal."""
    swap = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & F.array_contains(swap, b))


def _signs_kept(word: Column, candidate: Column) -> Column:
    """Inserted or replacing characters are letters: no more apostrophes or hyphens than before."""
    n = lambda c, sign: F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))
    return (n(candidate, "'") <= n(word, "'")) & (n(candidate, "-") <= n(word, "-"))


def candidates(words: DataFrame, model: DataFrame, letters: DataFrame | None = None) -> DataFrame:
    """(word, candidate, share): words of the model one edit away, by equal deletions and a check.

    ``letters``: alphabet for inserted characters where it is not the model's own.
    """
    left = words.select("word").distinct().withColumn("_d", F.explode(_deletions("word")))
    right = shares(model).select(F.col("word").alias("candidate"), "share").withColumn("_d", F.explode(_deletions("candidate")))
    pairs = left.join(right, "_d").select("word", "candidate", "share").distinct()
    pairs = pairs.where(one_edit(F.col("word"), F.col("candidate")) & _signs_kept(F.col("word"), F.col("candidate")))
    if letters is not None:
        used = pairs.select("word", "candidate", F.explode(F.array_except(F.split("candidate", ""), F.split("word", ""))).alias("letter")).where("letter <> ''")
        bad = used.join(letters, "letter", "left_anti").select("word", "candidate").distinct()
        pairs = pairs.join(bad, ["word", "candidate"], "left_anti")
    return pairs


def ranked_corrections(found: DataFrame, n: int = 5) -> DataFrame:
    """(word, place, candidate, share): the n likeliest of each word's candidates, ties by spelling."""
    order = Window.partitionBy("word").orderBy(F.desc("share"), "candidate")
    placed = found.withColumn("place", F.row_number().over(order).cast("long"))
    return placed.where(F.col("place") <= n).select("word", "place", "candidate", "share")


def corrections(words: DataFrame, model: DataFrame, n: int = 5) -> DataFrame:
    return ranked_corrections(candidates(words, model), n)


def check(segments: DataFrame, model: DataFrame | None = None, n: int = 5) -> DataFrame:
    """(segment_id, findings) of segments (segment_id, source, target); clean ones have an empty list.

    Segments without source are left out; without target there is the one finding that they are not translated.
    """
    rows = segments.where(~is_blank(F.col("source"))).select("segment_id", "source", "target")
    s, t = F.col("source"), F.col("target")
    missing = is_blank(t)
    none = F.lit(None).cast("string")

    def finding(level: str, kind: str, message: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type"), F.lit(message).alias("message"), none.alias("word"), F.lit(None).cast("array<string>").alias("suggestions"))

    plain = F.when(missing, F.array(finding("error", "untranslated", "Segment not translated."))).otherwise(
        F.array_compact(F.array(F.when(capital_mismatch(s, t), finding("warning", "capitalization", "Capitalization differs.")), F.when(closing_marks(s) != closing_marks(t), finding("warning", "punctuation", "Punctuation differs."))))
    )
    out = rows.select("segment_id", plain.alias("findings"))
    if model is None:
        return out
    unknown = unknown_words(rows.where(~missing), model, ["segment_id"], "target")
    best = corrections(unknown, model, n).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate"))), lambda x: x["candidate"]).alias("suggestions"))
    typos = unknown.join(best, "word", "left").select(
        "segment_id", "pos", F.struct(F.lit("warning").alias("level"), F.lit("spelling").alias("type"), F.lit("Unknown word.").alias("message"), F.col("word"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions")).alias("f")
    )
    typos = typos.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]).alias("_typos"))
    return out.join(typos, "segment_id", "left").select("segment_id", F.concat("findings", F.coalesce("_typos", F.array().cast(f"array<{FINDING}>"))).alias("findings"))
