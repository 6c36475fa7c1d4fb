"""From documents to new bilingual files, and from memories to exchange files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.ranking import ranked
from ..operators import segment
from ..schemas import TOKENS
from . import po
from .bilingual import ANNOTATED, XLIFF2, new_tmx
from .documents import document_units, text_units
from .office import PART, office_segments, office_units
from .xliff import let

DATA = "map<string,string>"


def text_tokens(c: Column) -> Column:
    """One text token."""
    null = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), null.alias("tag"), null.alias("id"), null.alias("data_ref"), null.alias("equiv"), c.alias("text"))).cast(TOKENS)


def units(files: DataFrame, kind: str) -> DataFrame:
    """(file_id, unit_ord, unit_id, source tokens, data, attrs, target tokens, internal) of documents (file_id, content).

    data: the XML that tags stand for. attrs: what the unit keeps of its place in the original. target: what the original
    has as translation (PO). internal: on the first unit, what the original has besides units (a PO file's header).
    """
    none = lambda t: F.lit(None).cast(t)
    if kind in PART:
        return office_units(files, kind).select("file_id", "unit_ord", "unit_id", "source", "data", none(DATA).alias("attrs"), none(TOKENS).alias("target"), none("string").alias("internal"))
    texts = files.select(F.col("file_id").alias("path"), F.decode("content", "UTF-8").alias("text"))
    attrs, target, internal = none(DATA), none(TOKENS), none("string")
    if kind == "txt":
        rows = text_units(texts, "path", "text").withColumn("unit_id", F.col("unit_ord").cast("string"))
    elif kind == "json":
        rows = document_units(texts, kind).where("error is null and source is not null")
        attrs = F.create_map(F.lit("key"), F.coalesce("unit_key", F.lit("")))
    elif kind == "po":
        rows = document_units(texts, kind).where("error is null and source is not null")
        is_header = F.coalesce((F.col("unit_key") == "header") & (F.col("kind") == "ignorable"), F.lit(False))
        header = F.when(is_header, F.struct(F.col("source").alias("header"), F.coalesce(F.col("attrs")["metadata"], F.lit("")).alias("comments")))
        # plural forms: a unit that refers to another carries the second translation of that one, which is the unit before it
        rows = po.seconds(rows.withColumn("_header", F.max(header).over(Window.partitionBy("path"))).where(~is_header), "path").withColumn("_rid", F.col("attrs")["rid"])
        a = lambda k: F.col("attrs")[k]
        plural = F.col("_rid").isNotNull()
        single = F.when(plural, "msgid_plural").otherwise("msgid")
        form = F.when(plural, "msgstr[1]").when(a("msgstr").isNotNull(), "msgstr").otherwise("msgstr[0]")
        given = F.coalesce(F.when(plural, F.col("_second")), a("msgstr"), a("msgstr[0]"), F.lit(""))
        target = F.when(given != "", text_tokens(given))
        listed = {"keys": F.concat(single, F.lit(";"), form), "metadata": F.coalesce(a("metadata"), F.lit("")), "rid": F.col("_rid"), "msgctxt": a("msgctxt")}
        attrs = F.map_filter(F.create_map(*(x for k, v in listed.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
        internal = F.when(F.col("_header").isNotNull(), F.concat("_header.comments", F.lit('\nmsgid ""\nmsgstr "'), "_header.header", F.lit('"\n')))
    else:
        raise ValueError(f"no bilingual file is made from {kind}")
    source = text_tokens(F.col("source")).alias("source")
    return rows.select(F.col("path").alias("file_id"), F.col("unit_ord").cast("int").alias("unit_ord"), "unit_id", source, none(DATA).alias("data"), attrs.alias("attrs"), target.alias("target"), internal.alias("internal"))


def new_segments(files: DataFrame, kind: str, segmentation: bool | None = None) -> DataFrame:
    """Segments and ignorables of new bilingual files, numbered per file, with their units' data, attrs and internal.

    PO files are not segmented unless asked; without segmentation a segment's id is its unit's and translations that the
    original has become targets.
    """
    split = segmentation if segmentation is not None else kind != "po"
    if kind in PART:  # a file is one row, so its segments are numbered where it is read
        none = lambda t: F.lit(None).cast(t)
        rows = office_segments(files, kind, split).withColumns({"attrs": none(DATA), "internal": none("string"), "target": none(TOKENS)})
        return rows if split else rows.withColumn("segment_id", F.when(F.col("kind") == "segment", F.col("unit_id")))
    rows = segment.segmented(units(files, kind).withColumnRenamed("target", "_target"), split, ("data", "attrs", "internal", "_target"))
    rows = rows if split else rows.withColumn("segment_id", F.when(F.col("kind") == "segment", F.col("unit_id")))
    target = F.when(F.lit(not split) & (F.col("kind") == "segment"), F.col("_target"))
    return rows.withColumn("target", target).drop("_target")


def _escaped(text: Column, attribute: bool = False) -> Column:
    """Text as the standard library's writer puts it into an element, or into an attribute."""
    more = (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")) if attribute else ()
    for plain, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *more):
        text = F.replace(text, F.lit(plain), F.lit(named))
    return text


def _always(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), _escaped(value, True), F.lit('"'))


def _attribute(name: str, value: Column) -> Column:
    """An attribute with the space before it; empty without a value."""
    return F.when(F.coalesce(value, F.lit("")) != "", _always(name, value)).otherwise("")


def _element(name: str, body: Column, attributes: Column | None = None) -> Column:
    head = F.concat(F.lit(f"<{name}"), attributes) if attributes is not None else F.lit(f"<{name}")
    return let(body, lambda b: F.when(b == "", F.concat(head, F.lit(" />"))).otherwise(F.concat(head, F.lit(">"), b, F.lit(f"</{name}>"))))


def _content(tokens: Column) -> Column:
    """Mixed content of a version-2 side."""

    def shown(t: Column) -> Column:
        tag = F.concat(F.lit("<"), t["tag"], _attribute("id", t["id"]), _attribute("dataRef", t["data_ref"]), _attribute("equiv", t["equiv"]), F.lit(" />"))
        wrong = F.raise_error(F.concat(F.lit("tag "), F.coalesce(t["tag"], F.lit("None")), F.lit(" is not allowed here"))).cast("string")
        return F.when(t["kind"] == "text", F.coalesce(_escaped(t["text"]), F.lit(""))).when(t["tag"].isin("sc", "ec", "ph"), tag).otherwise(wrong)

    return F.array_join(F.transform(F.coalesce(tokens, F.array().cast(TOKENS)), shown), "")


def to_xliff(segments: DataFrame, src: str, trg: str) -> DataFrame:
    """(file_id, content): one version-2 file for each file_id; ``target`` tokens, ``data``, ``attrs`` and ``internal`` are
    optional. A bilingual file is one document, so its rows meet in one row; each row is written before, by Spark's own
    functions and byte for byte as ``new_xliff`` writes it."""
    for c, kind in (("target", TOKENS), ("data", DATA), ("attrs", DATA), ("internal", "string")):
        if c not in segments.columns:
            segments = segments.withColumn(c, F.lit(None).cast(kind))
    listed = lambda entries, use: F.array_join(F.transform(entries, use), "")
    attrs = F.coalesce("attrs", F.create_map().cast(DATA))
    more = listed(F.filter(F.map_entries(attrs), lambda e: e["key"] != "id"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escaped(F.coalesce(e["value"], F.lit("")), True), F.lit('"')))
    datum = lambda e: F.concat(F.lit('<data id="'), _escaped(e["key"], True), F.lit('"'), F.when(F.coalesce(e["value"], F.lit("")) == "", " />").otherwise(F.concat(F.lit(">"), _escaped(e["value"]), F.lit("</data>"))))
    data = F.when(F.size(F.coalesce("data", F.create_map().cast(DATA))) > 0, F.concat(F.lit("<originalData>"), listed(F.map_entries("data"), datum), F.lit("</originalData>"))).otherwise("")
    head = F.concat(F.lit("<unit"), _attribute("id", F.coalesce(F.try_element_at(attrs, F.lit("id")), F.col("unit_id"))), more, F.lit(">"), data)
    target = F.when(F.size(F.coalesce("target", F.array().cast(TOKENS))) > 0, _element("target", _content(F.col("target")))).otherwise("")
    part = F.concat(F.lit("<"), F.col("kind"), _attribute("id", F.col("segment_id")), F.lit(">"), _element("source", _content(F.col("source"))), target, F.lit("</"), F.col("kind"), F.lit(">"))

    rows = segments.select("file_id", F.struct("unit_ord", "seg_ord", head.alias("head"), part.alias("part")).alias("row"), F.when(F.col("internal").isNotNull(), F.struct("unit_ord", "seg_ord", "internal")).alias("inside"))
    begins = lambda all_: lambda r, i: F.when(i == 0, F.concat(r["head"], r["part"])).when(F.element_at(all_, i)["unit_ord"].eqNullSafe(r["unit_ord"]), r["part"]).otherwise(F.concat(F.lit("</unit>"), r["head"], r["part"]))
    units = let(F.array_sort(F.collect_list("row")), lambda all_: F.array_join(F.transform(all_, begins(all_)), ""))
    files = rows.groupBy("file_id").agg(units.alias("units"), F.min("inside")["internal"].alias("internal"))
    name_space = F.when(F.col("internal").isNotNull(), F.lit(f' xmlns:note="{ANNOTATED}"')).otherwise("")
    inside = F.when(F.col("internal").isNotNull(), _element("note:internal-file", _escaped(F.col("internal")), F.lit(' note:rel="self"'))).otherwise("")
    languages = F.concat(_always("srcLang", F.lit(src)), _always("trgLang", F.lit(trg)))
    content = F.concat(
        F.lit(f"<?xml version='1.0' encoding='UTF-8'?>\n<xliff xmlns=\"{XLIFF2}\""), name_space, F.lit(' version="2.1"'), languages, F.lit('><file id="1"'), _always("original", F.col("file_id")), F.lit(">"),
        inside, F.col("units"), F.lit("</unit></file></xliff>"),
    )
    return files.select("file_id", F.encode(content, "UTF-8").alias("content"))


def _parts(memory: DataFrame, name: str, rows: int) -> DataFrame:
    """Pairs that have both sides with their place, and the file that each goes to: at most ``rows`` pairs a file, in id
    order, so that a large memory is many files and no task holds more than one of them."""
    placed = ranked(memory.where("source <> '' and target <> ''"), F.floor(F.col("id") / 100_000), ["id"], "_place")
    part = F.floor((F.col("_place") - 1) / rows).cast("int")
    return placed.withColumn("file_id", F.when(part == 0, F.lit(name)).otherwise(F.concat(F.lit(f"{name}-"), (part + 1).cast("string"))))


def memory_to_xliff(memory: DataFrame, src: str, trg: str, name: str = "memory", rows: int = 200_000) -> DataFrame:
    """Files of the pairs that have both sides, in id order, at most ``rows`` pairs each (``name``, ``name-2``, ...)."""
    pairs = _parts(memory, name, rows)
    pairs = pairs.select("file_id", F.col("id").alias("unit_ord"), F.col("id").cast("string").alias("unit_id"), F.lit(0).alias("seg_ord"), F.lit("segment").alias("kind"), T.tokens(F.col("source")).alias("source"), T.tokens(F.col("target")).alias("target"))
    return to_xliff(segment.numbered(pairs), src, trg)


def memory_to_tmx(memory: DataFrame, src: str, trg: str, created: str, name: str = "memory", rows: int = 200_000) -> DataFrame:
    """TMX files of the pairs that have both sides, in id order, at most ``rows`` pairs each."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values("id")
        return pd.DataFrame({"file_id": [pairs.file_id.iloc[0]], "content": [new_tmx(list(zip(pairs.source, pairs.target)), src, trg, created)]})

    return _parts(memory, name, rows).select("file_id", "id", "source", "target").groupBy("file_id").applyInPandas(run, "file_id string, content binary")
