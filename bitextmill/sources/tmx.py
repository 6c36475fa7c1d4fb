"""TMX of any size: a file is read and written as rows of units, by as many tasks as it has splits.

Reading takes the end of a unit for the end of a record, so no task holds more than one unit at a time; the parts of a unit
are found by XPath. Files must be UTF-8 and use no prefix for TMX's own elements; an end tag of a unit inside a comment or a
CDATA section would part it.

Nulls: rows with a null side are not written. A file without units gives no rows. Repeated units stay.
"""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_END = "</tu>"


def _variant(v: Column) -> Column:
    """Language and texts of a ``tuv`` element. Segments that are text only need no parser, others go through XPath."""
    lang = F.nullif(F.regexp_extract(v, r"\A<tuv\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    seg = F.regexp_extract(v, r"(?s)<seg(?:\s[^>]*)?>(.*)</seg\s*>", 1)
    simple = ~seg.rlike("[<\r]|&(?!(?:amp|lt|gt|quot|apos);)") & ~v.contains("<!")
    plain = seg
    for name, character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    text = F.when(simple, plain).otherwise(F.xpath_string(v, F.lit("tuv/seg/node()[1][self::text()]")))
    full = F.when(simple, plain).otherwise(F.array_join(F.xpath(v, F.lit("tuv/seg/text() | tuv/seg/*/text()")), ""))
    return F.struct(lang.alias("lang"), text.alias("text"), full.alias("full"))


def units(spark: SparkSession, path: str) -> DataFrame:
    """(file, tuv: array of lang, text, full; created) of each unit of the files under ``path``.

    ``text`` is the leading text of a segment, ``full`` all text one level deep. Files of another data type than plain text
    and xml are an error.
    """
    records = spark.read.option("lineSep", _END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    kind = F.regexp_extract("value", r"<header\b[^>]*?\sdatatype\s*=\s*[\"']([^\"']*)", 1)
    checked = F.when(kind.isin("", "plaintext", "xml"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("data type "), kind, F.lit(" is not read"))))
    unit = F.concat(F.regexp_extract(checked, r"(?s)(<tu(?:\s[^>]*)?>.*)\z", 1), F.lit(_END))
    rows = records.select("file", unit.alias("unit")).where(F.col("unit") != _END)
    variants = F.filter(F.regexp_extract_all("unit", F.lit(r"(?s)(<tuv\b.*?</tuv\s*>)"), F.lit(1)), lambda v: v.rlike(r"<seg\b"))
    created = F.nullif(F.regexp_extract("unit", r"\A<tu\b[^>]*?\screationdate\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    return rows.select("file", F.transform(variants, _variant).alias("tuv"), created.alias("created"))


def escaped(text: Column) -> Column:
    """Text as XML holds it."""
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def write(memory: DataFrame, path: str, src: str, trg: str, created: str, datatype: str = "xml") -> None:
    """The pairs of a memory (source, target) as TMX files under ``path``, a file a partition; order is the memory's own."""
    side = lambda lang, c: F.concat(F.lit(f"<tuv xml:lang={quoteattr(lang)}><seg>"), escaped(F.col(c)), F.lit("</seg></tuv>"))
    unit = F.concat(F.lit(f"<tu creationdate={quoteattr(created)}>"), side(src, "source"), side(trg, "target"), F.lit(_END))
    head = f'<?xml version="1.0" encoding="UTF-8"?><tmx version="1.4"><header srclang={quoteattr(src)} datatype={quoteattr(datatype)} segtype="sentence" adminlang="en" o-tmf="tmx" creationtool="bitextmill" creationtoolversion="1"/><body>'

    def framed(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["</body></tmx>"])], ["value"])

    rows = memory.where((F.col("source") != "") & (F.col("target") != "")).select(unit.alias("value"))
    rows.mapInArrow(framed, "value string").write.text(path)
