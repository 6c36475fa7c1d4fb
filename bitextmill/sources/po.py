"""PO files by Spark's own functions: blank lines part entries, lines without a keyword go on with the last value, long values
are cut into lines by one pattern.

Nulls: a null text is an empty file; it has no units. Entries without a value or comment are none. Ties cannot be: entries
keep the order of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A value line: an optional keyword and a quoted text.
_LINE = r'(?s)^\s*(msg[a-z_]+(?:\[\d+\])?)?\s*"(.*)"\s*$'
_VALUES = "struct<last:string,found:array<struct<k:string,v:string>>>"


def entries(docs: DataFrame, key: str) -> DataFrame:
    """(key, ord from 1, comments, values by keyword) of PO files (key, text)."""
    text = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), r"\A\n+|\n+\z", "")
    blocks = docs.select(key, F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("_at", "_block"))
    lines = F.split("_block", "\n")
    given = F.transform(F.filter(lines, lambda x: ~x.startswith("#") & x.rlike(_LINE)), lambda x: F.struct(F.nullif(F.regexp_extract(x, _LINE, 1), F.lit("")).alias("k"), F.regexp_extract(x, _LINE, 2).alias("v")))
    none = F.from_json(F.lit("{}"), _VALUES)

    def more(sofar: Column, line: Column) -> Column:
        last = F.coalesce(line["k"], sofar["last"])
        return F.struct(last.alias("last"), F.concat(F.coalesce(sofar["found"], F.array()), F.array(F.struct(last.alias("k"), line["v"].alias("v")))).alias("found"))

    rows = blocks.select(key, "_at", F.array_join(F.filter(lines, lambda x: x.startswith("#")), "\n").alias("comments"), F.aggregate(given, none, more)["found"].alias("_v"))
    found = F.filter(F.coalesce("_v", F.array()), lambda x: x["k"].isNotNull())
    rows = rows.withColumn("_v", found).withColumn("_k", F.array_distinct(F.transform("_v", lambda x: x["k"])))
    of = lambda k: F.array_join(F.transform(F.filter("_v", lambda x: x["k"] == k), lambda x: x["v"]), "")
    rows = rows.withColumn("values", F.map_from_arrays("_k", F.transform("_k", of))).where((F.size("_k") > 0) | (F.col("comments") != ""))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_at")).alias("ord"), "comments", "values")


def units(docs: DataFrame, key: str) -> DataFrame:
    """(key, unit_ord, unit_id, unit_key, source, kind, attrs, error); the first entry without msgid is the header, a plural is
    a second unit that refers to its entry by ``rid``."""
    value = lambda k: F.col("values")[k]
    header = (F.col("ord") == 1) & (F.coalesce(value("msgid"), F.lit("")) == "")
    plural = value("msgid_plural").isNotNull() & ~header
    rows = entries(docs, key).withColumns({"_header": header, "_plural": plural, "_n": F.when(header, 0).when(plural, 2).otherwise(1)})
    upto = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_id", F.sum("_n").over(upto) - F.col("_n") + 1)
    attrs = F.map_concat(F.create_map(F.lit("metadata"), F.col("comments")), F.map_filter("values", lambda k, _: ~k.isin("msgid", "msgid_plural")))
    text = lambda x: x.cast("string")
    made = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    of_header = made(unit_id=text(F.lit(None)), unit_key=F.lit("header"), source=F.coalesce(value("msgstr"), F.lit("")), kind=F.lit("ignorable"), attrs=attrs)
    single = made(unit_id=text(F.col("_id")), unit_key=value("msgctxt"), source=F.coalesce(value("msgid"), F.lit("")), kind=F.lit("segment"), attrs=attrs)
    second = made(unit_id=text(F.col("_id") + 1), unit_key=value("msgctxt"), source=value("msgid_plural"), kind=F.lit("segment"), attrs=F.create_map(F.lit("rid"), text(F.col("_id"))))
    each = F.when(F.col("_header"), F.array(of_header)).when(F.col("_plural"), F.array(single, second)).otherwise(F.array(single))
    before = F.sum(F.when(F.col("_header"), 1).otherwise(F.col("_n"))).over(upto) - F.when(F.col("_header"), 1).otherwise(F.col("_n"))
    rows = rows.select(key, before.alias("_before"), each.alias("_each")).select(key, "_before", F.posexplode("_each").alias("_pos", "u"))
    return rows.select(key, (F.col("_before") + F.col("_pos") + 1).cast("int").alias("unit_ord"), "u.unit_id", "u.unit_key", "u.source", "u.kind", "u.attrs", F.lit(None).cast("string").alias("error"))


def seconds(units: DataFrame, key: str) -> DataFrame:
    """``units`` with ``_second``: of a unit that refers to the one before it, the second translation of that one."""
    before = F.lag(F.struct("unit_id", F.col("attrs")["msgstr[1]"].alias("second"))).over(Window.partitionBy(key).orderBy("unit_ord"))
    rows = units.withColumn("_before", before)
    return rows.withColumn("_second", F.when(F.col("_before.unit_id") == F.col("attrs")["rid"], F.col("_before.second"))).drop("_before")


def wrapped(keyword: str | Column, value: Column, width: int = 80) -> Column:
    """Lines of a keyword and its value; values of ``width`` and more are broken behind white space, after an empty one.

    A line is the shortest stretch of ``width`` and more characters that ends in white space, so one pattern cuts the value
    in linear time."""
    keyword = F.lit(keyword) if isinstance(keyword, str) else keyword
    broken = rf"(?s).{{{width - 1},}}?\s"
    single = F.array(F.concat(keyword, F.lit(' "'), value, F.lit('"')))
    lines = F.transform(F.regexp_extract_all(value, F.lit(rf"{broken}|.+"), F.lit(0)), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    several = F.concat(F.array(F.concat(keyword, F.lit(' ""'))), lines)
    return F.when(F.length(value) < width, single).when(~value.rlike(rf"(?s)\A.{{{width - 1},}}\s"), single).otherwise(several)


def rebuilt(units: DataFrame, key: str) -> DataFrame:
    """(key, text) of PO files from ``units`` with a column target; what has none keeps its own translation."""
    order = Window.partitionBy(key).orderBy("unit_ord")
    rows = units.where("error is null").withColumns({"_next": F.lead(F.struct("source", "target", "attrs")).over(order)}).where(F.col("attrs")["rid"].isNull())
    attr, none = lambda k: F.col("attrs")[k], F.array().cast("array<string>")
    own = lambda target, k: F.coalesce(F.nullif(target, F.lit("")), attr(k), F.lit(""))
    plural = (F.col("_next")["attrs"]["rid"] == F.col("unit_id")) & F.col("unit_id").isNotNull()
    further = F.flatten(F.transform(F.array_sort(F.filter(F.map_keys("attrs"), lambda k: k.rlike(r"^msgstr\[([2-9]|\d\d+)\]$"))), lambda k: wrapped(k, F.col("attrs")[k])))
    target = F.when(F.col("unit_id").isNotNull(), F.col("target"))
    several = F.concat(wrapped("msgid_plural", F.col("_next")["source"]), wrapped("msgstr[0]", own(target, "msgstr[0]")), wrapped("msgstr[1]", own(F.col("_next")["target"], "msgstr[1]")), further)
    lines = F.concat(
        F.when(F.coalesce(attr("metadata"), F.lit("")) != "", F.array(attr("metadata"))).otherwise(none),
        F.when(attr("msgctxt").isNotNull(), wrapped("msgctxt", attr("msgctxt"))).otherwise(none),
        wrapped("msgid", F.when(F.col("kind") == "ignorable", F.lit("")).otherwise(F.col("source"))),
        F.when(plural, several).otherwise(wrapped("msgstr", own(target, "msgstr"))),
    )
    blocks = rows.select(key, "unit_ord", F.array_join(lines, "\n").alias("block"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", "block"))), lambda x: x["block"])
    return blocks.groupBy(key).agg(F.concat(F.array_join(listed, "\n\n"), F.lit("\n")).alias("text"))
