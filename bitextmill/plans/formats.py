"""Named queries over files: the driver's tables are written as files of each format, read back or changed, and checked.

Files are rows (file_id, content), so a corpus of them is one DataFrame; the DuckDB SQL states what they must hold.
"""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.text import html_escape
from ..operators import memory, qa, review, segment
from ..schemas import TOKENS
from ..sources import bilingual, convert, documents, office, po, stores, tmx
from ..sources.scratch import shared_path
from . import fixtures as D
from .fixtures import SQL_LINES, SQL_QA_WORDS, sql_could_reach, sql_ratios

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _text(*columns: str) -> list[Column]:
    return [T.plain_text(F.col(c)).alias(c) for c in columns]


def _turns(spark, sf_dir) -> DataFrame:
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


#: Conversations as bilingual files: a turn is a unit of one segment; those of the assistant have a target.
_SQL_TURNS = "t AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS INTEGER) + 1 AS unit_ord, CAST(turn AS VARCHAR) AS id, role, coalesce(text, '') AS text FROM conversations)"


def _xliff(spark, sf_dir) -> DataFrame:
    rows = _turns(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("file_id"), (F.col("turn") + 1).cast("int").alias("unit_ord"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("unit_id"), F.lit(0).alias("seg_ord"), F.col("turn").cast("string").alias("segment_id"),
        F.lit("segment").alias("kind"), convert.text_tokens(F.col("text")).alias("source"), F.when(F.col("role") == "assistant", convert.text_tokens(F.concat(F.lit("> "), "text"))).alias("target"),
    )
    return convert.to_xliff(rows, "en", "de")


@query("xliff_new", f"WITH {_SQL_TURNS} SELECT file_id, unit_ord, id AS segment_id, text AS source, CASE role WHEN 'assistant' THEN '> ' || text END AS target, 'initial-blank' AS state, false AS locked FROM t")
def xliff_new(spark, sf_dir):
    rows = bilingual.segments_of(bilingual.opened(_xliff(spark, sf_dir)))
    return rows.select("file_id", "unit_ord", "segment_id", *_text("source", "target"), "state", "locked")


@query("xliff_saved", f"WITH {_SQL_TURNS} SELECT file_id, id AS segment_id, CASE role WHEN 'user' THEN '< ' || text WHEN 'assistant' THEN '> ' || text END AS target, CASE role WHEN 'user' THEN 'translated' ELSE 'initial-blank' END AS state FROM t")
def xliff_saved(spark, sf_dir):
    null = F.lit(None).cast("string")
    edits = _turns(spark, sf_dir).where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("file_id"), null.alias("unit_id"), F.col("turn").cast("string").alias("segment_id"), convert.text_tokens(F.concat(F.lit("< "), "text")).alias("target"), F.lit("translated").alias("state"), F.lit("translated").alias("sub_state"), F.lit(False).alias("locked"), null.alias("modified_on"), null.alias("modified_by")
    )
    rows = bilingual.segments_of(bilingual.opened(bilingual.saved(_xliff(spark, sf_dir), edits)))
    return rows.select("file_id", "segment_id", *_text("target"), "state")


def _changes(rows: DataFrame, ord_: Column, op: str, **values: Column) -> DataFrame:
    """Rows of ``bilingual.CHANGE`` with file_id, from conversations."""
    null = {"target": TOKENS, "segments": "array<string>"}
    given = {"segment_id": F.col("turn").cast("string")} | values
    names = ("unit_id", "segment_id", "target", "state", "text", "type", "severity", "remark_id", "segments", "at", "by")
    return rows.select(F.col("conv_id").cast("string").alias("file_id"), ord_.cast("int").alias("ord"), F.lit(op).alias("op"), *(given.get(n, F.lit(None)).cast(null.get(n, "string")).alias(n) for n in names))


def _updates(spark, sf_dir) -> DataFrame:
    """Two updates of every segment, and one of a segment that is locked in between or missing."""
    turns, stamp = _turns(spark, sf_dir), {"by": F.lit("me"), "at": F.lit("2024-01-01T00:00:00")}
    target = lambda mark: convert.text_tokens(F.concat(F.lit(mark), "text"))
    one = _changes(turns, F.col("turn") * 10, "update", target=target("1 "), state=F.lit("translated"), **stamp)
    two = _changes(turns, F.col("turn") * 10 + 1, "update", target=target("2 "), state=F.lit("reviewed"), **stamp)
    lock = _changes(turns.where("turn % 3 = 2"), F.col("turn") * 10 + 2, "lock")
    three = _changes(turns.where("turn % 3 <> 1"), F.col("turn") * 10 + 3, "update", target=target("3 "), state=F.lit("draft"), **stamp)
    missing = _changes(turns.where("turn = 0"), F.lit(9000), "update", segment_id=F.lit("none"), target=target("4 "), state=F.lit("draft"), **stamp)
    return one.unionByName(two).unionByName(lock).unionByName(three).unionByName(missing)


@query(
    "xliff_updated",
    f"""WITH {_SQL_TURNS} SELECT file_id, id AS segment_id, CASE CAST(id AS INTEGER) % 3 WHEN 0 THEN '3 ' ELSE '2 ' END || text AS target, CASE CAST(id AS INTEGER) % 3 WHEN 0 THEN 'initial-draft' ELSE 'reviewed' END AS state,
CAST(id AS INTEGER) % 3 = 2 AS locked, 'me' AS modified_by FROM t""",
)
def xliff_updated(spark, sf_dir):
    rows = bilingual.segments_of(bilingual.opened(bilingual.changed(_xliff(spark, sf_dir), _updates(spark, sf_dir))))
    return rows.select("file_id", "segment_id", *_text("target"), "state", "locked", "modified_by")


@query("xliff_refused", f"WITH {_SQL_TURNS} SELECT file_id, CAST(id AS INTEGER) * 10 + 3 AS ord, 'segment ' || id || ' is locked' AS reason FROM t WHERE CAST(id AS INTEGER) % 3 = 2 UNION ALL SELECT file_id, 9000, 'segment none does not exist' FROM t WHERE id = '0'")
def xliff_refused(spark, sf_dir):
    return bilingual.changed(_xliff(spark, sf_dir), _updates(spark, sf_dir)).select("file_id", F.explode("refused").alias("r")).select("file_id", "r.*")


@query(
    "xliff_history",
    f"""WITH {_SQL_TURNS} SELECT file_id, id AS segment_id, CAST(1 AS INTEGER) AS version_ord, '> ' || text AS target, CAST(NULL AS VARCHAR) AS state FROM t WHERE role = 'assistant'
UNION ALL SELECT file_id, id, CASE role WHEN 'assistant' THEN 2 ELSE 1 END, '1 ' || text, 'translated' FROM t""",
)
def xliff_history(spark, sf_dir):
    """Targets that updates to translated and reviewed replaced, read from the files."""
    rows = bilingual.history_of(bilingual.opened(bilingual.changed(_xliff(spark, sf_dir), _updates(spark, sf_dir))))
    return rows.select("file_id", "segment_id", "version_ord", *_text("target"), "state")


def _remarks(spark, sf_dir, new: str, done: str) -> DataFrame:
    """Two remarks on every segment, of which the first is resolved, once more than can be."""
    turns, by = _turns(spark, sf_dir), {"by": F.lit("me")}
    values = lambda mark: {"text": F.concat(F.lit(mark), "text"), "at": F.lit("2024-01-01T00:00:00"), "type": F.col("role"), "severity": F.lit("minor")}
    one, two = (_changes(turns, F.col("turn") * 10 + k, new, **values(f"{k} "), **by) for k in (0, 1))
    resolved = _changes(turns, F.col("turn") * 10 + 2, done, remark_id=F.lit("1"), at=F.lit("2024-02-02T00:00:00"), by=F.lit("you"))
    return one.unionByName(two).unionByName(resolved)


_SQL_REMARKS = "SELECT file_id, unit_ord, CAST(k + 1 AS VARCHAR) AS {0}, id AS segment_id, k || ' ' || text AS {1}, '2024-01-01T00:00:00' AS added_at, 'me' AS added_by, {2}, CASE k WHEN 0 THEN '2024-02-02T00:00:00' END AS resolved_at, CASE k WHEN 0 THEN 'you' END AS resolved_by FROM t, (SELECT unnest([0, 1]) AS k)"


@query("xliff_comments", f"WITH {_SQL_TURNS} " + _SQL_REMARKS.format("note_id", "text", "CASE k WHEN 0 THEN 'resolved' ELSE 'open' END AS state"))
def xliff_comments(spark, sf_dir):
    return bilingual.notes_of(bilingual.opened(bilingual.changed(_xliff(spark, sf_dir), _remarks(spark, sf_dir, "comment", "resolve_comment"))))


@query("xliff_issues", f"WITH {_SQL_TURNS} " + _SQL_REMARKS.format("issue_id", "comment", "role AS type, 'minor' AS severity, k = 0 AS resolved"))
def xliff_issues(spark, sf_dir):
    return bilingual.issues_of(bilingual.opened(bilingual.changed(_xliff(spark, sf_dir), _remarks(spark, sf_dir, "issue", "resolve_issue"))))


_SQL_SPLIT = "SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"


def _lines_file(spark, sf_dir) -> DataFrame:
    """Documents as bilingual files of one unit: a segment a line that is not empty, ignorables between them."""
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    part = lambda kind, k: F.struct(F.lit(kind).alias("kind"), (F.col("pos") * 2 + k).alias("seg_ord"))
    rows = docs.withColumn("_p", F.explode(F.array(part("segment", 0), part("ignorable", 1))))
    segment_ = F.col("_p.kind") == "segment"
    return convert.to_xliff(
        rows.select(
            "file_id", F.lit(1).alias("unit_ord"), F.lit("1").alias("unit_id"), F.col("_p.seg_ord").cast("int").alias("seg_ord"), F.when(segment_, F.col("pos").cast("string")).alias("segment_id"), F.col("_p.kind").alias("kind"),
            convert.text_tokens(F.when(segment_, F.col("line")).otherwise(" | ")).alias("source"), F.when(segment_, convert.text_tokens(F.concat(F.lit("> "), "line"))).alias("target"),
        ),
        "en", "de",
    )


@query(
    "xliff_merged",
    f"""WITH l AS (SELECT doc_id, i - 1 AS pos, parts[i] AS line FROM ({_SQL_SPLIT}) WHERE parts[i] <> '')
SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(min(pos) AS VARCHAR) AS segment_id, string_agg(line, ' | ' ORDER BY pos) AS source, string_agg('> ' || line, ' | ' ORDER BY pos) AS target FROM l GROUP BY doc_id""",
)
def xliff_merged(spark, sf_dir):
    """All segments of a document's file merged into one."""
    lines = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    ids = F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string"))
    groups = lines.groupBy("conv_id").agg(ids.alias("ids")).where(F.size("ids") > 1).withColumn("turn", F.lit(0))
    merges = _changes(groups, F.lit(0), "merge", segment_id=F.lit(None), segments=F.col("ids"))
    rows = bilingual.segments_of(bilingual.opened(bilingual.changed(_lines_file(spark, sf_dir), merges))).where("kind = 'segment'")
    return rows.select("file_id", "segment_id", *_text("source", "target"))


# version 1


def _joined(rows: DataFrame, unit: Column, head: str, tail: str) -> DataFrame:
    """(file_id, content): one file a conversation, of its units in order."""
    units = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", unit.alias("x")))), lambda u: u["x"]), "")
    return rows.groupBy(F.col("conv_id").cast("string").alias("file_id")).agg(F.encode(F.concat(F.lit(head), units, F.lit(tail)), "UTF-8").alias("content"))


_V1 = ('<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2" xmlns:sdl="http://sdl.com/FileTypes/SdlXliff/1.0" version="1.2"><file original="a" source-language="en" target-language="de"><body>', "</body></file></xliff>")


def _formatted(template: str, **values: Column) -> Column:
    """``template`` with {names} in place of values."""
    parts: list[Column] = []
    for piece in template.split("{"):
        name, _, rest = piece.partition("}") if parts else ("", "", piece)
        parts += [*([values[name]] if name else []), F.lit(rest)]
    return F.concat(*parts)


def _xliff1(spark, sf_dir) -> DataFrame:
    """Turns of users as two marked segments of which the first is translated, others as whole units."""
    text, turn = html_escape(F.col("text")), F.col("turn").cast("string")
    marked = _formatted('<trans-unit id="{t}"><source>x</source><seg-source><mrk mtype="seg" mid="{t}a">{x}</mrk> <mrk mtype="seg" mid="{t}b">b <g id="1">{x}</g><x id="2"/></mrk></seg-source><target state="x-locked-draft"><mrk mtype="seg" mid="{t}a">A {x}</mrk></target></trans-unit>', t=turn, x=text)
    whole = _formatted('<trans-unit id="{t}"><source>{x}</source><target state="translated">W {x}</target></trans-unit>', t=turn, x=text)
    return _joined(_turns(spark, sf_dir), F.when(F.col("role") == "user", marked).otherwise(whole), *_V1)


@query(
    "xliff1_read",
    f"""WITH {_SQL_TURNS} SELECT file_id, id AS unit_id, id || 'a' AS segment_id, text AS source, 'A ' || text AS target FROM t WHERE role = 'user'
UNION ALL SELECT file_id, id, id || 'b', 'b <g-1>' || text || '</g-1><x-2/>', '' FROM t WHERE role = 'user'
UNION ALL SELECT file_id, id, 'N/A', text, 'W ' || text FROM t WHERE role <> 'user'""",
)
def xliff1_read(spark, sf_dir):
    rows = bilingual.segments_of(bilingual.opened(_xliff1(spark, sf_dir)))
    return rows.select("file_id", "unit_id", "segment_id", T.shown(F.col("source")).alias("source"), *_text("target"))


def _sdl(spark, sf_dir) -> DataFrame:
    text, turn = html_escape(F.col("text")), F.col("turn").cast("string")
    unit = _formatted(
        '<trans-unit id="{t}"><source>{x}</source><seg-source><mrk mtype="seg" mid="{t}">{x}</mrk></seg-source><target><mrk mtype="seg" mid="{t}">S {x}</mrk></target><sdl:seg-defs><sdl:seg id="{t}" conf="Draft" locked="{l}"/></sdl:seg-defs></trans-unit>',
        t=turn, x=text, l=F.when(F.col("turn") % 2 == 1, "true").otherwise("false"),
    )
    return _joined(_turns(spark, sf_dir), unit, *_V1)


@query("sdlxliff_read", f"WITH {_SQL_TURNS} SELECT file_id, id AS segment_id, text AS source, 'S ' || text AS target, 'draft' AS state, CAST(id AS INTEGER) % 2 = 1 AS locked FROM t")
def sdlxliff_read(spark, sf_dir):
    rows = bilingual.segments_of(bilingual.opened(_sdl(spark, sf_dir)))
    return rows.select("file_id", "segment_id", *_text("source", "target"), "state", "locked")


@query(
    "bilingual_guard",
    """SELECT CAST(conv_id AS VARCHAR) || '-' || k || '.' || suffix AS file_id, refused FROM (SELECT DISTINCT conv_id FROM conversations),
(VALUES ('v1', 'xliff', NULL), ('v1', 'sdlxliff', 'the content is not that of a sdlxliff file'), ('sdl', 'sdlxliff', NULL), ('sdl', 'kxliff', 'the content is not that of a kxliff file'), ('v2', 'xliff', NULL), ('v2', 'kxliff', 'the content is not that of a kxliff file'), ('note', 'kxliff', NULL)) AS n(k, suffix, refused)""",
)
def bilingual_guard(spark, sf_dir):
    """Files under suffixes that fit their content and under others."""
    plain = _xliff(spark, sf_dir)
    noted = bilingual.changed(plain, _remarks(spark, sf_dir, "issue", "resolve_issue")).select("file_id", "content")
    named = lambda files, k, suffix: files.select(F.concat("file_id", F.lit(f"-{k}.{suffix}")).alias("file_id"), "content")
    v1, sdl = _xliff1(spark, sf_dir), _sdl(spark, sf_dir)
    each = [named(v1, "v1", "xliff"), named(v1, "v1", "sdlxliff"), named(sdl, "sdl", "sdlxliff"), named(sdl, "sdl", "kxliff"), named(plain, "v2", "xliff"), named(plain, "v2", "kxliff"), named(noted, "note", "kxliff")]
    files = each[0]
    for more in each[1:]:
        files = files.unionByName(more)
    return bilingual.guarded(bilingual.opened(files)).select("file_id", "refused")


@query("sdlxliff_saved", f"WITH {_SQL_TURNS} SELECT file_id, id AS segment_id, CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'U ' ELSE 'S ' END || text AS target, CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'translated' ELSE 'draft' END AS state, CAST(id AS INTEGER) % 2 = 1 AS locked FROM t")
def sdlxliff_saved(spark, sf_dir):
    """Updates by the rules of the dialect, written to the files: locked segments stay as they are."""
    files = _sdl(spark, sf_dir)
    segments = bilingual.segments_of(bilingual.opened(files))
    edits = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("string").alias("segment_id"), convert.text_tokens(F.concat(F.lit("U "), "text")).alias("target"), F.lit("translated").alias("state"), F.lit("me").alias("submitted_by"), F.lit("01/01/2024 00:00:00").alias("at"))
    updated = review.update_segments(segments, edits, "sdl")[0].where("not locked")
    rows = bilingual.segments_of(bilingual.opened(bilingual.saved(files, updated.select("file_id", "unit_id", "segment_id", "target", "state", "sub_state", "locked", "modified_on", "modified_by"))))
    return rows.select("file_id", "segment_id", *_text("target"), "state", "locked")


# exchange files and memories


@query("tmx_round_trip", f"WITH {SQL_LINES} SELECT entry AS source, '> ' || entry AS target FROM lines WHERE doc_id % 2 = 0")
def tmx_round_trip(spark, sf_dir):
    made = convert.memory_to_tmx(D.memory(spark, sf_dir, 0), "en", "de", "20240101T000000Z", rows=1000)
    return memory.from_units(bilingual.tmx_units(made), "en", "de").select("source", "target")


@query("tmx_scan", f"WITH {SQL_LINES} SELECT entry AS source, '> ' || entry AS target FROM lines WHERE doc_id % 2 = 0")
def tmx_scan(spark, sf_dir):
    """A memory written as TMX files and read back, both unit by unit."""
    path = shared_path(spark, "tmx")
    tmx.write(D.memory(spark, sf_dir, 0), path, "en", "de", "20240101T000000Z")
    return memory.from_units(tmx.units(spark, path), "en", "de").select("source", "target")


@query("memory_to_xliff", f"WITH {SQL_LINES} SELECT doc_id * 100000 + pos AS id, entry AS source, '> ' || entry AS target FROM lines WHERE doc_id % 2 = 0")
def memory_to_xliff(spark, sf_dir):
    rows = D.memory(spark, sf_dir, 0).withColumns({c: html_escape(F.col(c)) for c in ("source", "target")})
    rows = bilingual.segments_of(bilingual.opened(convert.memory_to_xliff(rows, "en", "de", rows=1000)))
    return rows.select(F.col("unit_id").cast("long").alias("id"), *_text("source", "target"))


def _stores(spark, sf_dir) -> DataFrame:
    return stores.write_memories(D.memory(spark, sf_dir, 0).withColumn("file_id", F.col("submitted_by")), "en", "de")


@query("memory_files", f"WITH {SQL_LINES} SELECT file AS file_id, 'en' AS src_lang, 'de' AS trg_lang, doc_id * 100000 + pos AS id, entry AS source, '> ' || entry AS target, 'translated' AS state, CAST(NULL AS VARCHAR) AS time, file AS submitted_by FROM lines WHERE doc_id % 2 = 0")
def memory_files(spark, sf_dir):
    return stores.read_memories(_stores(spark, sf_dir), "en", "de").drop("version")


@query("xliff_import", f"WITH {_SQL_TURNS} SELECT text AS source, '> ' || text AS target, 'initial-blank' AS state FROM t WHERE role = 'assistant' AND text <> ''")
def xliff_import(spark, sf_dir):
    """Pairs of bilingual files as entries of a memory, escapes undone for the comparison."""
    rows = memory.from_segments(bilingual.segments_of(bilingual.opened(_xliff(spark, sf_dir))))
    return rows.select(*(T.html_unescape(F.col(c)).alias(c) for c in ("source", "target")), "state")


@query("xliff_import_upsert", f"WITH {_SQL_TURNS}, {SQL_LINES}, new AS (SELECT text FROM t WHERE role = 'assistant' AND text <> '') SELECT entry AS source, '> ' || entry AS target FROM lines WHERE doc_id % 2 = 0 AND entry NOT IN (SELECT text FROM new) UNION ALL SELECT text, '> ' || text FROM new")
def xliff_import_upsert(spark, sf_dir):
    pairs = memory.from_segments(bilingual.segments_of(bilingual.opened(_xliff(spark, sf_dir))))
    pairs = pairs.withColumns({c: T.html_unescape(F.col(c)) for c in ("source", "target")})
    bucket = F.ascii("source").cast("long") * (1 << 21) + F.ascii(F.substring("source", 2, 1))  # by two characters, which rises with the source
    return memory.upsert(D.memory(spark, sf_dir, 0), pairs, ["source", "target"], bucket).select("source", "target")


# documents


def _packed(kind: str):
    """Bytes of a document of lines: the first three characters of a line are formatted."""

    def docx(line: str) -> str:
        run = lambda t, style="": f'<w:r>{style}<w:t xml:space="preserve">{escape(t)}</w:t></w:r>' if t else ""
        return f"<w:p>{run(line[:3], '<w:rPr><w:b/></w:rPr>')}{run(line[3:])}</w:p>"

    def odf(line: str) -> str:
        return f'<text:p><text:span text:style-name="T1">{escape(line[:3])}</text:span>{escape(line[3:])}</text:p>'

    w, o, t = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    each = docx if kind == "docx" else odf
    head, tail = (f'<w:document xmlns:w="{w}"><w:body>', "</w:body></w:document>") if kind == "docx" else (f'<office:body xmlns:office="{o}" xmlns:text="{t}">', "</office:body>")

    @F.pandas_udf("binary")
    def run(text: pd.Series) -> pd.Series:
        def one(x: str | None) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(office.PART[kind], head + "".join(map(each, (x or "").split("\n"))) + tail)
            return out.getvalue()

        return text.map(one)

    return run


def _office(spark, sf_dir, kind: str) -> DataFrame:
    return D.spread(D.table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("file_id"), _packed(kind)(F.col("text")).alias("content"))


_SQL_PARAGRAPHS = f"WITH p AS (SELECT doc_id, i, parts[i] AS line FROM ({_SQL_SPLIT}) WHERE {{0}}) SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS unit_ord, {{1}} AS text FROM p"
_HAS_TEXT = {"docx": "parts[i] <> ''", "odt": "regexp_matches(parts[i], '\\S')"}


def _office_queries(kind: str) -> None:
    @query(f"{kind}_units", _SQL_PARAGRAPHS.format(_HAS_TEXT[kind], "line"))
    def units(spark, sf_dir):
        rows = office.office_units(_office(spark, sf_dir, kind), kind)
        return rows.select("file_id", "unit_ord", T.plain_text(F.col("source")).alias("text"))

    @query(f"{kind}_rebuilt", _SQL_PARAGRAPHS.format(_HAS_TEXT[kind], "'> ' || line"))
    def rebuilt(spark, sf_dir):
        """Documents with targets, by way of bilingual files: the tags' XML is read from the files."""
        files = _office(spark, sf_dir, kind)
        made = convert.to_xliff(convert.new_segments(files, kind, segmentation=False), "en", "de")
        opened = bilingual.opened(made)
        segments = bilingual.segments_of(opened)
        first = F.min("seg_ord").over(D.Window.partitionBy("file_id", "unit_ord"))
        marked = F.when(F.col("seg_ord") == first, F.concat(convert.text_tokens(F.lit("> ")), F.col("source"))).otherwise(F.col("source"))
        targets = segments.select("file_id", "unit_ord", "seg_ord", marked.alias("tokens"))
        out = office.office_units(office.rebuilt_files(files, targets, kind), kind)
        return out.select("file_id", "unit_ord", T.plain_text(F.col("source")).alias("text"))


_office_queries("docx")
_office_queries("odt")


@query("docx_original_data", f"WITH p AS ({_SQL_SPLIT}) SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(count(*) AS BIGINT) AS n FROM p WHERE parts[i] <> '' GROUP BY doc_id")
def docx_original_data(spark, sf_dir):
    """Units of which the bilingual file holds the XML that their tags stand for."""
    made = convert.to_xliff(convert.new_segments(_office(spark, sf_dir, "docx"), "docx"), "en", "de")
    data = bilingual.original_data_of(bilingual.opened(made)).where(F.col("xml").contains("rPr"))
    return data.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


_SQL_PO = "replace(replace(text, chr(10), ' '), '\"', '''')"


def _po(spark, sf_dir) -> DataFrame:
    """A PO file a conversation: a header, an entry a turn; those of users are plurals, the others translated."""
    value = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
    turns = _turns(spark, sf_dir)
    single, plural = '#: {t}\nmsgid "{x}"\nmsgstr "P {x}"\n', 'msgid "{x}"\nmsgid_plural "s {x}"\nmsgstr[0] ""\nmsgstr[1] "Q {x}"\n'
    entry = F.when(F.col("role") == "user", _formatted(plural, x=value)).otherwise(_formatted(single, t=F.col("turn").cast("string"), x=value))
    return _joined(turns, F.concat(F.lit("\n"), entry), '# head\nmsgid ""\nmsgstr "Content-Type: text\\\\n"\n', "")


_SQL_PO_UNITS = f"WITH {_SQL_TURNS}, p AS (SELECT file_id, unit_ord, role, {_SQL_PO} AS x FROM t), u AS (SELECT file_id, unit_ord, 0 AS k, x, role, CASE role WHEN 'user' THEN NULL ELSE 'P ' || x END AS target FROM p UNION ALL SELECT file_id, unit_ord, 1, 's ' || x, role, 'Q ' || x FROM p WHERE role = 'user') SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY unit_ord, k) AS VARCHAR) AS unit_id, x AS source{{0}} FROM u"


@query("po_units", _SQL_PO_UNITS.format(""))
def po_units(spark, sf_dir):
    texts = _po(spark, sf_dir).select(F.col("file_id").alias("path"), F.decode("content", "UTF-8").alias("text"))
    return documents.document_units(texts, "po").where("unit_id is not null").select(F.col("path").alias("file_id"), "unit_id", "source")


@query("po_rebuilt", _SQL_PO_UNITS.format(", CASE WHEN k = 1 THEN 'T s ' || x ELSE 'T ' || x END AS target").replace("'T s ' || x", "'T ' || x"))
def po_rebuilt(spark, sf_dir):
    texts = _po(spark, sf_dir).select(F.col("file_id").alias("path"), F.decode("content", "UTF-8").alias("text"))
    units = documents.document_units(texts, "po")
    made = documents.rebuilt_documents(units.withColumn("target", F.when(F.col("unit_id").isNotNull(), F.concat(F.lit("T "), "source"))), "po")
    rows = po.seconds(documents.document_units(made, "po").where("unit_id is not null"), "path")
    target = F.coalesce("_second", F.col("attrs")["msgstr"], F.col("attrs")["msgstr[0]"])
    return rows.select(F.col("path").alias("file_id"), "unit_id", "source", target.alias("target"))


def _sql_wrapped(keyword: str, value: str) -> str:
    fold = f"list_reduce(list_prepend('', regexp_extract_all({value}, '\\s|\\S+')), lambda a, p: a || p || CASE WHEN regexp_full_match(p, '\\s') AND length(string_split(a || p, chr(1))[-1]) >= 80 THEN chr(1) ELSE '' END)"
    lines = f"string_split({fold}, chr(1))"
    return f"CASE WHEN len({lines}) = 1 THEN ['{keyword} \"' || {value} || '\"'] ELSE list_concat(['{keyword} \"\"'], list_transform(list_filter({lines}, lambda l: l <> ''), lambda l: '\"' || l || '\"')) END"


@query(
    "po_lines",
    f"""WITH {_SQL_TURNS}, p AS (SELECT file_id, unit_ord, role, {_SQL_PO} AS x FROM t),
b AS (SELECT file_id, unit_ord, CASE WHEN role = 'user' THEN flatten([{_sql_wrapped('msgid', 'x')}, {_sql_wrapped('msgid_plural', "('s ' || x)")}, ['msgstr[0] ""'], {_sql_wrapped('msgstr[1]', "('Q ' || x)")}])
ELSE flatten([['#: ' || id], {_sql_wrapped('msgid', 'x')}, {_sql_wrapped('msgstr', "('P ' || x)")}]) END AS lines FROM (SELECT p.*, t.id FROM p JOIN t USING (file_id, unit_ord))),
f AS (SELECT file_id, flatten(list(list_prepend('', lines) ORDER BY unit_ord)) AS lines FROM b GROUP BY file_id)
SELECT file_id, CAST(unnest(range(1, len(lines) + 5)) AS INTEGER) AS line_no, unnest(list_concat(['# head', 'msgid ""', 'msgstr "Content-Type: text\\\\n"'], lines, [''])) AS line FROM f""",
)
def po_lines(spark, sf_dir):
    """The lines of PO files that were read and written again, long values wrapped, in their order."""
    texts = _po(spark, sf_dir).select(F.col("file_id").alias("path"), F.decode("content", "UTF-8").alias("text"))
    made = documents.rebuilt_documents(documents.document_units(texts, "po").withColumn("target", F.lit(None).cast("string")), "po")
    return made.select(F.col("path").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("_at", "line")).select("file_id", (F.col("_at") + 1).alias("line_no"), "line")


@query("po_new_file", _SQL_PO_UNITS.format(", target"))
def po_new_file(spark, sf_dir):
    """New bilingual files of PO files keep the translations that these have."""
    rows = bilingual.segments_of(bilingual.opened(convert.to_xliff(convert.new_segments(_po(spark, sf_dir), "po"), "en", "de")))
    side = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", T.plain_text(F.col(kind)).alias("x")))), lambda s: s["x"]), "")
    out = rows.groupBy("file_id", "unit_id").agg(side("source").alias("source"), F.max(F.when(F.size("target") > 0, T.plain_text(F.col("target")))).alias("target"))
    return out.select("file_id", "unit_id", "source", "target")


def _json(spark, sf_dir) -> DataFrame:
    turns = _turns(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return turns.select("path", F.to_json(F.struct("turns", F.struct(F.col("path").alias("id.name"), F.lit(" ").alias("blank")).alias("meta"))).alias("text"))


_SQL_JSON = f"WITH {_SQL_TURNS}, n AS (SELECT file_id, CAST(count(*) AS INTEGER) AS n FROM t GROUP BY file_id) SELECT file_id AS path, unit_ord, 'turns' AS unit_key, {{0}} AS source FROM t WHERE regexp_matches(text, '\\S') UNION ALL SELECT file_id, n + 1, 'meta.id.name', {{1}} FROM n"


@query("json_units", _SQL_JSON.format("text", "file_id"))
def json_units(spark, sf_dir):
    return documents.document_units(_json(spark, sf_dir), "json").where("kind = 'segment'").select("path", "unit_ord", "unit_key", "source")


@query("json_rebuilt", _SQL_JSON.format("'> ' || text", "'> ' || file_id"))
def json_rebuilt(spark, sf_dir):
    units = documents.document_units(_json(spark, sf_dir), "json").withColumn("target", F.when(F.col("kind") == "segment", F.concat(F.lit("> "), "source")))
    return documents.document_units(documents.rebuilt_documents(units, "json"), "json").where("kind = 'segment'").select("path", "unit_ord", "unit_key", "source")


# models, packages, reports


def _models(spark, sf_dir) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("file_id"), "text")
    letters = docs.select("file_id", F.explode(F.array_distinct(F.split("text", ""))).alias("letter")).distinct().where(F.col("letter").rlike(r"^\p{L}$"))
    words = docs.select("file_id", F.explode(qa.qa_words(F.col("text"))).alias("word")).groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("count"))
    return stores.write_models(letters, words)


@query("model_words", f"SELECT coalesce(lang, '') AS file_id, word, count(*) AS count FROM (SELECT lang, unnest({SQL_QA_WORDS.format('text')}) AS word FROM documents) GROUP BY ALL")
def model_words(spark, sf_dir):
    return stores.read_models(_models(spark, sf_dir))[1]


@query("model_letters", "SELECT DISTINCT coalesce(lang, '') AS file_id, letter FROM (SELECT lang, unnest(list_distinct(string_split(text, ''))) AS letter FROM documents) WHERE regexp_full_match(letter, '\\p{L}')")
def model_letters(spark, sf_dir):
    return stores.read_models(_models(spark, sf_dir))[0]


def _packages(spark, sf_dir) -> DataFrame:
    """A package a conversation: a member a turn under the target language; the manifest lists the first as the target."""
    turns = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("package_id"), "turn", F.concat(F.lit("de/"), F.col("turn").cast("string"), F.lit(".txt")).alias("member"), F.encode("text", "UTF-8").alias("content"))
    first = turns.groupBy("package_id").agg(F.min_by("member", "turn").alias("first"))
    manifest = F.to_json(F.struct(F.col("package_id").alias("title"), F.lit("en").alias("src"), F.lit("de").alias("trg"), F.create_map(F.lit("0"), F.struct(F.col("first").alias("targetBF"))).alias("files")))
    return stores.write_packages(turns, first.select("package_id", manifest.alias("manifest")))


@query("package_members", f"WITH {_SQL_TURNS} SELECT file_id AS package_id, file_id AS title, 'de/' || id || '.txt' AS member, text FROM t")
def package_members(spark, sf_dir):
    rows = stores.read_packages(_packages(spark, sf_dir))
    return rows.select("package_id", F.get_json_object("manifest", "$.title").alias("title"), "member", F.decode("content", "UTF-8").alias("text"))


@query("package_targets", f"WITH {_SQL_TURNS} SELECT file_id AS package_id, 'de/' || arg_min(id, unit_ord) || '.txt' AS member, arg_min(text, unit_ord) AS text FROM t GROUP BY file_id")
def package_targets(spark, sf_dir):
    return stores.read_packages(_packages(spark, sf_dir), targets_only=True).select("package_id", "member", F.decode("content", "UTF-8").alias("text"))


_SQL_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "report_pages",
    f"""WITH {_SQL_TURNS} SELECT file_id, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset=''utf-8''><title>' || file_id || '</title></head><body><h1>' || file_id || '</h1><p>now</p><table><tr><th>segment id</th><th>source</th><th>translation</th><th>edited</th><th>issues</th></tr>' || chr(10)
|| string_agg('<tr><td>' || id || '</td><td>' || {_SQL_ESC.format('text')} || '</td><td>' || {_SQL_ESC.format("'> ' || text")} || '</td><td></td><td>' || CASE role WHEN 'user' THEN 'style (minor): ' || id ELSE '' END || '</td></tr>', chr(10) ORDER BY unit_ord) || '</table></body></html>' AS content FROM t GROUP BY file_id""",
)
def report_pages(spark, sf_dir):
    issue = F.struct(F.lit("1").alias("issue_id"), F.lit("style").alias("type"), F.lit("minor").alias("severity"), F.col("turn").cast("string").alias("comment"))
    rows = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("string").alias("segment_id"), F.col("text").alias("source"), F.concat(F.lit("> "), "text").alias("translation"), F.lit(None).cast("string").alias("edited"), F.when(F.col("role") == "user", F.array(issue)).alias("issues"))
    return stores.report_pages(rows, "now")


# segments with tags


def _tagged(spark, sf_dir) -> DataFrame:
    """Parts as segments: name, formatted type, a break, brand."""
    null = F.lit(None).cast("string")
    text = lambda c: F.struct(F.lit("text").alias("kind"), null.alias("tag"), null.alias("id"), null.alias("data_ref"), null.alias("equiv"), F.col(c).alias("text"))
    tag = lambda name, id_, ref, equiv=None: F.struct(F.lit("tag").alias("kind"), F.lit(name).alias("tag"), F.lit(id_).alias("id"), F.lit(ref).alias("data_ref"), F.lit(equiv).cast("string").alias("equiv"), null.alias("text"))
    return D.spread(D.table(spark, sf_dir, "part")).withColumn("tokens", F.array(text("p_name"), tag("sc", "7", "1"), text("p_type"), tag("ec", "7", "1"), tag("ph", "9", "2", "<br/>"), text("p_brand")).cast(TOKENS))


@query("entry_of_tags", f"SELECT p_partkey, {_SQL_ESC.format('p_name')} || '<sc-1/>' || {_SQL_ESC.format('p_type')} || '<ec-1/><ph-2/>' || {_SQL_ESC.format('p_brand')} AS entry FROM part")
def entry_of_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select("p_partkey", T.entry(F.col("tokens")).alias("entry"))


@query("tags_of_entry", "SELECT p_partkey, p_name || '<sc-1/>' || p_type || '<ec-1/><ph-2/>' || p_brand AS shown FROM part")
def tags_of_entry(spark, sf_dir):
    return _tagged(spark, sf_dir).select("p_partkey", T.shown(T.tokens(T.entry(F.col("tokens")))).alias("shown"))


@query("tags_mapped_back", "SELECT p_partkey, p_name || '<sc-7/>' || p_type || '<ec-7/>' AS shown FROM part")
def tags_mapped_back(spark, sf_dir):
    """An entry's tags take the ids of the query's; a tag that the query lacks is dropped."""
    entry = F.concat(html_escape(F.col("p_name")), F.lit("<sc-1/>"), html_escape(F.col("p_type")), F.lit("<ec-1/><bx-5/>"))
    return _tagged(spark, sf_dir).select("p_partkey", T.shown(T.tokens(entry, F.col("tokens"), safe=True)).alias("shown"))


@query(
    "tm_hits_as_segments",
    f"""WITH RECURSIVE q AS (SELECT p_partkey AS query_id, p_name || '<sc-1/>' || p_type || '<ec-1/><ph-2/>' || p_brand AS entry FROM part),
tm AS (SELECT min(p_partkey) AS id, p_name || '<sc-1/>' || p_type || '<ec-1/><bx-5/>' AS source FROM part GROUP BY ALL),
{sql_ratios("SELECT DISTINCT source AS a, entry AS b FROM tm, q WHERE 2 * least(length(source), length(entry)) >= 0.85 * (length(source) + length(entry)) AND " + sql_could_reach('source', 'entry', 0.85))}
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ratio DESC, id) AS INTEGER) AS rank, replace(replace(replace(source, '<bx-5/>', ''), '<sc-1/>', '<sc-7/>'), '<ec-1/>', '<ec-7/>') AS source,
'> ' || replace(replace(replace(source, '<bx-5/>', ''), '<sc-1/>', '<sc-7/>'), '<ec-1/>', '<ec-7/>') AS target FROM ratios JOIN tm ON a = source JOIN q ON b = entry WHERE ratio >= 0.85""",
)
def tm_hits_as_segments(spark, sf_dir):
    """Fuzzy hits of segments with tags: both sides take the ids of the query's tags."""
    parts = D.table(spark, sf_dir, "part")
    entry = F.concat(html_escape(F.col("p_name")), F.lit("<sc-1/>"), html_escape(F.col("p_type")), F.lit("<ec-1/><bx-5/>"))
    tm = parts.groupBy(entry.alias("source")).agg(F.min("p_partkey").alias("id"))
    tm = tm.select("id", "source", F.concat(F.lit("&gt; "), "source").alias("target"), *(F.lit(None).cast("string").alias(c) for c in ("state", "time", "submitted_by")))
    hits = memory.lookup_hits(_tagged(spark, sf_dir).select(F.col("p_partkey").alias("query_id"), "tokens"), tm, 0.85)
    return hits.select("query_id", "id", "rank", T.shown(F.col("source")).alias("source"), T.shown(F.col("target")).alias("target"))


@query("tags_shown", "SELECT p_partkey, p_name || '<sc-7/>' || p_type || '<ec-7/><br/>' || p_brand AS shown FROM part")
def tags_shown(spark, sf_dir):
    return _tagged(spark, sf_dir).select("p_partkey", T.shown(F.col("tokens")).alias("shown"))


def _units_of(rows: DataFrame, tokens: Column) -> DataFrame:
    units = rows.select(F.col("p_partkey").cast("string").alias("file_id"), F.lit(1).alias("unit_ord"), F.lit("1").alias("unit_id"), tokens.alias("source"))
    return segment.segmented(units).select("file_id", "seg_ord", "kind", T.shown(F.col("source")).alias("text"))


@query("segment_merged_tags", "SELECT CAST(p_partkey AS VARCHAR) AS file_id, CAST(0 AS INTEGER) AS seg_ord, 'segment' AS kind, p_brand || '<sc-7/>' || p_type || p_name || '<ec-7/>' || p_brand AS text FROM part")
def segment_merged_tags(spark, sf_dir):
    """Formatting that closes and reopens at once is one run."""
    rows = _tagged(spark, sf_dir)
    t = lambda i: F.slice("tokens", i, 1)
    return _units_of(rows, F.concat(t(6), t(2), t(3), t(4), t(2), t(1), t(4), t(6)))


@query("segment_empty_pairs", "SELECT CAST(p_partkey AS VARCHAR) AS file_id, CAST(0 AS INTEGER) AS seg_ord, 'segment' AS kind, p_brand || p_type AS text FROM part")
def segment_empty_pairs(spark, sf_dir):
    t = lambda i: F.slice("tokens", i, 1)
    return _units_of(_tagged(spark, sf_dir), F.concat(t(6), t(2), t(4), t(3)))


@query(
    "segment_peeled_tags",
    """SELECT CAST(p_partkey AS VARCHAR) AS file_id, CAST(k AS INTEGER) AS seg_ord, CASE k WHEN 1 THEN 'segment' ELSE 'ignorable' END AS kind, CASE k WHEN 0 THEN '<sc-7/>  ' WHEN 1 THEN p_name ELSE ' <ec-7/><br/>' END AS text FROM part, (SELECT unnest([0, 1, 2]) AS k)""",
)
def segment_peeled_tags(spark, sf_dir):
    """Tags and white space at both ends become ignorables."""
    t = lambda i: F.slice("tokens", i, 1)
    return _units_of(_tagged(spark, sf_dir), F.concat(t(2), convert.text_tokens(F.concat(F.lit("  "), "p_name", F.lit(" "))), t(4), t(5)))


@query(
    "segment_tagged_sentences",
    """SELECT CAST(p_partkey AS VARCHAR) AS file_id, CAST(k AS INTEGER) AS seg_ord, CASE k WHEN 1 THEN 'ignorable' ELSE 'segment' END AS kind, CASE k WHEN 0 THEN 'It <sc-7/>rained today.' WHEN 1 THEN ' ' ELSE p_name || '<ec-7/> again' END AS text FROM part, (SELECT unnest([0, 1, 2]) AS k)""",
)
def segment_tagged_sentences(spark, sf_dir):
    """A sentence ends inside formatting, which goes on in the next one."""
    t = lambda i: F.slice("tokens", i, 1)
    tokens = F.concat(convert.text_tokens(F.lit("It ")), t(2), convert.text_tokens(F.lit("rained today. ")), t(1), t(4), convert.text_tokens(F.lit(" again")))
    return _units_of(_tagged(spark, sf_dir), tokens)


# remarks as tables

_SQL_EVENTS = "SELECT CAST(user_id % 50 AS VARCHAR) AS file_id, CAST(event_id % 4 AS VARCHAR) AS segment_id, CAST(event_id AS VARCHAR) AS {0}, {1} FROM events"


def _events(spark, sf_dir, id_: str) -> DataFrame:
    null = F.lit(None).cast("string")
    e = D.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).cast("string").alias("file_id"), F.lit(1).alias("unit_ord"), F.col("event_id").cast("string").alias(id_), (F.col("event_id") % 4).cast("string").alias("segment_id"), null.alias("resolved_at"), null.alias("resolved_by"))


def _done(spark, sf_dir, id_: str) -> DataFrame:
    return _events(spark, sf_dir, id_).where(F.col(id_).cast("long") % 5 == 0).select("file_id", "segment_id", id_, F.lit("now").alias("resolved_at"), F.lit("me").alias("resolved_by"))


@query("comments_resolved", _SQL_EVENTS.format("note_id", "CASE event_id % 5 WHEN 0 THEN 'resolved' ELSE 'open' END AS state, CASE event_id % 5 WHEN 0 THEN 'me' END AS resolved_by"))
def comments_resolved(spark, sf_dir):
    notes = _events(spark, sf_dir, "note_id").withColumn("state", F.lit("open"))
    return review.resolve(notes, _done(spark, sf_dir, "note_id"), "note_id")[0].select("file_id", "segment_id", "note_id", "state", "resolved_by")


@query("issues_resolved", _SQL_EVENTS.format("issue_id", "event_id % 5 = 0 AS resolved, CASE event_id % 5 WHEN 0 THEN 'now' END AS resolved_at"))
def issues_resolved(spark, sf_dir):
    issues = _events(spark, sf_dir, "issue_id").withColumn("resolved", F.lit(False))
    return review.resolve(issues, _done(spark, sf_dir, "issue_id"), "issue_id")[0].select("file_id", "segment_id", "issue_id", "resolved", "resolved_at")


@query("issues_resolved_twice", "SELECT CAST(user_id % 50 AS VARCHAR) AS file_id, CAST(event_id % 4 AS VARCHAR) AS segment_id, CAST(event_id AS VARCHAR) AS issue_id, 'already resolved' AS reason FROM events WHERE event_id % 5 = 0")
def issues_resolved_twice(spark, sf_dir):
    issues, done = _events(spark, sf_dir, "issue_id").withColumn("resolved", F.lit(False)), _done(spark, sf_dir, "issue_id")
    return review.resolve(review.resolve(issues, done, "issue_id")[0], done, "issue_id")[1]


@query(
    "issues_added",
    "SELECT CAST(user_id % 50 AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS VARCHAR) AS issue_id, event_type AS type, false AS resolved FROM events",
)
def issues_added(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    new = e.select((F.col("user_id") % 50).cast("string").alias("file_id"), F.lit(1).alias("unit_ord"), F.lit("N/A").alias("segment_id"), F.col("event_type").alias("type"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("added_at"), F.col("user_id").cast("string").alias("added_by"))
    none = new.where("false").select("file_id", "unit_ord", F.lit("").alias("issue_id"), "segment_id", "type", "added_at", "added_by", F.lit(False).alias("resolved"))
    return review.add_issues(none, new).select("file_id", "issue_id", "type", "resolved")


@query("csv_import", "SELECT text AS source, '> ' || text AS target, 'imported' AS state FROM benchmark WHERE text <> ''")
def csv_import(spark, sf_dir):
    """Pairs written as CSV files in the shared folder and read back."""
    from ..sources.scratch import shared_path

    path = shared_path(spark, "csv")
    rows = D.table(spark, sf_dir, "benchmark").select(F.col("text").alias("source"), F.concat(F.lit("> "), "text").alias("target"))
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    return memory.from_csv(spark, path).select("source", "target", "state")


