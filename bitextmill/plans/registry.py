"""Named queries over the driver's tables, each with the DuckDB SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.similarity import diff_spans
from ..operators import analyze, fuzzy, memory, qa, review, segment
from . import fixtures as D
from . import formats
from .fixtures import SQL_LINES, SQL_PAIRS, SQL_QA_WORDS, SQL_WORDS, sql_could_reach, sql_memory, sql_ratios

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _line_id():
    return F.col("doc_id") * 100_000 + F.col("pos")


@query(
    "leverage_exact_report",
    f"""WITH {SQL_LINES}, seg AS (SELECT file, entry, len({SQL_WORDS.format('entry')}) AS words, row_number() OVER (PARTITION BY entry ORDER BY file, doc_id, pos) AS rn FROM lines WHERE doc_id % 2 = 1),
tm AS (SELECT DISTINCT entry AS e FROM lines WHERE doc_id % 2 = 0),
b AS (SELECT file, words, CASE WHEN rn > 1 THEN 'Repetitions' WHEN e IS NOT NULL THEN '100%' ELSE 'New' END AS band FROM seg LEFT JOIN tm ON entry = e)
SELECT coalesce(file, 'Total') AS file, CAST(coalesce(sum(words) FILTER (band = 'Repetitions'), 0) AS BIGINT) AS "Repetitions", CAST(coalesce(sum(words) FILTER (band = '100%'), 0) AS BIGINT) AS "100%",
CAST(coalesce(sum(words) FILTER (band = 'New'), 0) AS BIGINT) AS "New", CAST(sum(words) AS BIGINT) AS "Total" FROM b GROUP BY ROLLUP(file)""",
)
def leverage_exact_report(spark, sf_dir):
    return analyze.exact_report(D.project(spark, sf_dir), D.memory_lines(spark, sf_dir))


_SQL_ITEMS = "items AS (SELECT item_id, i - 1 AS pos, parts[i] AS entry FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT item_id, string_split(text, chr(10)) AS parts FROM benchmark)) WHERE trim(parts[i], ' ') <> '')"
_SQL_CANDIDATES = f"SELECT DISTINCT c.entry AS a, f.entry AS b FROM fresh f, (SELECT entry, NULL AS item_id, NULL AS pos FROM items WHERE item_id % 2 = 0 UNION ALL SELECT entry, item_id, pos FROM first) c WHERE (c.item_id IS NULL OR (c.item_id, c.pos) < (f.item_id, f.pos)) AND {sql_could_reach('c.entry', 'f.entry', 0.5)}"


@query(
    "leverage_report",
    f"""WITH RECURSIVE {_SQL_ITEMS}, occ AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY item_id, pos) AS rn, len({SQL_WORDS.format('entry')}) AS words FROM items WHERE item_id % 2 = 1),
first AS (SELECT * FROM occ WHERE rn = 1), fresh AS (SELECT * FROM first WHERE entry NOT IN (SELECT entry FROM items WHERE item_id % 2 = 0)), {sql_ratios(_SQL_CANDIDATES)},
best AS (SELECT b, max(ratio) AS ratio FROM ratios GROUP BY b),
c AS (SELECT words, CASE WHEN rn > 1 THEN 'Repetitions' WHEN entry IN (SELECT entry FROM items WHERE item_id % 2 = 0) THEN '100%' WHEN ratio >= 0.95 THEN '95%-99%' WHEN ratio >= 0.85 THEN '85%-94%' WHEN ratio >= 0.75 THEN '75%-84%' WHEN ratio >= 0.5 THEN '50%-74%' ELSE 'New' END AS band FROM occ LEFT JOIN best ON entry = b)
SELECT 'benchmark' AS file, """ + ", ".join(f"CAST(coalesce(sum(words) FILTER (band = '{b}'), 0) AS BIGINT) AS \"{b}\"" for b in analyze.COLUMNS) + """, CAST(sum(words) AS BIGINT) AS "Total" FROM c HAVING count(*) > 0""",
)
def leverage_report(spark, sf_dir):
    """The full report of the lines of odd benchmark items, with the lines of even items as the memory."""
    items = D.table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "entry"), "item_id").where(F.trim("entry") != "")
    segments = items.where("item_id % 2 = 1").select("file", "entry", F.struct("item_id", "pos").alias("ordinal"))
    return analyze.report(segments, items.where("item_id % 2 = 0").select("entry"))


@query("word_count_by_file", f"WITH {SQL_LINES} SELECT file, CAST(count(*) AS BIGINT) AS segments, CAST(sum(len({SQL_WORDS.format('entry')})) AS BIGINT) AS words FROM lines GROUP BY file")
def word_count_by_file(spark, sf_dir):
    return D.lines(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("segments"), F.sum(X.word_count(F.col("entry"))).alias("words"))


@query("repetitions", f"WITH {SQL_LINES} SELECT entry, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT file) AS BIGINT) AS files, min(doc_id * 100000 + pos) AS first_line FROM lines GROUP BY entry HAVING count(*) > 1")
def repetitions(spark, sf_dir):
    per = D.lines(spark, sf_dir).groupBy("entry", "file").agg(F.count(F.lit(1)).alias("n"), F.min(_line_id()).alias("first_line"))
    return per.groupBy("entry").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"), F.min("first_line").alias("first_line")).where("n > 1")


def _bucket():
    return F.col("line_id") / 100_000


def _batch(spark, sf_dir, part):
    return D.lines(spark, sf_dir).where(F.col("doc_id") % 2 == part).select(_line_id().alias("line_id"), F.col("entry").alias("source"), F.lower("entry").alias("target"), F.lit("draft").alias("state"), F.col("file").alias("submitted_by"))


_SQL_UPSERT = f"""WITH {SQL_LINES}, {sql_memory('tm', 0)}, batch AS (SELECT doc_id * 100000 + pos AS line_id, entry AS source, lower(entry) AS target, file AS submitted_by FROM lines WHERE doc_id % 2 = 1)
SELECT id, source, target, state, time, submitted_by FROM tm @
UNION ALL SELECT (SELECT max(id) FROM tm) + row_number() OVER (ORDER BY line_id), source, target, 'draft', NULL, submitted_by FROM batch"""


@query("tm_upsert", _SQL_UPSERT.replace("@", "WHERE source NOT IN (SELECT source FROM batch)"))
def tm_upsert(spark, sf_dir):
    return memory.upsert(D.memory(spark, sf_dir, 0), _batch(spark, sf_dir, 1), ["line_id"], F.floor(_bucket()))


@query("tm_append", _SQL_UPSERT.replace("@", ""))
def tm_append(spark, sf_dir):
    return memory.upsert(D.memory(spark, sf_dir, 0), _batch(spark, sf_dir, 1), ["line_id"], F.floor(_bucket()), overwrite=False)


@query("tm_delete", f"WITH {SQL_LINES}, {sql_memory('tm', 0)} SELECT * FROM tm WHERE id NOT IN (SELECT l_orderkey * 100000 FROM lineitem)")
def tm_delete(spark, sf_dir):
    ids = D.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100_000).alias("id")).distinct()
    return memory.remove(D.memory(spark, sf_dir, 0), ids)


@query("tm_slice", f"WITH {SQL_LINES}, {sql_memory('tm', 0)} SELECT * FROM tm ORDER BY id LIMIT 200 OFFSET 100")
def tm_slice(spark, sf_dir):
    return memory.entries(D.memory(spark, sf_dir, 0), 100, 300)


@query("tm_union_sources", f"WITH {SQL_LINES} SELECT entry AS source FROM lines WHERE doc_id % 2 = 0 UNION ALL SELECT entry FROM lines WHERE doc_id % 2 = 1")
def tm_union_sources(spark, sf_dir):
    return D.memory(spark, sf_dir, 0).select("source").unionByName(D.memory(spark, sf_dir, 1).select("source"))


@query("tm_migrate_legacy", "SELECT CAST(row_number() OVER (ORDER BY item_id) AS BIGINT) AS id, text AS source, '> ' || text AS target, CAST(NULL AS VARCHAR) AS state, CAST(item_id AS VARCHAR) AS time, 'legacy' AS submitted_by FROM benchmark")
def tm_migrate_legacy(spark, sf_dir):
    old = D.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"), F.concat(F.lit("> "), "text").alias("target"), F.col("item_id").cast("string").alias("time"), F.lit("legacy").alias("submitted_by"))
    return memory.migrate(old, ["item_id"], F.floor(F.col("item_id") / 1000))


@query("tm_import_filter", f"WITH {SQL_PAIRS} SELECT segment_id, source, target, 'imported' AS state FROM pairs WHERE source <> '' AND target <> ''")
def tm_import_filter(spark, sf_dir):
    return D.pairs(spark, sf_dir).where(X.both_sides(F.col("source"), F.col("target"))).select("segment_id", "source", "target", F.lit("imported").alias("state"))


@query("tm_exact_hits", f"WITH {SQL_LINES} SELECT doc_id * 100000 + pos AS query_id, entry FROM lines WHERE doc_id % 2 = 1 AND entry IN (SELECT entry FROM lines WHERE doc_id % 2 = 0)")
def tm_exact_hits(spark, sf_dir):
    queries = D.lines(spark, sf_dir).where("doc_id % 2 = 1").select(_line_id().alias("query_id"), "entry")
    return memory.exact_hits(queries, D.memory_lines(spark, sf_dir).select(F.col("entry").alias("source")))


@query("tm_latest_per_source", f"WITH {SQL_LINES} SELECT entry AS source, max(doc_id * 100000 + pos) AS id, arg_max('> ' || entry, doc_id * 100000 + pos) AS target FROM lines GROUP BY entry")
def tm_latest_per_source(spark, sf_dir):
    return D.lines(spark, sf_dir).groupBy(F.col("entry").alias("source")).agg(F.max(_line_id()).alias("id"), F.max_by(F.concat(F.lit("> "), "entry"), _line_id()).alias("target"))


@query("leverage_documents")
def leverage_documents(spark, sf_dir):
    """The full report of the lines of odd documents, one file a source, with the lines of even documents as the memory."""
    return analyze.report(D.project(spark, sf_dir), D.memory_lines(spark, sf_dir))


def _line_hits(spark, sf_dir, least):
    items = D.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "entry")).where(F.trim("entry") != "")
    queries = items.select((F.col("item_id") * 1000 + F.col("pos")).alias("query_id"), "entry")
    tm = D.lines(spark, sf_dir).groupBy(F.col("entry").alias("source")).agg(F.min(_line_id()).alias("id"))
    tm = tm.select("id", "source", F.concat(F.lit("> "), "source").alias("target"), F.lit("translated").alias("state"), F.lit(None).cast("string").alias("time"), F.lit("tm").alias("submitted_by"))
    return memory.lookup_segments(queries, tm, least)


@query("tm_fuzzy_lookup")
def tm_fuzzy_lookup(spark, sf_dir):
    """Every benchmark item's lines against a memory of all document lines, at the default threshold."""
    return _line_hits(spark, sf_dir, 0.5)


@query(
    "tm_fuzzy_hits",
    f"""WITH RECURSIVE {_SQL_ITEMS}, {SQL_LINES}, tm AS (SELECT min(doc_id * 100000 + pos) AS id, entry AS source FROM lines GROUP BY entry), q AS (SELECT item_id * 1000 + pos AS query_id, entry FROM items),
{sql_ratios("SELECT DISTINCT source AS a, entry AS b FROM tm, q WHERE 2 * least(length(source), length(entry)) >= 0.9 * (length(source) + length(entry)) AND " + sql_could_reach('source', 'entry', 0.9))}
SELECT query_id, id, round(ratio, 9) AS ratio, source FROM ratios JOIN tm ON a = source JOIN q ON b = entry WHERE ratio >= 0.9""",
)
def tm_fuzzy_hits(spark, sf_dir):
    """The hits at a threshold of 0.9 without the differences, which SQL cannot tell."""
    return _line_hits(spark, sf_dir, 0.9).select("query_id", "id", F.round("ratio", 9).alias("ratio"), "source")


@query("tm_diff_spans")
def tm_diff_spans(spark, sf_dir):
    parts = D.table(spark, sf_dir, "part")
    return parts.select("p_partkey", diff_spans(F.col("p_type"), F.col("p_name")).alias("diff"))


@query(
    "fuzzy_part_names",
    f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name AS p FROM part), {sql_ratios("SELECT x.p AS a, y.p AS b FROM names x, names y WHERE x.p <> y.p AND " + sql_could_reach('x.p', 'y.p', 0.85))}
SELECT b AS q, a AS c, round(ratio, 9) AS ratio FROM ratios WHERE ratio >= 0.85""",
)
def fuzzy_part_names(spark, sf_dir):
    """Pairs of different part names with a similarity of 0.85."""
    names = D.table(spark, sf_dir, "part").select("p_name").distinct()
    queries, candidates = names.select(F.col("p_name").alias("q")), names.select(F.col("p_name").alias("c"))
    return fuzzy.fuzzy_join(queries, candidates, "q", "c", 0.85).where("q <> c").withColumn("ratio", F.round("ratio", 9))


@query(
    "term_lookup",
    f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name AS source FROM part), tw AS (SELECT source, unnest({SQL_WORDS.format('lower(source)')}) AS word FROM names),
asked_words AS (SELECT DISTINCT item_id AS query_id, unnest({SQL_WORDS.format("lower(regexp_replace(text, '<[^<>]+>', ' ', 'g'))")}) AS word FROM benchmark),
{sql_ratios("SELECT DISTINCT q.word AS a, t.word AS b FROM asked_words q, tw t")},
best AS (SELECT query_id, b AS word, max(ratio) AS best FROM asked_words JOIN ratios ON a = word GROUP BY query_id, b),
s AS (SELECT query_id, source, sum(length(word) * best) / sum(length(word)) AS score FROM tw JOIN best USING (word) GROUP BY query_id, source)
SELECT query_id, round(score, 9) AS score, source, '> ' || source AS target, 'approved' AS state, CAST(NULL AS VARCHAR) AS time, 'tb' AS submitted_by FROM s WHERE score >= 0.5""",
)
def term_lookup(spark, sf_dir):
    queries = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("entry"))
    parts = D.table(spark, sf_dir, "part")
    terms = parts.select(F.col("p_name").alias("source")).distinct().select(F.xxhash64("source").alias("id"), "source", F.concat(F.lit("> "), "source").alias("target"), F.lit("approved").alias("state"), F.lit(None).cast("string").alias("time"), F.lit("tb").alias("submitted_by"))
    return memory.lookup_terms(queries, terms, 0.5).withColumn("score", F.round("score", 9))


@query("term_lookup_ranks", f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, target) AS INTEGER) AS rank FROM ({ORACLE_SQL['term_lookup']})")
def term_lookup_ranks(spark, sf_dir):
    """The same hits with their places: best first, then by source."""
    return memory.ranked_terms(term_lookup(spark, sf_dir))


@query(
    "term_exact_hits",
    f"""WITH terms AS (SELECT item_id AS id, list_distinct({SQL_WORDS.format("lower(text)")}) AS words FROM benchmark), each AS (SELECT id, len(words) AS need, unnest(words) AS word FROM terms WHERE len(words) > 0),
asked AS (SELECT DISTINCT doc_id AS query_id, unnest({SQL_WORDS.format("lower(regexp_replace(text, '<[^<>]+>', ' ', 'g'))")}) AS word FROM documents)
SELECT query_id, id FROM asked JOIN each USING (word) GROUP BY query_id, id, need HAVING count(*) = need""",
)
def term_exact_hits(spark, sf_dir):
    queries = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("entry"))
    terms = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("source"))
    return memory.exact_terms(queries, terms)


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("entry_normalize", f"SELECT page_id, {_ESC.format('html')} AS entry FROM pages UNION ALL SELECT -1 - doc_id, {_ESC.format('text')} FROM documents")
def entry_normalize(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").select("page_id", X.html_escape(F.col("html")).alias("entry"))
    return pages.unionByName(D.table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("page_id"), X.html_escape(F.col("text")).alias("entry")))


@query("entry_round_trip", "SELECT page_id, html AS entry FROM pages")
def entry_round_trip(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", X.html_unescape_basic(X.html_escape(F.col("html"))).alias("entry"))


@query("strip_tags", f"SELECT page_id, regexp_replace(html, '<[^<>]+>', ' ', 'g') AS text, CAST(len({SQL_WORDS.format(chr(114) + 'egexp_replace(html, ' + chr(39) + '<[^<>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS BIGINT) AS words FROM pages")
def strip_tags(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").withColumn("text", X.strip_tags(F.col("html")))
    return pages.select("page_id", "text", X.word_count(F.col("text")).alias("words"))


_SQL_SENTENCES = "string_split(replace(regexp_replace(regexp_replace({0}, '(\\s+|^)(\\p{{Lu}}\\p{{L}}{{0,3}})(\\.+)(\\s+|$)', '\\1\\2\\3' || chr(57344) || '\\4', 'g'), '(\\s+|^)(\\p{{L}}+)([.!?:]+)(\\s+)', '\\1\\2\\3' || chr(57345), 'g'), chr(57344), ''), chr(57345))"


@query("sentence_split", f"SELECT doc_id, CAST(i AS INTEGER) AS seg, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {_SQL_SENTENCES.format('text')} AS parts FROM documents))")
def sentence_split(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.sentences(F.col("text"))).alias("seg", "sentence"))
    return docs.select("doc_id", (F.col("seg") + 1).alias("seg"), "sentence")


@query("sentence_count_by_lang", f"SELECT lang, CAST(sum(len({_SQL_SENTENCES.format('text')})) AS BIGINT) AS sentences FROM documents GROUP BY lang")
def sentence_count_by_lang(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(segment.sentences(F.col("text")))).alias("sentences"))


@query(
    "segment_numbers",
    f"WITH {SQL_LINES} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR) AS segment_id FROM lines",
)
def segment_numbers(spark, sf_dir):
    rows = D.lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_id"), "doc_id", F.col("pos").alias("unit_ord"), F.lit(0).alias("seg_ord"), F.lit("segment").alias("kind"))
    return segment.numbered(rows).select("doc_id", F.col("unit_ord").alias("pos"), "segment_id")


@query("peel_whitespace", "SELECT conv_id, turn, regexp_extract('  ' || text || ' ', '^(\\s*)', 1) AS head, regexp_replace(regexp_replace('  ' || text || ' ', '^\\s+', ''), '\\s+$', '') AS body, CASE WHEN regexp_matches(text, '\\S') THEN regexp_extract(text || ' ', '(\\s*)$', 1) ELSE '' END AS tail FROM conversations")
def peel_whitespace(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations").withColumn("p", segment.text_parts(F.concat(F.lit("  "), "text", F.lit(" "))))
    return turns.select("conv_id", "turn", "p.head", "p.body", "p.tail")


@query("txt_units", "SELECT doc_id, CAST(i AS INTEGER) AS unit_ord, parts[i] || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END AS source, CASE WHEN trim(parts[i], ' ') = '' THEN 'ignorable' ELSE 'segment' END AS kind FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE i < len(parts) OR parts[i] <> ''")
def txt_units(spark, sf_dir):
    from ..sources.documents import text_units

    docs = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_units(docs, "doc_id", "text")


@query("txt_rebuild", "SELECT doc_id, text FROM documents")
def txt_rebuild(spark, sf_dir):
    from ..sources.documents import rebuilt_text, text_units

    docs = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    # each row is a document of its own, whatever its id; null and empty texts have no units
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc"), "text")
    units = text_units(rows, "doc", "text").withColumn("target", F.lit(None).cast("string"))
    return rebuilt_text(units, "doc").select("doc.doc_id", "text").unionByName(docs.where("text is null or text = ''"))


@query(
    "json_group_consecutive",
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
SELECT user_id, event_type, min(event_id) AS first_event, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY event_id) AS ks FROM e GROUP BY user_id, event_type, island""",
)
def json_group_consecutive(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("event_id")
    events = D.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    events = events.withColumn("_new", F.when(F.lag("event_type").over(order) == F.col("event_type"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "k"))), lambda x: x["k"]), ",")
    return events.groupBy("user_id", "event_type", "_island").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n"), listed.alias("ks")).drop("_island")


@query("can_process", "SELECT page_id, regexp_matches(lower(url), '\\.(docx|json|kxliff|odp|ods|odt|po|sdlxliff|txt|xliff)$') AS ok FROM pages UNION ALL SELECT p_partkey + 1000000, regexp_matches(lower(p_name || '.' || (CASE p_size % 3 WHEN 0 THEN 'DOCX' WHEN 1 THEN 'txt' ELSE 'pdf' END)), '\\.(docx|json|kxliff|odp|ods|odt|po|sdlxliff|txt|xliff)$') FROM part")
def can_process(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").select("page_id", X.can_process(F.col("url")).alias("ok"))
    name = F.concat("p_name", F.lit("."), F.when(F.col("p_size") % 3 == 0, "DOCX").when(F.col("p_size") % 3 == 1, "txt").otherwise("pdf"))
    return pages.unionByName(D.table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000).alias("page_id"), X.can_process(name).alias("ok")))


@query("qa_letters", "SELECT DISTINCT lang, letter FROM (SELECT lang, unnest(list_distinct(string_split(text, ''))) AS letter FROM documents) WHERE regexp_full_match(letter, '\\p{L}')")
def qa_letters(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    return docs.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("letter")).distinct().where(F.col("letter").rlike(r"^\p{L}$"))


_SQL_MODEL = f"model AS (SELECT word, count(*) AS count FROM (SELECT unnest({SQL_QA_WORDS.format('text')}) AS word FROM documents) GROUP BY word)"


@query("qa_word_counts", f"WITH {_SQL_MODEL} SELECT * FROM model")
def qa_word_counts(spark, sf_dir):
    return qa.word_model(D.table(spark, sf_dir, "documents"))


@query("qa_word_prob", f"WITH {_SQL_MODEL} SELECT word, count, round(count / (SELECT sum(count) FROM model), 12) AS share FROM model")
def qa_word_prob(spark, sf_dir):
    return qa.shares(qa.word_model(D.table(spark, sf_dir, "documents"))).withColumn("share", F.round("share", 12))


_SQL_CAPITAL = "(lower(substr(source, 1, 1)) = substr(source, 1, 1)) <> (lower(substr(target, 1, 1)) = substr(target, 1, 1))"
_SQL_MARKS = "regexp_extract(source, '([.!?:]+)\\n?$', 1) <> regexp_extract(target, '([.!?:]+)\\n?$', 1)"


_SQL_NEXT = f"{SQL_LINES}, nxt AS (SELECT doc_id, pos, entry AS source, lead(entry) OVER (PARTITION BY doc_id ORDER BY pos) AS target FROM lines)"


def _next_lines(spark, sf_dir):
    """Lines and the lines after them, as pairs that often differ."""
    after = F.lead("entry").over(Window.partitionBy("doc_id").orderBy("pos"))
    return D.lines(spark, sf_dir).select("doc_id", "pos", F.col("entry").alias("source"), after.alias("target")).where(X.both_sides(F.col("source"), F.col("target")))


@query("qa_capitalization", f"WITH {_SQL_NEXT} SELECT doc_id, pos FROM nxt WHERE source <> '' AND target <> '' AND {_SQL_CAPITAL}")
def qa_capitalization(spark, sf_dir):
    return _next_lines(spark, sf_dir).where(X.capital_mismatch(F.col("source"), F.col("target"))).select("doc_id", "pos")


@query("qa_punctuation", f"WITH {_SQL_NEXT} SELECT doc_id, pos, regexp_extract(source, '([.!?:]+)\\n?$', 1) AS source_marks, regexp_extract(target, '([.!?:]+)\\n?$', 1) AS target_marks FROM nxt WHERE source <> '' AND target <> '' AND {_SQL_MARKS}")
def qa_punctuation(spark, sf_dir):
    rows = _next_lines(spark, sf_dir).select("doc_id", "pos", X.closing_marks(F.col("source")).alias("source_marks"), X.closing_marks(F.col("target")).alias("target_marks"))
    return rows.where("source_marks <> target_marks")


@query("qa_untranslated", f"WITH {SQL_PAIRS} SELECT segment_id FROM pairs WHERE source <> '' AND target = ''")
def qa_untranslated(spark, sf_dir):
    return D.pairs(spark, sf_dir).where(~X.is_blank(F.col("source")) & X.is_blank(F.col("target"))).select("segment_id")


@query(
    "qa_check",
    f"""WITH {SQL_PAIRS} SELECT segment_id, CASE WHEN target = '' THEN 'untranslated' ELSE concat_ws(',', CASE WHEN {_SQL_CAPITAL} THEN 'capitalization' END, CASE WHEN {_SQL_MARKS} THEN 'punctuation' END) END AS findings
FROM pairs WHERE source <> ''""",
)
def qa_check(spark, sf_dir):
    found = qa.check(D.pairs(spark, sf_dir))
    return found.select("segment_id", F.array_join(F.transform("findings", lambda f: f["type"]), ",").alias("findings"))


_SQL_UNKNOWN = f"""bm AS (SELECT DISTINCT unnest({SQL_QA_WORDS.format('text')}) AS word FROM benchmark),
bmc AS (SELECT word, count(*) AS count FROM (SELECT unnest({SQL_QA_WORDS.format('text')}) AS word FROM benchmark) GROUP BY word)"""


@query("qa_unknown_words", f"WITH {SQL_PAIRS}, {_SQL_UNKNOWN}, w AS (SELECT segment_id, unnest({SQL_QA_WORDS.format('target')}) AS word FROM pairs) SELECT segment_id, word, CAST(count(*) AS BIGINT) AS n FROM w WHERE word NOT IN (SELECT word FROM bm) GROUP BY ALL")
def qa_unknown_words(spark, sf_dir):
    model = qa.word_model(D.table(spark, sf_dir, "benchmark"))
    return qa.unknown_words(D.pairs(spark, sf_dir), model, ["segment_id"], "target").groupBy("segment_id", "word").agg(F.count(F.lit(1)).alias("n"))


_SQL_SIGNS = "(length(b) - length(replace(b, '''', ''))) <= (length(a) - length(replace(a, '''', ''))) AND (length(b) - length(replace(b, '-', ''))) <= (length(a) - length(replace(a, '-', '')))"


#: One character put in, left out, changed or swapped with the next. DuckDB's own distances count bytes.
_SQL_DROPPED = "len(list_filter(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1) = {1})) > 0"
_SQL_APART = "list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(word, i, 1))"
_SQL_ONE_EDIT = f"""CASE WHEN length(a) = length(word) + 1 THEN {_SQL_DROPPED.format('a', 'word')} WHEN length(a) + 1 = length(word) THEN {_SQL_DROPPED.format('word', 'a')}
ELSE len({_SQL_APART}) <= 1 OR (len({_SQL_APART}) = 2 AND {_SQL_APART}[2] = {_SQL_APART}[1] + 1 AND substr(a, {_SQL_APART}[1], 1) = substr(word, {_SQL_APART}[2], 1) AND substr(a, {_SQL_APART}[2], 1) = substr(word, {_SQL_APART}[1], 1)) END"""


@query(
    "qa_corrections",
    f"""WITH {SQL_PAIRS}, {_SQL_UNKNOWN}, u AS (SELECT DISTINCT a FROM (SELECT unnest({SQL_QA_WORDS.format('source')}) AS a FROM pairs) WHERE a NOT IN (SELECT word FROM bm)),
c AS (SELECT a, word AS b, count FROM u JOIN bmc ON abs(length(a) - length(word)) <= 1 AND damerau_levenshtein(a, word) <= 6 AND {_SQL_ONE_EDIT}),
r AS (SELECT a AS word, b AS candidate, round(count / (SELECT sum(count) FROM bmc), 12) AS share, row_number() OVER (PARTITION BY a ORDER BY count DESC, b) AS place FROM c WHERE {_SQL_SIGNS})
SELECT word, CAST(place AS BIGINT) AS place, candidate, share FROM r WHERE place <= 5""",
)
def qa_corrections(spark, sf_dir):
    model = qa.word_model(D.table(spark, sf_dir, "benchmark"))
    unknown = qa.unknown_words(D.pairs(spark, sf_dir), model, ["segment_id"], "source")
    found = qa.candidates(unknown, model)
    return qa.ranked_corrections(found).withColumn("share", F.round("share", 12))


@query("qa_check_spelling")
def qa_check_spelling(spark, sf_dir):
    return qa.check(D.pairs(spark, sf_dir), qa.word_model(D.table(spark, sf_dir, "benchmark")))


def _segments(spark, sf_dir):
    """Conversations as a file of segments: one a turn, every fifth locked, states by role."""
    turns = D.table(spark, sf_dir, "conversations")
    null = F.lit(None).cast("string")
    return turns.select(
        F.col("conv_id").cast("string").alias("file_id"), F.lit(1).alias("unit_ord"), F.col("turn").cast("int").alias("seg_ord"), F.col("turn").cast("string").alias("segment_id"), F.when(F.col("role") == "system", "ignorable").otherwise("segment").alias("kind"),
        F.col("text").alias("source"), F.concat(F.lit("> "), "text").alias("target"), F.when(F.col("role") == "user", "reviewed").otherwise("translated").alias("state"), null.alias("sub_state"), (F.col("turn") % 5 == 4).alias("locked"), null.alias("modified_on"), null.alias("modified_by"),
    )


@query(
    "state_encode",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'translated' WHEN 'assistant' THEN 'initial' END AS state, CASE role WHEN 'user' THEN 'translated' WHEN 'assistant' THEN 'initial-draft' END AS sub_state,
CASE role WHEN 'user' THEN 'translated' ELSE 'x-' || CASE role WHEN 'assistant' THEN 'draft' ELSE 'other' END END AS v1 FROM conversations""",
)
def state_encode(spark, sf_dir):
    state = F.when(F.col("role") == "user", "translated").when(F.col("role") == "assistant", "draft").otherwise("other")
    turns = D.table(spark, sf_dir, "conversations").withColumn("_v2", X.encoded_state("v2", state)).withColumn("_v1", X.encoded_state("v1", state))
    return turns.select("conv_id", "turn", "_v2.state", "_v2.sub_state", F.col("_v1.state").alias("v1"))


@query("state_decode", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'initial-draft' ELSE 'translated' END AS state, turn % 3 = 0 AS locked FROM conversations")
def state_decode(spark, sf_dir):
    plain = F.when(F.col("turn") % 2 == 0, "initial-draft").otherwise("translated")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(plain, F.lit("-locked"))).otherwise(plain)
    turns = D.table(spark, sf_dir, "conversations").withColumn("_s", X.decoded_state("v2", F.lit(None).cast("string"), raw))
    return turns.select("conv_id", "turn", "_s.state", "_s.locked")


@query("lock_toggle", "SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS VARCHAR) AS segment_id, CASE WHEN role = 'assistant' THEN true ELSE turn % 5 = 4 END AS locked FROM conversations")
def lock_toggle(spark, sf_dir):
    locks = D.table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("string").alias("segment_id"), F.lit(True).alias("locked"))
    return review.set_locks(_segments(spark, sf_dir), locks).select("file_id", "segment_id", "locked")


def _edits(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations").where("turn % 2 = 0")
    return turns.select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("string").alias("segment_id"), F.lower("text").alias("target"), F.lit("translated").alias("state"), F.lit("editor").alias("submitted_by"), F.lit("2024-01-01T00:00:00").alias("at"))


@query(
    "update_segments",
    "SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS VARCHAR) AS segment_id, CASE WHEN turn % 2 = 0 AND turn % 5 <> 4 THEN lower(text) ELSE '> ' || text END AS target, CASE WHEN turn % 2 = 0 AND turn % 5 <> 4 THEN 'translated' WHEN role = 'user' THEN 'reviewed' ELSE 'translated' END AS state, CASE WHEN turn % 2 = 0 AND turn % 5 <> 4 THEN 'editor' END AS modified_by FROM conversations",
)
def update_segments(spark, sf_dir):
    return review.update_segments(_segments(spark, sf_dir), _edits(spark, sf_dir))[0].select("file_id", "segment_id", "target", "state", "modified_by")


@query("update_errors", "SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS VARCHAR) AS segment_id, 'segment is locked' AS reason FROM conversations WHERE turn % 2 = 0 AND turn % 5 = 4")
def update_errors(spark, sf_dir):
    return review.update_segments(_segments(spark, sf_dir), _edits(spark, sf_dir))[1]


def _history(spark, sf_dir):
    """Two versions of every turn of a user."""
    base = _segments(spark, sf_dir).where("state = 'reviewed'")
    versions = base.withColumn("version_ord", F.explode(F.array(F.lit(1), F.lit(2))))
    return versions.select("file_id", "unit_ord", "segment_id", "version_ord", F.concat("target", F.col("version_ord").cast("string")).alias("target"), F.lit("translated").alias("state"), "modified_on", "modified_by")


@query(
    "history_append",
    """WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS VARCHAR) AS segment_id, v AS version_ord, '> ' || text || v AS target FROM conversations, (SELECT unnest([1, 2]) AS v) WHERE role = 'user')
SELECT * FROM h UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), CASE WHEN role = 'user' THEN 3 ELSE 1 END, '> ' || text FROM conversations WHERE turn % 2 = 0 AND turn % 5 <> 4 AND text <> ''""",
)
def history_append(spark, sf_dir):
    return review.append_history(_history(spark, sf_dir), _segments(spark, sf_dir), _edits(spark, sf_dir)).select("file_id", "segment_id", "version_ord", "target")


@query("segment_history", "SELECT v AS version_ord, '> ' || text || v AS target FROM conversations, (SELECT unnest([1, 2]) AS v) WHERE role = 'user' AND conv_id = 1 AND turn = 2")
def segment_history(spark, sf_dir):
    return review.segment_history(_history(spark, sf_dir), "1", "2").select("version_ord", "target")


def _issues(spark, sf_dir):
    """Events as quality issues of the conversations' segments; every third is resolved."""
    e = D.table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 50).cast("string").alias("file_id"), F.lit(1).alias("unit_ord"), F.col("event_id").cast("string").alias("issue_id"), (F.col("event_id") % 4).cast("string").alias("segment_id"), F.col("event_type").alias("type"), F.col("props").alias("comment"), F.lit("minor").alias("severity"),
        F.date_format("ts", X.ISO).alias("added_at"), F.col("user_id").cast("string").alias("added_by"), (F.col("event_id") % 3 == 0).alias("resolved"), F.lit(None).cast("string").alias("resolved_at"), F.lit(None).cast("string").alias("resolved_by"),
    )


@query(
    "lqi_report",
    """WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS VARCHAR) AS segment_id, text AS source, '> ' || text AS target, role FROM conversations WHERE role <> 'system'),
i AS (SELECT CAST(user_id % 50 AS VARCHAR) AS file_id, CAST(event_id % 4 AS VARCHAR) AS segment_id, CAST(count(*) AS INTEGER) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
SELECT s.file_id, s.segment_id, source, CASE WHEN role = 'user' THEN target || '2' ELSE target END AS translation, CASE WHEN role = 'user' THEN target END AS edited, coalesce(n, 0) AS issues FROM s LEFT JOIN i ON s.file_id = i.file_id AND s.segment_id = i.segment_id""",
)
def lqi_report(spark, sf_dir):
    rows = review.issue_report(_segments(spark, sf_dir), _history(spark, sf_dir), _issues(spark, sf_dir))
    return rows.withColumn("issues", F.coalesce(F.size("issues"), F.lit(0))).withColumn("issues", F.greatest("issues", F.lit(0)))


@query("segment_issues", "SELECT CAST(event_id AS VARCHAR) AS issue_id, event_type AS type FROM events WHERE user_id % 50 = 3 AND event_id % 4 = 1 AND event_id % 3 <> 0")
def segment_issues(spark, sf_dir):
    return review.segment_issues(_issues(spark, sf_dir), "3", "1").select("issue_id", "type")


@query(
    "segment_comments",
    """WITH n AS (SELECT CAST(user_id % 50 AS VARCHAR) AS file_id, CAST(event_id % 4 AS VARCHAR) AS segment_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), CAST(event_id AS VARCHAR)) AS ids FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS VARCHAR) AS segment_id, ids FROM conversations LEFT JOIN n ON CAST(conv_id AS VARCHAR) = n.file_id AND CAST(turn AS VARCHAR) = n.segment_id""",
)
def segment_comments(spark, sf_dir):
    issues = _issues(spark, sf_dir)
    notes = issues.select("file_id", "unit_ord", F.col("issue_id").alias("note_id"), "segment_id", F.lit("closed").alias("state"), F.col("comment").alias("text"), "added_at", "added_by")
    rows = review.with_remarks(_segments(spark, sf_dir), notes, issues)
    return rows.select("file_id", "segment_id", F.array_join(F.transform("remarks", lambda r: r["id"]), ",").alias("ids"))


@query("comments_numbered", "SELECT CAST(user_id % 50 AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id) AS VARCHAR) AS note_id, props AS text FROM events")
def comments_numbered(spark, sf_dir):
    new = D.table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("file_id"), F.lit(1).alias("unit_ord"), F.col("event_id").alias("segment_id"), F.col("props").alias("text"), F.date_format("ts", X.ISO).alias("added_at"), F.col("user_id").cast("string").alias("added_by"))
    empty = new.where("false").select("file_id", "unit_ord", F.lit("").alias("note_id"), "segment_id", F.lit("").alias("state"), "text", "added_at", "added_by")
    return review.add_comments(empty, new).select("file_id", "note_id", "text")


@query(
    "merge_segments",
    """WITH g AS (SELECT conv_id FROM conversations WHERE turn IN (1, 2) GROUP BY conv_id HAVING count(*) = 2 AND count(*) FILTER (role = 'system') = 0)
SELECT CAST(c.conv_id AS VARCHAR) AS file_id, CAST(turn AS VARCHAR) AS segment_id, CASE WHEN turn = 1 AND g.conv_id IS NOT NULL THEN text || (SELECT text FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = 2) ELSE text END AS source FROM conversations c LEFT JOIN g USING (conv_id) WHERE g.conv_id IS NULL OR turn <> 2""",
)
def merge_segments(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    groups = rows.where("segment_id in ('1', '2') and kind = 'segment'").select(F.col("file_id").alias("merge_id"), "file_id", "segment_id")
    return review.merge_segments(rows, groups)[0].select("file_id", "segment_id", "source")


@query("version_order", "SELECT p_partkey, p_size > 9 AS newer FROM part")
def version_order(spark, sf_dir):
    parts = D.table(spark, sf_dir, "part")
    return parts.select("p_partkey", (X.version(F.concat(F.lit("0."), F.col("p_size").cast("string"), F.lit(".0-beta"))) > X.version(F.lit("0.9.5"))).alias("newer"))


@query("time_formats", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%dT%H%M%SZ') AS tmx, strftime(ts, '%m/%d/%Y %H:%M:%S') AS sdl FROM events")
def time_formats(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    return events.select("event_id", *(X.formatted_time(F.col("ts"), p).alias(n) for n, p in (("iso", X.ISO), ("tmx", X.TMX_TIME), ("sdl", X.SDL_TIME))))


@query("language_catalogue", "SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish; Castilian' END AS name FROM documents")
def language_catalogue(spark, sf_dir):
    from ..sources.languages import languages

    langs = D.table(spark, sf_dir, "documents").select("lang").distinct()
    return langs.join(languages(spark), langs["lang"] == F.col("code"), "left").select("lang", "name")


@query("legacy_quotes", "SELECT doc_id, replace(text, '\"', '\"\"') AS text FROM documents")
def legacy_quotes(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", X.legacy_quotes(F.col("text")).alias("text"))


QUERIES |= formats.QUERIES
ORACLE_SQL |= formats.ORACLE_SQL
