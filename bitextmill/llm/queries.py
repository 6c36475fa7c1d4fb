"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, decontamination, divergence, line_crf, lm_scoring, near_dedup, packing, pii, prefix_trie, quality_rules, sharding, token_files, toxicity
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), per_cent=85)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op1_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can tell: counts and the base score, rounded."""
    base = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    return op1_lm_scoring(spark, sf_dir).select(*base, F.round("base_score", 6).alias("base_score"))


def op7_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can tell: all but the verdict of the estimates."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op9_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can tell: the counts of base spans."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_dedup": op4_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_files": op13_token_files,
    "op1_base": op1_base,
    "op7_base": op7_base,
    "op9_base": op9_base,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"
#: crc32 of an id as text, bit by bit.
_CRC_OF = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_CRC = _CRC_OF.format("doc_id")
_TERMS = "regexp_extract_all(" + _LOWER.replace("text", "coalesce(text, '')") + ", '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''),
lambda ch, i: CASE WHEN i % 2 = 1 THEN CAST(ch AS INTEGER) ELSE 2 * CAST(ch AS INTEGER) - CASE WHEN CAST(ch AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

ORACLE_SQL: dict[str, str] = {
    "op1_base": f"""WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, list_append({_WORDS.format(_LOWER)}, '') AS words FROM documents),
w AS (SELECT doc_id, held_out, unnest(words) AS word FROM d), c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score
FROM w LEFT JOIN c USING (word), s GROUP BY doc_id, held_out""",
    # all pairs of texts that share a shingle, and the smallest id that links reach
    "op4_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) AS sh FROM w WHERE len(words) > 0),
g AS (SELECT min(doc_id) AS rep, sh FROM s GROUP BY sh), e AS (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM g),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT rep AS id, rep AS top FROM g UNION SELECT p.b, r.top FROM r JOIN p ON p.a = r.id), l AS (SELECT id, min(top) AS top FROM r GROUP BY id),
m AS (SELECT s.doc_id, l.top AS component_id FROM s JOIN g ON s.sh = g.sh JOIN l ON l.id = g.rep)
SELECT w.doc_id, CAST(coalesce(len(s.sh), 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN s ON w.doc_id = s.doc_id LEFT JOIN m ON w.doc_id = m.doc_id""",
    "op7_base": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS words FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) > 2), k AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS x FROM t),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM k), rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM q, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
coalesce(rep.n, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(words) AS base_failed FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)""",
    "op9_base": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: TRY_CAST(p AS DOUBLE) > 255)) = 0)) AS BIGINT) AS n_ip,
CAST(len(list_filter(regexp_extract_all(text, '[0-9]([\\x20-]?[0-9])+'), lambda x: {_LUHN})) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(text, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM d""",
    # every node by its whole list of turns, and every subtree by the nodes that begin with its list
    "op11_prefix_trie": f"""WITH t AS (SELECT conv_id, concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS x, CAST(length(coalesce(text, '')) AS BIGINT) AS n, turn FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, x, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(x)) AS p FROM t),
c AS (SELECT conv_id, CASE WHEN conv_id % 100 = 0 THEN 0 ELSE h END AS h FROM (SELECT conv_id, {_CRC_OF.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM p))),
r AS (SELECT c.conv_id, 0 AS own, p.p, p.x, p.n FROM c JOIN p ON p.conv_id = c.conv_id - c.conv_id % 100 AND p.p <= c.h UNION ALL SELECT c.conv_id, 1, p.p, p.x, p.n FROM c JOIN p ON p.conv_id = c.conv_id AND p.p > c.h),
s AS (SELECT c.conv_id, list(x ORDER BY own, p) FILTER (WHERE x IS NOT NULL) AS xs, list(n ORDER BY own, p) FILTER (WHERE x IS NOT NULL) AS ns FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, unnest(range(0, coalesce(len(xs), 0) + 1)) AS d, coalesce(xs, []) AS xs, ns FROM s),
k AS (SELECT xs[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(ns[d]), 0) AS saved, max(len(xs)) = d AS leaf, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(xs) = d), '')) AS ends FROM m GROUP BY xs[1:d], d),
u AS (SELECT path[1:a] AS path, count(*) FILTER (WHERE a = d - 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved FROM (SELECT path, d, saved, leaf, unnest(range(0, d + 1)) AS a FROM k) GROUP BY path[1:a])
SELECT k.conv_id, k.d AS depth, CASE WHEN k.d > 0 THEN o.conv_id END AS parent_conv_id, k.n_convs, u.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN u USING (path) LEFT JOIN k o ON o.path = k.path[1:k.d - 1] AND o.d = k.d - 1""",
    # every group with every kept term, absent ones too
    "op12_source_divergence": f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS words FROM documents), w AS (SELECT doc, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10), v AS (SELECT lang, count(*) AS v, sum(total) AS m FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS cnt FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term), g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(cnt), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
s AS (SELECT n.lang, n.source, kept.term, coalesce(cnt, 0) AS cnt, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(cnt, 0) + 2) // (n + 2 * v) AS BIGINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (m + 2 * v) AS BIGINT) AS q
FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s WHERE cnt > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM o) SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10""",
}
