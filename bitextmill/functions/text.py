"""Scalar text functions as Column expressions: normal forms, words, states, mismatches. No Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTML escapes, the ampersand first: fixed values.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
#: File types that can be turned into bilingual files: fixed values.
PROCESSABLE = ("docx", "json", "kxliff", "odp", "ods", "odt", "po", "sdlxliff", "txt", "xliff")
#: Word characters of the checker, and what counts as a word: fixed patterns.
NOT_WORD = r"(?U)[^\p{L}\p{N}\s'-]"
WORD = r"^[\p{L}'-]+$"
#: Leverage bands and their lower bounds: fixed values.
BANDS = (("95%-99%", 0.95), ("85%-94%", 0.85), ("75%-84%", 0.75), ("50%-74%", 0.5))


def can_process(path: Column) -> Column:
    """Whether the file name has one of the known endings."""
    return F.lower(path).rlike(rf"\.({'|'.join(PROCESSABLE)})$")


def html_escape(c: Column) -> Column:
    for plain, escaped in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def html_unescape_basic(c: Column) -> Column:
    """Inverse of ``html_escape``; other named entities stay as they are."""
    for plain, escaped in reversed(ESCAPES):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^<>]+>", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def both_sides(source: Column, target: Column) -> Column:
    """Rows that a memory takes: neither side empty."""
    return ~is_blank(source) & ~is_blank(target)


def qa_words(c: Column) -> Column:
    """The checker's words: over one character, letters, apostrophes and hyphens only."""
    cleaned = F.split(F.regexp_replace(c, NOT_WORD, ""), r"(?U)\s+")
    return F.filter(cleaned, lambda w: (F.length(w) > 1) & w.rlike(WORD))


def capital_mismatch(source: Column, target: Column) -> Column:
    """One side starts in lower case (or without case), the other does not."""
    low = lambda c: F.lower(F.substring(c, 1, 1)) == F.substring(c, 1, 1)
    return low(source) != low(target)


def closing_marks(c: Column) -> Column:
    """The run of closing marks at the end, empty if there is none."""
    return F.regexp_extract(c, r"([.!?:]+)\n?\z", 1)


def band(ratio: Column) -> Column:
    """Leverage band of a similarity below one."""
    out = F.when(ratio >= BANDS[0][1], BANDS[0][0])
    for name, low in BANDS[1:]:
        out = out.when(ratio >= low, name)
    return out.otherwise("New")


def version(c: Column) -> Column:
    """Comparable struct of a dotted version; what follows a hyphen is dropped."""
    parts = F.split(F.split(c, "-")[0], r"\.")
    return F.struct(*(F.coalesce(F.try_element_at(parts, F.lit(i + 1)).cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("major", "minor", "patch"))))


def decoded_state(dialect: str, state: Column, sub_state: Column | None = None, locked: Column | None = None) -> Column:
    """struct(state, locked) as read from a file. Dialects: ``v2`` (XLIFF 2 and later), ``v1`` and ``sdl``."""
    if dialect == "v2":
        raw = F.coalesce(sub_state, state, F.lit("initial-blank"))
        return F.struct(F.regexp_replace(raw, "-locked$", "").alias("state"), raw.endswith("-locked").alias("locked"))
    if dialect == "v1":
        raw = F.coalesce(state, F.lit(""))
        return F.struct(F.regexp_replace(raw, "^x-locked-", "").alias("state"), raw.startswith("x-locked-").alias("locked"))
    raw, lock = F.lower(F.coalesce(state, F.lit(""))), F.coalesce(F.lower(locked) == "true", F.lit(False))
    return F.struct(raw.alias("state"), lock.alias("locked"))


def shown_state(dialect: str, state: Column, locked: Column) -> Column:
    """The one string in which editors see state and lock."""
    if dialect == "v1":
        return F.when(locked, F.concat(F.lit("x-locked-"), state)).otherwise(state)
    return F.when(locked & (state == ""), F.lit("locked")).when(locked, F.concat(state, F.lit("-locked"))).otherwise(state)


def encoded_state(dialect: str, state: Column) -> Column:
    """struct(state, sub_state) as written. Unknown states of ``v2`` are null: such updates write no state."""
    if dialect == "v2":
        pair = lambda s, sub: F.struct(F.lit(s).alias("state"), F.lit(sub).alias("sub_state"))
        return F.when(state == "blank", pair("initial", "initial-blank")).when(state == "draft", pair("initial", "initial-draft")).when(state.isin("translated", "reviewed"), F.struct(state.alias("state"), state.alias("sub_state")))
    if dialect == "v1":
        kept = F.when(state.isin("new", "translated", "signed-off"), state).otherwise(F.concat(F.lit("x-"), state))
        return F.struct(kept.alias("state"), F.lit(None).cast("string").alias("sub_state"))
    return F.struct(F.concat(F.upper(F.substring(state, 1, 1)), F.lower(F.substring(state, 2, 100))).alias("state"), F.lit(None).cast("string").alias("sub_state"))


def legacy_quotes(c: Column) -> Column:
    """The doubled quotes that older memories hold."""
    return F.replace(c, F.lit('"'), F.lit('""'))


#: Time formats of the dialects.
ISO, TMX_TIME, SDL_TIME = "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd'T'HHmmss'Z'", "MM/dd/yyyy HH:mm:ss"


def formatted_time(ts: Column, pattern: str = ISO) -> Column:
    return F.date_format(ts, pattern)
