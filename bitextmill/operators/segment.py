"""Sentence segmentation and the clean-up of segments: whitespace peeling, numbering.

Two forms: Column expressions over plain text (fast, JVM only), and exact functions over token arrays for mixed
content. They differ only where a boundary's text occurs earlier in the unit without being a boundary.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import workers
from ..schemas import TOKENS

#: Patterns of abbreviations and of sentence ends: fixed values. Groups: space before, word, marks, space after.
ABBREVIATION = r"(\s+|^)(\p{Lu}\p{L}{0,3})(\.+)(\s+|$)"
SENTENCE_END = r"(\s+|^)(\p{L}+)([.!?:]+)(\s+|$)"
GO_ON, STOP = "\ue000", "\ue001"  # private-use characters
_ABBREVIATION, _SENTENCE_END = regex.compile(ABBREVIATION), regex.compile(SENTENCE_END)


def sentences(text: Column, keep_space: bool = False) -> Column:
    """Sentences of a text. ``keep_space``: the space between two sentences begins the second one."""
    guarded = F.regexp_replace(text, rf"(?U){ABBREVIATION}", rf"$1$2$3{GO_ON}$4")
    split = F.regexp_replace(guarded, rf"(?U){SENTENCE_END.removesuffix('|$)')})", rf"$1$2$3{STOP}{'$4' if keep_space else ''}")
    return F.split(F.replace(split, F.lit(GO_ON), F.lit("")), STOP)


def sentence_list(text: str, keep_space: bool = False) -> list[str]:
    """The exact form: every hit is marked at the first place where its text occurs."""

    def marked(s: str, hit: regex.Match, mark: str, space: str) -> str:
        at = s.find(hit[0])
        return s if at < 0 else s[:at] + hit[1] + hit[2] + hit[3] + mark + space + s[at + len(hit[0]) :]

    for hit in list(_ABBREVIATION.finditer(text)):
        text = marked(text, hit, GO_ON, hit[4])
    for hit in list(_SENTENCE_END.finditer(text)):
        if hit[4]:
            text = marked(text, hit, STOP, hit[4] if keep_space else "")
    return text.replace(GO_ON, "").split(STOP)


def split_tokens(tokens: list[dict]) -> list[list[dict]]:
    """Sentences of mixed content: breaks are found on the text and laid back on the tokens, so tags stay in place."""
    text = "".join(t["text"] or "" for t in tokens if t["kind"] == "text")
    if len(text.split()) <= 1:
        return [list(tokens)]
    lengths = [len(s) for s in sentence_list(text, keep_space=True)]
    out, room, queue = [[]], lengths, [dict(t) for t in tokens]
    k, left = 0, room[0]
    for t in queue:
        if t["kind"] != "text":
            out[-1].append(t)
            continue
        rest = t["text"] or ""
        while len(rest) > left and k + 1 < len(room):
            if left:
                out[-1].append(t | {"text": rest[:left]})
            rest, k = rest[left:], k + 1
            left = room[k]
            out.append([])
        if rest:
            out[-1].append(t | {"text": rest})
            left -= len(rest)
    # a closing tag that begins a sentence belongs to the one before
    for before, after in zip(out, out[1:]):
        if after and after[0]["kind"] == "tag" and after[0]["tag"] == "ec":
            before.append(after.pop(0))
    return [s for s in out if s]


def merged_tags(tokens: list[dict]) -> list[dict]:
    """Without closing tags that the same formatting reopens at once."""
    out: list[dict] = []
    for t in tokens:
        last = out[-1] if out else None
        if last and last["kind"] == t["kind"] == "tag" and last["tag"] == "ec" and t["tag"] == "sc" and last["data_ref"] is not None and last["data_ref"] == t["data_ref"]:
            out.pop()
            continue
        out.append(t)
    return out


def without_empty_pairs(tokens: list[dict]) -> list[dict]:
    """Without an opening tag that its own closing tag follows at once."""
    out: list[dict] = []
    for t in tokens:
        last = out[-1] if out else None
        if last and last["kind"] == t["kind"] == "tag" and (last["tag"], t["tag"]) == ("sc", "ec") and last["id"] == t["id"]:
            out.pop()
        else:
            out.append(t)
    return out


def peeled(tokens: list[dict]) -> list[tuple[str, list[dict]]]:
    """(kind, tokens) parts: white space and tags at both ends become ignorables, until neither end changes."""
    body, head, tail = [dict(t) for t in tokens], [], []
    while body:
        t = body[0]
        text = t["text"] or ""
        if t["kind"] == "text" and not text.strip():
            head.append(body.pop(0))
        elif t["kind"] == "text" and text != text.lstrip():
            cut = len(text) - len(text.lstrip())
            head.append(t | {"text": text[:cut]})
            body[0] = t | {"text": text[cut:]}
        elif t["kind"] == "tag" and not _closes_inside(body, 0):
            head.append(body.pop(0))
        else:
            break
    while body:
        t = body[-1]
        text = t["text"] or ""
        if t["kind"] == "text" and not text.strip():
            tail.insert(0, body.pop())
        elif t["kind"] == "text" and text != text.rstrip():
            cut = len(text.rstrip())
            tail.insert(0, t | {"text": text[cut:]})
            body[-1] = t | {"text": text[:cut]}
        elif t["kind"] == "tag" and not _opens_inside(body, len(body) - 1):
            tail.insert(0, body.pop())
        else:
            break
    parts = [("ignorable", head), ("segment", body), ("ignorable", tail)]
    return [(k, p) for k, p in parts if p]


def _closes_inside(body: list[dict], at: int) -> bool:
    """Whether the pair that opens here closes before the end, so that it marks a part of the segment only."""
    t = body[at]
    ends = [i for i, o in enumerate(body) if o["kind"] == "tag" and o["tag"] == "ec" and o["id"] == t["id"]]
    return t["tag"] == "sc" and bool(ends) and any(o["kind"] == "text" and (o["text"] or "").strip() for o in body[ends[-1] :])


def _opens_inside(body: list[dict], at: int) -> bool:
    t = body[at]
    starts = [i for i, o in enumerate(body) if o["kind"] == "tag" and o["tag"] == "sc" and o["id"] == t["id"]]
    return t["tag"] == "ec" and bool(starts) and any(o["kind"] == "text" and (o["text"] or "").strip() for o in body[: starts[0]])


def unit_parts(tokens: list[dict], segmentation: bool = True) -> list[tuple[str, list[dict]]]:
    """Segments and ignorables of one unit, in order."""
    out = []
    for sentence in split_tokens(tokens) if segmentation else [tokens]:
        out += peeled(without_empty_pairs(merged_tags(sentence)))
    return out


def segmented(units: DataFrame, segmentation: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """units (file_id, unit_ord, unit_id, source tokens) to rows of segments and ignorables, segments numbered per file.
    ``keep``: further columns of the units that their rows have."""

    given = units.select("file_id", "unit_ord", "unit_id", *keep, "source")

    def run(*row):
        *own, source = row
        for n, (kind, tokens) in enumerate(unit_parts(source or [], segmentation)):
            yield *own, n, kind, tokens

    rows = workers.mapped(given, run, StructType([*given.schema.fields[:-1], *StructType.fromDDL(f"seg_ord int, kind string, source {TOKENS}")]))
    return numbered(rows)


PART = 4096  #: units that are numbered together


def numbered(rows: DataFrame) -> DataFrame:
    """segment_id 1..n per file over its units in order; ignorables have none."""
    # in parts of some thousand units, so that a file of many rows is more than one task
    segment_ = F.when(F.col("kind") == "segment", 1).otherwise(0)
    rows = rows.withColumn("_part", F.floor(F.col("unit_ord") / PART))
    sizes = rows.groupBy("file_id", "_part").agg(F.sum(segment_).alias("_n"))
    before = Window.partitionBy("file_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(segment_).over(Window.partitionBy("file_id", "_part").orderBy("unit_ord", "seg_ord"))
    # sizes are as many as files, so they are joined where they lie, never sent to all by way of the driver
    rows = rows.withColumn("_place", inside).join(sizes.hint("shuffle_hash"), ["file_id", "_part"])
    number = (F.col("_before") + F.col("_place")).cast("long").cast("string")
    return rows.withColumn("segment_id", F.when(F.col("kind") == "segment", number)).drop("_part", "_place", "_before")


def text_parts(text: Column) -> Column:
    """struct(head, body, tail) of plain text: white space apart. The text-only case of ``peeled``."""
    return F.struct(F.regexp_extract(text, r"(?s)^(\s*)", 1).alias("head"), F.regexp_replace(text, r"^\s+|\s+\z", "").alias("body"), F.when(text.rlike(r"^\s*\z"), F.lit("")).otherwise(F.regexp_extract(text, r"(\s*)\z", 1)).alias("tail"))
