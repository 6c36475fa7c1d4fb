"""Review of segments: updates with states and locks, history, comments, quality issues, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import encoded_state

KEY = ["file_id", "segment_id"]


def _empty(target: Column, kind: str) -> Column:
    return target.isNull() | ((F.size(target) == 0) if kind.startswith("array") else (target == ""))


def update_segments(segments: DataFrame, edits: DataFrame, dialect: str = "v2") -> tuple[DataFrame, DataFrame]:
    """(segments, errors) after ``edits`` (file_id, segment_id, target, state, submitted_by, at).

    Locked and missing segments are not changed and are listed with the reason. State and stamps are written only if an
    edit names who submitted it; states that the dialect does not know leave state and stamps as they were.
    """
    e = edits.select(*KEY, F.col("target").alias("_target"), F.col("state").alias("_state"), F.col("submitted_by").alias("_by"), F.col("at").alias("_at"))
    locked = segments.where("locked and segment_id is not null").select(*KEY)
    missing = e.join(segments.select(*KEY), KEY, "left_anti").select(*KEY, F.lit("segment does not exist").alias("reason"))
    refused = e.join(locked, KEY, "left_semi").select(*KEY, F.lit("segment is locked").alias("reason"))
    joined = segments.join(e, KEY, "left")
    apply = F.col("_target").isNotNull() & ~F.coalesce(F.col("locked"), F.lit(False))
    code = encoded_state(dialect, F.col("_state"))
    stamped = apply & F.col("_by").isNotNull() & code.isNotNull()
    changed = {
        "target": F.when(apply, F.col("_target")).otherwise(F.col("target")),
        "state": F.when(stamped, code["state"]).otherwise(F.col("state")),
        "sub_state": F.when(stamped, code["sub_state"]).otherwise(F.col("sub_state")),
        "modified_on": F.when(stamped, F.col("_at")).otherwise(F.col("modified_on")),
        "modified_by": F.when(stamped, F.col("_by")).otherwise(F.col("modified_by")),
    }
    if dialect == "sdl" and "created_on" in segments.columns:
        fresh = stamped & F.col("created_on").isNull()
        changed |= {"created_on": F.when(fresh, F.col("_at")).otherwise(F.col("created_on")), "created_by": F.when(fresh, F.col("_by")).otherwise(F.col("created_by"))}
        changed |= {c: F.when(stamped & F.col("created_on").isNotNull(), F.col(v)).otherwise(F.col(c)) for c, v in (("modified_on", "_at"), ("modified_by", "_by"))}
    return joined.withColumns(changed).select(*segments.columns), missing.unionByName(refused)


def append_history(history: DataFrame, segments: DataFrame, edits: DataFrame) -> DataFrame:
    """History with the target that each edit to translated or reviewed replaces, if it was not empty."""
    kind = segments.schema["target"].dataType.simpleString()
    now = edits.where(F.col("state").isin("translated", "reviewed")).select(*KEY)
    old = segments.where(~_empty(F.col("target"), kind) & ~F.coalesce(F.col("locked"), F.lit(False))).join(now, KEY, "left_semi")
    last = history.groupBy(*KEY).agg(F.max("version_ord").alias("_last"))
    new = old.join(last, KEY, "left").withColumn("version_ord", (F.coalesce("_last", F.lit(0)) + 1).cast("int"))
    return history.unionByName(new.select(*history.columns))


def segment_history(history: DataFrame, file_id: str, segment_id: str) -> DataFrame:
    return history.where((F.col("file_id") == file_id) & (F.col("segment_id") == segment_id)).orderBy("version_ord")


def segment_issues(issues: DataFrame, file_id: str, segment_id: str, resolved: bool = False) -> DataFrame:
    found = issues.where((F.col("file_id") == file_id) & (F.col("segment_id") == segment_id))
    return found if resolved else found.where(~F.coalesce(F.col("resolved"), F.lit(False)))


def set_locks(segments: DataFrame, locks: DataFrame) -> DataFrame:
    """``locks``: file_id, segment_id, locked. Setting what is set changes nothing."""
    wanted = locks.select(*KEY, F.col("locked").alias("_locked"))
    return segments.join(wanted, KEY, "left").withColumn("locked", F.coalesce("_locked", "locked")).select(*segments.columns)


def _numbered(rows: DataFrame, new: DataFrame, unit: list[str], id_: str, order: list[str]) -> DataFrame:
    """``new`` with the next ids of its unit, appended."""
    have = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("_have"))
    place = F.row_number().over(Window.partitionBy(*unit).orderBy(*order))
    new = new.join(have, unit, "left").withColumn(id_, (F.coalesce("_have", F.lit(0)) + place).cast("string")).drop("_have")
    for c in rows.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    return rows.unionByName(new.select(*rows.columns))


def add_comments(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Open notes with the unit's next ids. ``new``: file_id, unit_ord, segment_id, text, added_at, added_by."""
    return _numbered(notes, new.withColumn("state", F.lit("open")), ["file_id", "unit_ord"], "note_id", ["added_at", "segment_id"])


def add_issues(issues: DataFrame, new: DataFrame) -> DataFrame:
    """Quality issues with the unit's next ids; a segment id may be ``N/A``."""
    return _numbered(issues, new.withColumn("resolved", F.lit(False)), ["file_id", "unit_ord"], "issue_id", ["added_at", "segment_id"])


def resolve(rows: DataFrame, done: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) after stamping ``done`` (file_id, segment_id, id, resolved_at, resolved_by); once only."""
    key = [*KEY, id_]
    d = done.select(*key, F.col("resolved_at").alias("_at"), F.col("resolved_by").alias("_by"))
    missing = d.join(rows.select(*key), key, "left_anti").select(*key, F.lit("does not exist").alias("reason"))
    again = d.join(rows.where("resolved_at is not null").select(*key), key, "left_semi").select(*key, F.lit("already resolved").alias("reason"))
    fresh = F.col("_at").isNotNull() & F.col("resolved_at").isNull()
    changed = {"resolved_at": F.when(fresh, F.col("_at")).otherwise(F.col("resolved_at")), "resolved_by": F.when(fresh, F.col("_by")).otherwise(F.col("resolved_by"))}
    if "resolved" in rows.columns:
        changed["resolved"] = F.col("resolved") | fresh
    else:
        changed["state"] = F.when(fresh, F.lit("resolved")).otherwise(F.col("state"))
    return rows.join(d, key, "left").withColumns(changed).select(*rows.columns), missing.unionByName(again)


def with_remarks(segments: DataFrame, notes: DataFrame, issues: DataFrame) -> DataFrame:
    """Segments with their open notes and unresolved issues, oldest first (then by kind and id)."""
    row = lambda kind, id_, text: F.struct("added_at", F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(text).alias("text"), F.col("added_by").alias("by"))
    both = notes.where("state = 'open'").select(*KEY, row("note", "note_id", "text").alias("r")).unionByName(issues.where("not coalesce(resolved, false)").select(*KEY, row("issue", "issue_id", "comment").alias("r")))
    listed = both.groupBy(*KEY).agg(F.array_sort(F.collect_list("r")).alias("remarks"))
    return segments.join(listed, KEY, "left")


def merge_segments(segments: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, errors) after merging ``groups`` (merge_id, file_id, segment_id).

    A group has two or more unlocked, consecutive segments of one unit. Ignorables between them give their source to
    both sides; the merged segment takes the place and id of the first.
    """
    rows = segments.join(groups, KEY, "left")
    marked = rows.where("merge_id is not null")
    spans = marked.groupBy("merge_id").agg(
        F.first("file_id").alias("file_id"), F.min("unit_ord").alias("_unit"), F.max("unit_ord").alias("_unit2"), F.min("seg_ord").alias("_from"), F.max("seg_ord").alias("_to"), F.count(F.lit(1)).alias("_n"), F.max(F.coalesce("locked", F.lit(False))).alias("_locked"), F.countDistinct("file_id").alias("_files")
    )
    inside = segments.select("file_id", F.col("unit_ord").alias("_unit"), "seg_ord", "kind", "source", "target", "segment_id").join(spans, ["file_id", "_unit"]).where(F.col("seg_ord").between(F.col("_from"), F.col("_to")))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", c))), lambda x: x[c.split(".")[-1]])
    array = segments.schema["source"].dataType.simpleString().startswith("array")
    join = F.flatten if array else (lambda c: F.array_join(c, ""))
    inside = inside.withColumn("_t", F.when(F.col("kind") == "ignorable", F.col("source")).otherwise(F.col("target")))
    merged = inside.groupBy("merge_id").agg(join(side("source")).alias("_source"), join(side("_t")).alias("_target"), F.min(F.when(F.col("kind") == "segment", F.col("seg_ord"))).alias("_first"), F.sum(F.when(F.col("kind") == "segment", 1).otherwise(0)).alias("_inside"))
    state = spans.join(merged, "merge_id").withColumn("reason", F.when((F.col("_n") < 2), "fewer than two segments").when((F.col("_unit") != F.col("_unit2")) | (F.col("_files") > 1), "not in one unit").when(F.col("_locked"), "a segment is locked").when(F.col("_inside") != F.col("_n"), "not consecutive"))
    good = state.where("reason is null").select("file_id", F.col("_unit").alias("unit_ord"), "_from", "_to", "_first", "_source", "_target")
    out = segments.join(good, ["file_id", "unit_ord"], "left")
    within = F.coalesce(F.col("seg_ord").between(F.col("_from"), F.col("_to")), F.lit(False))
    # a unit with several merges meets each of them: keep one row a segment
    first = within & (F.col("seg_ord") == F.col("_first"))
    picked = out.groupBy(*[c for c in ("file_id", "unit_ord", "seg_ord")]).agg(F.max(within).alias("_within"), F.max_by(F.struct(F.col("_source"), F.col("_target")), first.cast("int")).alias("_m"), F.max(first).alias("_is_first"))
    result = segments.join(picked, ["file_id", "unit_ord", "seg_ord"]).where("not _within or _is_first")
    result = result.withColumns({"source": F.when(F.col("_is_first"), F.col("_m._source")).otherwise(F.col("source")), "target": F.when(F.col("_is_first"), F.col("_m._target")).otherwise(F.col("target"))})
    return result.select(*segments.columns), state.where("reason is not null").select("merge_id", "reason")


def issue_report(segments: DataFrame, history: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows of the quality report: id, source, translation, edited, issues.

    For reviewed segments with a translated version in the history, the translation is the last of those and the edited
    text is the current one; otherwise the translation is the current one.
    """
    before = history.where("state = 'translated'").groupBy(*KEY).agg(F.max_by("target", "version_ord").alias("_before"), F.max(F.lit(True)).alias("_has"))
    open_ = issues.where("not coalesce(resolved, false)").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("issue_id", "type", "severity", "comment"))).alias("issues"))
    rows = segments.where("kind = 'segment'").join(before, KEY, "left").join(open_, KEY, "left")
    edited = (F.col("state") == "reviewed") & F.coalesce(F.col("_has"), F.lit(False))
    return rows.select(*KEY, "source", F.when(edited, F.col("_before")).otherwise(F.col("target")).alias("translation"), F.when(edited, F.col("target")).alias("edited"), "issues")
