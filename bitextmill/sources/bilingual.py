"""Bilingual XML files: XLIFF 1.2, XLIFF 2 and the annotated v2 dialect, SDLXLIFF and TMX, read into rows and written back.

Files come as whole binaries (one row a file) and become the tables of ``schemas`` by Spark's own functions (``xliff``). Changes (targets, states, locks, comments, quality issues, merges, history) are written by applying rows to
the original file, so everything else in it stays.
"""

from __future__ import annotations

import copy
import io
import xml.etree.ElementTree as ET
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import workers
from ..functions.text import decoded_state
from ..schemas import TOKENS
from . import xliff

#: Name spaces: fixed values.
XLIFF2, XLIFF1 = "urn:oasis:names:tc:xliff:document:2.0", "urn:oasis:names:tc:xliff:document:1.2"
SDL = "http://sdl.com/FileTypes/SdlXliff/1.0"
#: Name space of annotations (history, quality issues, the original's text) in files that have none of their own yet.
ANNOTATED = "urn:bitextmill:annotated:1.0"
ANNOTATIONS = ("history", "locQualityIssues", "internal-file")
XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
MOST_BYTES = 256 << 20  #: larger files are refused, not parsed



def local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _token(kind: str, text: str | None = None, tag: str | None = None, id_: str | None = None, ref: str | None = None, equiv: str | None = None) -> dict:
    return {"kind": kind, "tag": tag, "id": id_, "data_ref": ref, "equiv": equiv, "text": text}


def parse(content: bytes) -> ET.Element:
    """The root of an untrusted document; entity declarations and oversized input are refused."""
    if len(content) > MOST_BYTES:
        raise ValueError("file too large")
    if b"<!ENTITY" in content[:65_536]:
        raise ValueError("entity declarations are not read")
    return ET.fromstring(content)


def tokens_v2(element: ET.Element | None) -> list[dict] | None:
    """Mixed content of a version-2 source or target."""
    if element is None:
        return None
    out = [_token("text", element.text)] if element.text else []
    for child in element:
        equiv = child.get("equiv")
        out.append(_token("tag", None, local(child), child.get("id"), child.get("dataRef"), unescape(equiv) if equiv is not None else None))
        if child.tail:
            out.append(_token("text", child.tail))
    return out


def tokens_v1(element: ET.Element | None) -> list[dict] | None:
    """Mixed content of a version-1 side; ``g`` becomes an opening and a closing tag, other tags stand alone."""
    if element is None:
        return None
    out = [_token("text", element.text)] if element.text else []
    for child in element:
        name, id_ = local(child), child.get("id", "N/A")
        if name == "g":
            out.append(_token("tag", None, "g", id_, None, f"<g-{id_}>"))
            out += tokens_v1(child)
            out.append(_token("tag", None, "g", id_, None, f"</g-{id_}>"))
        elif name == "mrk":
            out += tokens_v1(child)
        else:
            out.append(_token("tag", None, name, id_, None, f"<{name}-{id_}/>"))
        if child.tail:
            out.append(_token("text", child.tail))
    return out


def _find(element: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in element if local(c) == name), None)


def _iter(element: ET.Element, name: str):
    return (e for e in element.iter() if local(e) == name)


def sniff(root: ET.Element) -> str:
    """The format of a document by its root: kxliff, xliff2, sdlxliff, xliff1 or tmx."""
    if local(root) == "tmx":
        return "tmx"
    if local(root) != "xliff":
        raise ValueError(f"not a bilingual file: {local(root)}")
    if float(root.get("version", "1.2")[:3]) >= 2:
        return "kxliff" if any(local(e) in ANNOTATIONS for e in root.iter()) else "xliff2"
    return "sdlxliff" if any(e.tag.startswith(f"{{{SDL}}}") for e in root.iter() if isinstance(e.tag, str)) else "xliff1"


def _row(u: int, unit: str | None, s: int, id_: str | None, kind: str, source, target, **more) -> dict:
    base = dict.fromkeys(("state", "sub_state", "lock", "modified_on", "modified_by"))
    return {"unit_ord": u, "unit_id": unit, "seg_ord": s, "segment_id": id_, "kind": kind, "source": source or [], "target": target, **base, **more}


def _segments_v2(root: ET.Element) -> tuple[list[dict], list[dict]]:
    rows, remarks = [], []
    for u, unit in enumerate(_iter(root, "unit"), 1):
        s = 0
        for child in unit:
            kind = local(child)
            if kind in ("segment", "ignorable"):
                more = {"state": child.get("state"), "sub_state": child.get("subState"), "modified_on": child.get("modified_on"), "modified_by": child.get("modified_by")}
                rows.append(_row(u, unit.get("id"), s, child.get("id"), kind, tokens_v2(_find(child, "source")), tokens_v2(_find(child, "target")), **more))
                s += 1
            elif kind in ("notes", "locQualityIssues", "originalData"):
                names = {"notes": "note", "locQualityIssues": "lqi", "originalData": "data"}
                remarks += [{"unit_ord": u, "kind": names[kind], "attrs": dict(e.attrib), "text": "".join(e.itertext())} for e in child]
        if len(unit.attrib) > ("id" in unit.attrib):
            remarks.append({"unit_ord": u, "kind": "unit", "attrs": {k.rpartition("}")[2]: v for k, v in unit.attrib.items()}, "text": None})
    return rows, remarks


def _known(value: str | None) -> str | None:
    return None if value == "N/A" else value


def _history(root: ET.Element) -> list[dict]:
    """Earlier versions of targets: each its own row, with the state and the stamps it had."""
    out = []
    for u, unit in enumerate(_iter(root, "unit"), 1):
        for segment in (s for h in unit if local(h) == "history" for s in h):
            for v, target in enumerate(segment, 1):
                out.append({"unit_ord": u, "segment_id": segment.get("id"), "version_ord": v, "target": tokens_v2(target), "state": _known(target.get("state")), "modified_on": _known(target.get("modified_on")), "modified_by": _known(target.get("modified_by"))})
    return out


def _segments_v1(root: ET.Element, sdl: bool) -> list[dict]:
    rows = []
    for u, unit in enumerate(_iter(root, "trans-unit"), 1):
        whole, source, target = _find(unit, "seg-source"), _find(unit, "source"), _find(unit, "target")
        marks = [m for m in _iter(whole, "mrk") if m.get("mtype") == "seg"] if whole is not None else []
        defs = {d.get("id"): d for d in unit.iter(f"{{{SDL}}}seg")} if sdl else {}
        if marks:
            theirs = {m.get("mid"): m for m in _iter(target, "mrk")} if target is not None else {}
            pairs = [(m.get("mid"), m, theirs.get(m.get("mid"))) for m in marks]
        elif sdl:
            continue  # only marked segments have states
        else:
            side = whole if whole is not None else source
            pairs = [("N/A", side, target)] if side is not None else []
        for s, (id_, a, b) in enumerate(pairs):
            d = defs.get(id_)
            if sdl and d is None:
                raise ValueError(f"segment {id_} of unit {unit.get('id')} has no definition")
            state = d.get("conf") if d is not None else b.get("state") if b is not None else None
            rows.append(_row(u, unit.get("id"), s, id_, "segment", tokens_v1(a), tokens_v1(b) or [], state=state, lock=d.get("locked") if d is not None else None))
    return rows


def file_rows(content: bytes) -> dict:
    """Everything of one file that is held in memory, or the cause why it cannot be read (tables of files: ``opened``)."""
    out = {"format": None, "version": None, "src_lang": None, "trg_lang": None, "original": None, "segments": [], "remarks": [], "history": [], "internal": None, "error": None}
    try:
        root = parse(content)
        kind = sniff(root)
        file = next(_iter(root, "file"), None)
        out |= {"format": kind, "version": root.get("version"), "original": file.get("original") if file is not None else None}
        if kind in ("kxliff", "xliff2"):
            out["src_lang"], out["trg_lang"] = root.get("srcLang"), root.get("trgLang")
            out["segments"], out["remarks"] = _segments_v2(root)
            out["history"] = _history(root)
            inside = next(_iter(root, "internal-file"), None)
            out["internal"] = None if inside is None else "".join(inside.itertext())
        elif kind == "tmx":
            raise ValueError("a TMX file holds no segments; use tmx_units")
        else:
            if file is not None:
                out["src_lang"], out["trg_lang"] = file.get("source-language"), file.get("target-language")
            out["segments"] = _segments_v1(root, kind == "sdlxliff")
    except (ET.ParseError, ValueError) as e:
        out["error"] = str(e)[:300]
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")


def opened(files: DataFrame) -> DataFrame:
    """``files`` (file_id, content) with the struct ``f`` of everything in it, read without Python workers."""
    return xliff.opened(files)


def guarded(opened_files: DataFrame) -> DataFrame:
    """``opened_files`` with the column ``refused``: why a file cannot be what its suffix says, or null. Annotated and SDL files have
    suffixes of their own; an annotated file without annotations declares their name space. Others may be any dialect."""
    suffix, kind = F.lower(F.regexp_extract("file_id", r"\.([^./]+)$", 1)), F.col("_format")
    head = F.substring(F.decode(F.substring("content", 1, 4096), "ISO-8859-1"), 1, 4096)
    declared = F.regexp_extract(head, r"(<xliff[^>]*>)", 1).rlike(r"xmlns:[A-Za-z]")
    fits = F.when(suffix == "kxliff", (kind == "kxliff") | ((kind == "xliff2") & declared)).when(suffix == "sdlxliff", kind == "sdlxliff").otherwise(F.lit(True))
    wrong = F.when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("the content is not that of a "), suffix, F.lit(" file")))
    return opened_files.withColumn("refused", F.coalesce(F.col("_error"), wrong))


def _each(opened_files: DataFrame, rows: str, name: str, *more) -> DataFrame:
    """A row of ``f`` each. Nulls are dropped behind the explosion: a filter inferred before it would repeat the reading of the file."""
    return opened_files.select("file_id", *more, F.explode_outer(rows).alias(name)).where(F.col(name).isNotNull())


def segments_of(opened_files: DataFrame) -> DataFrame:
    """Rows of ``SEGMENTS``: states and locks decoded by dialect."""
    rows = _each(opened_files, "f.segments", "s", "_format").select("file_id", "_format", "s.*")
    null = F.lit(None).cast("string")
    v2, sdl = F.col("_format").isin("kxliff", "xliff2"), F.col("_format") == "sdlxliff"
    state = F.when(v2, decoded_state("v2", F.col("state"), F.col("sub_state"))).when(sdl, decoded_state("sdl", F.col("state"), null, F.col("lock"))).otherwise(decoded_state("v1", F.col("state")))
    rows = rows.withColumn("_s", state)
    return rows.select("file_id", "unit_ord", "unit_id", "seg_ord", "segment_id", "kind", "source", "target", F.col("_s.state").alias("state"), "sub_state", F.col("_s.locked").alias("locked"), "modified_on", "modified_by")


def _remarks(opened_files: DataFrame, kind: str) -> DataFrame:
    rows = _each(opened_files, "f.remarks", "r").where(F.col("r.kind") == kind)
    return rows.select("file_id", "r.unit_ord", F.col("r.attrs").alias("a"), F.col("r.text").alias("text"))


def notes_of(opened_files: DataFrame) -> DataFrame:
    a = lambda k: F.col("a")[k]
    return _remarks(opened_files, "note").select("file_id", "unit_ord", a("id").alias("note_id"), a("segment").alias("segment_id"), a("state").alias("state"), "text", a("added_at").alias("added_at"), a("added_by").alias("added_by"), a("resolved_at").alias("resolved_at"), a("resolved_by").alias("resolved_by"))


def issues_of(opened_files: DataFrame) -> DataFrame:
    a = lambda k: F.col("a")[k]
    return _remarks(opened_files, "lqi").select(
        "file_id", "unit_ord", a("id").alias("issue_id"), a("segment").alias("segment_id"), a("type").alias("type"), a("comment").alias("comment"), a("severity").alias("severity"), a("added_at").alias("added_at"), a("added_by").alias("added_by"), (F.coalesce(F.lower(a("resolved")), F.lit("")) == "true").alias("resolved"), a("resolved_at").alias("resolved_at"), a("resolved_by").alias("resolved_by")
    )


def history_of(opened_files: DataFrame) -> DataFrame:
    """Rows of ``HISTORY``: earlier versions of targets, oldest first by ``version_ord``."""
    return _each(opened_files, "f.history", "h").select("file_id", "h.*")


def unit_attributes_of(opened_files: DataFrame) -> DataFrame:
    """(file_id, unit_ord, attrs) of units that have more than an id."""
    return _remarks(opened_files, "unit").select("file_id", "unit_ord", F.col("a").alias("attrs"))


def original_data_of(opened_files: DataFrame) -> DataFrame:
    return _remarks(opened_files, "data").select("file_id", "unit_ord", F.col("a")["id"].alias("data_id"), F.col("text").alias("xml"))


# writing


def _fill(element: ET.Element, tokens: list[dict], space: str, v1: bool) -> None:
    """Mixed content from tokens; in version 1, pairs of ``g`` are nested again."""
    for child in list(element):
        element.remove(child)
    element.text = None
    stack = [element]

    def add_text(text: str) -> None:
        at = stack[-1]
        if len(at):
            at[-1].tail = (at[-1].tail or "") + text
        else:
            at.text = (at.text or "") + text

    for t in tokens:
        if t["kind"] == "text":
            add_text(t["text"] or "")
        elif v1 and t["tag"] == "g":
            if (t["equiv"] or "").startswith("</"):
                if len(stack) > 1 and stack[-1].get("id") == t["id"]:
                    stack.pop()
            else:
                stack.append(ET.SubElement(stack[-1], f"{space}g", {"id": t["id"]}))
        elif v1 or t["tag"] in ("sc", "ec", "ph"):
            attrs = {"id": t["id"]} if t["id"] else {}
            if not v1:
                attrs |= {k: v for k, v in (("dataRef", t["data_ref"]), ("equiv", t["equiv"])) if v}
            ET.SubElement(stack[-1], f"{space}{t['tag']}", attrs)
        else:
            raise ValueError(f"tag {t['tag']} is not allowed here")


def _annotated(root: ET.Element) -> str:
    """The name space that the file's annotations have, or would have."""
    found = next((e for e in root.iter() if local(e) in ANNOTATIONS and e.tag.startswith("{")), None)
    return found.tag[: found.tag.index("}") + 1] if found is not None else f"{{{ANNOTATED}}}"


def written(root: ET.Element) -> bytes:
    out = io.BytesIO()
    for prefix, uri in (("sdl", SDL), ("note", _annotated(root)[1:-1])):
        ET.register_namespace(prefix, uri)
    space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else ""
    if space:
        ET.register_namespace("", space)
    ET.ElementTree(root).write(out, encoding="UTF-8", xml_declaration=True)
    return out.getvalue()


def apply_edits(content: bytes, edits: list[dict]) -> bytes:
    """The file with edited segments: dicts of segment_id, unit_id (or None), target, state, sub_state, locked, modified_*."""
    root = parse(content)
    kind = sniff(root)
    space = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    v1 = kind in ("xliff1", "sdlxliff")
    by_id = {(e.get("unit_id"), e["segment_id"]): e for e in edits} | {(None, e["segment_id"]): e for e in edits if e["segment_id"] != "N/A"}
    for unit in _iter(root, "trans-unit" if v1 else "unit"):
        places = []
        if not v1:
            places = [(c.get("id"), c) for c in unit if local(c) == "segment"]
        else:
            whole = _find(unit, "seg-source")
            marks = [m.get("mid") for m in _iter(whole, "mrk") if m.get("mtype") == "seg"] if whole is not None else []
            places = [(i, None) for i in marks or ["N/A"]]
        for id_, segment in places:
            edit = by_id.get((unit.get("id"), id_)) or (by_id.get((None, id_)) if id_ != "N/A" else None)
            if edit is None:
                continue
            holder = segment if segment is not None else unit
            target = _find(holder, "target")
            if target is None:
                target = ET.SubElement(holder, f"{space}target")
            if v1 and id_ != "N/A":
                mark = next((m for m in _iter(target, "mrk") if m.get("mid") == id_), None)
                if mark is None:
                    mark = ET.SubElement(target, f"{space}mrk", {"mtype": "seg", "mid": id_})
                _fill(mark, edit["target"] or [], space, True)
            else:
                _fill(target, edit["target"] or [], space, v1)
            if not v1:
                for name, value in (("state", edit.get("state")), ("subState", edit.get("sub_state")), ("modified_on", edit.get("modified_on")), ("modified_by", edit.get("modified_by"))):
                    if value:
                        segment.set(name, value)
            elif kind == "sdlxliff":
                d = next((d for d in unit.iter(f"{{{SDL}}}seg") if d.get("id") == id_), None)
                if d is not None:
                    if edit.get("state"):
                        d.set("conf", edit["state"])
                    if edit.get("locked") is not None:
                        d.set("locked", str(bool(edit["locked"])).lower())
            elif edit.get("state"):
                target.set("state", ("x-locked-" if edit.get("locked") else "") + edit["state"])
    return written(root)


def saved(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_id, content) with ``edits`` (file_id, unit_id, segment_id, target tokens, state, sub_state, locked, modified_on,
    modified_by; states as written, see ``encoded_state``) applied, one file a group."""
    listed = edits.groupBy("file_id").agg(F.collect_list(F.struct("unit_id", "segment_id", "target", "state", "sub_state", "locked", "modified_on", "modified_by")).alias("edits"))

    def run(file_id, content, edits):
        yield file_id, apply_edits(content, edits or [])

    return workers.mapped(files.join(listed, "file_id", "left").select("file_id", "content", "edits"), run, "file_id string, content binary", lambda r: len(r[1]))


#: A change of an annotated file, in the order ``ord``: ``op`` is update, lock, unlock, comment, resolve_comment, issue,
#: resolve_issue or merge. ``text`` is a comment, ``remark_id`` the id that is resolved, ``segments`` the ids to merge.
CHANGE = f"ord int, op string, unit_id string, segment_id string, target {TOKENS}, state string, text string, type string, severity string, remark_id string, segments array<string>, at string, by string"
#: States as written: fixed values.
_STATES = {"blank": ("initial", "initial-blank"), "draft": ("initial", "initial-draft"), "translated": ("translated", "translated"), "reviewed": ("reviewed", "reviewed")}


class Container:
    """A version-2 file that changes are applied to, one after the other."""

    def __init__(self, content: bytes):
        self.root = parse(content)
        if sniff(self.root) not in ("kxliff", "xliff2"):
            raise ValueError("changes of this kind need a version-2 file")
        self.space = self.root.tag[: self.root.tag.index("}") + 1] if self.root.tag.startswith("{") else ""
        self.notes_space = _annotated(self.root)
        self.units = {id(c): unit for unit in _iter(self.root, "unit") for c in unit}
        self.by_id: dict[str | None, ET.Element] = {}
        self.notes: dict[tuple, ET.Element] = {}
        self.issues: dict[tuple, ET.Element] = {}
        for unit in _iter(self.root, "unit"):
            self.by_id.setdefault(unit.get("id"), unit)
        for kind, known in (("note", self.notes), ("locQualityIssue", self.issues)):
            for x in _iter(self.root, kind):
                known.setdefault((x.get("segment"), x.get("id")), x)
        self.segments: dict[tuple, list[ET.Element]] = {}  # in file order, in any unit and in units of an id
        for unit in _iter(self.root, "unit"):
            for c in unit:
                if local(c) == "segment":
                    for key in {(None, c.get("id")), (unit.get("id"), c.get("id"))}:
                        self.segments.setdefault(key, []).append(c)
        self.parts: dict[tuple, ET.Element] = {}
        self.histories: dict[int, dict] = {}  # by history, then segment

    def segment(self, id_: str | None, unit_id: str | None = None) -> ET.Element:
        found = self.segments.get((unit_id, id_))
        if not found:
            raise ValueError(f"segment {id_} does not exist")
        return found[0]

    def _locked(self, segment: ET.Element) -> bool:
        return "locked" in segment.get("subState", "")

    def _child(self, parent: ET.Element, name: str, space: str) -> ET.Element:
        found = _find(parent, name)
        return found if found is not None else ET.SubElement(parent, f"{space}{name}")

    def _part(self, unit: ET.Element, name: str, space: str) -> ET.Element:
        """A child that a unit has once and keeps."""
        if (id(unit), name) not in self.parts:
            self.parts[id(unit), name] = self._child(unit, name, space)
        return self.parts[id(unit), name]

    def update(self, c: dict) -> None:
        segment = self.segment(c["segment_id"], c["unit_id"])
        if self._locked(segment):
            raise ValueError(f"segment {c['segment_id']} is locked")
        if c["state"] in ("translated", "reviewed"):
            self._remember(segment)
        _fill(self._child(segment, "target", self.space), list(c["target"]) if c["target"] is not None else [], self.space, False)
        if c["by"] and c["state"] in _STATES:
            state, sub = _STATES[c["state"]]
            for name, value in (("state", state), ("subState", sub), ("modified_on", c["at"]), ("modified_by", c["by"])):
                if value:
                    segment.set(name, value)

    def _remember(self, segment: ET.Element) -> None:
        """Puts the target that is replaced into the history, unless it is empty or was the last version already."""
        target = _find(segment, "target")
        if target is None or (not len(target) and not target.text):
            return
        history = self._part(self.units[id(segment)], "history", self.notes_space)
        if id(history) not in self.histories:
            known = self.histories[id(history)] = {}
            for s in history:
                known.setdefault(s.get("id"), s)
        known = self.histories[id(history)]
        versions = known.get(segment.get("id"))
        if versions is None:
            versions = known[segment.get("id")] = ET.SubElement(history, f"{self.notes_space}segment", {"id": segment.get("id")})
        if len(versions) and tokens_v2(versions[-1]) == tokens_v2(target):
            return
        kept = copy.deepcopy(target)
        kept.tail = None
        for name in ("state", "modified_on", "modified_by"):
            kept.set(name, segment.get(name, "N/A"))
        versions.append(kept)

    def lock(self, c: dict) -> None:
        segment = self.segment(c["segment_id"], c["unit_id"])
        if not self._locked(segment):
            segment.set("subState", f"{segment.get('subState') or segment.get('state') or 'initial-blank'}-locked")

    def unlock(self, c: dict) -> None:
        segment = self.segment(c["segment_id"], c["unit_id"])
        segment.set("subState", segment.get("subState", "").removesuffix("-locked") or "initial-blank")

    def comment(self, c: dict) -> None:
        unit = self.units[id(self.segment(c["segment_id"], c["unit_id"]))]
        notes = self._part(unit, "notes", self.space)
        note = ET.SubElement(notes, f"{self.space}note", {"id": str(len(notes) + 1), "segment": c["segment_id"], "state": "open", "added_at": c["at"] or "", "added_by": c["by"] or ""})
        note.text = c["text"]
        self.notes.setdefault((note.get("segment"), note.get("id")), note)

    def resolve_comment(self, c: dict) -> None:
        note = self.notes.get((c["segment_id"], c["remark_id"]))
        if note is None:
            raise ValueError(f"comment {c['remark_id']} does not exist")
        for name, value in (("resolved_at", c["at"]), ("resolved_by", c["by"]), ("state", "resolved")):
            note.set(name, value or "")

    def issue(self, c: dict) -> None:
        unit = self.by_id.get(c["unit_id"]) if c["unit_id"] else self.units[id(self.segment(c["segment_id"]))]
        if unit is None:
            raise ValueError(f"unit {c['unit_id']} does not exist")
        issues = self._part(unit, "locQualityIssues", self.notes_space)
        values = {"id": str(len(issues) + 1), "segment": c["segment_id"] or "N/A", "type": c["type"], "comment": c["text"], "severity": c["severity"], "added_at": c["at"], "added_by": c["by"]}
        issue = ET.SubElement(issues, f"{self.notes_space}locQualityIssue", {k: v or "" for k, v in values.items()})
        self.issues.setdefault((issue.get("segment"), issue.get("id")), issue)

    def resolve_issue(self, c: dict) -> None:
        issue = self.issues.get((c["segment_id"] or "N/A", c["remark_id"]))
        if issue is None:
            raise ValueError(f"issue {c['remark_id']} does not exist")
        if issue.get("resolved"):
            raise ValueError(f"issue {c['remark_id']} is resolved already")
        for name, value in (("resolved_at", c["at"]), ("resolved_by", c["by"]), ("resolved", "true")):
            issue.set(name, value or "")

    def merge(self, c: dict) -> None:
        """Puts consecutive segments of one unit into the first; an ignorable between them goes to both sides."""
        wanted = list(c["segments"]) if c["segments"] is not None else []
        if len(wanted) < 2:
            raise ValueError("fewer than two segments")
        chosen = [self.segment(i) for i in wanted]
        unit = self.units[id(chosen[0])]
        if any(self.units[id(x)] is not unit for x in chosen):
            raise ValueError("not in one unit")
        if any(map(self._locked, chosen)):
            raise ValueError("a segment is locked")
        parts = list(unit)
        place, taken = {id(x): i for i, x in enumerate(parts)}, {id(x) for x in chosen}
        places = [place[id(x)] for x in chosen]
        within = [x for x in parts[min(places) : max(places) + 1] if local(x) in ("segment", "ignorable")]
        if any(local(x) == "segment" and id(x) not in taken for x in within):
            raise ValueError("not consecutive")
        sides: dict[str, list[dict]] = {"source": [], "target": []}
        for x in within:
            source, target = (tokens_v2(_find(x, side)) or [] for side in sides)
            sides["source"] += source
            sides["target"] += target if local(x) == "segment" else source
        for side, tokens in sides.items():
            _fill(self._child(within[0], side, self.space), tokens, self.space, False)
        gone = {id(x) for x in within[1:]}
        unit[:] = [x for x in parts if id(x) not in gone]
        for x in within[1:]:
            if local(x) == "segment":
                for key in {(None, x.get("id")), (unit.get("id"), x.get("id"))}:
                    self.segments[key].remove(x)


def apply_changes(content: bytes, changes: list[dict]) -> tuple[bytes, list[dict]]:
    """The file after ``changes`` (dicts of ``CHANGE``) in their order, and those that were refused, with the reason."""
    file, refused = Container(content), []
    for c in sorted(changes, key=lambda c: c["ord"]):
        try:
            if c["op"] not in ("update", "lock", "unlock", "comment", "resolve_comment", "issue", "resolve_issue", "merge"):
                raise ValueError(f"{c['op']} is no change")
            getattr(file, c["op"])(c)
        except ValueError as e:
            refused.append({"ord": c["ord"], "reason": str(e)})
    return written(file.root), refused


def changed(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, content, refused) of version-2 files after ``changes`` (file_id and ``CHANGE``), one file a row."""
    names = [c.split()[0] for c in CHANGE.replace(TOKENS, "tokens").split(", ")]
    listed = changes.groupBy("file_id").agg(F.collect_list(F.struct(*names)).alias("changes"))

    def run(file_id, content, changes):
        yield file_id, *apply_changes(content, changes or [])

    joined = files.join(listed, "file_id", "left").select("file_id", "content", "changes")
    return workers.mapped(joined, run, "file_id string, content binary, refused array<struct<ord:int,reason:string>>", lambda r: len(r[1]))


def new_xliff(segments: list[dict], src: str, trg: str, original: str, internal: str | None = None) -> bytes:
    """A version-2 file of segments (unit_id, segment_id, kind, source and target tokens; ``data``: the XML that the unit's
    tags stand for, by id; ``attrs``: further attributes of the unit). ``internal``: what the original has besides units."""
    s, a = f"{{{XLIFF2}}}", f"{{{ANNOTATED}}}"
    root = ET.Element(f"{s}xliff", {"version": "2.1", "srcLang": src, "trgLang": trg})
    file, unit, last = ET.SubElement(root, f"{s}file", {"id": "1", "original": original}), None, None
    if internal is not None:
        ET.SubElement(file, f"{a}internal-file", {f"{a}rel": "self"}).text = internal
    for r in segments:
        key = r.get("unit_ord", r["unit_id"])
        if unit is None or key != last:
            last = key
            unit = ET.SubElement(file, f"{s}unit", ({"id": r["unit_id"]} if r["unit_id"] else {}) | dict(r.get("attrs") or {}))
            if r.get("data"):
                originals = ET.SubElement(unit, f"{s}originalData")
                for id_, xml in dict(r["data"]).items():
                    ET.SubElement(originals, f"{s}data", {"id": id_}).text = xml
        part = ET.SubElement(unit, f"{s}{r['kind']}", {"id": r["segment_id"]} if r.get("segment_id") else {})
        _fill(ET.SubElement(part, f"{s}source"), r["source"], s, False)
        if r.get("target"):
            _fill(ET.SubElement(part, f"{s}target"), r["target"], s, False)
    return written(root)


# TMX


def tmx_rows(content: bytes) -> list[dict]:
    """Units with their variants: the leading text, and all text one level deep."""
    root = parse(content)
    header = _find(root, "header")
    if header is not None and header.get("datatype") not in (None, "plaintext", "xml"):
        raise ValueError(f"data type {header.get('datatype')} is not read")
    out = []
    for tu in _iter(root, "tu"):
        tuv = []
        for v in (v for v in tu if local(v) == "tuv"):
            seg = _find(v, "seg")
            if seg is None:
                continue
            full = (seg.text or "") + "".join((c.text or "") + (c.tail or "") for c in seg)
            tuv.append({"lang": v.get(XML_LANG) or v.get("lang"), "text": seg.text or "", "full": full})
        out.append({"tuv": tuv, "created": tu.get("creationdate")})
    return out


def tmx_units(files: DataFrame) -> DataFrame:
    """(file_id, tuv, created) of every unit."""

    def run(file_id, content):
        for u in tmx_rows(content):
            yield file_id, u["tuv"], u["created"]

    return workers.mapped(files.select("file_id", "content"), run, "file_id string, tuv array<struct<lang:string,text:string,full:string>>, created string")


def new_tmx(pairs: list[tuple[str, str]], src: str, trg: str, created: str, datatype: str = "xml") -> bytes:
    """A TMX document of (source, target); ``created`` as TMX writes times."""
    root = ET.Element("tmx", {"version": "1.4"})
    ET.SubElement(root, "header", {"srclang": src, "datatype": datatype, "segtype": "sentence", "adminlang": "en", "o-tmf": "tmx", "creationtool": "bitextmill", "creationtoolversion": "1"})
    body = ET.SubElement(root, "body")
    for source, target in pairs:
        tu = ET.SubElement(body, "tu", {"creationdate": created})
        for lang, text in ((src, source), (trg, target)):
            ET.SubElement(ET.SubElement(tu, "tuv", {XML_LANG: lang}), "seg").text = text
    out = io.BytesIO()
    ET.ElementTree(root).write(out, encoding="UTF-8", xml_declaration=True)
    return out.getvalue()
