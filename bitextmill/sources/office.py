"""Office documents (docx, odt, ods, odp): translatable paragraphs as token arrays, and documents with targets.

A paragraph's formatting becomes paired tags and its fields single tags; each refers to the XML it stands for, once per
unit. Rebuilding reads the original again and replaces the content of the same paragraphs, in the same order.
"""

from __future__ import annotations

import copy
import io
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import workers
from ..operators.segment import unit_parts
from ..schemas import TOKENS
from .bilingual import _token, local, parse

#: Name spaces: fixed values.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
DRAW = "{urn:oasis:names:tc:opendocument:xmlns:drawing:1.0}"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
PART = {"docx": "word/document.xml", "odt": "content.xml", "ods": "content.xml", "odp": "content.xml"}


def _xml(e: ET.Element) -> str:
    shown = copy.deepcopy(e)
    shown.tail = None
    return ET.tostring(shown, encoding="unicode")


def _content(e: ET.Element, tail: bool = False) -> tuple:
    """All that ``_xml`` shows, without writing it."""
    return (e.tag, tuple(e.attrib.items()), e.text, e.tail if tail else None, tuple(_content(c, True) for c in e))


class Unit:
    """Tokens and the XML that their tags stand for, by data id. ``shown``: XML by content, for all units of a file, so that a
    formatting that many runs have is written once."""

    def __init__(self, shown: dict[tuple, str]):
        self.tokens: list[dict] = []
        self.data: dict[str, str] = {}
        self.shown, self.refs = shown, {}

    def ref(self, e: ET.Element) -> str:
        content = _content(e)
        if content not in self.shown:
            self.shown[content] = _xml(e)
        xml = self.shown[content]
        k = self.refs.setdefault(xml, str(len(self.data) + 1))
        self.data[k] = xml
        return k

    def text(self, t: str | None) -> None:
        if t:
            self.tokens.append(_token("text", t))

    def single(self, e: ET.Element) -> None:
        k = self.ref(e)
        self.tokens.append(_token("tag", None, "ph", k, k, f"<{local(e)}/>"))

    def pair(self, e: ET.Element, name: str, inside) -> None:
        k = self.ref(e)
        self.tokens.append(_token("tag", None, "sc", k, k, f"<{name}-{k}>"))
        inside()
        self.tokens.append(_token("tag", None, "ec", k, k, f"</{name}-{k}>"))


def _shell(e: ET.Element, *children: ET.Element) -> ET.Element:
    out = ET.Element(e.tag, e.attrib)
    out.extend(copy.deepcopy(c) for c in children)
    return out


def _docx_part(e: ET.Element, unit: Unit) -> None:
    name = local(e)
    if name == "r":
        style = e.find(f"{W}rPr")
        walk = lambda: [_docx_part(c, unit) for c in e]
        if style is not None and len(style):
            unit.pair(_shell(ET.Element(f"{W}r"), style), "tag", walk)
        else:
            walk()
    elif name == "hyperlink":
        unit.pair(_shell(e), "link", lambda: [_docx_part(c, unit) for c in e])
    elif name == "t":
        unit.text(e.text)
    elif name in ("tab", "br", "drawing"):
        unit.single(e)


def _docx_paragraphs(root: ET.Element) -> list[ET.Element]:
    """Paragraphs with text, in the body and in tables; those inside text boxes after the one that holds the box."""
    out = []
    body = root.find(f"{W}body")
    for block in body if body is not None else ():
        if local(block) in ("p", "tbl"):
            out += [p for p in block.iter(f"{W}p") if p.find(f".//{W}t") is not None]
    return [p for p in out if any(t is not None for t in _own_texts(p))]


def _holds_paragraph(e: ET.Element) -> bool:
    return any(t == "p" or t.endswith("}p") for x in e.iter() if isinstance(t := x.tag, str))


def _own_texts(p: ET.Element):
    """Text elements of the paragraph itself, not of paragraphs in its boxes."""
    for c in p:
        if local(c) == "p":
            continue
        if local(c) == "t":
            yield c
        elif not _holds_paragraph(c):
            yield from _own_texts(c)


def _odf_part(e: ET.Element, unit: Unit) -> None:
    unit.text(e.text)
    for c in e:
        name = local(c)
        if name == "span":
            unit.pair(_shell(c), c.get(f"{TEXT}style-name", "span"), lambda c=c: _odf_part(c, unit))
        elif name == "a":
            unit.pair(_shell(c), "a", lambda c=c: _odf_part(c, unit))
        elif name == "frame" and c.find(f".//{DRAW}text-box") is None or name in ("line-break", "tab", "s"):
            unit.single(c)
        unit.text(c.tail)


def _odf_paragraphs(root: ET.Element) -> list[ET.Element]:
    return [p for p in root.iter() if p.tag in (f"{TEXT}p", f"{TEXT}h") and "".join(p.itertext()).strip()]


def _paragraphs(root: ET.Element, kind: str) -> list[ET.Element]:
    return _docx_paragraphs(root) if kind == "docx" else _odf_paragraphs(root)


def units_of(content: bytes, kind: str) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = parse(z.read(PART[kind]))
    return _units(_paragraphs(root, kind), kind)


def _units(paragraphs: list[ET.Element], kind: str) -> list[dict]:
    out, shown = [], {}
    for n, p in enumerate(paragraphs, 1):
        unit = Unit(shown)
        if kind == "docx":
            for c in p:
                if local(c) != "pPr" and not _holds_paragraph(c):
                    _docx_part(c, unit)
        else:
            _odf_part(p, unit)
        out.append({"unit_ord": n, "tokens": unit.tokens, "data": unit.data})
    return out


def _docx_fill(p: ET.Element, tokens: list[dict], data: dict[str, str], parsed: dict[str, ET.Element]) -> None:
    """``parsed``: elements by their XML, for all paragraphs of a file; what is put in is a copy."""
    for c in list(p):
        if local(c) != "pPr" and not _holds_paragraph(c):
            p.remove(c)
    holders, styles = [p], []

    def run(child: ET.Element) -> None:
        r = ET.SubElement(holders[-1], f"{W}r")
        if styles:
            r.append(copy.deepcopy(styles[-1]))
        r.append(child)

    for t in tokens:
        if t["kind"] == "text":
            text = ET.Element(f"{W}t", {SPACE: "preserve"})
            text.text = t["text"]
            run(text)
            continue
        xml = data.get(t["data_ref"])
        if xml is None:
            continue
        if xml not in parsed:
            parsed[xml] = ET.fromstring(xml)
        e = parsed[xml]
        if t["tag"] == "ph":
            run(copy.deepcopy(e))
        elif local(e) == "hyperlink":
            if t["tag"] == "sc":
                e = copy.deepcopy(e)
                holders[-1].append(e)
                holders.append(e)
            elif len(holders) > 1:
                holders.pop()
        elif t["tag"] == "sc":
            styles.append(e.find(f"{W}rPr"))
        elif styles:
            styles.pop()


def _odf_fill(p: ET.Element, tokens: list[dict], data: dict[str, str], parsed: dict[str, ET.Element]) -> None:
    for c in list(p):
        p.remove(c)
    p.text, stack = None, [p]
    for t in tokens:
        at = stack[-1]
        if t["kind"] == "text":
            if len(at):
                at[-1].tail = (at[-1].tail or "") + (t["text"] or "")
            else:
                at.text = (at.text or "") + (t["text"] or "")
        elif t["tag"] == "ec":
            if len(stack) > 1:
                stack.pop()
        elif t["data_ref"] in data:
            xml = data[t["data_ref"]]
            if xml not in parsed:
                parsed[xml] = ET.fromstring(xml)
            e = copy.deepcopy(parsed[xml])
            at.append(e)
            if t["tag"] == "sc":
                stack.append(e)


def rebuilt(content: bytes, kind: str, targets: dict[int, list[dict]]) -> bytes:
    """The document with targets by unit; other paragraphs and members stay as they are."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        z.getinfo(PART[kind])  # a file without it is no document
        members = [(i, z.read(i)) for i in z.infolist()]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info, body in members:
            if info.filename == PART[kind]:
                for _, (prefix, uri) in ET.iterparse(io.BytesIO(body), events=["start-ns"]):
                    if not prefix.startswith("ns"):
                        ET.register_namespace(prefix, uri)
                root = parse(body)
                paragraphs = _paragraphs(root, kind)
                data = [u["data"] for u in _units(paragraphs, kind)]  # all of them before any is filled
                parsed: dict[str, ET.Element] = {}
                for n, p in enumerate(paragraphs, 1):
                    if n in targets:
                        (_docx_fill if kind == "docx" else _odf_fill)(p, targets[n], data[n - 1], parsed)
                body = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            z.writestr(info, body)
    return out.getvalue()


def office_units(files: DataFrame, kind: str) -> DataFrame:
    """(file_id, unit_ord, unit_id, source tokens, data) of files (file_id, content)."""

    def run(file_id, content):
        for u in units_of(content, kind):
            yield file_id, u["unit_ord"], str(u["unit_ord"]), u["tokens"], list(u["data"].items())

    return workers.mapped(files.select("file_id", "content"), run, f"file_id string, unit_ord int, unit_id string, source {TOKENS}, data map<string,string>")


def office_segments(files: DataFrame, kind: str, segmentation: bool = True) -> DataFrame:
    """Units of files (file_id, content) cut into segments and ignorables, segments numbered per file, as ``segmented`` does; a
    file is one row here, so nothing is shuffled and each file is read once."""

    def run(file_id, content):
        number = 0
        for u in units_of(content, kind):
            data = list(u["data"].items())
            for k, (part, tokens) in enumerate(unit_parts(u["tokens"], segmentation)):
                number += part == "segment"
                yield file_id, u["unit_ord"], str(u["unit_ord"]), k, part, tokens, data, str(number) if part == "segment" else None

    schema = f"file_id string, unit_ord int, unit_id string, seg_ord int, kind string, source {TOKENS}, data map<string,string>, segment_id string"
    return workers.mapped(files.select("file_id", "content"), run, schema)


def rebuilt_files(files: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """(file_id, content) with ``targets`` (file_id, unit_ord, seg_ord, tokens), one file a row."""
    part = F.struct("unit_ord", "seg_ord", "tokens")
    listed = targets.groupBy("file_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))

    def run(file_id, content, parts):
        units: dict[int, list] = {}
        for p in parts or ():
            units.setdefault(p["unit_ord"], []).extend(p["tokens"])
        yield file_id, rebuilt(content, kind, units)

    joined = files.join(listed, "file_id", "left").select("file_id", "content", "parts")
    return workers.mapped(joined, run, "file_id string, content binary", lambda r: len(r[1]))
