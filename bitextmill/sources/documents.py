"""Plain documents as translation units: text, JSON and PO, and their rebuilding with targets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import po

UNITS = "array<struct<unit_id:string,key:string,text:string,kind:string,attrs:map<string,string>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


# text


def text_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit_ord from 1, source, kind): one unit a line, its newline kept; blank lines are ignorables."""
    parts = F.split(F.col(text), "(?<=\n)")
    rows = docs.select(key, F.posexplode(parts).alias("_pos", "source")).where("source <> ''")
    kind = F.when(F.col("source").rlike(r"^\s*\z"), "ignorable").otherwise("segment")
    return rows.select(key, (F.col("_pos") + 1).alias("unit_ord"), "source", kind.alias("kind"))


def rebuilt_text(units: DataFrame, key: str) -> DataFrame:
    """(key, text) of units in order, each by its target or else its source."""
    unit = F.struct("unit_ord", F.coalesce("target", "source").alias("t"))
    return units.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(unit)), lambda u: u["t"]), "").alias("text"))


# JSON


def json_leaves(value, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], bool, object]]:
    """(path, in a list, leaf) depth first; the items of a list share their list's path."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in json_leaves(v, (*path, k))]
    if isinstance(value, list):
        return [(p, True, leaf) for v in value for p, _, leaf in json_leaves(v, path)]
    return [(path, False, value)]


def json_units(text: str) -> list[dict]:
    """Units of a JSON document. Blank leaves and leaves that are no strings are kept as ignorables without id.

    The path is kept whole, as a JSON array in ``attrs``, so that keys with dots survive; ``key`` is the dotted form.
    """
    out = []
    for n, (path, listed, leaf) in enumerate(json_leaves(json.loads(text)), 1):
        words = isinstance(leaf, str) and leaf.strip() != ""
        attrs = {"path": json.dumps(path, ensure_ascii=False), "list": str(listed).lower(), "raw": json.dumps(leaf, ensure_ascii=False)}
        out.append({"unit_id": str(n) if words else None, "key": ".".join(path), "text": leaf if isinstance(leaf, str) else json.dumps(leaf), "kind": "segment" if words else "ignorable", "attrs": attrs})
    return out


def rebuilt_json(units: list[dict], targets: dict[str, str]) -> str:
    """The document with targets by unit id in place of leaves."""
    root: dict = {}
    for u in units:
        path, raw = json.loads(u["attrs"]["path"]), json.loads(u["attrs"]["raw"])
        value = targets.get(u["unit_id"], raw) if u["unit_id"] else raw
        at = root
        for k in path[:-1]:
            at = at.setdefault(k, {})
        if not path:
            return json.dumps(value, ensure_ascii=False)
        if u["attrs"]["list"] == "true":
            at.setdefault(path[-1], []).append(value)
        else:
            at[path[-1]] = value
    return json.dumps(root, ensure_ascii=False, indent=4)


# PO

_KEYWORD = re.compile(r'^(msg[a-z_]+(?:\[\d+\])?)?\s*"(.*)"\s*$')
_SPACE = re.compile(r"(\s)")


def po_entries(text: str) -> list[dict]:
    """Entries of one PO text: comment lines and the values by keyword, continuation lines joined (tables: ``po.entries``)."""
    out = []
    for block in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n").strip("\n")):
        comments, values, last = [], {}, None
        for line in block.split("\n"):
            if line.startswith("#"):
                comments.append(line)
            elif m := _KEYWORD.match(line.strip()):
                last = m[1] or last
                if last:
                    values[last] = values.get(last, "") + m[2]
        if values or comments:
            out.append({"comments": "\n".join(comments), "values": values})
    return out


def po_units(text: str) -> list[dict]:
    """The first entry is the header; a plural is a second unit that refers to its entry by ``rid``."""
    out, given = [], 0
    for n, e in enumerate(po_entries(text)):
        v = e["values"]
        attrs = {"metadata": e["comments"], **{k: x for k, x in v.items() if k not in ("msgid", "msgid_plural")}}
        if n == 0 and not v.get("msgid"):
            out.append({"unit_id": None, "key": "header", "text": v.get("msgstr", ""), "kind": "ignorable", "attrs": attrs})
            continue
        given += 1
        unit = str(given)
        out.append({"unit_id": unit, "key": v.get("msgctxt"), "text": v.get("msgid", ""), "kind": "segment", "attrs": attrs})
        if "msgid_plural" in v:
            given += 1
            out.append({"unit_id": str(given), "key": v.get("msgctxt"), "text": v["msgid_plural"], "kind": "segment", "attrs": {"rid": unit}})
    return out


def po_wrapped(keyword: str, value: str, width: int = 80) -> str:
    """A keyword line; values of ``width`` and more are broken at white space into quoted lines after an empty one."""
    lines, now = [], ""
    for part in _SPACE.split(value):
        now += part
        if len(now) >= width and part.isspace():
            lines.append(now)
            now = ""
    lines.append(now)
    if len(lines) == 1:
        return f'{keyword} "{value}"'
    return "\n".join([f'{keyword} ""', *(f'"{x}"' for x in lines if x)])


def rebuilt_po(units: list[dict], targets: dict[str, str]) -> str:
    """The PO file with targets by unit id; what has none keeps its own translation."""
    plurals = {u["attrs"]["rid"]: u for u in units if "rid" in u["attrs"]}
    blocks = []
    for u in units:
        a = u["attrs"]
        if "rid" in a:
            continue
        lines = [a["metadata"]] if a.get("metadata") else []
        if "msgctxt" in a:
            lines.append(po_wrapped("msgctxt", a["msgctxt"]))
        lines.append(po_wrapped("msgid", "" if u["kind"] == "ignorable" else u["text"]))
        if (p := plurals.get(u["unit_id"])) is not None:
            lines.append(po_wrapped("msgid_plural", p["text"]))
            lines.append(po_wrapped("msgstr[0]", targets.get(u["unit_id"], a.get("msgstr[0]", ""))))
            lines.append(po_wrapped("msgstr[1]", targets.get(p["unit_id"], a.get("msgstr[1]", ""))))
            lines += [po_wrapped(k, a[k]) for k in sorted(a) if re.fullmatch(r"msgstr\[([2-9]|\d\d+)\]", k)]
        else:
            lines.append(po_wrapped("msgstr", targets.get(u["unit_id"], a.get("msgstr", ""))))
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) + "\n"


_PARSERS = {"json": json_units}
_WRITERS = {"json": rebuilt_json}


def document_units(docs: DataFrame, kind: str, key: str = "path") -> DataFrame:
    """(key, unit_ord, unit_id, unit_key, source, kind, attrs, error) of JSON or PO documents (key, text).

    A document that cannot be parsed is one row with the cause in ``error``.
    """
    if kind == "po":
        return po.units(docs, key)
    parse = _PARSERS[kind]

    @F.pandas_udf(f"struct<units:{UNITS},error:string>")
    def units(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((parse(t or ""), None))
            except (ValueError, RecursionError) as e:
                rows.append(([], str(e)[:200]))
        return pd.DataFrame(rows, columns=["units", "error"])

    rows = docs.select(key, units("text").alias("u")).select(key, "u.error", F.posexplode_outer("u.units").alias("_pos", "x"))
    return rows.select(key, (F.col("_pos") + 1).alias("unit_ord"), "x.unit_id", F.col("x.key").alias("unit_key"), F.col("x.text").alias("source"), "x.kind", "x.attrs", "error")


def rebuilt_documents(units: DataFrame, kind: str, key: str = "path") -> DataFrame:
    """(key, text) from units (``document_units`` with a column target), one file a group."""
    if kind == "po":
        return po.rebuilt(units, key)
    write = _WRITERS[kind]
    column = units.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit_ord")
        given = [{"unit_id": u.unit_id, "text": u.source, "kind": u.kind, "attrs": dict(u.attrs)} for u in rows.itertuples()]
        targets = {u.unit_id: u.target for u in rows.itertuples() if u.unit_id is not None and u.target}
        return pd.DataFrame({key: [rows[key].iloc[0]], "text": [write(given, targets)]})

    return units.where("error is null").select(key, "unit_ord", "unit_id", "source", "kind", "attrs", "target").groupBy(key).applyInPandas(run, f"{key} {column}, text string")
