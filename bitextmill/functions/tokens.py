"""Segments with inline tags: token arrays to entries (``<tag-N/>`` in escaped text) and back, and display forms."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import TOKENS

#: Tags whose first letter tells opening from closing; such a pair shares its number.
_PAIRED = {"s": "e", "e": "s"}
_PART = re.compile(r"<(?P<name>[^<>\s/]+?)-(?P<number>\d+)/>|(?P<text>[^<>]+)")


def _token(**values) -> dict:
    return {k: values.get(k) for k in ("kind", "tag", "id", "data_ref", "equiv", "text")}


def entry_of(tokens, numbers: dict | None = None) -> tuple[str, dict]:
    """The entry of a segment, and the tag numbers by (name, id) to use for its other side.

    A tag gets the next number at its first appearance; its opposite (``sc`` and ``ec``) with the same id shares it.
    """
    numbers, out = dict(numbers or {}), []
    for t in tokens if tokens is not None else ():
        if t["kind"] != "tag":
            out.append(html.escape(t["text"] or ""))
        elif t["id"] is None:
            out.append(t["text"] or "")
        else:
            name = t["tag"]
            other = _PAIRED.get(name[:1], name[:1]) + name[1:]
            number = numbers.get((name, t["id"]), numbers.get((other, t["id"])))
            if number is None:
                number = len(set(numbers.values())) + 1
            numbers[name, t["id"]] = number
            out.append(f"<{name}-{number}/>")
    return "".join(out), numbers


def tokens_of(entry: str | None, numbers: dict | None = None, safe: bool = True) -> list[dict]:
    """The tokens of an entry. Safe: tags that ``numbers`` (of the query) lacks are dropped; otherwise kept as shown."""
    back = {(name, n): key for (name, key), n in (numbers or {}).items()}
    out = []
    for m in _PART.finditer(entry or ""):
        if m["text"] is not None:
            out.append(_token(kind="text", text=html.unescape(m["text"])))
            continue
        name, number = m["name"], int(m["number"])
        if (name, number) in back:
            out.append(_token(kind="tag", tag=name, id=back[name, number]))
        elif not safe:
            out.append(_token(kind="tag", tag=name, id=str(number), equiv=m[0]))
    return out


def entry_pair(source: Column | str, target: Column | str) -> Column:
    """struct(entry, other): entries of both sides, the target with the source's tag numbers."""

    @F.pandas_udf("struct<entry:string,other:string>")
    def run(source: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t in zip(source, target):
            entry, numbers = entry_of(s)
            rows.append((entry, entry_of(t, numbers)[0] if t is not None else None))
        return pd.DataFrame(rows, columns=["entry", "other"])

    return run(source, target)


def entry(tokens: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: entry_of(t)[0])

    return run(tokens)


def tokens(entry_: Column, query: Column | None = None, safe: bool = False) -> Column:
    """Token array of an entry; with ``query`` tokens, tags are mapped back on the query's."""
    if query is None:

        @F.pandas_udf(TOKENS)
        def plain(e: pd.Series) -> pd.Series:
            return e.map(lambda x: tokens_of(x, None, safe))

        return plain(entry_)

    @F.pandas_udf(TOKENS)
    def mapped(e: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([tokens_of(x, entry_of(y)[1], safe) for x, y in zip(e, q)])

    return mapped(entry_, query)


def plain_text(tokens_: Column) -> Column:
    """Text without tags."""
    return F.array_join(F.transform(F.filter(tokens_, lambda t: t["kind"] == "text"), lambda t: F.coalesce(t["text"], F.lit(""))), "")


def shown(tokens_: Column) -> Column:
    """Text with tags as an editor shows them: their ``equiv`` or ``<name-id/>``."""
    tag = lambda t: F.coalesce(t["equiv"], F.concat(F.lit("<"), t["tag"], F.coalesce(F.concat(F.lit("-"), t["id"]), F.lit("")), F.lit("/>")))
    return F.array_join(F.transform(tokens_, lambda t: F.when(t["kind"] == "text", F.coalesce(t["text"], F.lit(""))).otherwise(tag(t))), "")


def html_unescape(c: Column) -> Column:
    """Every named and numeric entity."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return run(c)
