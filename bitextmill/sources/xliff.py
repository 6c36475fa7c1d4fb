"""XLIFF 1.2, XLIFF 2 (plain and annotated) and SDLXLIFF read by Spark's own functions: no Python worker sees a file.

A file's text is cut into units, a unit into segments and a side into its marks and texts by patterns; a fold over these pairs
opening and closing tags. All is local to the file's row, so reading needs no shuffle and only what is selected is computed.

Elements and attributes may have any prefix. Files are UTF-8, ISO-8859-1 if declared, or UTF-16 with a byte order mark; other
encodings, entity declarations, other roots and marks that do not balance are refused with the cause in ``error``.

Nulls: null content is an empty file, which is refused. Empty sides have no tokens; a side that is missing is null (version 2)
or has no tokens. Two marked segments of one id in a unit share their tokens. A unit of an SDL file in which a marked segment
has no definition is refused with its file.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TOKENS

#: Name space of SDL's elements, and elements that make a file an annotated one: fixed values.
SDL = "http://sdl.com/FileTypes/SdlXliff/1.0"
ANNOTATIONS = ("history", "locQualityIssues", "internal-file")

_PREFIX = r"(?:[\w.-]+:)?"
_INSIDE = r"""(?:[^"'<>/]++|/(?!>)|"[^"]*"|'[^']*')*+"""
_MARK = rf"<{_INSIDE}/?>"
#: Characters that no text holds stand for white space given by number, which attributes keep.
_STANDS, _SPACES = "\ufdd0\ufdd1\ufdd2", "\n\t\r"
_KEPT = {38: "&amp;", 60: "&lt;", 62: "&gt;", 34: "&quot;", 39: "&apos;", 10: _STANDS[0], 9: _STANDS[1], 13: _STANDS[2]}
_HTML = ",".join(f"{name}:{code}" for name, code in name2codepoint.items()) + ",apos:39"
_MARKED = f"array<struct<mid:string,token:{TOKENS.removeprefix('array<').removesuffix('>')}>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also inside of lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def resolved(text: Column, names: str, kept: Column | None = None) -> Column:
    """Text with its numeric references and those by ``names`` resolved, each once; others stay. ``kept``: what to put for characters."""
    table = F.str_to_map(F.lit(names), F.lit(","), F.lit(":"))

    def coded(p: Column) -> Column:
        name = F.regexp_extract(p, r"\A&([^;&]+);", 1)
        number = F.when(name.startswith("#x"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2))).otherwise(F.try_element_at(table, name))
        return F.struct(p.alias("p"), F.try_to_number(F.regexp_extract(number, r"\A0*(\d{1,7})\z", 1), F.lit("9999999")).cast("long").alias("code"))

    def put(x: Column) -> Column:
        valid = x["code"].between(1, 0x10FFFF) & ~x["code"].between(0xD800, 0xDFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(x["code"]), 8, "0")), "UTF-32")
        shown = character if kept is None else F.coalesce(F.try_element_at(kept, x["code"]), character)
        return F.when(valid, F.concat(shown, F.regexp_replace(x["p"], r"\A&[^;]+;", ""))).otherwise(x["p"])

    pieces = F.split(text, r"(?=&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)")
    return F.when(text.contains("&"), F.array_join(F.transform(F.transform(pieces, coded), put), "")).otherwise(text)


def unescaped(text: Column) -> Column:
    """Text of a file whose numeric references are resolved (``_bare``), with the five named ones resolved."""
    for name, character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    return F.translate(text, _STANDS, _SPACES)


def _pattern(name: str) -> str:
    return rf"(?s)<{_PREFIX}{name}(?=[\s/>]){_INSIDE}(?:/>|>(.*?)</{_PREFIX}{name}\s*>)"


def _elements(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(_pattern(name)), F.lit(0))


def _children(inside: Column) -> Column:
    """Elements one level below; one that holds its own name again ends at the first end tag."""
    return F.regexp_extract_all(inside, F.lit(rf"(?s)<([\w.:-]+)(?=[\s/>]){_INSIDE}(?:/>|>.*?</\1\s*>)"), F.lit(0))


def _inside(xml: Column, name: str) -> Column:
    """What the first element of the name holds, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(xml, F.lit(_pattern(name)), F.lit(1)), F.lit(1))


def _words(inside: Column) -> Column:
    return unescaped(F.regexp_replace(inside, _MARK, ""))


def _own(xml: Column) -> Column:
    """All text of an element."""
    return F.coalesce(_words(xml), F.lit(""))


def _value(quoted: Column) -> Column:
    return unescaped(F.translate(F.regexp_replace(quoted, r"(?s)\A.|.\z", ""), "\n\t", "  "))


def attribute(mark: Column, name: str) -> Column:
    """An attribute of the element that ``mark`` begins with, null if it has none of that name. Pass long elements' ``_head``."""
    skipped = r"""\A<[^\s/>]+(?:\s+[^\s=]+\s*=\s*(?:"[^"]*"|'[^']*'))*?"""
    pattern = rf"""{skipped}\s+{name}\s*=\s*("[^"]*"|'[^']*')"""
    return _value(F.nullif(F.regexp_extract(mark, pattern, 1), F.lit("")))


def _head(element: Column) -> Column:
    """The mark that an element begins with."""
    return F.regexp_extract(element, rf"(?s)\A{_MARK}", 0)


def _attributes(element: Column) -> Column:
    """Attributes of an element by name, without prefixes and declarations of name spaces."""
    head = F.regexp_extract(element, rf"(?s)\A{_MARK}", 0)
    pattern = F.lit(r"""\s([^\s=]+)\s*=\s*("[^"]*"|'[^']*')""")
    pairs = F.arrays_zip(F.regexp_extract_all(head, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(head, pattern, F.lit(2)).alias("v"))
    own = F.filter(pairs, lambda p: ~p["k"].rlike("^xmlns(:|$)"))
    named = F.transform(own, lambda p: F.struct(F.regexp_replace(p["k"], "^[^:]*:", "").alias("k"), _value(p["v"]).alias("v")))
    first = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return let(named, lambda all_: F.map_from_entries(F.when(F.size(F.array_distinct(F.transform(all_, lambda p: p["k"]))) == F.size(all_), all_).otherwise(first(all_))))


def _name(mark: Column) -> Column:
    return F.regexp_extract(mark, rf"\A</?{_PREFIX}([\w.-]+)", 1)


def _token(kind: str, tag=None, id_=None, ref=None, equiv=None, text=None) -> Column:
    given = {"tag": tag, "id": id_, "data_ref": ref, "equiv": equiv, "text": text}
    return F.struct(F.lit(kind).alias("kind"), *((F.lit(None) if v is None else v).cast("string").alias(k) for k, v in given.items()))


def _items(inside: Column) -> Column:
    return F.regexp_extract_all(inside, F.lit(rf"(?s){_MARK}|[^<]+"), F.lit(0))


def tokens_v2(inside: Column) -> Column:
    """Tokens of a version-2 side: its texts and the marks at its top level."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast(TOKENS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        mark, end, top = x.startswith("<"), x.startswith("</"), s["depth"] == 0
        tag = _token("tag", _name(x), attribute(x, "id"), attribute(x, "dataRef"), resolved(attribute(x, "equiv"), _HTML))
        out = F.when(top & ~mark, F.concat(s["out"], F.array(_token("text", text=unescaped(x))))).when(top & mark & ~end, F.concat(s["out"], F.array(tag))).otherwise(s["out"])
        depth = s["depth"] + F.when(~mark, 0).when(end, -1).when(x.endswith("/>"), 0).otherwise(1)
        return F.struct(depth.alias("depth"), out.alias("out"))

    return F.aggregate(_items(inside), start, step, lambda s: s["out"])


def tokens_v1(inside: Column) -> Column:
    """(mid, token) of a version-1 side: ``g`` opens and closes, ``mrk`` only says whose its tokens are, others stand alone."""
    stack = "array<struct<name:string,id:string,mid:string>>"
    start = F.struct(F.array().cast(stack).alias("open"), F.lit(0).alias("skip"), F.array().cast(_MARKED).alias("out"))

    def seen_item(x: Column) -> Column:
        mark, end = x.startswith("<"), x.startswith("</")
        return F.struct(x.alias("x"), mark.alias("mark"), end.alias("end"), (mark & ~end & ~x.endswith("/>")).alias("enters"), _name(x).alias("name"), F.coalesce(attribute(x, "id"), F.lit("N/A")).alias("id"), attribute(x, "mid").alias("mid"))

    def step(s: Column, i: Column) -> Column:
        top, last, none = s["skip"] == 0, F.try_element_at(s["open"], F.lit(-1)), F.array().cast(_MARKED)
        tag = lambda n, id_, left, right: F.struct(last["mid"].alias("mid"), _token("tag", n, id_, None, F.concat(F.lit(left), n, F.lit("-"), id_, F.lit(right))).alias("token"))
        g, kept = F.lit("g"), i["name"].isin("g", "mrk")
        new = (
            F.when(~top, none)
            .when(~i["mark"], F.array(F.struct(last["mid"].alias("mid"), _token("text", text=unescaped(i["x"])).alias("token"))))
            .when(i["end"], F.when(last["name"] == "g", F.array(tag(g, last["id"], "</", ">"))).otherwise(none))
            .when(i["name"] == "mrk", none)
            .when((i["name"] == "g") & i["enters"], F.array(tag(g, i["id"], "<", ">")))
            .when(i["name"] == "g", F.array(tag(g, i["id"], "<", ">"), tag(g, i["id"], "</", ">")))
            .otherwise(F.array(tag(i["name"], i["id"], "<", "/>")))
        )
        pushed = F.array(F.struct(i["name"].alias("name"), i["id"].alias("id"), F.when(i["name"] == "mrk", F.coalesce(i["mid"], last["mid"])).otherwise(last["mid"]).alias("mid")))
        popped = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        open_ = F.when(top & i["enters"] & kept, F.concat(s["open"], pushed)).when(top & i["end"], popped).otherwise(s["open"])
        skip = s["skip"] + F.when(top, F.when(i["enters"] & ~kept, 1).otherwise(0)).when(i["enters"], 1).when(i["end"], -1).otherwise(0)
        return F.struct(open_.alias("open"), skip.alias("skip"), F.concat(s["out"], new).alias("out"))

    return F.aggregate(F.transform(_items(inside), seen_item), start, step, lambda s: s["out"])


def _row(unit_ord, unit_id, seg_ord, segment_id, kind, source, target, **more: Column) -> Column:
    none = F.lit(None).cast("string")
    given = {"unit_ord": unit_ord.cast("int"), "unit_id": unit_id, "seg_ord": seg_ord.cast("int"), "segment_id": segment_id, "kind": kind, "source": F.coalesce(source, F.array().cast(TOKENS)), "target": target}
    given |= {k: more.get(k, none) for k in ("state", "sub_state", "lock", "modified_on", "modified_by")}
    return F.struct(*(v.alias(k) for k, v in given.items()))


def _side_v2(element: Column, name: str) -> Column:
    return tokens_v2(_inside(element, name))


def _unit_v2(xml: Column, n: Column) -> Column:
    """Segments of a unit; earlier versions have segments of the same name, which are no part of the text."""
    pattern = rf"(?s)<{_PREFIX}(segment|ignorable)(?=[\s/>]){_INSIDE}(?:/>|>.*?</{_PREFIX}\1\s*>)"
    found = F.regexp_extract_all(F.regexp_replace(xml, _pattern("history"), ""), F.lit(pattern), F.lit(0))

    def rows(id_: Column) -> Column:
        """The unit's id and each segment's first mark are taken once, so a unit of many segments is not read for each of them."""
        a = attribute
        return F.transform(
            F.transform(found, lambda x: F.struct(x.alias("x"), _head(x).alias("h"))),
            lambda p, s: _row(n + 1, id_["v"], s, a(p["h"], "id"), _name(p["h"]), _side_v2(p["x"], "source"), _side_v2(p["x"], "target"), state=a(p["h"], "state"), sub_state=a(p["h"], "subState"), modified_on=a(p["h"], "modified_on"), modified_by=a(p["h"], "modified_by")),
        )

    return let(F.struct(attribute(_head(xml), "id").alias("v")), rows)


def _marks(inside: Column) -> Column:
    return F.regexp_extract_all(inside, F.lit(rf"<{_PREFIX}mrk(?=[\s/>]){_INSIDE}/?>"), F.lit(0))


def _definition(unit: Column, id_: Column) -> Column:
    """SDL's definition of a segment."""
    marks = F.regexp_extract_all(unit, F.lit(rf"<[\w.-]+:seg(?=[\s/>]){_INSIDE}/?>"), F.lit(0))
    return F.try_element_at(F.filter(marks, lambda d: attribute(d, "id").eqNullSafe(id_)), F.lit(-1))


def _plain_unit(xml: Column) -> Column:
    return F.regexp_replace(xml, _pattern("alt-trans"), "")


def _seg_marks(unit: Column) -> Column:
    return F.filter(_marks(_inside(unit, "seg-source")), lambda x: attribute(x, "mtype") == "seg")


def _unit_v1(xml: Column, n: Column, sdl: Column) -> Column:
    """Segments of a unit: its marked ones, matched by ``mid``, or the whole unit."""

    def pairs(z: Column) -> Column:
        of = lambda side, mid: F.transform(F.filter(side, lambda t: t["mid"].eqNullSafe(mid)), lambda t: t["token"])
        whole = lambda side: F.transform(F.coalesce(side, F.array().cast(_MARKED)), lambda t: t["token"])
        found = lambda mid: F.try_element_at(F.filter(z["marks"], lambda m: attribute(m, "mid").eqNullSafe(mid)), F.lit(-1))
        empty = F.array().cast(TOKENS)

        def marked(m: Column, s: Column) -> Column:
            mid, defined = attribute(m, "mid"), F.when(sdl, _definition(z["xml"], attribute(m, "mid")))
            state = F.when(sdl, attribute(defined, "conf")).otherwise(attribute(found(mid), "state"))
            return _row(n + 1, z["id"], s, mid, F.lit("segment"), of(z["source"], mid), F.coalesce(of(z["target"], mid), empty), state=state, lock=attribute(defined, "locked"))

        side = z["source"]
        state = attribute(F.try_element_at(_elements(z["xml"], "target"), F.lit(1)), "state")
        single = _row(n + 1, z["id"], F.lit(0), F.lit("N/A"), F.lit("segment"), whole(side), whole(z["target"]), state=state)
        several = F.transform(z["segments"], marked)
        return F.when(F.size(z["segments"]) > 0, several).otherwise(F.filter(F.array(single), lambda _: ~sdl & side.isNotNull()))

    def parts(unit: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.struct(
            unit.alias("xml"), attribute(_head(unit), "id").alias("id"), tokens_v1(F.coalesce(_inside(unit, "seg-source"), _inside(unit, "source"))).alias("source"), tokens_v1(_inside(unit, "target")).alias("target"),
            F.coalesce(_seg_marks(unit), none).alias("segments"), F.coalesce(_marks(_inside(unit, "target")), none).alias("marks"),
        )

    return let(let(_plain_unit(xml), parts), pairs)


def _undefined(xml: Column) -> Column:
    """The marked segments of an SDL unit that have no definition."""
    return let(_plain_unit(xml), lambda unit: F.filter(F.transform(F.coalesce(_seg_marks(unit), F.array().cast("array<string>")), lambda m: attribute(m, "mid")), lambda mid: _definition(unit, mid).isNull()))


def _remarks(xml: Column, n: Column) -> Column:
    """Notes, quality issues, original data and further attributes of a unit."""
    remark = lambda kind, attrs, text: F.struct((n + 1).cast("int").alias("unit_ord"), F.lit(kind).alias("kind"), attrs.alias("attrs"), text.cast("string").alias("text"))
    each = lambda name, kind: F.transform(_children(F.coalesce(_inside(xml, name), F.lit(""))), lambda e: remark(kind, _attributes(e), _own(e)))
    own = _attributes(xml)
    more = F.filter(F.array(remark("unit", own, F.lit(None))), lambda r: F.size(F.map_filter(r["attrs"], lambda k, _: k != "id")) > 0)
    return F.concat(each("notes", "note"), each("locQualityIssues", "lqi"), each("originalData", "data"), more)


def _history(xml: Column, n: Column) -> Column:
    """Earlier versions of targets, oldest first."""
    known = lambda e, name: F.nullif(attribute(e, name), F.lit("N/A"))
    inner = lambda e: F.coalesce(F.regexp_extract(e, rf"(?s)\A{_MARK}(.*)</[^<>]*>\z", 1), F.lit(""))

    def version(segment: Column):
        return lambda e, v: F.struct(
            (n + 1).cast("int").alias("unit_ord"), attribute(segment, "id").alias("segment_id"), (v + 1).cast("int").alias("version_ord"), tokens_v2(inner(e)).alias("target"),
            known(e, "state").alias("state"), known(e, "modified_on").alias("modified_on"), known(e, "modified_by").alias("modified_by"),
        )

    segments = F.flatten(F.transform(_elements(xml, "history"), lambda h: _children(inner(h))))
    return F.flatten(F.transform(segments, lambda s: F.transform(_children(inner(s)), version(s))))


def _text(content: Column) -> tuple[Column, Column]:
    """Text of a file and why it has none."""
    raw = F.coalesce(content, F.lit(b""))
    head = F.decode(F.substring(raw, 1, 200), "ISO-8859-1")
    declared = F.upper(F.regexp_extract(head, r"""\A[^<]*<\?xml[^>]*?encoding\s*=\s*["']([^"']*)""", 1))
    wide = F.hex(F.substring(raw, 1, 2)).isin("FEFF", "FFFE") & (F.length(raw) % 2 == 0)
    utf8 = raw.cast("string")
    text = F.when(wide, F.decode(raw, "UTF-16")).when(declared == "ISO-8859-1", F.decode(raw, "ISO-8859-1")).when(declared.isin("", "UTF-8", "UTF8", "US-ASCII") & F.is_valid_utf8(utf8), utf8)
    return text, F.when(text.isNull(), F.when(declared.isin("", "UTF-8", "UTF8", "US-ASCII"), F.lit("not well-formed: no UTF-8 text")).otherwise(F.concat(F.lit("encoding "), declared, F.lit(" is not read"))))


def _bare(text: Column) -> Column:
    """Text with one kind of line end, literal sections as escaped text, and nothing that is neither mark nor text."""
    text = F.regexp_replace(F.regexp_replace(text, r"\A\x{FEFF}", ""), "\r\n?", "\n")

    def section(piece: Column, i: Column) -> Column:
        end = F.instr(piece, "]]>")
        literal = F.substr(piece, F.lit(1), end - 1)
        for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            literal = F.replace(literal, F.lit(plain), F.lit(name))
        return F.when((i == 0) | (end == 0), piece).otherwise(F.concat(literal, F.substr(piece, end + 3)))

    text = F.when(text.contains("<![CDATA["), F.array_join(F.transform(F.split(text, r"<!\[CDATA\["), section), "")).otherwise(text)
    return F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", "")


def _numbered(text: Column) -> Column:
    """Text with its numeric references resolved; characters that mark up are named instead."""
    kept = F.create_map(*(F.lit(x) for code, name in _KEPT.items() for x in (code, name)))
    return F.when(text.contains("&#"), resolved(text, "none:0", kept.cast("map<bigint,string>"))).otherwise(text)


def opened(files: DataFrame) -> DataFrame:
    """``files`` (file_id, content) with the struct ``f`` of everything in it: format, version, languages, segments, remarks,
    history, the original's text, or the cause why it cannot be read; ``_format`` and ``_error`` are its fields once more."""
    text, problem = _text(F.col("content"))
    c, own = (lambda name: F.col("_x_" + name)), files.columns
    put = lambda rows, **more: rows.withColumns({"_x_" + k: v for k, v in more.items()})
    rows = put(files, raw=text, problem=problem)
    rows = put(rows, bare=_bare(F.coalesce(c("raw"), F.lit(""))), entities=F.coalesce(F.substring(c("raw"), 1, 65_536).contains("<!ENTITY"), F.lit(False)))
    rows = put(rows, text=_numbered(c("bare")))
    count = lambda p: F.regexp_count(c("text"), F.lit(p))
    rows = put(
        rows,
        root=F.regexp_extract(c("text"), rf"(?s)\A\s*({_MARK})", 1), first=F.regexp_extract(c("text"), rf"<{_PREFIX}file(?=[\s/>]){_INSIDE}/?>", 0),
        prefix=F.regexp_extract(c("text"), rf"""xmlns:([\w.-]+)\s*=\s*["']{SDL.replace(".", "[.]")}["']""", 1), annotated=c("text").rlike(rf"<{_PREFIX}(?:{'|'.join(ANNOTATIONS)})(?=[\s/>])"),
        whole=(count("<") == count(_MARK)) & (count(rf"<(?!/){_INSIDE}>") == count("</")),
    )
    rows = put(rows, name=_name(c("root")), version=attribute(c("root"), "version"))
    rows = put(rows, number=F.regexp_extract(F.coalesce(c("version"), F.lit("1.2")), r"\A(\d+(?:\.\d?)?)", 1))
    rows = put(rows, v2=F.coalesce(F.when(c("number") != "", c("number").cast("double") >= 2), F.lit(False)))
    rows = put(rows, sdl=~c("v2") & (c("prefix") != "") & c("text").contains(F.concat(F.lit("<"), c("prefix"), F.lit(":"))))
    rows = put(rows, undefined=F.when(c("sdl"), F.try_element_at(F.flatten(F.transform(_elements(c("text"), "trans-unit"), _undefined)), F.lit(1))))
    error = (
        F.when(c("problem").isNotNull(), c("problem"))
        .when(c("entities"), "entity declarations are not read")
        .when(c("root") == "", "not well-formed: no element")
        .when(~c("whole"), "not well-formed: marks do not balance")
        .when(c("name") == "tmx", "a TMX file holds no segments; use tmx_units")
        .when(c("name") != "xliff", F.concat(F.lit("not a bilingual file: "), c("name")))
        .when(c("number") == "", "the version is no number")
        .when(c("undefined").isNotNull(), F.concat(F.lit("segment "), c("undefined"), F.lit(" has no definition")))
    )
    kind = F.when(c("name") == "tmx", "tmx").when(c("v2"), F.when(c("annotated"), "kxliff").otherwise("xliff2")).when(c("sdl"), "sdlxliff").otherwise("xliff1")
    rows = put(rows, error=error, kind=kind)
    fine = c("error").isNull()
    known = fine | c("undefined").isNotNull() | ((c("name") == "tmx") & c("whole") & c("problem").isNull() & ~c("entities"))
    none = F.array().cast("array<string>")
    units = lambda when, name, use: F.flatten(F.transform(F.when(fine & when, _elements(c("text"), name)).otherwise(none), use))
    lang = lambda new, before: F.when(fine, F.when(c("v2"), attribute(c("root"), new)).otherwise(attribute(c("first"), before)))
    form = F.when(known, c("kind"))
    f = F.struct(
        form.alias("format"), F.when(known, c("version")).alias("version"), lang("srcLang", "source-language").alias("src_lang"), lang("trgLang", "target-language").alias("trg_lang"),
        F.when(known, attribute(c("first"), "original")).alias("original"),
        F.concat(units(c("v2"), "unit", _unit_v2), units(~c("v2"), "trans-unit", lambda x, n: _unit_v1(x, n, c("sdl")))).alias("segments"),
        units(c("v2"), "unit", _remarks).alias("remarks"), units(c("v2"), "unit", _history).alias("history"),
        F.when(fine & c("v2"), _words(_inside(c("text"), "internal-file"))).alias("internal"), c("error").alias("error"),
    )
    # a struct of which two fields are read is computed whole, so what is read beside others stands on its own, too
    return rows.select(*own, f.alias("f"), form.alias("_format"), c("error").alias("_error"))
