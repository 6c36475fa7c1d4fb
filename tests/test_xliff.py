"""The native reader of bilingual files against the standard library's parser."""

import pytest
from pyspark.sql import functions as F

from bitextmill.sources import bilingual, xliff

from .test_sources import SDL, V1, V2

HARD2 = """<?xml version="1.0" encoding="UTF-8"?>
<!-- <unit id="no"/> --><x:xliff xmlns:x="urn:oasis:names:tc:xliff:document:2.0" xmlns:k="urn:some:annotations" version="2.0" srcLang='en' trgLang="fr">
<x:file id="1" original="a &quot;b&quot; > c.docx"><k:internal-file form="base64">QUJD</k:internal-file><x:group id="g"><x:unit name="n &lt; m" id="u 1" xml:space="preserve">
<k:history><k:segment id="1"><k:target state="translated" modified_on="N/A" modified_by="me">old <x:ph id="1"/></k:target><k:target state="N/A">older</k:target></k:segment></k:history>
<k:locQualityIssues><k:locQualityIssue id="1" segment="1" type="grammar" comment="a &amp;lt; b&#10;c\td" severity="3" resolved="false"/></k:locQualityIssues>
<x:notes><x:note id="1" segment="1" state='open'>say "x" &#x2014; <b>not</b> so</x:note><x:note id="2"/></x:notes>
<x:segment id="1" state="final" subState="a:b" modified_on="2024" modified_by="M &#38; N"><x:source>A &amp;amp; B &#169;&lt;c&gt;<x:pc id="1" equiv="&amp;nbsp;&amp;lt;b&amp;gt;">inner <x:ph id="9"/></x:pc> tail<![CDATA[ <raw> & ]]>end<!-- gone --> more</x:source><x:target/></x:segment>
<x:ignorable><x:source>
\t</x:source></x:ignorable><x:segment><x:target>only target <x:sc id="7" dataRef="d1"/>\U0001f600</x:target></x:segment></x:unit><x:unit id="empty"/></x:group></x:file></x:xliff>""".encode()
HARD1 = """<?xml version="1.0"?><!DOCTYPE xliff><xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file source-language="en" target-language="de" original="o"><header/><body>
<trans-unit id="1"><source>s</source><seg-source><g id="1"><mrk mtype="seg" mid="1">A <g id="2">b<g id="3"/></g><mrk mtype="term">t</mrk></mrk></g> <mrk mid="2" mtype="seg"/><mrk mtype="seg" mid="3"><ph id="4">code <x id="5"/></ph>z<it/></mrk></seg-source>
<target><mrk mtype="seg" mid="1" state="x-locked-new">B &gt; <bx id="2"/></mrk><mrk mtype="seg" mid="3"></mrk></target></trans-unit>
<group><trans-unit id="2"><source>whole <g id="1">x<x id="2"/></g></source><alt-trans><source>other</source><target state="final">wrong</target></alt-trans></trans-unit></group>
<trans-unit id="3"><source>a</source><target state="signed-off">b</target></trans-unit><trans-unit id="4"><source/></trans-unit><trans-unit id="5"><target>lone</target></trans-unit></body></file></xliff>""".encode()
BAD = [b"", b"<nope/>", b"<broken", b"<xliff version='2.0'><file></xliff>", b'<!DOCTYPE x [<!ENTITY a "b">]><xliff version="2.0"/>', b"\xff\xffx", b"<tmx version='1.4'><body/></tmx>", SDL.replace(b'<sdl:seg id="1"', b'<sdl:seg id="9"'), b"<xliff version='x'/>"]
EMPTY = [b'<xliff version="2.0"/>', b'<xliff><file original="a"><body/></file></xliff>']


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k.rpartition("}")[2]: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def joined(tokens):
    """Tokens with neighbouring texts as one: comments and literal sections part texts in one reader, not in the other."""
    out = []
    for t in tokens or []:
        if t["kind"] == "text" and out and out[-1]["kind"] == "text":
            out[-1] = out[-1] | {"text": out[-1]["text"] + t["text"]}
        else:
            out.append(t)
    return out


@pytest.mark.parametrize("content", [V2, V1, SDL, HARD2, HARD1, HARD2.decode().encode("utf-16").replace(b"\xff\xfeU", b"\xff\xfeU"), *EMPTY])
def test_rows_equal_the_parser(spark, content):
    wanted = bilingual.file_rows(content.decode("utf-16").replace(' encoding="UTF-8"', "").encode() if content[:2] == b"\xff\xfe" else content)
    got = plain(xliff.opened(spark.createDataFrame([("f", bytearray(content), 1)], "file_id string, content binary, text int")).first().f)
    wanted = plain(wanted)
    assert wanted["error"] is None
    for s in got["segments"] + wanted["segments"] + got["history"] + wanted["history"]:
        for side in ("source", "target"):
            if s.get(side) is not None:
                s[side] = joined(s[side])
    key = lambda r: (r["unit_ord"], r["kind"], sorted(r["attrs"].items()))
    got["remarks"], wanted["remarks"] = sorted(got["remarks"], key=key), sorted(wanted["remarks"], key=key)
    for name in wanted:
        assert got[name] == wanted[name], name


def test_what_cannot_be_read_says_why(spark):
    files = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(BAD)] + [("null", None)], "file_id string, content binary")
    rows = xliff.opened(files).collect()
    assert len(rows) == len(BAD) + 1
    for r in rows:
        assert r.f.error and r.f.segments == [] and r.f.remarks == []
    assert {r.file_id: r.f.format for r in rows}["7"] == "sdlxliff" and "segment 1" in {r.file_id: r.f.error for r in rows}["7"]


def test_no_python_worker(spark):
    files = spark.createDataFrame([("f", bytearray(HARD2))], "file_id string, content binary")
    plan = bilingual.segments_of(xliff.opened(files))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_references_once(spark):
    rows = spark.createDataFrame([("&amp;lt; &#38;lt; &#x1F600;&unknown; &#0; &#xD800; &#10; a & b &apos;",), (None,), ("",)], "x string")
    assert [r[0] for r in rows.select(xliff.unescaped(xliff._numbered(F.col("x")))).collect()] == ["&lt; &lt; \U0001f600&unknown; &#0; &#xD800; \n a & b '", None, ""]


def test_long_texts_and_many_units(spark):
    units = "".join(f'<unit id="{i}"><segment id="1"><source>{"word &amp; " * 50}</source></segment></unit>' for i in range(3000)) + f'<unit id="long"><segment id="1"><source>{"x" * 3_000_000}</source></segment></unit>'
    content = f'<xliff version="2.0" srcLang="en" trgLang="de"><file id="1">{units}</file></xliff>'.encode()
    rows = bilingual.segments_of(xliff.opened(spark.createDataFrame([("f", bytearray(content))], "file_id string, content binary")))
    sizes = rows.select("unit_ord", F.length(F.element_at("source", 1)["text"]).alias("n")).collect()
    assert len(sizes) == 3001 and {r.n for r in sizes} == {350, 3_000_000} and max(r.unit_ord for r in sizes) == 3001


def test_only_what_is_selected_is_read(spark):
    """Two fields of a file at once do not compute all others: the guard folds no tokens, segments need no history and no remarks."""
    opened = xliff.opened(spark.createDataFrame([("f.xliff", bytearray(b"<xliff/>"))], "file_id string, content binary"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    guard = plan(bilingual.guarded(opened).select("file_id", "refused"))
    assert "aggregate(" not in guard and "history" not in guard.replace("history|locQualityIssues", "")
    segments = plan(bilingual.segments_of(opened))
    assert "version_ord" not in segments and "originalData" not in segments and "aggregate(" in segments


def test_repeated_attributes_keep_the_first(spark):
    """Attributes that differ in prefix only: the first counts, with and without repeats."""
    xml = ['<a k="1" b:k="2" c="3"/>', '<a k="1" c="3"/>', "<a/>"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "i int, x string").select("i", xliff._attributes(F.col("x")).alias("a")).orderBy("i").collect()
    assert [r.a for r in rows] == [{"k": "1", "c": "3"}, {"k": "1", "c": "3"}, {}]
