"""Readers and writers on small hand-written files."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bitextmill.functions import tokens as T
from bitextmill.operators import analyze, memory, review, segment
from bitextmill.sources import bilingual, documents, languages, office, stores, tmx
from bitextmill.streaming import lookup

V2 = b"""<?xml version='1.0'?><xliff xmlns="urn:oasis:names:tc:xliff:document:2.0" version="2.1" srcLang="en" trgLang="de"><file id="1" original="a.txt">
<unit id="u1"><originalData><data id="1">&lt;b/&gt;</data></originalData><notes><note id="1" segment="1" state="open" added_at="2024-01-01" added_by="me">look</note></notes>
<segment id="1" state="initial" subState="initial-draft"><source>One <sc id="1" dataRef="1" equiv="&lt;b&gt;"/>two<ec id="1" dataRef="1"/></source><target>Eins</target></segment><ignorable><source> </source></ignorable>
<segment id="2" state="translated" subState="translated-locked"><source>Three</source></segment></unit></file></xliff>"""
V1 = b"""<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2" version="1.2"><file original="a" source-language="en" target-language="fr"><body>
<trans-unit id="1"><source>One. Two.</source><seg-source><mrk mtype="seg" mid="1">One.</mrk> <mrk mtype="seg" mid="2">T<g id="5">w</g>o<x id="6"/></mrk></seg-source><target state="x-draft"><mrk mtype="seg" mid="1">Un.</mrk></target></trans-unit>
<trans-unit id="2"><source>Whole</source></trans-unit></body></file></xliff>"""
SDL = b"""<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2" xmlns:sdl="http://sdl.com/FileTypes/SdlXliff/1.0" version="1.2"><file original="a" source-language="en" target-language="fr"><body>
<trans-unit id="1"><source>A</source><seg-source><mrk mtype="seg" mid="1">A</mrk></seg-source><target><mrk mtype="seg" mid="1">B</mrk></target><sdl:seg-defs><sdl:seg id="1" conf="Draft" locked="true"/></sdl:seg-defs></trans-unit></body></file></xliff>"""


def files(spark, *contents):
    return spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents)], "file_id string, content binary")


def text(tokens):
    return "".join(t["text"] or "" for t in tokens if t["kind"] == "text")


def test_bilingual_files(spark):
    opened = bilingual.opened(files(spark, V2, V1, SDL, b"<nope/>", b"<broken")).cache()
    info = {r.file_id: (r.f.format, r.f.src_lang, r.f.error) for r in opened.collect()}
    assert [info[str(i)][0] for i in range(3)] == ["xliff2", "xliff1", "sdlxliff"]
    assert info["3"][2] and info["4"][2]
    rows = {(r.file_id, r.segment_id): r for r in bilingual.segments_of(opened).collect()}
    assert rows["0", "1"].state == "initial-draft" and not rows["0", "1"].locked and [t.tag for t in rows["0", "1"].source if t.kind == "tag"] == ["sc", "ec"]
    assert (rows["0", "2"].state, rows["0", "2"].locked) == ("translated", True)
    assert rows["0", None].kind == "ignorable"
    assert text(rows["1", "1"].target) == "Un." and rows["1", "2"].target == [] and rows["1", "N/A"].unit_id == "2"
    assert [t.equiv for t in rows["1", "2"].source if t.kind == "tag"] == ["<g-5>", "</g-5>", "<x-6/>"]
    assert (rows["2", "1"].state, rows["2", "1"].locked) == ("draft", True)
    assert bilingual.notes_of(opened).first().text == "look" and bilingual.original_data_of(opened).first().data_id == "1"
    entries = memory.from_segments(bilingual.segments_of(opened).where("file_id = '0'"))
    assert [(r.source, r.target) for r in entries.collect()] == [("One <sc-1/>two<ec-1/>", "Eins")]
    shown = bilingual.segments_of(opened).where("file_id = '0' and segment_id = '1'").select(T.shown(F.col("source")), T.plain_text(F.col("source"))).first()
    assert tuple(shown) == ("One <b>two<ec-1/>", "One two")


def test_saved_edits_read_back(spark):
    tokens = [T._token(kind="text", text="Neu "), T._token(kind="tag", tag="sc", id="1", data_ref="1"), T._token(kind="tag", tag="ec", id="1", data_ref="1")]
    g = [T._token(kind="tag", tag="g", id="5", equiv="<g-5>"), T._token(kind="text", text="zw"), T._token(kind="tag", tag="g", id="5", equiv="</g-5>")]
    edit = lambda id_, t, state, sub=None: {"unit_id": None, "segment_id": id_, "target": t, "state": state, "sub_state": sub, "locked": None, "modified_on": "t", "modified_by": "me"}
    out = bilingual.file_rows(bilingual.apply_edits(V2, [edit("1", tokens, "translated", "translated")]))["segments"][0]
    assert text(out["target"]) == "Neu " and out["state"] == "translated" and out["modified_by"] == "me"
    assert {t["tag"] for t in out["target"]} == {None, "sc", "ec"}
    changed = bilingual.file_rows(bilingual.apply_edits(V1, [edit("2", g, "new")]))["segments"]
    assert [t["equiv"] for t in changed[1]["target"] if t["kind"] == "tag"] == ["<g-5>", "</g-5>"] and text(changed[0]["target"]) == "Un."
    sdl = bilingual.file_rows(bilingual.apply_edits(SDL, [edit("1", [T._token(kind="text", text="C")], "Translated")]))["segments"][0]
    assert (sdl["state"], text(sdl["target"])) == ("Translated", "C")
    with pytest.raises(ValueError):
        bilingual.apply_edits(V2, [edit("1", [T._token(kind="tag", tag="script", id="1")], "draft")])
    edits = spark.createDataFrame([("0", "u1", "2", [T._token(kind="text", text="Drei")], "draft", None, None, None, None)], f"file_id string, unit_id string, segment_id string, target {bilingual.TOKENS}, state string, sub_state string, locked boolean, modified_on string, modified_by string")
    saved = bilingual.saved(files(spark, V2), edits).first()
    assert text(bilingual.file_rows(bytes(saved.content))["segments"][2]["target"]) == "Drei"


def test_entities_are_refused():
    assert "entity" in bilingual.file_rows(b'<!DOCTYPE x [<!ENTITY a "b">]><xliff version="2.0"/>')["error"]


def test_tmx(spark):
    made = bilingual.new_tmx([("Hello", "Hallo"), ("Bye", "")], "en", "de", "20240101T000000Z")
    units = bilingual.tmx_units(files(spark, made))
    assert [(r.source, r.target) for r in memory.from_units(units, "en", "de").collect()] == [("Hello", "Hallo")]
    assert memory.from_units(units, "en", "fr").count() == 0
    inline = b'<tmx version="1.4"><header datatype="xml"/><body><tu><tuv xml:lang="en"><seg>a <bpt>b</bpt>c</seg></tuv><tuv xml:lang="de"><seg>d</seg></tuv></tu></body></tmx>'
    rows = bilingual.tmx_units(files(spark, inline))
    assert [memory.from_units(rows, "en", "de", plain).first().source for plain in (True, False)] == ["a ", "a bc"]


def test_memory_files(spark):
    new = stores.memory_bytes([(1, "a", "b", "translated", "t", "me"), (4, "c", "d", None, None, None)], "en", "de")
    assert [tuple(r)[4:] for r in stores.read_memories(files(spark, new), "en", "de").orderBy("id").collect()] == [(1, "a", "b", "translated", "t", "me"), (4, "c", "d", None, None, None)]
    with pytest.raises(Exception, match="the file is for"):
        stores.read_memories(files(spark, new), "en", "fr").collect()
    assert stores.version_of("0.10.2-beta") > stores.version_of("0.9.9") > stores.version_of(None)


def test_csv(spark, tmp_path):
    (tmp_path / "tm.csv").write_text('source,target\n"say ""hi""",x\n,y\nz,\na,b\na,c\n')
    rows = memory.from_csv(spark, str(tmp_path / "tm.csv")).collect()
    assert sorted((r.source, r.target, r.submitted_by) for r in rows) == [("a", "b", "tm.csv"), ("a", "c", "tm.csv"), ('say "hi"', "x", "tm.csv")]


def test_text_and_json_and_po(spark):
    docs = spark.createDataFrame([("d", "One\n\n  two\nlast")], "path string, text string")
    units = documents.text_units(docs, "path", "text")
    assert [(r.source, r.kind) for r in units.orderBy("unit_ord").collect()] == [("One\n", "segment"), ("\n", "ignorable"), ("  two\n", "segment"), ("last", "segment")]
    assert documents.rebuilt_text(units.withColumn("target", F.when(F.col("unit_ord") == 1, F.lit("Eins\n"))), "path").first().text == "Eins\n\n  two\nlast"
    value = {"a": {"b.c": "x", "l": ["1", "", 5]}, "n": None, "one": ["solo"]}
    parsed = documents.json_units(json.dumps(value))
    assert [(u["unit_id"], u["kind"]) for u in parsed] == [("1", "segment"), ("2", "segment"), (None, "ignorable"), (None, "ignorable"), (None, "ignorable"), ("6", "segment")]
    assert json.loads(documents.rebuilt_json(parsed, {})) == value
    assert json.loads(documents.rebuilt_json(parsed, {"1": "y"}))["a"]["b.c"] == "y"
    po = '# head\nmsgid ""\nmsgstr "Content-Type: x\\n"\n\n#: file\nmsgctxt "menu"\nmsgid "Open"\nmsgstr ""\n\nmsgid "one file"\nmsgid_plural ""\n"many "\n"files"\nmsgstr[0] ""\nmsgstr[1] ""\n'
    units = documents.po_units(po)
    assert [(u["unit_id"], u["text"]) for u in units] == [(None, "Content-Type: x\\n"), ("1", "Open"), ("2", "one file"), ("3", "many files")]
    again = documents.po_units(documents.rebuilt_po(units, {"1": "Auf", "3": "viele"}))
    assert again[1]["attrs"]["msgstr"] == "Auf" and again[2]["attrs"]["msgstr[1]"] == "viele" and again[1]["attrs"]["msgctxt"] == "menu"
    long = documents.po_wrapped("msgid", "word " * 40)
    assert long.startswith('msgid ""\n"') and "".join(x.strip('"') for x in long.split("\n")[1:]) == "word " * 40
    rows = documents.document_units(spark.createDataFrame([("a", json.dumps(value)), ("b", "{")], "path string, text string"), "json")
    assert rows.where("error is not null").select("path").first()[0] == "b"
    out = documents.rebuilt_documents(rows.withColumn("target", F.when(F.col("unit_id") == "1", F.lit("y"))), "json")
    assert json.loads(out.first().text)["a"]["b.c"] == "y"


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:pPr/><w:r><w:t>Plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:tab/><w:t> end</w:t></w:r></w:p><w:p><w:r/></w:p><w:tbl><w:tr><w:tc><w:p><w:hyperlink><w:r><w:t>Cell</w:t></w:r></w:hyperlink></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("other.xml", "<x/>")
    return out.getvalue()


def odt():
    n = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<office:body {n}><text:h>Head</text:h><text:p>a <text:span text:style-name="T1">b</text:span> c<text:line-break/></text:p><text:p/></office:body>')
    return out.getvalue()


@pytest.mark.parametrize("kind,make,texts", [("docx", docx, ["Plain bold end", "Cell"]), ("odt", odt, ["Head", "a b c"])])
def test_office(spark, kind, make, texts):
    content = make()
    units = office.units_of(content, kind)
    assert [text(u["tokens"]) for u in units] == texts
    same = office.units_of(office.rebuilt(content, kind, {u["unit_ord"]: u["tokens"] for u in units}), kind)
    assert [[(t["kind"], t["tag"], t["text"]) for t in u["tokens"]] for u in same] == [[(t["kind"], t["tag"], t["text"]) for t in u["tokens"]] for u in units]
    rows = segment.segmented(office.office_units(files(spark, content), kind))
    targets = rows.withColumn("tokens", F.transform("source", lambda t: t.withField("text", F.upper(t["text"])))).select("file_id", "unit_ord", "seg_ord", "tokens")
    out = office.rebuilt_files(files(spark, content), targets, kind).first()
    assert [text(u["tokens"]) for u in office.units_of(bytes(out.content), kind)] == [t.upper() for t in texts]


def test_models_packages_and_reports(spark):
    letters, words = stores.read_model(spark, stores.model_bytes(["b", "a"], [("x", 1), ("y", 3)]))
    assert letters.count() == 2 and words.first().word == "y"
    manifest, members = stores.project_manifest("P", "en", "de", {"0": {"source": "/s/a.docx", "originalBF": "/s/a.kxliff", "targetBF": "/t/a.kxliff"}, "1": {"originalBF": "/s/b.kxliff", "targetBF": "/t/b.kxliff"}}, tms=["/x/m.kdb"], tbs=["/x/t.kdb", "/x/u.kdb"], only={"0"})
    assert members["de/a.kxliff"] == "/t/a.kxliff" and list(manifest["files"]) == ["0"] and len(manifest["tbs"]) == 2
    made = stores.package_bytes(manifest, {n: b"x" for n in members})
    assert stores.read_package(made)[0] == manifest and set(stores.read_package(made, True)[1]) == {"de/a.kxliff"}
    with pytest.raises(ValueError):
        stores.read_package(stores.package_bytes({"files": {}}, {"../x": b""}))
    page = stores.report_html("A & B", [{"segment_id": "1", "source": "<b>", "issues": [{"type": "t", "severity": "s", "comment": "c"}]}], "now")
    assert "&lt;b&gt;" in page and "t (s): c" in page and "A &amp; B" in page
    assert len(languages.CATALOGUE.strip().split("\n")) == 184
    made = bilingual.new_xliff([{"unit_id": "1", "segment_id": "1", "kind": "segment", "source": [T._token(kind="text", text="a")], "target": None}], "en", "de", "x")
    assert bilingual.file_rows(made)["segments"][0]["segment_id"] == "1"
    assert review.segment_issues(spark.createDataFrame([("f", "1", False), ("f", "1", True)], "file_id string, segment_id string, resolved boolean"), "f", "1").count() == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a b", "f", "2024-01-01 00:00:00"), ("c", "f", "2024-01-01 00:01:00"), ("a b", "f", "2024-01-01 00:02:00")], "entry string, file string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("entry string, file string, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    tm = spark.createDataFrame([("a b", "A B")], "source string, target string")
    assert sorted((r.entry, r.target) for r in run(lookup.exact_hits(stream(), tm), "append", "hits")) == [("a b", "A B"), ("a b", "A B"), ("c", None)]
    assert [r.words for r in run(lookup.word_counts(stream()), "complete", "counts")] == [5]
    assert sorted(r.entry for r in run(lookup.fresh_entries(stream()), "append", "fresh")) == ["a b", "c"]


def test_streamed_bands_equal_the_batch_report(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["f", "g"]), f"entry {rng.randrange(20)} of {rng.randrange(3)}", i, f"2024-01-01 00:{i // 60:02}:{i % 60:02}") for i in range(300)]
    frame = spark.createDataFrame(rows, "file string, entry string, ordinal long, ts string").withColumn("ts", F.to_timestamp("ts"))
    for k in range(3):  # three batches in the order of time
        frame.where((F.col("ordinal") >= 100 * k) & (F.col("ordinal") < 100 * k + 100)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    tm = spark.createDataFrame([(f"entry {i} of 1", "x") for i in range(0, 20, 2)], "source string, target string")
    stream = spark.readStream.schema("file string, entry string, ordinal long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = lookup.leverage(stream, tm).writeStream.outputMode("append").format("memory").queryName("bands").option("checkpointLocation", str(tmp_path / "bands")).start()
    q.processAllAvailable()
    q.stop()
    streamed = {(r.file, r.band): r.words for r in spark.table("bands").groupBy("file", "band").agg(F.sum("words").alias("words")).collect()}
    report = analyze.exact_report(frame.select("file", "entry", "ordinal"), tm.select(F.col("source").alias("entry")))
    batch = {(r.file, b): r[b] for r in report.where("file <> 'Total'").collect() for b in ("Repetitions", "100%", "New") if r[b]}
    assert streamed == batch and len(batch) == 6


def test_large_exchange_files_are_split(spark, tmp_path):
    inline = '<tmx version="1.4"><header datatype="xml"/><body>\n<tu creationdate="now"><tuv xml:lang="en"><seg>a &amp; <bpt>b</bpt>c &#228;</seg></tuv><note/><tuv xml:lang="de"><prop>p</prop><seg><ph/>d</seg></tuv><tuv xml:lang="fr"/></tu>\n<tu><tuv lang="en"><seg/></tuv></tu></body></tmx>'
    (tmp_path / "one.tmx").write_text(inline, encoding="utf-8")
    plain = [(v["lang"], v["text"], v["full"]) for u in bilingual.tmx_rows(inline.encode()) for v in u["tuv"]]
    got = tmx.units(spark, str(tmp_path / "one.tmx")).collect()
    assert [(v.lang, v.text, v.full) for u in sorted(got, key=lambda u: -len(u.tuv)) for v in u.tuv] == plain and {u.created for u in got} == {"now", None}
    (tmp_path / "bad.tmx").write_text(inline.replace('"xml"', '"html"'), encoding="utf-8")
    with pytest.raises(Exception, match="data type html is not read"):
        tmx.units(spark, str(tmp_path / "bad.tmx")).collect()
    rows = spark.range(60_000).select(F.concat(F.lit("<source> & "), "id").alias("source"), F.concat(F.repeat(F.lit("long "), 20), "id").alias("target")).union(spark.createDataFrame([("", "x"), (None, "y"), ("z", None)], "source string, target string"))
    tmx.write(rows.coalesce(1), str(tmp_path / "large"), "en", "de", "20240101T000000Z")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        read = tmx.units(spark, str(tmp_path / "large"))
        assert read.rdd.getNumPartitions() > 5
        pairs = memory.from_units(read, "en", "de").select("source", "target")
        assert pairs.count() == 60_000 and pairs.exceptAll(rows).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_memories_are_not_created_twice(spark, tmp_path):
    memory.create(spark, str(tmp_path / "tm"), "en", "de")
    assert spark.read.parquet(str(tmp_path / "tm" / "main")).columns == memory.COLUMNS and spark.read.parquet(str(tmp_path / "tm" / "metadata")).first().target == "de"
    with pytest.raises(ValueError, match="exists already"):
        memory.create(spark, str(tmp_path / "tm"), "en", "fr")


def test_po_tables_equal_plain_texts(spark):
    po = '# head\n# more\nmsgid ""\nmsgstr "Content-Type: x\\n"\n"second"\n\n\n#: file\n  msgctxt "menu"\nmsgid "Open"\nmsgstr ""\n \t\nmsgid "one file"\nmsgid_plural ""\n"many "\n"files"\nmsgstr[0] ""\nmsgstr[1] "x"\nmsgstr[2] "z"\nmsgstr[10] "y"\n\n# only a comment\n\n"lost"\n\nmsgid "' + "word  " * 40 + '"\nmsgstr "' + "x" * 200 + '"\n\nmsgid "last"'
    texts = [("a", po), ("b", po.replace("\n", "\r\n")), ("c", ""), ("d", None), ("e", 'msgid "no header"\nmsgstr "k"'), ("f", "\n\n" + po + "\n\n")]
    rows = documents.document_units(spark.createDataFrame(texts, "path string, text string"), "po").orderBy("path", "unit_ord").collect()
    for path, text in texts:
        want = documents.po_units(text or "")
        got = [{"unit_id": r.unit_id, "key": r.unit_key, "text": r.source, "kind": r.kind, "attrs": r.attrs} for r in rows if r.path == path]
        assert got == want and [r.unit_ord for r in rows if r.path == path] == list(range(1, len(want) + 1))
    targets = {"1": "Auf", "3": "viele " * 30, "4": ""}
    given = documents.document_units(spark.createDataFrame(texts, "path string, text string"), "po").withColumn("target", F.element_at(F.create_map(*(F.lit(x) for p in targets.items() for x in p)), F.coalesce("unit_id", F.lit("none"))))
    made = {r.path: r.text for r in documents.rebuilt_documents(given, "po").collect()}
    assert made == {path: documents.rebuilt_po(units, {k: v for k, v in targets.items() if v}) for path, text in texts if (units := documents.po_units(text or ""))}


def test_a_formatting_is_written_and_read_once_a_file(monkeypatch):
    """2,000 paragraphs of one formatting: its XML was written for each of them, and parsed for each of their tags."""
    w, calls = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", {"written": 0, "read": 0}
    body = "".join(f'<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a{i}</w:t></w:r><w:r><w:t>b</w:t><w:br/></w:r></w:p>' for i in range(2000))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    written, read = office._xml, office.ET.fromstring

    def counted(name, use):
        def run(x):
            calls[name] += 1
            return use(x)

        return run

    monkeypatch.setattr(office, "_xml", counted("written", written))
    units = office.units_of(out.getvalue(), "docx")
    assert calls["written"] == 2 and all(len(u["data"]) == 2 for u in units) and len(units) == 2000
    monkeypatch.setattr(office.ET, "fromstring", counted("read", read))
    made = office.rebuilt(out.getvalue(), "docx", {u["unit_ord"]: u["tokens"] for u in units})
    assert calls["read"] <= 4
    assert [u["tokens"] for u in office.units_of(made, "docx")] == [u["tokens"] for u in units]  # prefixes of the XML may differ
    with pytest.raises(KeyError):
        office.rebuilt(out.getvalue(), "odt", {})
