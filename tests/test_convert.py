"""New bilingual files from documents, and memories as exchange files."""

import time

import pytest
from pyspark.sql import functions as F

from bitextmill.functions import tokens as T
from bitextmill.schemas import TOKENS
from bitextmill.sources import bilingual, convert, documents, po

from .test_sources import docx, files, text


def segments(spark, content, kind, **options):
    out = convert.to_xliff(convert.new_segments(files(spark, content), kind, **options), "en", "de")
    rows = bilingual.segments_of(bilingual.opened(out)).orderBy("unit_ord", "seg_ord").collect()
    return [(r.segment_id, text(r.source)) for r in rows if r.kind == "segment"]


def test_documents_to_bilingual_files(spark):
    assert segments(spark, b"One is here. Two is here.\n\n  Three\n", "txt") == [("1", "One is here."), ("2", "Two is here."), ("3", "Three")]
    assert segments(spark, b'{"a": "One is here. Two is here.", "b": ["x", ""]}', "json") == [("1", "One is here."), ("2", "Two is here."), ("3", "x")]
    assert segments(spark, b'msgid ""\nmsgstr "h"\n\nmsgid "One is here. Two is here."\nmsgstr ""\n', "po")[-1] == ("1", "One is here. Two is here.")
    assert segments(spark, docx(), "docx") == [("1", "Plain bold end"), ("2", "Cell")]


def test_memories_to_exchange_files(spark):
    tm = spark.createDataFrame([(2, "b &lt; <ph-1/>", "B"), (1, "a", "A"), (3, "c", "")], "id long, source string, target string")
    out = convert.memory_to_xliff(tm, "en", "de")
    rows = bilingual.segments_of(bilingual.opened(out)).orderBy("unit_ord").collect()
    assert [(r.segment_id, text(r.source), text(r.target)) for r in rows] == [("1", "a", "A"), ("2", "b < ", "B")]
    assert [t.equiv for t in rows[1].source if t.kind == "tag"] == ["<ph-1/>"]
    tmx = bilingual.tmx_units(convert.memory_to_tmx(tm, "en", "de", "20240101T000000Z")).select(F.col("tuv")[0]["text"]).collect()
    assert [r[0] for r in tmx] == ["a", "b &lt; <ph-1/>"]


def test_many_changes_of_one_file_take_linear_time():
    n = 20_000
    token = {"kind": "text", "text": "x", "role": None, "id": None, "data_ref": None, "equiv": None}
    for units in (1, n):  # all in one unit, and a unit each
        rows = [{"unit_id": str(i * units // n), "segment_id": str(i), "kind": "segment", "source": [token], "target": [token | {"text": "old"}]} for i in range(n)]
        content = bilingual.new_xliff(rows, "en", "de", "a.txt")
        none = dict.fromkeys(("unit_id", "segment_id", "target", "state", "text", "type", "severity", "remark_id", "segments", "at", "by"))
        changes = [none | {"ord": i, "op": "update", "segment_id": str(i % n), "target": [token | {"text": f"new {i}"}], "state": "translated", "at": "t", "by": "me"} for i in range(n)]
        changes += [none | {"ord": n + 2 * i, "op": "comment", "segment_id": str(i), "text": "c"} for i in range(0, n, 4)]
        began = time.perf_counter()
        after, refused = bilingual.apply_changes(content, [*changes, none | {"ord": 9 * n, "op": "update", "segment_id": "none"}])
        assert time.perf_counter() - began < 30 and [r["ord"] for r in refused] == [9 * n]
        root = bilingual.parse(after)
        assert sum(e.tag.endswith("}note") for e in root.iter()) == n // 4
        assert [e.text for e in root.iter() if e.tag.endswith("}target")].count("old") == n  # each in its history


def test_merged_segments_give_way_to_later_ones_of_their_id():
    token = {"kind": "text", "text": "x", "role": None, "id": None, "data_ref": None, "equiv": None}
    rows = [{"unit_id": u, "segment_id": s, "kind": "segment", "source": [token], "target": [token]} for u, s in (("a", "1"), ("a", "2"), ("b", "2"))]
    none = dict.fromkeys(("unit_id", "segment_id", "target", "state", "text", "type", "severity", "remark_id", "segments", "at", "by"))
    changes = [none | {"ord": 1, "op": "merge", "segments": ["1", "2"]}, none | {"ord": 2, "op": "update", "segment_id": "2", "target": [token | {"text": "later"}]}, none | {"ord": 3, "op": "update", "unit_id": "a", "segment_id": "2"}]
    after, refused = bilingual.apply_changes(bilingual.new_xliff(rows, "en", "de", "a.txt"), changes)
    assert [r["ord"] for r in refused] == [3] and b"later" in after


def test_many_entries_take_linear_time():
    text = "\n\n".join(f'msgid "entry {i}"\nmsgid_plural "entries {i}"\nmsgstr[0] ""' for i in range(40_000))
    began = time.perf_counter()
    units = documents.po_units(text)
    assert time.perf_counter() - began < 10 and [u["unit_id"] for u in units] == [str(i + 1) for i in range(80_000)]
    assert units[5]["attrs"] == {"rid": "5"}


def test_files_are_written_as_by_the_xml_writer(spark):
    """Files written by Spark's functions have the bytes that the standard library's writer gives them."""
    text, tag = lambda x: T._token(kind="text", text=x), lambda name, **k: T._token(kind="tag", tag=name, **k)
    hard = "a & b < c > \"d\" 'e'\n\r\té\U0001f600]]>"
    rows = [
        {"file_id": "f" + hard, "unit_ord": 2, "unit_id": "u\"2", "seg_ord": 1, "segment_id": None, "kind": "ignorable", "source": [text(hard), text(""), text(None)], "target": [], "data": {"1": "<b a=\"1\"/>\n", "2": ""}, "attrs": {"keys": "x;y\n"}, "internal": None},
        {"file_id": "f" + hard, "unit_ord": 2, "unit_id": "u\"2", "seg_ord": 0, "segment_id": "1", "kind": "segment", "source": [tag("sc", id="1", data_ref="1", equiv="<b>"), text("x"), tag("ec", id="1", data_ref=""), tag("ph")], "target": [text("y")], "data": {"1": "<b a=\"1\"/>\n", "2": ""}, "attrs": {"keys": "x;y\n"}, "internal": hard},
        {"file_id": "f" + hard, "unit_ord": 10, "unit_id": None, "seg_ord": 0, "segment_id": "", "kind": "segment", "source": [], "target": [text("")], "data": None, "attrs": {}, "internal": "second"},
        {"file_id": "g", "unit_ord": 1, "unit_id": "1", "seg_ord": 0, "segment_id": "1", "kind": "segment", "source": [text("")], "target": None, "data": {}, "attrs": None, "internal": None},
    ]
    schema = f"file_id string, unit_ord int, unit_id string, seg_ord int, segment_id string, kind string, source {TOKENS}, target {TOKENS}, data map<string,string>, attrs map<string,string>, internal string"
    made = {r.file_id: bytes(r.content) for r in convert.to_xliff(spark.createDataFrame(rows, schema), "en", "d\"e").collect()}
    for file in {r["file_id"] for r in rows}:
        own = sorted((r for r in rows if r["file_id"] == file), key=lambda r: (r["unit_ord"], r["seg_ord"]))
        assert made[file] == bilingual.new_xliff(own, "en", "d\"e", file, next((r["internal"] for r in own if r["internal"] is not None), None))
    wrong = spark.createDataFrame([rows[3] | {"source": [tag("bx", id="1")]}], schema)
    with pytest.raises(Exception, match="tag bx is not allowed here"):
        convert.to_xliff(wrong, "en", "de").collect()


def test_files_are_written_without_python_workers(spark, capsys):
    rows = spark.range(3).select(F.lit("f").alias("file_id"), F.col("id").cast("int").alias("unit_ord"), F.lit("1").alias("unit_id"), F.lit(0).alias("seg_ord"), F.lit("1").alias("segment_id"), F.lit("segment").alias("kind"), convert.text_tokens(F.lit("x")).alias("source"))
    convert.to_xliff(rows, "en", "de").explain()
    assert "Pandas" not in capsys.readouterr().out


def test_workers_hold_few_rows(spark):
    """What a row yields is sent on in small batches, so that a file of many rows is never held whole."""
    from bitextmill.functions import workers

    rows = workers.mapped(spark.range(1, numPartitions=1), lambda i: ((n,) for n in range(1000)), "n int")
    sizes = rows.mapInArrow(lambda batches: batches, "n int")
    assert rows.count() == 1000 and sizes.agg(F.sum("n")).first()[0] == 499_500
    for name, most in workers.BATCH.items():
        assert int(spark.conf.get(name).rstrip("b")) <= most


def test_numbers_are_not_sent_by_the_driver(spark, capsys):
    units = spark.range(20).select(F.col("id").cast("string").alias("file_id"), F.lit(1).alias("unit_ord"), F.lit("1").alias("unit_id"), convert.text_tokens(F.lit("It rained. It stopped.")).alias("source"))
    rows = convert.segment.segmented(units)
    rows.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert {r.segment_id for r in rows.where("kind = 'segment'").collect()} == {"1", "2"}


def test_large_memories_are_several_files(spark):
    """No file holds more rows than a task should; all come back."""
    from bitextmill.sources import stores

    tm = spark.range(25).select(F.lit("m").alias("file_id"), "id", F.concat(F.lit("s"), "id").alias("source"), F.lit("t").alias("target"), *(F.lit(None).cast("string").alias(c) for c in ("state", "time", "submitted_by")))
    made = stores.write_memories(tm, "en", "de", most=10)
    assert sorted(r.part for r in made.collect()) == [1, 2, 3]
    assert sorted(r.id for r in stores.read_memories(made).collect()) == list(range(25))


def test_models_are_written_as_their_rows_come(spark, capsys):
    from bitextmill.sources import stores

    letters = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "file_id string, letter string")
    words = spark.createDataFrame([("a", "xy", 2), ("a", "yx", 3), ("c", "q", 1)], "file_id string, word string, count long")
    made = stores.write_models(letters, words)
    made.explain()
    assert "collect_list" not in capsys.readouterr().out
    assert {r.file_id: bytes(r.content) for r in made.collect()}.keys() == {"a", "b"}
    back = stores.read_models(made)
    assert sorted(map(tuple, back[0].collect())) == [("a", "x"), ("a", "y"), ("b", "z")] and sorted(map(tuple, back[1].collect())) == [("a", "xy", 2), ("a", "yx", 3)]


def test_po_lines_are_cut_like_the_writer_does(spark):
    """Values around the width, with white space of every kind at the break, without any, and ending at a break."""
    values = ["", "a", "a" * 79, "a" * 80, "a" * 79 + " ", "a" * 78 + " b", "a" * 79 + " b", "a" * 90 + " " + "b" * 79 + "\t", "wort " * 60, "x" * 81 + "\n" + "y" * 5, " " * 200, "\U0001f600 " * 90]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", F.array_join(po.wrapped("msgid", F.col("v")), "\n").alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == [documents.po_wrapped("msgid", v) for v in values]
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_po_files_are_read_once(spark):
    """Headers and second translations come from the file's own units, not from joins that read it again."""
    text = '# c\nmsgid ""\nmsgstr "H"\n\nmsgid "a"\nmsgid_plural "b"\nmsgstr[0] "x"\nmsgstr[1] "y"\n\nmsgid "z"\nmsgid_plural "w"\nmsgstr[0] ""\n\nmsgid "q"\nmsgstr "r"\n'
    files = spark.createDataFrame([("f", bytearray(text.encode())), ("g", bytearray(b'msgid "only"\nmsgstr ""\n'))], "file_id string, content binary")
    rows = convert.units(files, "po")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.file_id, r.unit_id): (r.attrs.get("keys"), r.attrs.get("rid"), r.target and r.target[0].text, r.internal) for r in rows.collect()}
    internal = '# c\nmsgid ""\nmsgstr "H"\n'
    assert got == {
        ("f", "1"): ("msgid;msgstr[0]", None, "x", internal), ("f", "2"): ("msgid_plural;msgstr[1]", "1", "y", internal), ("f", "3"): ("msgid;msgstr[0]", None, None, internal),
        ("f", "4"): ("msgid_plural;msgstr[1]", "3", None, internal), ("f", "5"): ("msgid;msgstr", None, "r", internal), ("g", "1"): ("msgid;msgstr", None, None, None),
    }
