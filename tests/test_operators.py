"""Leverage, memories, checks and reviews against sequential models on small inputs."""

import difflib

import pytest
from pyspark.sql import functions as F

from bitextmill.operators import analyze, fuzzy, memory, qa, review
from bitextmill.sources.convert import text_tokens

LINES = ["the cat sat on the mat", "the cat sat on a mat", "a dog ran", "the cat sat on the mat", "nothing like it at all", "the dog ran", "abcdefghij klm", "abcdefghij kln"]


def sequential(files, tm):
    """The report by reading segments in order."""
    seen, report = [], {}
    for file, entries in files:
        row = report.setdefault(file, dict.fromkeys([*analyze.COLUMNS, "Total"], 0))
        for e in entries:
            n = len(e.split())
            if e in seen:
                band = "Repetitions"
            elif e in tm:
                band = "100%"
            else:
                best = max([difflib.SequenceMatcher(None, c, e).ratio() for c in [*tm, *seen]], default=0)
                band = next((b for b, low in analyze.BANDS if best >= low), "New")
            if e not in seen:
                seen.append(e)
            row[band] += n
            row["Total"] += n
    return report


@pytest.mark.parametrize("tm", [["the cat sat on the hat", "a dog ran"], []])
def test_report_equals_sequential_reading(spark, tm):
    files = [("a", LINES[:4]), ("b", LINES[4:] + ["a dog ran"])]
    rows = [(f, e, i) for i, (f, e) in enumerate((f, e) for f, es in files for e in es)]
    segments = spark.createDataFrame(rows, "file string, entry string, ordinal int").repartition(3)
    entries = spark.createDataFrame([(t,) for t in tm], "entry string")
    got = {r["file"]: {c: r[c] for c in [*analyze.COLUMNS, "Total"]} for r in analyze.report(segments, entries).collect()}
    want = sequential(files, tm)
    total = {c: sum(r[c] for r in want.values()) for c in [*analyze.COLUMNS, "Total"]}
    assert got == {**want, "Total": total}
    assert all(sum(r[c] for c in analyze.COLUMNS) == r["Total"] for r in got.values())
    assert analyze.report(segments.where("file = 'a'"), entries).count() == 1  # no grand total of one file


def test_report_by_ordinals_of_several_columns(spark):
    """Places of a text are never null, so neither is a field of the ordinal, but a memory's entries have no ordinal."""
    docs = spark.createDataFrame([("a", "\n".join(LINES[:4])), ("b", "\n".join(LINES[4:] + ["a dog ran"]))], "file string, text string")
    segments = docs.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "entry")).select("file", "entry", F.struct("file", "pos").alias("ordinal"))
    assert not segments.schema["ordinal"].dataType["pos"].nullable
    entries = ["the cat sat on the hat", "a dog ran"]
    got = {r["file"]: {c: r[c] for c in [*analyze.COLUMNS, "Total"]} for r in analyze.report(segments, spark.createDataFrame([(t,) for t in entries], "entry string")).collect()}
    want = sequential([("a", LINES[:4]), ("b", LINES[4:] + ["a dog ran"])], entries)
    assert {f: got[f] for f in want} == want


def test_fuzzy_join_equals_all_pairs(spark):
    queries = spark.createDataFrame([(x,) for x in [*LINES, ""]], "q string").distinct()
    candidates = spark.createDataFrame([(x,) for x in [*LINES, "", "cat"]], "c string").distinct()
    for least in (0.5, 0.75, 0.95):
        got = {(r.q, r.c, round(r.ratio, 9)) for r in fuzzy.fuzzy_join(queries, candidates, "q", "c", least).collect()}
        pairs = [(q, c, difflib.SequenceMatcher(None, c, q).ratio()) for q in {*LINES, ""} for c in {*LINES, "", "cat"}]
        assert got == {(q, c, round(r, 9)) for q, c, r in pairs if r >= least}


def tm(spark, rows):
    return spark.createDataFrame([(*r, "translated", None, "me") for r in rows], "id long, source string, target string, state string, time string, submitted_by string")


def test_memory_mutations(spark):
    old = tm(spark, [(1, "a", "A"), (2, "b", "B"), (5, "c", "C")])
    batch = spark.createDataFrame([(1, "b", "B1"), (2, "b", "B2"), (3, "d", ""), (4, "e", "E")], "n int, source string, target string")
    new = memory.upsert(old, batch, ["n"], F.col("n") * 0)
    assert {(r.id, r.source, r.target) for r in new.collect()} == {(1, "a", "A"), (5, "c", "C"), (6, "b", "B1"), (7, "b", "B2"), (8, "e", "E")}
    kept = memory.upsert(old, batch, ["n"], F.col("n") * 0, overwrite=False, high_water=10)
    assert {r.id for r in kept.collect()} == {1, 2, 5, 11, 12, 13}
    assert {r.id for r in memory.remove(old, old.where("id = 2")).collect()} == {1, 5}
    assert [r.id for r in memory.entries(old, 1, 3).collect()] == [2, 5]
    assert [r.id for r in memory.entries(old, -2, -1).collect()] == [2]
    legacy = spark.createDataFrame([("a", "A", "t", "u")], "source string, target string, time string, submitted_by string")
    assert memory.migrate(legacy, ["source"], F.lit(0)).first().asDict() == {"id": 1, "source": "a", "target": "A", "state": None, "time": "t", "submitted_by": "u"}


def test_lookups(spark):
    table = tm(spark, [(1, "the cat sat on the hat", "x"), (2, "quite different", "y")])
    queries = spark.createDataFrame([("q", "the cat sat on the mat")], "query_id string, entry string")
    hit = memory.lookup_segments(queries, table, 0.75).collect()
    assert [(r.id, round(r.ratio, 6)) for r in hit] == [(1, round(difflib.SequenceMatcher(None, "the cat sat on the hat", "the cat sat on the mat").ratio(), 6))]
    terms = tm(spark, [(1, "Cat", "Katze"), (2, "mats", "Matten"), (3, "zebra", "Zebra")])
    got = memory.lookup_terms(queries, terms, 0.7).collect()
    assert [r.source for r in got] == ["Cat", "mats"]
    assert got[0].score == 1.0 and 0.8 < got[1].score < 1
    assert memory.lookup_terms(queries, terms, 0.99, case_sensitive=True).count() == 0
    assert {r.id for r in memory.exact_terms(queries, terms).collect()} == {1}


def test_lookups_compare_each_text_once(spark, monkeypatch):
    table = tm(spark, [(1, "the cat sat on the hat", "x"), (2, "the cat sat on the hat", "y"), (3, "quite different", "z")])
    text = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "nothing like it") for i in range(40)], "query_id long, text string")
    queries = text.select("query_id", text_tokens(F.col("text")).alias("tokens"), F.col("text").alias("entry"))
    sizes, plain = [], memory.fuzzy_join

    def kept(left, right, *more):
        sizes.append((left.count(), right.count()))
        return plain(left, right, *more)

    monkeypatch.setattr(memory, "fuzzy_join", kept)
    for hits in (memory.lookup_segments(queries, table, 0.75), memory.lookup_hits(queries.drop("entry"), table, 0.75)):
        assert sorted((r.query_id, r.id) for r in hits.collect()) == [(i, k) for i in range(1, 40, 2) for k in (1, 2)]
        # what is asked can be far larger than its files tell, so no task may hold it whole
        assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    assert sizes == [(2, 2), (2, 2)]


def edits_of(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {word} | {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def test_corrections_equal_enumeration(spark):
    vocabulary = {"house": 5, "horse": 5, "mouse": 3, "it's": 2, "its": 9, "well-known": 1, "ab": 2, "ba": 1, "näher": 2}
    letters = {c for w in vocabulary for c in w if c.isalpha()}
    asked = ["hose", "huose", "its", "it's", "wellknown", "well-know", "ba", "naher", "zzz"]
    model = spark.createDataFrame(list(vocabulary.items()), "word string, count long")
    got = {}
    for r in qa.candidates(spark.createDataFrame([(w,) for w in asked], "word string"), model).collect():
        got.setdefault(r.word, set()).add(r.candidate)
    assert got == {w: c for w in asked if (c := edits_of(w, letters) & set(vocabulary))}
    best = qa.corrections(spark.createDataFrame([("hose",)], "word string"), model, 2).orderBy("place").collect()
    assert [r.candidate for r in best] == ["horse", "house"]


def test_check(spark):
    model = qa.word_model(spark.createDataFrame([("the red house stands here",)], "text string"))
    rows = [(1, "A b.", ""), (2, "A house.", "the huose"), (3, "red", "red"), (4, "", "x"), (5, None, "x"), (6, "No marks", "No marks")]
    got = {r.segment_id: [(f.type, f.word, f.suggestions) for f in r.findings] for r in qa.check(spark.createDataFrame(rows, "segment_id int, source string, target string"), model).collect()}
    assert got == {1: [("untranslated", None, None)], 2: [("capitalization", None, None), ("punctuation", None, None), ("spelling", "huose", ["house"])], 3: [], 6: [("spelling", "No", []), ("spelling", "marks", [])]}


SEGMENTS = "file_id string, unit_ord int, seg_ord int, segment_id string, kind string, source string, target string, state string, sub_state string, locked boolean, modified_on string, modified_by string"


def segments(spark):
    rows = [("f", 1, 0, "1", "segment", "a", "A"), ("f", 1, 1, None, "ignorable", " ", None), ("f", 1, 2, "2", "segment", "b", "B"), ("f", 2, 0, "3", "segment", "c", "C"), ("f", 2, 1, "4", "segment", "d", "")]
    return spark.createDataFrame([(*r, "translated", None, r[3] == "3", None, None) for r in rows], SEGMENTS)


def test_updates_locks_and_history(spark):
    edits = spark.createDataFrame([("f", "1", "A2", "reviewed", "me", "t"), ("f", "3", "C2", "draft", "me", "t"), ("f", "9", "x", "draft", "me", "t"), ("f", "4", "D", "odd", "me", "t")], "file_id string, segment_id string, target string, state string, submitted_by string, at string")
    out, errors = review.update_segments(segments(spark), edits)
    by = {r.segment_id: r for r in out.collect()}
    assert (by["1"].target, by["1"].state, by["1"].modified_by) == ("A2", "reviewed", "me")
    assert (by["3"].target, by["4"].target, by["4"].modified_by) == ("C", "D", None)
    assert {(r.segment_id, r.reason) for r in errors.collect()} == {("3", "segment is locked"), ("9", "segment does not exist")}
    none = spark.createDataFrame([], "file_id string, unit_ord int, segment_id string, version_ord int, target string, state string, modified_on string, modified_by string")
    history = review.append_history(none, segments(spark), edits)
    assert [(r.segment_id, r.version_ord, r.target) for r in history.collect()] == [("1", 1, "A")]
    locks = spark.createDataFrame([("f", "1", True), ("f", "3", False)], "file_id string, segment_id string, locked boolean")
    once = review.set_locks(segments(spark), locks)
    assert {r.segment_id: r.locked for r in review.set_locks(once, locks).where("segment_id in ('1', '3')").collect()} == {"1": True, "3": False}


def test_merges(spark):
    groups = spark.createDataFrame([("m", "f", "1"), ("m", "f", "2"), ("x", "f", "3"), ("x", "f", "4"), ("y", "f", "9")], "merge_id string, file_id string, segment_id string")
    out, errors = review.merge_segments(segments(spark), groups)
    rows = {(r.unit_ord, r.seg_ord): (r.segment_id, r.source, r.target) for r in out.collect()}
    assert rows == {(1, 0): ("1", "a b", "A B"), (2, 0): ("3", "c", "C"), (2, 1): ("4", "d", "")}
    assert [(r.merge_id, r.reason) for r in errors.collect()] == [("x", "a segment is locked")]


def test_comments_and_issues(spark):
    notes = spark.createDataFrame([("f", 1, "1", "1", "open", "hi", "t1", "me", None, None)], "file_id string, unit_ord int, note_id string, segment_id string, state string, text string, added_at string, added_by string, resolved_at string, resolved_by string")
    more = spark.createDataFrame([("f", 1, "1", "second", "t2", "me")], "file_id string, unit_ord int, segment_id string, text string, added_at string, added_by string")
    both = review.add_comments(notes, more)
    assert {r.note_id for r in both.collect()} == {"1", "2"}
    done = spark.createDataFrame([("f", "1", "1", "t9", "you"), ("f", "1", "7", "t9", "you")], "file_id string, segment_id string, note_id string, resolved_at string, resolved_by string")
    out, errors = review.resolve(both, done, "note_id")
    assert {r.note_id: r.state for r in out.collect()} == {"1": "resolved", "2": "open"}
    assert errors.first().reason == "does not exist"
    assert review.resolve(out, done.where("note_id = '1'"), "note_id")[1].first().reason == "already resolved"


def test_merging_a_file_takes_linear_time():
    """8,000 segments into one: looking each up among its unit's parts took seconds."""
    import time

    from bitextmill.sources import bilingual

    body = "".join(f'<segment id="{i}"><source>s{i}</source></segment><ignorable><source> </source></ignorable>' for i in range(8000))
    content = f'<xliff xmlns="{bilingual.XLIFF2}" version="2.1"><file id="1"><unit id="1">{body}</unit></file></xliff>'.encode()
    change = {"ord": 0, "op": "merge", "segments": [str(i) for i in range(8000)]}
    began = time.perf_counter()
    made, refused = bilingual.apply_changes(content, [change])
    took = time.perf_counter() - began
    assert not refused and " ".join(f"s{i}" for i in range(8000)).encode() in made and made.count(b"<segment ") == 1
    assert took < 2
