"""Scalar functions, tokens, similarity and segmentation, against plain Python."""

import difflib
import html

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitextmill.functions import similarity, text, tokens
from bitextmill.operators import segment


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()[0]


def tag(name, id_, equiv=None, ref=None):
    return {"kind": "tag", "tag": name, "id": id_, "data_ref": ref, "equiv": equiv, "text": None}


def words(s):
    return {"kind": "text", "tag": None, "id": None, "data_ref": None, "equiv": None, "text": s}


def test_escapes(spark):
    s = "a <b> & \"c\" 'd' &amp;"
    assert one(spark, text.html_escape(F.col("s")), s=s) == html.escape(s)
    assert one(spark, text.html_unescape_basic(text.html_escape(F.col("s"))), s=s) == s
    assert one(spark, tokens.html_unescape(F.col("s")), s="&eacute;&#65;") == "éA"


def test_words_and_marks(spark):
    assert one(spark, text.word_count(F.col("s")), s=" a b \t c\n") == 3
    assert one(spark, text.qa_words(F.col("s")), s="It's a well-known fact: x2 $5, naïve!") == ["It's", "well-known", "fact", "naïve"]
    assert one(spark, text.closing_marks(F.col("s")), s="what?!") == "?!"
    assert one(spark, text.closing_marks(F.col("s")), s="what") == ""
    assert one(spark, text.capital_mismatch(F.col("a"), F.col("b")), a="Ab", b="ab") is True
    assert one(spark, text.can_process(F.col("s")), s="x/Y.DOCX") is True
    assert one(spark, text.can_process(F.col("s")), s="x.pdf") is False


def test_states(spark):
    got = lambda d, **v: tuple(one(spark, text.decoded_state(d, *(F.col(k) for k in v)), **v))
    assert got("v2", s="initial", u="initial-draft-locked") == ("initial-draft", True)
    assert got("v1", s="x-locked-draft") == ("draft", True)
    assert one(spark, text.encoded_state("v1", F.col("s")), s="draft")[0] == "x-draft"
    assert one(spark, text.encoded_state("v2", F.col("s")), s="unknown") is None
    assert one(spark, text.encoded_state("v2", F.col("s")), s="blank")[:] == ("initial", "initial-blank")
    assert one(spark, text.encoded_state("sdl", F.col("s")), s="approvedTranslation")[0] == "Approvedtranslation"


def test_similarity_is_asymmetric_and_keeps_autojunk():
    assert similarity.ratios(["tide", "diet"], ["diet", "tide"]) == [0.25, 0.5]
    a, b = "ab" * 120, "ba" * 121
    assert similarity.ratios([a], [b]) == [difflib.SequenceMatcher(None, a, b).ratio()]
    assert similarity.ratios([a], [b], autojunk=False) == [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()]
    assert similarity.ratios([None, ""], ["x", ""]) == [None, 1.0]


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12), st.sampled_from([0.0, 0.5, 0.8]))
def test_bounds_never_lose_a_pair(a, b, least):
    r = difflib.SequenceMatcher(None, a, b).ratio()
    assert similarity.ratios([a], [b], least) == [r if r >= least else None]


def test_diff_spans_rebuild_both_sides():
    spans = similarity.spans("colour", "color!")
    assert "".join(s["text"] for s in spans if s["change"] != "add") == "colour"
    assert "".join(s["text"] for s in spans if s["change"] != "remove") == "color!"


def test_entries_number_tags_by_first_appearance():
    source = [words("a < "), tag("sc", "7"), words("b"), tag("ec", "7"), tag("ph", "9")]
    entry, numbers = tokens.entry_of(source)
    assert entry == "a &lt; <sc-1/>b<ec-1/><ph-2/>"
    assert tokens.entry_of([tag("ph", "9"), words("z")], numbers)[0] == "<ph-2/>z"
    assert [t["id"] for t in tokens.tokens_of("<ph-2/><x-5/>", numbers)] == ["9"]  # unknown tags are dropped
    assert [t["equiv"] for t in tokens.tokens_of("<x-5/>", None, safe=False)] == ["<x-5/>"]


def test_sentences(spark):
    s = "Mr. Smith went home. He slept. In 2020. Then he left! Home. Away"
    exact = segment.sentence_list(s)
    assert exact == ["Mr. Smith went home.", "He slept.", "In 2020. Then he left!", "Home. Away"]
    assert one(spark, segment.sentences(F.col("s")), s=s) == exact
    assert "".join(segment.sentence_list(s, keep_space=True)) == s
    assert segment.sentence_list("It rained. Stopped. Then we left") == ["It rained.", "Stopped. Then we left"]


def test_mixed_content_keeps_tags_in_place():
    unit = [words("  First one ends. "), tag("sc", "1"), words("Second one"), tag("ec", "1"), words(" here.  ")]
    parts = segment.unit_parts(unit)
    assert [k for k, _ in parts] == ["ignorable", "segment", "ignorable", "segment", "ignorable"]
    flat = "".join(t["text"] or "" for _, p in parts for t in p)
    assert flat == "  First one ends. Second one here.  "
    assert segment.without_empty_pairs([tag("sc", "1"), tag("ec", "1"), words("x")]) == [words("x")]
    assert segment.merged_tags([words("a"), tag("ec", "1", ref="d"), tag("sc", "2", ref="d"), words("b")]) == [words("a"), words("b")]


def test_peeling_and_numbers(spark):
    assert one(spark, segment.text_parts(F.col("s")), s=" \n a b ")[:] == (" \n ", "a b", " ")
    units = spark.createDataFrame([("f", 1, "1", [words("One here. Two here.")]), ("f", 2, "2", [words(" ")])], "file_id string, unit_ord int, unit_id string, source " + segment.TOKENS)
    rows = segment.segmented(units).orderBy("unit_ord", "seg_ord").collect()
    assert [r.segment_id for r in rows if r.kind == "segment"] == ["1", "2"]
    assert all(r.segment_id is None for r in rows if r.kind == "ignorable")
