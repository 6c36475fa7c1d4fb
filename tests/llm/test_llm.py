"""The training-data operators against brute force, on edge cases, and by held-out accuracy."""

import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitextmill.llm import byte_cnn, decontamination, line_crf, lm_scoring, near_dedup, packing, pii, quality_rules, queries, sharding, toxicity
from bitextmill.llm.common import clean, ranked, remainder, staged

DIR = "/root/testdata/sf0.001"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree beside the quiet river and nobody speaks until the moon has climbed above the hill"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id string, key string, shard int, kept boolean, rank long, stats string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None, 1, "x", "y", 2, None, 3, "z") for i, t, lang, src in rows], SCHEMA)


def edge_rows():
    near = BASE.replace("quiet", "noisy")
    rows = [
        (1, BASE, "en", "a"), (2, BASE.upper(), "en", "a"), (3, near, "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \n\t ", "en", "a"), (7, "word", "en", None),
        (8, "word", None, "b"), (9, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "en", "a"), (10, "x" * 50_000, "en", "a"), (11, "ß é 日本 \U0001f600", "de", "b"), (None, "no id here at all", "en", "a"),
        (12, BASE + " mail a.b@c.de or 4111 1111 1111 1111 and +1 (555) 123-4567 at 10.0.0.1", "en", "a"), (13, "stupid 1d10t " + BASE, "en", "a"), (1, BASE, "en", "a"), (14, "a\nb\n\na\n" * 40, "fr", "a"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, BASE), (2, None), (3, ""), (None, "another item with quite some words that nobody copied")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, labels, bench: lm_scoring.score(d, queries.tokenizer_path(), rows=20, vocabulary=50),
    "op3": lambda d, labels, bench: line_crf.score(d, labels),
    "op4": lambda d, labels, bench: near_dedup.link(d),
    "op5": lambda d, labels, bench: sharding.shard(d, 4),
    "op7": lambda d, labels, bench: quality_rules.judged(d),
    "op8": lambda d, labels, bench: byte_cnn.identify(d),
    "op9": lambda d, labels, bench: pii.find(d),
    "op10": lambda d, labels, bench: toxicity.score(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_one_row_a_document(docs, empty, labels, bench, name):
    got = OPERATORS[name](docs, labels, bench)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect()) == sorted((i is None, i or 0) for i, *_ in edge_rows())
    assert OPERATORS[name](empty, labels, bench).count() == 0


def test_no_labels(docs, labels):
    none = labels.where("false")
    assert all(0 <= r.score <= 1 for r in line_crf.score(docs, none).collect())
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, none).collect())
    assert {r.lang_pred for r in byte_cnn.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_scores(docs):
    got = {r.doc_id: r for r in byte_cnn.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6)) and got[1].lang_pred == "en"
    assert got[1].held_out == (zlib.crc32(b"1") % 4 == 2)


# near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, per_cent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, s)), (b, (_, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and 100 * len(s & t) >= per_cent * len(s | t):
            parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(len(sets)):
        groups[root(k)].append(sets[k][0])
    return {sets[k][0]: (min(groups[root(k)]), len(sets[k][1])) for k in range(len(sets))}


def varied(rng, n, words=60, edits=(0, 12)):
    """Copies of a text with some words changed: similarities on both sides of the threshold, and chains."""
    base = [f"w{rng.integers(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base if not out or rng.random() < 0.5 else out[rng.integers(0, len(out))].split())
        for k in rng.integers(0, words, rng.integers(*edits)):
            w[k] = f"v{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [*varied(rng, 120, 80, (0, 4)), *varied(rng, 60, 40, (0, 2)), *(t for t in ["", "one two", "One  TWO", "one two three"] for _ in range(2)), None]
    rows = list(enumerate(texts * 1, 1))
    want = components(rows)
    for block in (near_dedup.BLOCK, 16):  # one block, and many that meet each other
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in near_dedup.link(frame(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
        assert got == {i: (c, n, c == i) for i, (c, n) in want.items()}


def test_similarity_estimates():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.85, 0.95):
        n = 2000
        shared = int(2 * n * j / (1 + j))
        common = rng.integers(0, 2**63, shared).astype(np.uint64)
        sides = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - shared).astype(np.uint64)])) for _ in "ab"]
        a, b = near_dedup.sketches(sides)
        union = near_dedup.sketches([np.union1d(*sides)])[0]
        assert (np.maximum(a, b) == union).all()  # mergeable
        equal, greater = np.array([(a == b).sum()]), np.array([(a > b).sum()])
        less, sizes = near_dedup.REGISTERS - equal - greater, np.array([float(n)])
        assert near_dedup.at_least(j - 0.13, less, equal, greater, sizes, sizes)[0]
        assert not near_dedup.at_least(min(0.99, j + 0.13), less, equal, greater, sizes, sizes)[0]


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.label for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_stage_keeps_one_of_each_group(docs):
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = components([(i, t) for i, t, *_ in edge_rows() if i is not None])
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for c, _ in want.values()})


# packing


def test_pieces_round_trip_through_the_tokenizer_file(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack(docs, queries.tokenizer_path(), 512).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.start, r.length, r.ids_crc32, r.piece))
    for i, text, *_ in edge_rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        pieces = sorted(by[i])
        assert [p[3] for p in pieces] == list(range(len(pieces))) and sum(p[1] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c, _ in pieces)
        assert all(n == 512 for _, n, _, k in pieces if k > 0)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512


def test_special_strings_are_as_the_file_says():
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b  \n\n c's   x"
    path = queries.tokenizer_path()
    assert packing.Encoder(path).encode(text)[:-1].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.best_two_fit(counts, 10) == [([6, 2, 2], 1), ([3], 1)]  # 6 and 3 leave one; two twos leave none
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    bins = packing.best_two_fit(counts, 100)
    used = np.zeros(101, np.int64)
    for items, times in bins:
        assert sum(items) <= 100
        np.add.at(used, items, times)
    assert (used == counts).all()
    assert sum(n for _, n in bins) <= 1.005 * math.ceil((counts * np.arange(101)).sum() / 100)


# sharding


@pytest.mark.parametrize("n", [0, 3, 100])
def test_shards_are_even_and_cut_few_groups(spark, n):
    texts = [f"same {i % 7}" if i % 3 else f"own {i}" for i in range(n)] + ["hot"] * (n // 2)
    rows = sharding.shard(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), 8).collect()
    size = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and (not rows or max(size.values()) - min([size[s] for s in range(8)]) <= 1)
    for s in size:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(size[s]))
    by = collections.defaultdict(set)
    for r in rows:
        by[texts[r.doc_id]].add(r.shard)
        assert r["size"] == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    if n == 100:
        assert len(by["hot"]) <= 5  # of 50 rows, 18 or 19 a shard; at random all eight
        assert sum(len(s) > 1 for t, s in by.items() if t.startswith("same")) <= 3


def test_ranks_are_gapless(spark):
    df = spark.range(500).withColumn("p", (F.col("id") % 3 == 0).cast("int"))
    rows = ranked(df, ["p"], ["id"], F.pmod(F.hash("id"), F.lit(9))).collect()
    for p in (0, 1):
        assert sorted(r["rank"] for r in rows if r.p == p) == list(range(sum(r.p == p for r in rows)))


# rules


def slow_stats(text):
    words = (text or "").encode().split()
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_rule_statistics_equal_brute_force(docs):
    texts = [t for _, t, *_ in edge_rows()] + ["a b a b a b", "x x x x", "a b c d a b c", "#*$ <a>\n<a>\n <a>\n<a>", "   x\x1cy \x85"]
    for t in texts:
        assert quality_rules.text_stats(t)[:5] == slow_stats(t), t
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t, *_ in edge_rows():
        n, _, _, _, rep = slow_stats(t)
        assert got[i].base_failed == (n < 50 or 100 * rep > 50 * n) and (not got[i].kept or not got[i].base_failed)


def test_outliers_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    rows = [(i, " ".join(word() for _ in range(80)), "en", f"s{i % 2}") for i in range(1000)]
    bad = [(1000 + i, " ".join(word() + "***" for _ in range(80)), "en", "s0") for i in range(100)]
    got = {r.doc_id: r.kept for r in quality_rules.judged(frame(spark, rows + bad)).collect()}
    assert all(got[i] for i, *_ in rows) and not any(got[i] for i, *_ in bad)
    kept = quality_rules.filter_documents(frame(spark, rows + bad))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").replace(" boolean", "").split(", ")
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_sources_of_some_tens_of_rows_have_their_own_estimates(spark):
    """A source that writes in capitals is no outlier of itself; a single document that does is one of its language."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    text = lambda: " ".join(word() for _ in range(80))
    rows = [(i, text(), "en", "plain") for i in range(500)]
    own = [(1000 + i, text().upper(), "en", "capitals") for i in range(60)]
    odd = [(2000, text().upper(), "en", "plain"), (2001, text().upper(), "en", "single"), (2002, " ".join(word().upper() + "***" for _ in range(80)), "en", "capitals")]
    got = {r.doc_id: r.kept for r in quality_rules.judged(frame(spark, rows + own + odd)).collect()}
    assert all(got[i] for i, *_ in rows + own) and not any(got[i] for i, *_ in odd)


def test_pooled_estimates_have_no_step():
    wide, own = (np.zeros(4), np.eye(4)), (np.ones(4), 2 * np.eye(4))
    means = [quality_rules.pooled(n, *own, *wide)[0][0] for n in range(2000)]
    assert means[0] == 0 and means[-1] > 0.99 and 0 < max(np.diff(means)) < 0.02 and min(np.diff(means)) > 0


# personal data


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if luhn(m[0])]
    return out + [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(map(str.isdigit, m[0])) <= 15]


TRICKY = [
    "a@b.c_d@e.f, x@y..z q@-.- é@b.co \U0001f600 ab@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 99999999999999999999999999999999999999999.1.1.1 1.1.1.300 1.1.1.3", "4111-1111 1111 1111 and 4111111111111112 5500005555555559 12", "+1 (555) 123-4567+44 20 7946 0958 +1234567 +1--2 +12345678901234567",
    "4111 1111 1111 1111 4111 1111 1111 1111", "@" * 300 + "a" * 2000, "1." * 2000, "login password = \"abcd1234efgh5678\" token: xyz", "write to jane (at) mail (dot) com or call (555) 123-4567", "look at this dot com",
]


def test_base_spans_equal_brute_force(spark, docs):
    rows = [(100 + i, t, "en", "a") for i, t in enumerate(TRICKY)]
    texts = dict((i, t or "") for i, t, *_ in [*edge_rows(), *rows])
    for r in pii.find(docs.unionByName(frame(spark, rows))).collect():
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r, joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _ in spans) for x in ("email", "ip", "card", "phone")]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_labelers_that_agree_are_trusted():
    counts = [((1, 1, 0), 80), ((1, 1, 1), 20), ((-1, -1, 0), 150), ((-1, 1, 0), 10), ((0, -1, 0), 40)]
    prior, tables, post = pii.reliabilities(counts)
    assert post[0] > 0.9 and post[1] > 0.9 and post[2] < 0.1 and tables[0][1][0] > tables[0][1][1] and 0.2 < prior < 0.5


def test_redaction_replaces_spans_only(docs):
    got = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert got[12] == BASE + " mail [email] or [card] and [phone] at [ip]" and got[1] == BASE and got[4] is None and got[10] == "x" * 50_000
    assert pii.redacted(docs).columns == docs.columns


# decontamination


def test_leaks_are_found_and_clean_texts_left(spark, docs, bench):
    rng = np.random.default_rng(5)
    filler = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    rows = [(1, filler(300) + " " + BASE + " " + filler(200), "en", "a"), (2, filler(500), "en", "a"), (3, filler(37), "en", "a"), (4, None, "en", "a"), (5, "The. " + BASE.upper().replace(" ", ", "), "en", "a")]
    rows += [(10 + i, filler(60), "en", "a") for i in range(30)]
    got = decontamination.contaminated(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (5, 1)} and all(r.ratio >= 0.6 for r in got)
    kept = decontamination.drop_contaminated(frame(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {1, 5} and kept.columns == docs.columns
    assert decontamination.contaminated(frame(spark, rows), bench.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_recall_of_leaks_and_paraphrases(spark):
    """Against brute force by word runs; and every fifth word of an item changed, inside documents of the corpus."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: decontamination.words_of(r.text) for r in bench.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    leaks = {(i, k) for i, t in rows for k, w in items.items() if " " + " ".join(x.decode() for x in w) + " " in " " + " ".join(x.decode() for x in decontamination.words_of(t)) + " "}
    clean = [(i, t) for i, t in rows if i not in {d for d, _ in leaks}][: len(items)]
    planted = [(10_000 + i, f"{t} {' '.join(w.decode() if n % 5 else 'changed' for n, w in enumerate(words))} {t}", k) for (i, t), (k, words) in zip(clean, items.items())]
    more = spark.createDataFrame([(i, t) for i, t, _ in planted], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs.select("doc_id", "text").unionByName(more), bench).collect()}
    assert leaks <= got
    assert len({(i, k) for i, _, k in planted} & got) >= 0.9 * len(planted)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_loose_paraphrases_reach_the_verification(spark):
    """Items of which 46% of the words are left, the answer among them, inside documents: against the check on the place."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    space = decontamination.fitted(docs, [bench])[0]
    texts = [decontamination.words_of(r.text) for r in docs.orderBy("doc_id").limit(200).collect()]
    rng, tried, found = np.random.default_rng(0), 0, 0
    pool = [w for t in texts for w in t[:60]]
    for item in space.items:
        n, a = len(item.words), len(item.answer)
        for _ in range(5):
            left = {*rng.permutation(n - a)[: max(0, math.ceil(0.46 * n) - a)].tolist(), *range(n - a, n)}
            altered = [w if i in left else pool[rng.integers(len(pool))] for i, w in enumerate(item.words)]
            text = texts[rng.integers(len(texts))]
            at = rng.integers(0, len(text) + 1)
            if item.in_region(altered)[1]:
                tried += 1
                found += item.key in {m[0] for m in space.matches([text[:at] + altered + text[at:]])[0]}
    assert tried >= 100 and found >= 0.9 * tried, (found, tried)


@pytest.mark.parametrize("n", [20, 30, 38, 54])
def test_windows_reach_the_end_of_the_text(n):
    """Half of an item's words, its answer among them, as the last words of texts of all lengths."""
    item = decontamination.Item(1, [b"w%d" % i for i in range(n)])
    altered = [w if i < n // 2 - len(item.answer) + 1 or i >= n - len(item.answer) else b"x" for i, w in enumerate(item.words)]
    assert decontamination.LOOSE <= item.in_region(altered)[0] / n < decontamination.OVERLAP
    for more in range(40):
        text = [b"y"] * more + altered
        assert decontamination.Space._best(item, text, 0, len(text)), more


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (rng.integers(0, 4, rng.integers(0, 30)).tolist() for _ in "ab")
        assert decontamination.common_subsequence(a, b) == slow(a, b)


# scoring


def test_base_score_equals_brute_force(docs):
    got = OPERATORS["op1"](docs, None, None).collect()
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t, *_ in edge_rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = {i: (held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens}
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) and r.score < 0


def test_windows_score_each_id_once():
    lengths = np.array([1, 5, 24, 25, 43, 200])
    f = {"ids": np.arange(lengths.sum())}
    _, at, scored = lm_scoring.windows_of(f, lengths, 0)
    assert sorted(at[scored].tolist()) == list(range(lengths.sum()))


def tiny_model():
    words = [[1], [2, 3], [2, 4], [5], [6]]
    trie, owner, steps, last = lm_scoring.Trie.of(*lm_scoring._flat(words), np.array([5, 4, 3, 2, 6]))
    rng = np.random.default_rng(0)
    share, theta = np.full(lm_scoring.TOPICS, 1 / lm_scoring.TOPICS), rng.dirichlet(np.ones(7), lm_scoring.TOPICS)
    reach, stop = rng.random((len(trie.through), lm_scoring.TOPICS)) + 0.1, rng.random((len(trie.through), lm_scoring.TOPICS)) + 0.05
    reach[0] = 1
    return lm_scoring.Attention(reach, stop, share, theta, 0), trie


def test_gradients_equal_differences():
    model, trie = tiny_model()
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.reach, model.stop, model.theta = (x.astype(np.float64) for x in (model.reach, model.stop, model.theta))
    rng, shape = np.random.default_rng(1), (3, lm_scoring.LENGTH)
    f = {"ids": rng.integers(0, 7, shape), "child": rng.integers(0, len(trie.through), shape), "parent": rng.integers(0, len(trie.through), shape), "node": rng.integers(0, len(trie.through), shape), "gate": rng.integers(0, 20, shape), "before": np.zeros(shape, int)}
    f |= {k: rng.random(shape) for k in ("factor", "share", "other", "w_factor", "w_share", "w_other")}
    inputs, weight = rng.integers(0, 7, shape), np.ones(shape)

    def loss():
        model2 = lm_scoring.Attention.__new__(lm_scoring.Attention)
        model2.__dict__.update(model.__dict__)
        x = model.embed[inputs]
        s = np.where(model.mask, (x @ model.wq / math.sqrt(lm_scoring.WIDTH)) @ (x @ model.wk).transpose(0, 2, 1) + model.near[model.distance], -1e9)
        a = np.exp(s - s.max(2, keepdims=True))
        u = (a / a.sum(2, keepdims=True)) @ (x @ model.wv) @ model.wo + model.bias
        z = np.exp(u - u.max(2, keepdims=True))
        z /= z.sum(2, keepdims=True)
        dot = lambda t: (z * t).sum(2)
        p = (f["factor"] * dot(model.reach[f["child"]]) / dot(model.reach[f["parent"]]) + f["share"] * f["other"]) * (f["w_factor"] * dot(model.stop[f["node"]]) / dot(model.reach[f["node"]]) + f["w_share"] * f["w_other"])
        g = 1 / (1 + np.exp(-model.gates[f["gate"]]))
        return -np.log(g * p + (1 - g) * dot(model.theta[f["ids"]])).mean()

    found = model.gradients(inputs, f, weight)
    for name in model.NAMES:
        value = getattr(model, name)
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 5)]:
            keep = value[at]
            value[at] = keep + 1e-5
            up = loss()
            value[at] = keep - 1e-5
            down = loss()
            value[at] = keep
            assert found[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(7)
    chain, lengths = rng.normal(size=(2, 2)), np.array([1, 4, 3])
    unary = rng.normal(size=8)
    got, counts = line_crf.forward_backward(unary, lengths, chain)
    at, total = 0, np.zeros((2, 2))
    for n in lengths:
        u = unary[at : at + n]
        weights = {y: math.exp(sum(u[i] * y[i] for i in range(n)) + sum(chain[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=int(n))}
        norm = sum(weights.values())
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / norm)
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                total[a, b] += w / norm
        at += n
    assert counts == pytest.approx(total)


def test_disguised_words_are_restored():
    text = "idiot moron clown stupid loser the and of with this that word words " * 20
    model = toxicity.CharacterModel(toxicity.trigrams([text]))
    for word, plain in (("1d10t", "idiot"), ("m.o.r.o.n", "moron"), ("cl0wn!!", "clown"), ("looooser", "loser"), ("$tup1d", "stupid")):
        assert plain in toxicity.restored(word, model), word
    assert toxicity.restored("word,", model) == ("word",) and toxicity.restored("x" * 99, model) == ("x" * 99,)
    hashed = toxicity.features("idiot")[0]
    reader = toxicity.Reader(model, {hashed: 1.0})
    assert hashed in reader.text("so i d i o t it is") and hashed not in reader.text("a b c d e f")


def test_signs_at_the_edges_are_read():
    model = toxicity.CharacterModel(toxicity.trigrams(["ass worthless shit asshole less glass shot idiot hole the and of worth word " * 20]))
    for word, plain in (("a$$", "ass"), ("worthle$$", "worthless"), ("$$hit", "shit"), ("@$$hole", "asshole"), ("'worthle$$!!',", "worthless"), ("!!diot", "idiot")):
        assert plain in toxicity.restored(word, model), word
    for word in ("word!!", "(word)!!!", "__word__", "\u201eword\u201d,"):
        assert toxicity.restored(word, model)[0] == "word"
    assert toxicity.restored("word!!", model) == ("word",) and toxicity.restored("$$$", model) == toxicity.restored("--", model) == ()


def test_words_of_any_length_are_restored():
    model = toxicity.CharacterModel(toxicity.trigrams(["you are a stupid idiot moron loser the and of with this that word " * 20]))
    stretched = "l" + "o" * 60 + "ser"
    assert "loser" in toxicity.restored(stretched, model) and "idiot" in toxicity.restored("i" + "." * 60 + "diot", model)
    hashed = toxicity.features("idiot")[0]
    reader = toxicity.Reader(model, {hashed: 1.0})
    assert hashed in reader.text("-".join("the word of this that and you are a stupid 1d10t with word".split()))
    assert hashed in reader.text(" ".join("theandofwiththatwordyouareastup1d1d10tandthewordofthisthatandthat"))
    assert hashed not in reader.text("-".join(["the word of this"] * 9)) and toxicity.decode("w" * 50_000, model) in ("w", "ww")


SMALL = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name,label,least", [("op3_quality_classifier", "quality", 0.97), ("op10_toxicity", "toxic", 0.9), ("op8_language_id", None, 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SMALL).where("held_out")
    if label:
        rows = got.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").select((F.col("predicted") == F.col(label)).alias("ok"))
    else:
        rows = got.join(spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null"), "doc_id").select((F.col("lang_pred") == F.col("lang")).alias("ok"))
    assert rows.agg(F.avg(F.col("ok").cast("double"))).first()[0] >= least


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_model_beats_the_base_on_held_out_texts(spark):
    r = queries.QUERIES["op1_lm_scoring"](spark, SMALL).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# the pipeline


def test_stages_and_edges(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, "entirely different words in this benchmark item that nobody has copied anywhere else")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (docs, empty):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == given.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    bench = [decontamination.words_of(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality_rules.judged(spark.read.parquet(f"{DIR}/documents.parquet")).where("kept").collect()}
    assert not any(r.doc_id in good for r in docs if slow_stats(r.text)[0] < 50)
    rows = [(r.doc_id, r.text) for r in docs if r.doc_id in good]
    linked = components(rows, 80)  # the stage's rule: a similarity of 0.8 or more
    rows = [(i, t) for i, t in rows if linked[i][0] == i]
    joined = lambda t: b" " + b" ".join(decontamination.words_of(t)) + b" "
    leaked = {i for i, t in rows if any(b" " + b" ".join(w) + b" " in joined(t) for w in bench)}
    got = {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == {i for i, _ in rows} - leaked


def test_staged_tables_are_read_back_and_cleaned(spark):
    kept = staged(spark.range(5), "five")
    assert kept.count() == 5
    assert clean(spark) >= 1 and clean(spark) == 0


def test_remainders(spark):
    rows = spark.range(50).select("id", remainder("id", 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
