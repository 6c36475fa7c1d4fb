"""The methods of the training-data operators against slow and plain versions of themselves, and at their limits."""

import collections
import hashlib
import itertools
import math
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitextmill.llm import byte_cnn, decontamination, line_crf, lm_scoring, near_dedup, packing, pii, quality_rules, queries, sharding, toxicity

from .test_llm import BASE, base_spans, bench, components, docs, edge_rows, empty, frame, labels, varied  # noqa: F401 - fixtures

# sharding


def linked_rows(spark, n=200, shards=8):
    rng = np.random.default_rng(3)
    texts = [f"group {g}" for g in rng.integers(0, 45, n)] + ["hot"] * (n // 4)
    df = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    df = df.select("doc_id", F.col("text").alias("hub"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")).withColumn("_u", sharding._unit("doc_id", "text_crc32"))
    capacity = len(texts) // shards
    return df.withColumn("piece", F.when(F.col("hub") == "hot", F.floor(F.col("_u") * math.ceil(n // 4 / capacity)).cast("int")).otherwise(0)).cache(), shards, capacity


def test_propagation_equals_a_plain_version(spark):
    df, shards, capacity = linked_rows(spark)
    number = lambda c: c.alias("h")
    tie = {(r.hub, r.piece, r.s): r.h for r in df.select("hub", "piece").distinct().withColumn("s", F.explode(F.array(*map(F.lit, range(shards))))).select("hub", "piece", "s", number(F.xxhash64("hub", "piece", "s"))).collect()}
    rows = df.select("doc_id", "hub", "piece", F.pmod(F.xxhash64("doc_id", "_u"), F.lit(sharding.GRAIN)).alias("own"), F.pmod(F.xxhash64("hub", "piece"), F.lit(sharding.GRAIN)).alias("all")).collect()
    label = {r.doc_id: r["shard"] for r in sharding.propagate(df, shards, capacity, 0).collect()}
    most = capacity + -(-capacity // sharding.SLACK)
    load = collections.Counter({s: 0 for s in range(shards)}) + collections.Counter()
    load = {s: sum(v == s for v in label.values()) for s in range(shards)}
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.hub, r.piece].append(r)
    for rounds in range(1, 4):
        open_ = [s for s in load if load[s] < most]
        asked = []
        for (hub, piece), members in groups.items():
            cells = collections.Counter(label[r.doc_id] for r in members)
            best = max(((cells[s], tie[hub, piece, s], s) for s in cells if s in open_), default=None)
            for r in members:
                now = label[r.doc_id]
                if best and best[2] != now and cells[now] <= best[0]:
                    asked.append((now, best[2], int(r.own if len(members) * 8 > capacity else r["all"]), r.doc_id))
        allowed = sharding.granted(load, [(*k, n) for k, n in collections.Counter(a[:3] for a in asked).items()], most)
        for _, want, grain, i in asked:
            if (want, grain) in allowed:
                label[i] = want
        got = {r.doc_id: r["shard"] for r in sharding.propagate(df, shards, capacity, rounds).collect()}
        assert got == label, rounds
        assert load == {s: sum(v == s for v in label.values()) for s in range(shards)}


def test_propagation_cuts_fewer_edges_each_round(spark):
    df, shards, capacity = linked_rows(spark, 2000, 16)
    cut = [sharding.cut_edges(sharding.propagate(df, shards, capacity, rounds)) for rounds in (0, 1, 3, 5)]
    # 500 copies of one text need four shards: 93750 of the links cannot but be cut
    assert cut[0] > cut[1] > cut[2] >= cut[3] and cut[3] - 93_750 < 0.3 * (cut[0] - 93_750), cut
    placed = {rounds: {r.doc_id: r["shard"] for r in sharding.shard(frame(spark, [(r.doc_id, r.hub, "en", "a") for r in df.collect()]), shards, rounds).collect()} for rounds in (0, 3)}
    hubs = {r.doc_id: r.hub for r in df.collect()}
    split = {k: sum(len({p[i] for i in hubs if hubs[i] == h}) - 1 for h in set(hubs.values())) for k, p in placed.items()}
    assert placed[0] != placed[3] and split[3] < split[0]


def test_quotas_are_kept():
    rng = random.Random(1)
    for _ in range(50):
        load = {s: rng.randrange(20) for s in range(5)}
        most = rng.randrange(15, 25)
        requests = [(a, b, g, rng.randrange(1, 6)) for a in range(5) for b in range(5) if a != b for g in range(3) if rng.random() < 0.6]
        before = dict(load)
        allowed = sharding.granted(load, requests, most)
        after = dict(before)
        for a, b, g, n in requests:
            if (b, g) in allowed:
                after[a] -= n
                after[b] += n
        assert after == load and all(after[s] <= max(most, before[s]) for s in load)


# near duplicates


def test_thousands_of_near_copies_in_one_bucket(spark, monkeypatch):
    """Most differ from one another in a word or two; the blocks that are compared are few, and the result is whole."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(5000):
        w = list(words)
        w[rng.integers(0, 300)] = f"v{i}"
        rows.append((i, " ".join(w), "en", "a"))
    far = [f"x{k}" if k % 9 == 0 else w for k, w in enumerate(words)]
    rows += [(9000 + i, " ".join([*far[:-1], f"z{i}"]), "en", "a") for i in range(20)]
    began = time.perf_counter()
    got = {r.doc_id: r.component_id for r in near_dedup.link(frame(spark, rows)).collect()}
    assert {got[i] for i in range(5000)} == {0} and {got[9000 + i] for i in range(20)} == {9000}
    assert time.perf_counter() - began < 120


def test_blocks_by_component_and_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [*varied(rng, 90, 80, (0, 5)), *varied(rng, 60, 40, (0, 3))]
    rows = list(enumerate(texts, 1))
    want = components(rows)
    for name, value in (("BLOCK", 8), ("BLOCK_BYTES", 4000), ("REPRESENTATIVES", 1)):
        monkeypatch.setattr(near_dedup, name, value)
        got = {r.doc_id: r.component_id for r in near_dedup.link(frame(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
        assert got == {i: c for i, (c, _) in want.items()}, name


def test_too_many_ids_for_a_bitmap(docs, monkeypatch):  # noqa: F811
    want = sorted((r.doc_id or -1) for r in near_dedup.drop_near_duplicates(docs).collect())
    monkeypatch.setattr(near_dedup, "MOST_BITS", 1)
    assert sorted((r.doc_id or -1) for r in near_dedup.drop_near_duplicates(docs).collect()) == want


# rules


def plain_estimates(rows, steps=quality_rules.STEPS):
    """rows: (lang, source, features). Estimates of all groups, by loops."""
    p, h, factor = quality_rules.P, quality_rules.SUPPORT, quality_rules._consistency(quality_rules.SUPPORT)
    groups = collections.defaultdict(list)
    for lang, source, x in rows:
        for key in ("all", ("l", lang), ("s", lang, source)):
            groups[key].append(x)
    groups = {k: np.array(v) for k, v in groups.items()}
    up = lambda k: () if k == "all" else ("all",) if k[0] == "l" else (("l", k[1]), "all")

    def pooled(raw, key):
        mean, cov = raw["all"][1:]
        for k in [k for k in (*reversed(up(key)), key) if k != "all"]:
            mean, cov = quality_rules.pooled(raw[k][0], raw[k][1], raw[k][2], mean, cov)
        return mean, np.linalg.inv(cov + quality_rules.RIDGE)

    best = {}
    for start in range(quality_rules.STARTS):
        now = {}
        for k, x in groups.items():
            n = len(x)
            if start == 0:
                q = np.sort(x, axis=0)[[math.ceil(s * n) - 1 for s in (0.25, 0.5, 0.75)]]
                mean, var = q[1], ((q[2] - q[0]) / 1.349) ** 2
            else:
                mean, var = x.mean(0), x.var(0)
            now[k] = mean, np.diag(1 / (var + np.diag(quality_rules.RIDGE)))
        for _ in range(steps):
            raw = {}
            for k, x in groups.items():
                d = np.einsum("ni,ij,nj->n", x - now[k][0], now[k][1], x - now[k][0])
                bins = np.clip(np.floor((np.log(d + 1e-9) - quality_rules.LOW) * quality_rules.GRAIN), 0, quality_rules.BINS)
                limit = np.sort(bins)[math.ceil(len(x) * h) - 1]
                inside = x[bins <= limit]
                raw[k] = len(inside), inside.mean(0), factor * np.cov(inside.T, bias=True).reshape(p, p)
            now = {k: pooled(raw, k) for k in groups}
        for k in groups:
            det = np.linalg.slogdet(raw[k][2] + quality_rules.RIDGE)[1]
            if k not in best or det < best[k][0] - 1e-12:
                best[k] = det, raw[k]
    chosen = {k: r for k, (_, r) in best.items()}
    return {k: pooled(chosen, k) for k in groups}


@pytest.mark.parametrize("most_sent", [20_000, 0])
def test_verdicts_equal_plain_estimates(spark, monkeypatch, most_sent):
    monkeypatch.setattr(quality_rules, "MOST_SENT", most_sent)  # 0: groups are joined by key and salt
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 10)))
    text = lambda mark, case: " ".join((word().upper() if rng.random() < case else word()) + (mark if rng.random() < 0.1 else "") for _ in range(70))
    rows = [(i, text("*" if i % 31 == 0 else "", 0.05 + 0.3 * (i % 3 == 2)) + ("***" * 40 if i % 50 == 0 else ""), "en" if i % 4 else "de", f"s{i % 3}") for i in range(400)]
    rows += [(1000, text("", 0.0), None, None), (1001, "short", "en", "s0"), (1002, text("#", 1.0), "fr", "single")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    features = {r.doc_id: [r[f] for f in quality_rules.FEATURES] for r in quality_rules.with_stats(df, ["doc_id"]).select("doc.doc_id", *quality_rules.FEATURES).collect()}
    good = [(lang, source, features[i]) for i, _, lang, source in rows if not got[i].base_failed]
    found = plain_estimates(good)
    limit = quality_rules.chi2_quantile(quality_rules.P, quality_rules.TAIL)
    for i, _, lang, source in rows:
        if got[i].base_failed:
            assert not got[i].kept
            continue
        mean, inverse = found["s", lang, source]
        x = np.array(features[i]) - mean
        assert got[i].distance == pytest.approx(x @ inverse @ x, rel=1e-6, abs=1e-9), i
        assert got[i].kept == (got[i].distance <= limit)


# personal data


def test_many_matches_take_linear_time(spark):
    """100,000 matches of one kind, of several kinds by turns, and wide candidates, each in one text."""
    texts = ["a@b.co " * 100_000, "a@b.co 10.0.0.1 +1 (555) 123-4567 x (at) y (dot) com " * 25_000, "token: abcd1234efgh " * 50_000]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    clean = {r.doc_id: r.text for r in pii.redacted(frame(spark, rows)).collect()}
    assert time.perf_counter() - began < 90
    assert got[0].n_email == 100_000 and (got[1].n_email, got[1].n_ip, got[1].n_phone) == (25_000,) * 3
    assert got[0].spans.split(",")[-1] == f"email:{7 * 99_999}:{7 * 100_000 - 1}"
    assert clean[0] == "[email] " * 100_000 and clean[1].startswith("[email] [ip] [phone] ")


def test_places_are_those_of_brute_force(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "é", "\U0001f600", "word", "\n", "300.1.1.1", "secret=abcdefgh1234"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 127, 128, 129, 700]))), "en", "a") for i in range(40)]
    for r in pii.find(frame(spark, rows)).collect():
        want = [f"{k}:{m.start()}:{m.end()}" for k, m in base_spans(rows[r.doc_id][1])]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))


def test_mask_characters_of_a_text_survive(spark):
    text = "﷐﷑ a@b.co ﷘﷠ ﷗x ﷘ 1.2.3.4﷒"
    rows = [(1, text, "en", "a"), (2, "﷐ nothing", "en", "a")]
    got = {r.doc_id: r.text for r in pii.redacted(frame(spark, rows)).collect()}
    assert got == {1: text.replace("a@b.co", "[email]").replace("1.2.3.4", "[ip]"), 2: "﷐ nothing"}


# decontamination


@pytest.mark.parametrize("key", ["int", "string", "bigint"])
def test_ids_of_any_type(spark, docs, empty, bench, key):  # noqa: F811
    items = bench.select(F.col("item_id").cast(key).alias("item_id"), "text")
    got = decontamination.contaminated(docs, items)
    assert dict(got.dtypes)["item_id"] == key
    assert {(r.doc_id, str(r.item_id)) for r in got.collect()} >= {(i, "1") for i in (1, 2, 3, 12, 13)}
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.contaminated(docs, items.where("false")).count() == 0


def test_blocks_of_items_find_the_same(spark, docs, bench, monkeypatch):  # noqa: F811
    want = sorted((r.doc_id, r.item_id, r.common_words) for r in decontamination.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK", 1)
    monkeypatch.setattr(decontamination, "TOGETHER", 2)
    assert sorted((r.doc_id, r.item_id, r.common_words) for r in decontamination.contaminated(docs, bench).collect()) == want and want


@pytest.mark.parametrize("dense", [1 << 24, 64])
def test_latent_space_rests_on_every_document(spark, monkeypatch, dense):
    """Sums over the passages of more documents than a sample would hold, repeated and null ids too, against plain ones."""
    monkeypatch.setattr(decontamination, "DENSE", dense)
    monkeypatch.setattr(decontamination, "PART", 200)
    rng, pool = np.random.default_rng(3), [f"w{i}" for i in range(60)]
    texts = [" ".join(pool[j] for j in (rng.random(rng.integers(0, 90)) ** 2 * 60).astype(int)) for _ in range(2000)] + ["", "none of these"]
    docs = spark.createDataFrame([(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    items = [[decontamination.Item(k, [w.encode() for w in pool[a + k : a + k + 20]]) for k in range(5)] for a in (0, 25)]
    spaces = [decontamination.Space(i) for i in items]
    decontamination._frequencies(docs, spaces)
    moments = decontamination._moments(docs, spaces)
    for block, space in enumerate(spaces):
        want, n = np.zeros((space.size, space.size)), 0
        for t in texts:
            words = decontamination.words_of(t)
            for f, v in space.rows(words, np.arange(0, len(words), decontamination.PASSAGE)):
                want[np.ix_(f, f)] += np.outer(v, v)
                n += len(f) > 0
        got = np.zeros(want.size + 200)
        rows = moments.where(F.col("block") == block).collect()
        for r in rows:
            if r.k >= 0:
                got[r.k * decontamination.part_rows(space.size) * space.size + np.frombuffer(r.cells, np.int32)] += np.frombuffer(r.sums)
        got = got[: want.size].reshape(want.shape)
        assert np.allclose(got + got.T, want, rtol=1e-5) and sum(r.n for r in rows if r.k < 0) == n > 3000


def test_screen_leaves_out_nothing_that_verifies():
    rng = np.random.default_rng(0)
    pool = [b"w%d" % i for i in range(60)]
    items = [decontamination.Item(k, [pool[j] for j in rng.integers(0, 60, rng.integers(4, 30))]) for k in range(12)]
    space = decontamination.Space(items)
    leaks = 0
    for _ in range(150):
        words = [pool[j] for j in rng.integers(0, 60, 80)]
        item = items[rng.integers(12)]
        at = rng.integers(0, 60)
        words[at : at + len(item.words)] = [w if rng.random() < 0.7 else b"x" for w in item.words]
        space.screen(rng.integers(0, 9, space.size))  # whichever words are frequent
        other = [pool[j] for j in rng.integers(0, 60, 30)]
        found = list(map(space.features, (other, words, [])))
        likely = space.first.plausible(found)
        assert len(likely) == 3 and not len(likely[2])
        for k, it in enumerate(items):
            for text, f, some in zip((other, words), found, likely):
                if decontamination.Space._best(it, text, 0, len(text)):
                    leaks += 1
                    assert k in some and k in space.second.dense(some, *f)
    assert leaks > 50


# packing


def plain_packing(lengths, capacity):
    """Best-two-fit on single pieces."""
    left, bins = sorted(lengths), 0
    while left:
        items, gap = [], capacity
        while (fits := [x for x in left if x <= gap]) and gap:
            items.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap:
            wide = gap + items[-1]
            pairs = [(a + b) for a, b in itertools.combinations(left, 2) if a + b <= wide]
            if pairs and max(pairs) > items[-1]:
                a, b = next((a, b) for a, b in itertools.combinations(left, 2) if a + b == max(pairs))
                left.remove(a)
                left.remove(b)
                left.append(items.pop())
                left.sort()
        bins += 1
    return bins


def test_packing_equals_a_plain_version():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 60, 150):
        lengths = rng.integers(1, 41, n).tolist()
        counts = np.bincount(lengths, minlength=41) if n else np.zeros(41, np.int64)
        bins = packing.best_two_fit(counts, 40)
        assert sum(k for _, k in bins) == plain_packing(lengths, 40)


def test_packing_edges(spark, docs, empty):  # noqa: F811
    path = queries.tokenizer_path()
    assert packing.pack(empty, path).count() == 0
    got = packing.pack(docs, path, 2048).collect()
    assert {r.doc_id for r in got} == {i for i, *_ in edge_rows()}
    assert sorted(r.length for r in got if r.doc_id in (4, 5)) == [1, 1]


def test_other_tokenizer_files_go_through_their_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 5, "b": 6, "[UNK]": 7}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "words.json"))
    encoder = packing.Encoder(str(tmp_path / "words.json"))
    assert encoder.fast is None and encoder.encode("a b c").tolist() == [5, 6, 7, 0]
    assert packing.Encoder(queries.tokenizer_path()).fast is not None


# classifiers


def test_line_scores_equal_enumeration():
    """A document's score from all labellings of its lines."""
    rng = np.random.default_rng(1)
    text = "Good line here.\n\nBUY $$$ NOW !!!\nAnother fine line of words.\nx x x"
    stats, weight = line_crf.line_stats(text)
    field = line_crf.Field(rng.normal(size=line_crf.WIDTH), np.ones(line_crf.WIDTH), rng.normal(0, 0.2, line_crf.WIDTH), 0.1, rng.normal(size=(2, 2)), (1.3, -0.2))
    unary = field.unary(line_crf.with_neighbours(stats))
    good, norm = np.zeros(len(unary)), 0.0
    for y in itertools.product((0, 1), repeat=len(unary)):
        w = math.exp(sum(u * k for u, k in zip(unary, y)) + sum(field.chain[a, b] for a, b in zip(y, y[1:])))
        norm += w
        good += w * np.array(y)
    share = float((good / norm * weight).sum() / weight.sum())
    want = 1 / (1 + math.exp(-(1.3 * math.log(share / (1 - share)) - 0.2)))
    assert field.scores([(stats, weight)])[0] == pytest.approx(want, rel=1e-5)


def test_convolutions_equal_loops():
    net = byte_cnn.Network(["de", "en", "fr"])
    window = np.frombuffer("The quick brown fox".encode().ljust(byte_cnn.WINDOW, b"\0"), np.uint8)
    hidden = np.full(byte_cnn.CHANNELS, -np.inf)
    for c in range(byte_cnn.CHANNELS):
        for at in range(byte_cnn.WINDOW - byte_cnn.WIDEST + 1):
            total = 0.0
            for k in range(byte_cnn.WIDTHS[c // byte_cnn.FILTERS]):  # narrower filters see fewer bytes
                for e in range(byte_cnn.EMBED):
                    total += float(net.embed[window[at + k], e]) * float(net.filters[k * byte_cnn.EMBED + e, c])
            hidden[c] = max(hidden[c], total)
    z = np.maximum(hidden + net.bias, 0) @ net.out + net.out_bias
    assert net.log_probs(window[None])[0] == pytest.approx(z - np.log(np.exp(z).sum()), abs=1e-4)


def test_decoding_equals_all_readings():
    model = toxicity.CharacterModel(toxicity.trigrams(["idiot stupid loser the of and that this word " * 10]))
    for word in ("1d10t", "st.u!p", "looo5er", "a$$", "w0rd", "t-h-1-s"):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(word)]
        best = max(itertools.product(*(toxicity.readings(c, n) for c, n in runs)), key=lambda r: sum(x[1] for x in r) + model.word("".join(x[0] for x in r)))
        found = toxicity.decode(word, model)
        value = lambda letters: max(sum(x[1] for x in r) + model.word(letters) for r in itertools.product(*(toxicity.readings(c, n) for c, n in runs)) if "".join(x[0] for x in r) == letters)  # noqa: E731, B023
        assert value(found) == pytest.approx(sum(x[1] for x in best) + model.word("".join(x[0] for x in best)))


# scoring


def test_passages_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 30)}"
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)]
    texts += texts[:10]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, [(i, t, "en", "a") for i, t in rows]), queries.tokenizer_path()).collect()}
    import xxhash
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    places, seen = {}, collections.Counter()
    counts = collections.Counter(w for i, t in rows if not held(i) for w in t.encode().split())
    for i, t in rows:
        w = t.encode().split()
        h = np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
        at, _ = lm_scoring.passages(h, np.array([len(w)]))
        places[i] = [(tuple(w[k - lm_scoring.CONTEXT : k]), w[k]) for k in at.tolist()]
        if not held(i):
            seen.update(places[i])
    for i, _ in rows:
        own = collections.Counter() if held(i) else collections.Counter(places[i])
        told = [p for p in places[i] if counts[p[1]] > 1]  # the next word is in the trie
        assert got[i].n_passages == len(told)
        assert got[i].n_repeated == sum(seen[p] > own[p] for p in told)
    assert sum(r.n_repeated for r in got.values()) > 0


def test_spelling_is_a_distribution():
    """Words of two subwords over a small set of ids: the chances of all words of one, two and three add up to at most one."""
    rng = np.random.default_rng(2)
    ids, words = 5, [[1, 2], [1, 3], [2], [1, 2, 4], [3, 3], [4]]
    flat, size = lm_scoring._flat(words)
    topics = rng.dirichlet(np.ones(lm_scoring.TOPICS), len(words))
    speller = lm_scoring.Speller(flat, size, np.array([9, 4, 3, 2, 2, 1]), topics, ids)
    total = np.zeros(lm_scoring.TOPICS)
    for n in (1, 2, 3, 4):
        total += (10 ** speller.log10([list(w) for w in itertools.product(range(ids), repeat=n)])).sum(0)
    assert (total < 1 + 1e-4).all() and (total > 0.9).all()
    known, unknown = speller.log10([[1, 2], [2, 1]])
    assert (known > unknown).all()


def test_attention_carries_the_topics():
    """Ids of two topics: after ids of one the model expects that one, and without attention (uniform weights) it does not
    tell where in the window they stood."""
    rng = np.random.default_rng(0)
    share, theta = np.full(lm_scoring.TOPICS, 1 / lm_scoring.TOPICS), rng.dirichlet(np.full(9, 0.1), lm_scoring.TOPICS) + 0.01
    theta /= theta.sum(1, keepdims=True)
    model = lm_scoring.Attention(np.ones((1, lm_scoring.TOPICS)), np.ones((1, lm_scoring.TOPICS)), share, theta, 7)
    model.prepared()
    inputs = np.stack([rng.choice(9, lm_scoring.LENGTH, p=theta[z]) for z in range(lm_scoring.TOPICS) for _ in range(20)])
    scored = np.zeros((len(inputs), lm_scoring.LENGTH - lm_scoring.OVERLAP), bool)
    scored[:, -1] = True
    weights = model.weights(inputs, scored)
    top = weights.argmax(1).reshape(lm_scoring.TOPICS, 20)
    assert np.mean(top == np.arange(lm_scoring.TOPICS)[:, None]) > 0.7
    later = inputs.copy()
    later[:, -1] = 3
    early = np.zeros_like(scored)
    early[:, 0] = True
    assert (model.weights(inputs, early) == model.weights(later, early)).all()  # no place sees what comes after it




@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_attention_tells_more_than_fixed_topics(spark, monkeypatch):
    """Held-out score a token, against the same model with fixed topic shares whose gates and shares are fitted alike."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mean = lambda: lm_scoring.score(docs, queries.tokenizer_path()).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    whole, made = mean(), lm_scoring.Attention.__init__

    def fixed(self, *given, **more):
        made(self, *given, **more)
        self.wo = np.zeros_like(self.wo)

    monkeypatch.setattr(lm_scoring.Attention, "__init__", fixed)
    monkeypatch.setattr(lm_scoring.Attention, "NAMES", ("bias", "gates"))
    assert whole > mean() + 0.2


@pytest.mark.parametrize("times", [1, 2, 4, 15])
def test_words_inside_count_at_any_length(times):
    model = toxicity.CharacterModel(toxicity.trigrams(["you are an idiot stupid loser the of and that this word " * 10]))
    weighted = toxicity.features("idiot")[0]
    reader = toxicity.Reader(model, [weighted])
    assert weighted in reader.text("youareanidiot" * times) and weighted in reader.text("x" + "youarean1d10t" * times)
    assert weighted in reader.text(("word" * 12)[: 43 - 5 * (times > 1)] + "idiot") and not reader.text("youareagoodone" * times)
    named = toxicity.Reader(model, [weighted], ["idiot", "fool"])
    for text in ("youareanidiot" * times, "x" + "youarean1d10t" * times, "i d i o t s are h e r e", "idio t", "idiotidiot"):
        assert named.text(text) == reader.text(text)
    long = "antidisestablishmentarianism"
    assert reader.lengths == [5] and toxicity.Reader(model, [toxicity.features(long)[0]]).text(f"pseudo{long}s")


def test_fit_and_score_read_the_same_features(spark):
    texts = [(i, ("the word of badword and this" if i % 2 else "the word of notbadwordy and this") + f" n{i}") for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    inside = [got[i] for i in range(0, 120, 2)]  # clean texts hold the word inside another, and the fit has seen that
    assert max(inside) < 0.9 and max(inside) - min(inside) < 0.2


@pytest.mark.parametrize("size", [8, 127, 128, 129, 200, 2000])
def test_whole_secrets_go(spark, size):
    rng = np.random.default_rng(size)
    token = "".join(rng.choice(list("abcXYZ0189+/_-~="), size - 1)) + "z"
    dotted = token[: size // 2] + "." + token[size // 2 :]
    rows = [(1, f"so login password: {token} is it", "en", "a"), (2, f"so login api_key={dotted}. And more", "en", "a"), (3, f'login secret="{token}" ok', "en", "a")]
    found = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    ends = {1: (19 + size - 0, token), 2: (0, dotted), 3: (0, token)}
    for i, text, *_ in rows:
        at = text.index(ends[i][1])
        spans = [tuple(map(int, x.split(":")[1:])) for x in found[i].split(",") if x.startswith("secret")]
        for a, b in spans:
            assert a < at and b >= at + len(ends[i][1]) and b <= at + len(ends[i][1]) + 1
    for r in pii.redacted(frame(spark, rows)).collect():
        if found[r.doc_id]:
            assert not any(ends[r.doc_id][1][k : k + 8] in r.text for k in range(0, size - 7, 8))


def test_remembered_words_keep_the_probability_of_all(spark):
    p, counts = np.array([0.3, 0.2, 0.1, 0.15]), [3, 1, 0, 0]  # words of the trie; the rest is the end's and that of rare words
    rows = [(n, sum(counts), float(p.sum()), math.log10(x)) for n, x in zip(counts, p)]
    c = [F.col(x) for x in ("again", "others", "room", "p")]
    got = [10 ** r[0] for r in spark.createDataFrame(rows, "again long, others long, room double, p double").select(lm_scoring.remembering(*c)).collect()]
    assert sum(got) == pytest.approx(p.sum()) and got[0] > p[0] and got[2] < p[2]
    none = spark.createDataFrame([(0, 0, 0.75, math.log10(0.3))], "again long, others long, room double, p double").select(lm_scoring.remembering(*c)).first()[0]
    assert 10**none == pytest.approx(0.3)


def test_words_of_the_trie_leave_room_for_the_others(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{min(int(rng.exponential(6)), 40)}" for _ in range(40)) for _ in range(40)]
    seen = []
    plain = lm_scoring.Attention.log10

    def kept(self, inputs, scored, f, words):
        out = plain(self, inputs, scored, f, words)
        seen.append(out[2])
        assert ((out[2] > 0) & (out[2] <= 1)).all() and len(out[2]) == (f["before"] >= 0).sum()
        ends = 10 ** out[0][(f["ids"] == self.end) & (f["before"] >= 0)]
        at = (f["ids"] == self.end)[f["before"] >= 0]
        assert (out[2][at] <= 1 - ends + 1e-4).all()  # where the end comes, its own probability is no room for words
        return out

    counts = lm_scoring.word_counts(spark.createDataFrame([(t, False) for t in texts], "text string, held_out boolean"))
    learn = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    lexicon, model, *_ = lm_scoring.fit(learn, counts.where(~lm_scoring._is_passage()), queries.tokenizer_path(), 1000, 40, 8)
    monkeypatch.setattr(lm_scoring.Attention, "log10", kept)
    t = lexicon.value.tables()
    _, ks, sizes = lexicon.value.read(texts)
    f, lengths = lm_scoring.sequences(ks, sizes, t)
    by_id, _, room = lm_scoring.score_ids(model.value, f, lengths, t)
    assert len(room) == sizes.sum() and seen and 0.5 < room.mean() < 1


def test_words_are_read_once_a_batch():
    texts = [None, "", " \n", " lead and trail ", "A\x0bb\x0cc\rD\x1ce\x85f g　h", "ÀÉ İI", "and x\x00y and", "and " * 50]
    plain = [(t or "").encode().lower().split() for t in texts]
    words, place, sizes = lm_scoring.words_of(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(w) for w in plain] and [words[i] for i in place.tolist()] == [x for w in plain for x in w]
    assert words == list(dict.fromkeys(x for w in plain for x in w))
    none, place, sizes = lm_scoring.words_of(pa.array([], pa.string()))
    assert not none and not len(place) and not len(sizes)
