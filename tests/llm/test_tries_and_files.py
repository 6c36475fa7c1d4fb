"""The conversation trie, the audit of sources and the token files against plain versions and on edge cases."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from bitextmill.llm import divergence, prefix_trie, queries, token_files

from .test_llm import DIR, docs, empty, frame  # noqa: F401

DRIVER = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@DRIVER
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_source_divergence"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(map(repr, (tuple(r) for r in queries.QUERIES[name](spark, DIR).select(*columns).collect()))) == want


# the prefix trie


def plain_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows, every subtree walked."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(np.fmod(c, 100))
        made[c] = (*(ts[:h] if first == c else own.get(first, [])[:h]), *ts[h:])
    members = collections.defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = set()
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(cs), len(path), parent, len(cs), sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, k1 string, own long, block string"


def conversation_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], CONVERSATIONS)


def talk(rng, n):
    rows = []
    for c in rng.permutation(np.r_[np.arange(-30, 330), 100, 100]).tolist()[:n]:
        for turn in range(rng.integers(0, 9)):
            text = [None, "", "a", "bé", "日本 x", "1:a"][rng.integers(0, 6) if turn > 3 else turn % 3]
            rows.append((c, None if rng.random() < 0.02 else turn, [None, "user", "1"][turn % 3], text))
    return rows


@pytest.mark.parametrize("block, salts, chunk", [(1024, 64, 16_384), (3, 2, 7)])
def test_trie_equals_a_plain_version(spark, monkeypatch, block, salts, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "SALTS", salts)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rng = np.random.default_rng(11)
    rows = talk(rng, 300)
    rows += [(7, None, "user", "tie"), (7, None, "user", "tie"), (7, None, "user", "other tie"), (None, 0, "user", "nobody's"), (401, 0, None, None)]  # 401: no first conversation
    rows += [(500, t, "user", "again") for t in range(40)] + [(501, t, "user", "again") for t in range(45)] + [(502, 0, "user", "x" * 100_000)]
    got = [tuple(r) for r in prefix_trie.trie(conversation_frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(conversation_frame(spark, [])).count() == 0
    assert prefix_trie.trie(conversation_frame(spark, [(None, 1, "a", "b")])).count() == 0
    alone = conversation_frame(spark, [(1, 0, "user", "short")])  # crc32("1") % 6 == 1 turn is not its own
    assert zlib.crc32(b"1") % 6 >= 1
    assert [tuple(r) for r in prefix_trie.trie(alone).collect()] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


# the audit of sources


def plain_audit(rows, least):
    rows = [((text or ""), lang or "", source or "") for text, lang, source in rows]
    words = [re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        df, counts, total = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
        for (_, x, source), w in zip(rows, words):
            if x == lang:
                df.update(set(w))
                counts[source].update(w)
        kept = [t for t, n in df.items() if n >= least]
        for c in counts.values():
            total.update(c)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(sorted(terms)[:10], 1)}
    return out


def sources(rng, n=400):
    vocabulary = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)), "ÉTÉ", "été", "日本", "İx", "A_b", "x1y"]
    rows = []
    for i in range(n):
        source = int(rng.integers(0, 7))
        w = [vocabulary[min(int(rng.exponential(10 + 3 * source)), len(vocabulary) - 1)] for _ in range(rng.integers(0, 30))]
        rows.append((" ".join(w) + f"\x00rare{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", ["de", "en", None][i % 3], [f"s{source}", None][source == 3]))
    return [*rows, (None, "fr", "a"), ("", "fr", "b"), ("seul", "fr", None), ("?", "xx", "only"), *[("twice Twice", "en", "s1")] * 12, ("long " * 200_000, "en", "s2")]


@pytest.mark.parametrize("least, width, depth, few", [(10, 1 << 22, 3, 256), (2, 1 << 16, 1, 2), (1, 1 << 16, 2, 1)])
def test_audit_equals_a_plain_version(spark, monkeypatch, least, width, depth, few):
    monkeypatch.setattr(divergence, "FEW", few)
    rows = sources(np.random.default_rng(12))
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "text string, lang string, source string, V int, term string, value double").repartition(3)
    got = [tuple(r) for r in divergence.audit(frame, least=least, width=width, depth=depth).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, least)


def test_audit_of_nothing(empty):  # noqa: F811
    assert divergence.audit(empty).count() == 0


def test_sketch_leaves_out_no_frequent_word(spark):
    rows = [(f"common{'abcdefghij'[i % 10]} seldom{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", "en") for i in range(100)]
    frame = spark.createDataFrame(rows, "text string, lang string").selectExpr("CAST(text AS BINARY) text", "lang").repartition(5)
    bits = {r.piece: np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in divergence.sketched(frame, 10, 1 << 20, 2).collect()}
    full = np.concatenate([bits.get(k, np.zeros(1 << 16, np.uint8)) for k in range(32)]).astype(bool)
    common, seldom = sorted({w.encode() for t, _ in rows for w in t.split() if w[0] == "c"}), sorted({w.encode() for t, _ in rows for w in t.split() if w[0] == "s"})
    assert full[divergence.cells(common, "en", 1 << 20, 2)].all()
    assert not full[divergence.cells(seldom, "en", 1 << 20, 2)].all(axis=0).any()


# token files


PATH = queries.tokenizer_path("word_bpe_49k.json")
ODD = ["", None, "é ́e ạ́", "x y z\u0085w\x1cv\x0bu", "It's WE'LL ÀÉ ß İI ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "a" * 5000, "1234 5,6", "😀👍🏽 日本語\n\n\t ok", "'s' t ' s ﻿", "ẛ̣ Å", "# \" !", " ", "a\x00b"]


def whole(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)


def test_words_give_the_ids_of_whole_texts(spark):
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(PATH), token_files.Encoder(PATH)
    assert encoder.by_word and encoder.type == "<u2" and not token_files.Encoder(queries.tokenizer_path("byte_bpe_50k.json")).by_word
    texts = [t or "" for t in ODD] + [f"{a}{b} {b}{a}" for a in ODD if a for b in ODD if b and len(b) < 100]
    if os.path.isdir(DIR):
        texts += [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    for i in range(0, len(texts), 50):
        for text, ids in zip(texts[i : i + 50], encoder.encode([t.encode() for t in texts[i : i + 50]])):
            assert ids.tolist() == whole(plain, text).tolist(), text[:80]
            assert len(encoder.words) <= token_files.HELD and all(len(w) <= token_files.WORD for w in encoder.words)


@pytest.mark.parametrize("length, rows, file_ids", [(2048, 256, 1 << 24), (16, 3, 400), (1, 1, 1)])
def test_files_round_trip(spark, length, rows, file_ids):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = [(i * 7 % 23, t) for i, t in enumerate([*ODD, *(f"document {i} " * (i % 9) for i in range(30)), *["copy"] * 9])] + [(None, "no id"), (5, "copy"), (5, "copy")]
    data = frame(spark, [(i, t, "en", "a") for i, t in texts]).repartition(3)
    manifest = token_files.write(data, PATH, token_files.new_folder(spark), length, rows, file_ids=file_ids)
    got = sorted(((r.start, r) for r in token_files.read(manifest).collect()), key=lambda x: x[0])
    assert [r.doc_id is not None and r.doc_id for _, r in got] == sorted((i is not None and i) for i, _ in texts)
    at = 0
    for start, r in got:
        assert start == at
        at += r.n_tokens
    want = collections.Counter((i, len(ids := whole(plain, t)), zlib.crc32(ids)) for i, t in texts)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for _, r in got) == want
    for file in manifest.collect():  # every sequence in place, as the stream has it
        with token_files.opened(file.path) as source:
            table = pa.ipc.open_stream(source).read_all()
            assert table.schema.field("ids").type.list_size == length and table.num_rows == -(-file.n_ids // length)
            for i in {0, 1, 2, 3, 4, table.num_rows // 2, table.num_rows - 1} & set(range(table.num_rows)):
                ids, mask = token_files.sequence(file.path, i)
                assert ids.tolist() == table["ids"][i].as_py() and mask.to_pylist() == table["mask"][i].as_py()
                assert mask.true_count == min(length, file.n_ids - i * length) and all(mask[: mask.true_count].to_pylist())
                assert ids.dtype == np.uint16 and not ids.flags.owndata
            with pytest.raises((IndexError, pa.ArrowInvalid, EOFError)):
                token_files.sequence(file.path, table.num_rows)


def test_files_of_nothing(spark, empty):  # noqa: F811
    assert token_files.round_trip(empty, PATH).count() == 0


@DRIVER
def test_files_of_documents_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain, at = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in queries.op13_token_files(spark, DIR).collect()}
    for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect():
        ids = whole(plain, r.text)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
