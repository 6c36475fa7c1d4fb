"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded; filters of several widths run over fixed-length windows of the whole text, each is max-pooled over
its window, and a softmax layer gives a distribution over languages. A document's distribution is the softmax of its
windows' mean log-probabilities, weighted by their bytes. All widths are one matrix product: narrower filters are
padded with zeros to the widest.

Training reads a bounded sample of at most ``rows`` labelled documents (by hash of id) and ``windows`` windows of each,
evenly spaced over the whole text. Scoring reads every byte.

Nulls: a text that is null or holds no letter is ``und`` with score 0. With no labelled rows all are ``und``; rows whose
lang is null are never learned from. Repeated rows repeat; empty tables give no rows; other columns are ignored. Very long texts
are read whole, in blocks of windows. Ties between languages go to the first by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, remainder, slices

SAMPLE_ROWS, SAMPLE_WINDOWS = 3000, 2
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 12, 6
WIDEST, CHANNELS = max(WIDTHS), FILTERS * len(WIDTHS)


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((WIDEST, EMBED, CHANNELS), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(WIDEST * EMBED, CHANNELS)
        self.filters = rng.normal(0, 0.3, self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(CHANNELS, np.float32)
        self.out = rng.normal(0, 0.1, (CHANNELS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, WIDEST * EMBED): the embedded bytes under the filters at each place."""
        e = self.embed[windows]
        return np.concatenate([e[:, k : WINDOW - WIDEST + 1 + k] for k in range(WIDEST)], axis=2)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.columns(windows)
        y = x.reshape(-1, x.shape[2]) @ self.filters
        y = y.reshape(len(windows), -1, CHANNELS)
        return x, y, np.maximum(y.max(1) + self.bias, 0)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[2] @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def step(self, windows: np.ndarray, target: np.ndarray, state: dict, rate: float) -> None:
        """One Adam step on the cross-entropy of a batch."""
        x, y, h = self.pooled(windows)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(target)), target] -= 1
        p /= len(target)
        dh = (p @ self.out.T) * (h > 0)
        at = y.argmax(1)
        picked = x[np.arange(len(x))[:, None], at]  # windows, channels, columns
        g_filters = np.einsum("nc,ncd->dc", dh, picked) * self.mask
        g_embed = np.zeros_like(self.embed)
        back = (dh[:, :, None] * self.filters.T[None]).reshape(len(x), CHANNELS, WIDEST, EMBED)
        place = at[:, :, None] + np.arange(WIDEST)
        np.add.at(g_embed, windows[np.arange(len(x))[:, None, None], place], back)
        state["t"] = t = state.get("t", 0) + 1
        for name, g in (("filters", g_filters), ("embed", g_embed), ("bias", dh.sum(0)), ("out", h.T @ p + 1e-4 * self.out), ("out_bias", p.sum(0))):
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            state[name] = m, v
            setattr(self, name, (getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32))


def cut(raw: bytes) -> np.ndarray:
    """(windows, WINDOW) uint8 of the whole text; the last window is padded with zero bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def train(rows: list[tuple[bytes, str]], steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network | None:
    """``rows``: windows (bytes of WINDOW) with their language. Languages are drawn evenly."""
    if not rows:
        return None
    langs = sorted({lang for _, lang in rows})
    net, state, rng = Network(langs), {}, np.random.default_rng(seed)
    windows = np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(-1, WINDOW)
    target = np.array([langs.index(lang) for _, lang in rows])
    by = [np.flatnonzero(target == k) for k in range(len(langs))]
    for i in range(steps):
        pick = np.array([rng.choice(by[k]) for k in rng.integers(0, len(langs), batch)])
        # cut some windows short, as the last of a text is
        x = windows[pick].copy()
        short = rng.random(batch) < 0.25
        x[short[:, None] & (np.arange(WINDOW)[None] >= rng.integers(8, WINDOW, batch)[:, None])] = 0
        net.step(x, target[pick], state, rate * (1 - i / steps) + 1e-4)
    return net


def training_windows(docs: DataFrame, modulus: int, held_out: int, rows: int, windows: int) -> list[tuple[bytes, str]]:
    """A bounded sample of windows: rows x windows x WINDOW bytes at most reach the driver."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out))
    ids = learn.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()

    def run(batches):
        for batch in slices(batches):
            out, langs = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = cut(text.encode("utf-8", "surrogatepass"))
                for k in sorted({int(i * (len(w) - 1) / max(1, windows - 1)) for i in range(windows)}):
                    out.append(w[k].tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], ["window", "lang"])

    # one text an id, so that an id on many rows adds one
    sample = learn.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))).alias("_one")).select("_one.*")
    return sorted((bytes(r[0]), r[1]) for r in sample.mapInArrow(lean(run), "window binary, lang string").collect())


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score (the probability of the language named)."""
    net = docs.sparkSession.sparkContext.broadcast(train(training_windows(docs, modulus, held_out, rows, windows)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = net.value
        for batch in slices(batches, rows=128, chars=400_000):
            texts = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
            n = batch.num_rows
            lang, score = ["und"] * n, np.zeros(n)
            use = [i for i in range(n) if letters[i]] if model else []
            if use:
                raws = [texts[i].as_py().encode("utf-8", "surrogatepass") for i in use]
                cuts = [cut(r) for r in raws]
                all_ = np.concatenate(cuts)
                logs = np.concatenate([model.log_probs(all_[k : k + 512]) for k in range(0, len(all_), 512)]).astype(np.float64)
                weight = np.full(len(all_), float(WINDOW))
                ends = np.cumsum([len(c) for c in cuts])
                weight[ends - 1] = [len(r) - (len(c) - 1) * WINDOW for r, c in zip(raws, cuts)]
                starts = ends - [len(c) for c in cuts]
                mean = np.add.reduceat(logs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, best, row in zip(use, p.argmax(1), p):
                    lang[i], score[i] = model.langs[best], row[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"))
    return source.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
