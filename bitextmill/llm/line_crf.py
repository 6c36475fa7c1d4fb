"""Document quality from a linear-chain conditional random field over lines.

Every line of a whole text is labelled good or bad. The unary scores come from the line's own statistics and those of
its neighbours, the chain's transition scores from training; forward-backward gives each line's marginal, and a
document's score is the length-weighted mean of the marginals, calibrated by a logistic curve.

Only document labels exist, so training is by self-labelling: lines start with their document's label; then the lines
of bad documents that the field is sure are good become good, as long as the document keeps a bad part. Training reads a
bounded sample: at most ``rows`` labelled documents and ``lines`` consecutive lines from a hashed place in each of them.
Scoring reads every line of every text.

Nulls: a null or empty text is one empty line and scores by it. Lines without words carry weight one. Repeated rows
repeat; an empty table gives no rows; without any labelled row every score is one half. Other columns are ignored. Very
long texts are read whole, all their lines as one chain. Ties: a score of one half is good.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, lean, remainder, slices

SAMPLE_ROWS, SAMPLE_LINES = 2500, 48
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
DIGIT = b"0123456789"
SYMBOL = b"#*$%&|<>{}[]\\^~=_@"
MARKS = b"!?"
_END = re.compile(rb"[.!?:;]$")
NAMES = ["words", "length", "upper", "symbol", "digit", "marks", "word", "again", "seen", "end", "single", "next"]
K = len(NAMES)


def line_stats(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, K) statistics of every line of the whole text, and their weights (code units of words)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    out, weight, earlier = np.zeros((len(lines), K), np.float32), np.ones(len(lines), np.float32), set()
    for i, line in enumerate(lines):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        count = lambda chars: size - len(line.translate(None, chars))  # noqa: B023, E731
        solid = sum(map(len, words))
        pairs = len(set(zip(words, words[1:])))
        out[i] = (
            np.log1p(n),
            np.log1p(size),
            count(UPPER) / solid,
            count(SYMBOL) / solid,
            count(DIGIT) / solid,
            count(MARKS) / solid,
            np.log(solid / n),
            1 - len(set(words)) / n,
            line in earlier,
            _END.search(words[-1]) is not None,
            sum(len(w) == 1 for w in words) / n,
            1 - pairs / max(1, n - 1),
        )
        weight[i] = solid
        earlier.add(line)
    return out, weight


def with_neighbours(stats: np.ndarray) -> np.ndarray:
    """Own statistics, roots of the shares, both neighbours' statistics and whether there are neighbours."""
    n = len(stats)
    before, after = np.zeros_like(stats), np.zeros_like(stats)
    before[1:], after[:-1] = stats[:-1], stats[1:]
    edge = np.zeros((n, 2), np.float32)
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([stats, np.sqrt(stats[:, 2:6]), before, after, edge])


WIDTH = 3 * K + 6


class Field:
    """Two labels: 0 bad, 1 good."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, chain: np.ndarray, curve: tuple[float, float]):
        self.mean, self.scale, self.weights, self.bias, self.chain, self.curve = mean, scale, weights, bias, chain, curve

    def unary(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def marginals(self, unary: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(good) of every line; ``unary`` is the concatenation of chains of the given lengths."""
        return forward_backward(unary, lengths, self.chain)[0]

    def scores(self, stats: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        lengths = np.array([len(w) for _, w in stats])
        weight = np.concatenate([w for _, w in stats]).astype(np.float64)
        good = self.marginals(self.unary(np.vstack([with_neighbours(s) for s, _ in stats])), lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        share = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        return 1 / (1 + np.exp(-(self.curve[0] * _logit(share) + self.curve[1])))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def forward_backward(unary: np.ndarray, lengths: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each position and expected transition counts (2, 2), all chains side by side by position.

    unary: score of label 1 against label 0. Chains are sorted by length, so step t handles those that reach it.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    first, reach = starts[order], lengths[order]
    alive = np.searchsorted(-reach, -np.arange(1, reach[0] + 1), "right")  # chains of at least t+1 positions
    move = np.exp(chain - chain.max())
    # forward odds in probability space, rescaled at each step
    ahead, back = np.empty((len(unary), 2)), np.empty((len(unary), 2))
    local = np.stack([1 / (1 + np.exp(np.clip(unary, -40, 40))), 1 / (1 + np.exp(-np.clip(unary, -40, 40)))], 1)
    for t in range(int(reach[0])):
        at = first[: alive[t]] + t
        a = local[at] if t == 0 else (ahead[at - 1] @ move) * local[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(int(reach[0]) - 1, -1, -1):
        at = first[: alive[t]] + t
        b = np.full((len(at), 2), 0.5)
        if t + 1 < reach[0]:
            on = alive[t + 1]
            nxt = at[:on] + 1
            c = (back[nxt] * local[nxt]) @ move.T
            b[:on] = c / c.sum(1, keepdims=True)
        back[at] = b
    both = ahead * back
    good = both[:, 1] / both.sum(1)
    inner = np.ones(len(unary), bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    joint = ahead[to - 1][:, :, None] * move[None] * (local[to] * back[to])[:, None, :]
    counts = (joint / joint.sum((1, 2), keepdims=True)).sum(0) if len(to) else np.zeros((2, 2))
    return good, counts


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 3, steps: int = 120, rate: float = 0.08) -> Field:
    """Train on (stats, weights, document label) by full-batch gradient ascent with Adam, then calibrate."""
    if not examples:
        return Field(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, np.zeros((2, 2)), (1.0, 0.0))
    lengths = np.array([len(w) for _, w, _ in examples])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc = np.array([y for _, _, y in examples], np.float64)
    weight = np.concatenate([w for _, w, _ in examples]).astype(np.float64)
    x = np.vstack([with_neighbours(s) for s, _, _ in examples]).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 0.02
    z = np.clip((x - mean) / scale, -8, 8)
    label = np.repeat(doc, lengths)
    params, moment, square = np.zeros(WIDTH + 1 + 4), 0.0, 0.0
    inner = np.ones(len(label), bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    step = 0
    for r in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[to - 1].astype(int), label[to].astype(int)), 1.0)
        for _ in range(steps):
            step += 1
            good, counts = forward_backward(z @ params[:WIDTH] + params[WIDTH], lengths, params[-4:].reshape(2, 2))
            err = label - good
            grad = np.concatenate([z.T @ err / len(z), [err.mean()], ((seen - counts) / len(z)).ravel()]) - 1e-3 * params
            moment = 0.9 * moment + 0.1 * grad
            square = 0.99 * square + 0.01 * grad**2
            params = params + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        if r + 1 < rounds:
            good, _ = forward_backward(z @ params[:WIDTH] + params[WIDTH], lengths, params[-4:].reshape(2, 2))
            bad = np.repeat(doc, lengths) == 0
            clean = bad & (good > 0.6)
            # a bad document keeps bad what is at least as bad as its mean line
            floor = np.repeat(np.minimum.reduceat(good, starts), lengths)
            label = np.where(bad, np.where(clean & (good > floor), 1.0, 0.0), 1.0)
    field = Field(mean, scale, params[:WIDTH], float(params[WIDTH]), params[-4:].reshape(2, 2), (1.0, 0.0))
    good, _ = forward_backward(field.unary(x), lengths, field.chain)
    share = _logit(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts))
    a, b = 1.0, 0.0
    for _ in range(400):  # logistic curve on the training documents
        p = 1 / (1 + np.exp(-(a * share + b)))
        a, b = a - 0.1 * (float(((p - doc) * share).mean()) + 1e-3 * (a - 1)), b - 0.1 * float((p - doc).mean()) * 3
    field.curve = (max(a, 0.05), b)
    return field


def sample_lines(text: str | None, doc_id, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of at most ``lines`` consecutive lines of the whole text, from a place given by the id's hash."""
    stats, weight = line_stats(text)
    if len(weight) > lines:
        start = zlib.crc32(str(doc_id).encode()) % (len(weight) - lines + 1)
        stats, weight = stats[start : start + lines], weight[start : start + lines]
    return stats, weight


def training_examples(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, lines: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Line statistics of the sample, made on the executors: at most rows x lines x K numbers reach the driver."""

    def run(batches):
        for batch in slices(batches):
            got = [sample_lines(t.as_py(), d.as_py(), lines) for d, t in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary()), batch.column(2)], ["stats", "weight", "label"])

    sample = labelled_sample(docs, labels, label, modulus, held_out, rows).select("doc_id", F.col("text").cast("string").alias("text"), "label")
    found = sample.mapInArrow(lean(run), "stats binary, weight binary, label int").collect()
    found.sort(key=lambda r: (r[2], bytes(r[0])))  # the same model whatever the partitions
    return [(np.frombuffer(s, np.float32).reshape(-1, K), np.frombuffer(w, np.float32), y) for s, w, y in found]


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1, higher is better) and predicted (score >= 0.5)."""
    field = fit(training_examples(docs, labels, label, modulus, held_out, rows, lines))
    model = docs.sparkSession.sparkContext.broadcast(field)  # some hundred numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        field = model.value
        for batch in slices(batches):
            got = field.scores([line_stats(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"))
    return source.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")
