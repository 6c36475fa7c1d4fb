"""Toxicity of whole texts after noisy-channel deobfuscation.

A word that looks disguised (signs or digits among letters, letters repeated three times, single letters in a row) is
read as a lattice of what its characters may stand for: look-alike signs, separators that were put in, repetitions.
A Viterbi decode under a character trigram model picks the likeliest reading, and the restored words are scored by a
logistic model of whole words and word beginnings.

The trigram counts cover every training text (never the held-out ones) and are a table of fixed size. The classifier is
fitted on a bounded sample of ``rows`` labelled documents, by hash of id: features of the restored words whose log-odds
stand out are selected; then the sample is read again as every text is scored, with selected words of three letters and
more also inside other words and rows of single letters, and what still stands out is weighted together. So a selected word
that clean words often hold inside loses its weight. Scoring reads every word of every text.

Decoding is linear in the length, so words and rows of single letters of any length are decoded whole.
A single character repeated holds no word and stays as it is.
Nulls: null and empty texts have no features and score by the bias alone. Without labelled rows every score is the
prior, zero. Ties: of sample rows that repeat an id the least text counts; a score of the threshold is toxic. Repeated rows repeat, empty tables give no rows, other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, lean, remainder, slices, staged

SAMPLE_ROWS = 4000
#: Letters of the character model: fixed values. 0 stands for everything else.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâáçñíìîïóòôúùûœæ"
SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
S = len(LETTERS) + 1
#: What a sign may stand for: fixed values.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*'`~,/\\:;·​ "
BEGINNINGS = (3, 4, 5)
_EDGE = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$!|+(€£]+$")
_PLAIN_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_DISGUISED = re.compile(r"[^\W\d_].*[^\w]|[^\w].*[^\W\d_]|[^\W\d_].*[\d_]|[\d_].*[^\W\d_]|(\w)\1\1", re.S)
_CODE = np.zeros(0x250, np.int64)
for _c, _i in SYMBOL.items():
    _CODE[ord(_c)] = _i


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams, S**3 of them; runs of other characters count as one boundary on each side."""
    points = np.frombuffer("\n\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < len(_CODE), _CODE[np.minimum(points, len(_CODE) - 1)], 0)
    keep = np.ones(len(codes), bool)
    keep[2:] = ~((codes[2:] == 0) & (codes[1:-1] == 0) & (codes[:-2] == 0))
    codes = codes[keep]
    codes = codes[np.concatenate([[True], ~((codes[1:] == 0) & (codes[:-1] == 0))])]
    two = np.repeat(codes, np.where(codes == 0, 2, 1))  # both places before a word's first letter are boundaries
    if len(two) < 3:
        return np.zeros(S**3, np.int64)
    key = (two[:-2] * S + two[1:-1]) * S + two[2:]
    return np.bincount(key[two[2:] + two[1:-1] > 0], minlength=S**3)


class CharacterModel:
    """Interpolated trigram log-probabilities of a letter after two others."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(S, S, S).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1)) + 0.5
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        self.table = np.log((three + 3 * p2[None]) / (three.sum(2, keepdims=True) + 3)).tolist()

    def word(self, word: str) -> float:
        a = b = 0
        total = 0.0
        for c in map(SYMBOL.get, word):
            c = c or 0
            total += self.table[a][b][c]
            a, b = b, c
        return total + self.table[a][b][0]


def readings(char: str, times: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with log-probabilities of the channel."""
    if char in SYMBOL or char.isalpha():
        return [(char, 0.0)] if times == 1 else [(char * 2, -0.1), (char, -2.5)] if times == 2 else [(char, -0.7), (char * 2, -0.9)]
    counts = {1: -1.0} if times == 1 else {1: -1.5, 2: -1.2} if times == 2 else {1: -1.2, 2: -1.5}
    out = [(c * k, cost) for c in LOOKS.get(char, "") for k, cost in counts.items()]
    if char in SEPARATORS or char == "_" or not out:
        out.append(("", -0.5))
    elif char in "!|+(":
        out.append(("", -2.0))
    return out


def decode(word: str, model: CharacterModel) -> str:
    """The likeliest reading of a disguised word: Viterbi over the last two letters, with links back to what was read."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    i = 0
    while i < len(word):
        j = i
        while j < len(word) and word[j] == word[i]:
            j += 1
        options, ahead = readings(word[i], j - i), {}
        for (a, b), (score, back) in states.items():
            for letters, cost in options:
                x, y, total = a, b, score + cost
                for c in letters:
                    k = SYMBOL.get(c, 0)
                    total += model.table[x][y][k]
                    x, y = y, k
                if (x, y) not in ahead or total > ahead[x, y][0]:
                    ahead[x, y] = (total, (back, letters) if letters else back)
        states, i = ahead, j
    back, out = max(((score + model.table[a][b][0], back) for (a, b), (score, back) in states.items()), key=lambda x: x[0])[1], []
    while back:
        back, letters = back
        out.append(letters)
    return "".join(reversed(out))


def restored(word: str, model: CharacterModel) -> tuple[str, ...]:
    """Readings of one white-space-delimited, lower-case word: itself without edge signs and, if disguised, decoded."""
    plain = _PLAIN_EDGE.sub("", word)
    core = _EDGE.sub("", word)
    if len(set(core)) == 1:
        return (plain,) if plain else ()
    # sentence marks after a word are no letters of it; any other look-alike at an edge may be
    lead, _, tail = core.partition(plain) if plain else ("", "", "")
    signs = not LOOKS.keys().isdisjoint(lead + tail.replace("!", ""))
    if plain.isalpha() and len(core) - len(plain) != 1 and not signs and not re.search(r"(\w)\1\1", plain):
        return (plain,)
    out = [plain] if plain else []
    for w in dict.fromkeys((core, core.rstrip("!"), plain) if signs else (core, plain)):
        if w and _DISGUISED.search(w):
            out.append(decode(w, model))
    return tuple(dict.fromkeys(x for x in out if x))


def whole(word: str) -> int:
    """A hash of a word; its last byte is the word's length, or 0 for words that are not looked for inside others."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ~0xFF | (len(word) if 3 <= len(word) < 256 else 0)


def features(word: str) -> list[int]:
    """Hashes of a restored word and of its beginnings."""
    return [whole(word), *(xxhash.xxh3_64_intdigest(f"{n}^{word[:n]}".encode("utf-8", "surrogatepass")) & ~0xFF for n in BEGINNINGS if len(word) > n)]


class Reader:
    """Features of whole texts, with a bounded memory of words seen. ``weights``: the features that count, words among them
    also inside longer words; None keeps every feature of whole words. ``names``: the words that count, if they are known;
    then an automaton finds them inside others, else the hash of each part is looked up. Both find the same."""

    def __init__(self, model: CharacterModel, weights: Collection[int] | None = None, names: Collection[str] | None = None):
        self.model, self.weights = model, None if weights is None else frozenset(weights)
        self.lengths = sorted({f & 0xFF for f in self.weights or ()} - {0})
        self.automaton = None
        names = [] if names is None or weights is None else [(n, h) for n in names if (h := whole(n)) in self.weights and h & 0xFF]
        if names:
            self.automaton = ahocorasick.Automaton()
            for name, h in names:
                self.automaton.add_word(name, h)
            self.automaton.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        read = restored(word, self.model)
        found = {f for r in read for f in features(r)}
        return tuple(found if self.weights is None else (found & self.weights).union(*map(self._inside, read)))

    def text(self, text: str | None) -> set[int]:
        if len(self.known) > 400_000:
            self.known.clear()
        known, out, words = self.known, set(), (text or "").lower().split()
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = self._of(w)
            if f:
                out.update(f)
        # single letters in a row are one spaced word, which may stand among other single letters
        run: list[str] = []
        if sum(len(w) == 1 for w in words) >= 3:
            for w in [*words, "--"]:
                c = _PLAIN_EDGE.sub("", w) if len(w) <= 3 else w
                if len(c) == 1 or (len(w) == 1 and w in LOOKS):
                    run.append(c or w)
                else:
                    if len(run) >= 3:
                        out |= self._spaced(run)
                    run = []
        return out

    def _spaced(self, run: list[str]) -> set[int]:
        letters = decode("".join(run), self.model)
        out = set(features(letters))
        return out if self.weights is None else (out & self.weights) | self._inside(letters)

    def _inside(self, letters: str) -> set[int]:
        """Words that count anywhere in a row of letters."""
        if self.automaton is not None:
            return {h for _, h in self.automaton.iter(letters)}
        each = (whole(letters[i : i + n]) for n in self.lengths for i in range(len(letters) - n + 1))
        return {h for h in each if h in self.weights}


def select_and_fit(docs: list[tuple[np.ndarray, int]]) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias, from (features, label) of the sampled documents."""
    labels = np.array([y for _, y in docs], np.float64)
    if not len(docs) or labels.min() == labels.max():
        return {}, -30.0 if not len(docs) or labels.max() == 0 else 30.0
    flat = np.concatenate([f for f, _ in docs])
    owner = np.repeat(np.arange(len(docs)), [len(f) for f, _ in docs])
    ids, inverse = np.unique(flat, return_inverse=True)
    yes = np.bincount(inverse, weights=labels[owner])
    no = np.bincount(inverse) - yes
    n1, n0 = labels.sum(), len(docs) - labels.sum()
    odds = np.log((yes + 0.5) / (n1 + 1)) - np.log((no + 0.5) / (n0 + 1))
    z = odds / np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    chosen = np.flatnonzero((z > 3.2) & (yes >= 4) & (odds > 1.5))
    chosen = chosen[np.argsort(-z[chosen], kind="stable")]
    if not len(chosen):
        return {}, float(np.log(n1 / n0))
    column = np.full(len(ids), -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(docs), len(chosen)))
    hit = column[inverse] >= 0
    x[owner[hit], column[inverse[hit]]] = 1
    w, b = np.minimum(odds[chosen], 3.0) / 2, float(np.log(n1 / n0))
    m = v = 0.0
    for t in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = np.append(x.T @ (p - labels) / len(docs) + 2e-4 * w, (p - labels).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {int(ids[c]): float(x) for c, x in zip(chosen, w)}, float(b)


def corpus_trigrams(docs: DataFrame, modulus: int, held_out: int) -> np.ndarray:
    """Trigram counts over every training text: each task sends its non-zero counts, which are summed by key."""

    def run(batches):
        total = np.zeros(S**3, np.int64)
        for batch in slices(batches, rows=1024):
            total += trigrams([t or "" for t in batch.column(0).to_pylist()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "n"])

    texts = docs.where(F.col("text").isNotNull() & (remainder("doc_id", modulus) != held_out)).select(F.col("text").cast("string").alias("text"))
    counts = np.zeros(S**3, np.int64)
    for k, n in texts.mapInArrow(lean(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most S**3 rows
        counts[k] = n
    return counts


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1, higher: toxic likelier) and predicted."""
    counts = corpus_trigrams(docs, modulus, held_out)
    share = docs.sparkSession.sparkContext.broadcast

    table = share(counts)

    sample = labelled_sample(docs, labels, label, modulus, held_out, rows).select(F.col("text").cast("string").alias("text"), "label")
    sample = staged(sample, "sample")  # `rows` rows at most

    def fitted(counting, names) -> tuple[dict[int, float], float]:
        given = share((counting, names))

        def read(batches):
            reader = Reader(CharacterModel(table.value), *given.value)
            for batch in slices(batches):
                found = [np.array(sorted(reader.text(t.as_py())), np.uint64).tobytes() for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["features", "label"])

        found = sample.mapInArrow(lean(read), "features binary, label int").collect()
        return select_and_fit([(np.frombuffer(f, np.uint64), y) for f, y in sorted((bytes(r[0]), r[1]) for r in found)])

    # whole words tell which count; then the same texts are read as all texts will be, with these words inside others
    chosen = frozenset(fitted(None, None)[0])
    given = share(chosen)

    def named(batches):
        model = CharacterModel(table.value)
        for batch in batches:
            words = {w for t in batch.column(0).to_pylist() for w in (t or "").lower().split()}
            found = {r for w in words for r in restored(w, model) if whole(r) in given.value}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["name"])

    names = sorted(r[0] for r in sample.select("text").mapInArrow(lean(named), "name string").distinct().collect())  # at most as many as features
    weights, bias = fitted(list(chosen), names)
    model = share((weights, bias, names))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        weights, bias, names = model.value
        reader = Reader(CharacterModel(table.value), weights, names)
        for batch in slices(batches):
            got = [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(sorted(map(weights.__getitem__, reader.text(t.as_py())))))))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.float64()), pa.array([int(p >= threshold) for p in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"))
    return source.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")
