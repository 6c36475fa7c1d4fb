"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks.

1. Benchmark items are cut into passages of PASSAGE words. Their words are the vocabulary; document frequencies come
   from every document, and passages are TF-IDF vectors over that vocabulary.
2. A randomised singular value decomposition of the items' passages and of all passages of the corpus, cut so that each
   word is in one, gives the latent space: one reading adds up the products of the words of each passage, then a random
   projection, power steps and a small eigenproblem work on these sums, each a distributed pass in which every task adds up
   its share.
3. Each document's overlapping passages are projected (sums of word vectors) and compared by cosine with item passages.
   A leak needs LOOSE of an item's words within one stretch of text, so as many but a few outside its most frequent
   words; items without such a stretch in the document, and passages without one around them, are left out before, as
   none of them could pass step 4. Benchmarks are taken in blocks
   of about BLOCK items and CHARS characters, so what is broadcast stays bounded, and TOGETHER blocks share each reading
   of the corpus.
4. A candidate is verified around its place: the longest common subsequence of words must hold OVERLAP of the item's
   words; paraphrases that hold LOOSE of them count if the item's answer, its last words, is there in order as well.

Nulls: null and empty texts and items match nothing; a null item id is kept as null. Repeated rows repeat, empty tables
give no rows; other columns are ignored by ``contaminated`` and kept by ``drop_contaminated``. Very long texts are read
whole; memory grows with one text's words. Ties: of places with as many common words, the first one is returned. Ids may
be of any type.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, shared, slices, staged

PASSAGE, STRIDE = 24, 12
RANK, POWER_STEPS = 128, 1
#: Directions of less than this share of the greatest variance are not raised further: passages tell little of them.
FLOOR = 0.02
BLOCK, CHARS, TOGETHER = 5000, 1_000_000, 4
ROWS = 4096  #: features in a part of a matrix
COMMON = 0.35  #: of an item's words, its most frequent ones, that the first screen leaves out
CELLS = 1 << 23  #: cells of the tables of items and words of one text
WEIGHT = 6000  #: passages that the corpus's count as, beside the items'
DENSE, PART = 1 << 24, 1 << 17  #: cells of a task's table of moments, and of a part of it
NEAR, OVERLAP, LOOSE, ANSWER = 0.35, 0.6, 0.45, 0.8
#: ASCII signs part words; case is folded before.
_SIGNS = bytes(0x20 if b < 0x80 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: what ASCII white space and signs leave."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split()


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = 0
    for x in b:
        hit = places.get(x)
        if hit:
            y = row | hit
            row = y & ~(y - ((row << 1) | 1))
    return row.bit_count()


class Item:
    def __init__(self, key, words: list[bytes]):
        self.key, self.words = key, words
        self.answer = words[-max(3, len(words) // 6) :]
        self.known = set(words)

    def present(self, words: set[bytes]) -> int:
        """Words of the item that are among ``words``, repeats counted: no common subsequence is longer."""
        return sum(map(words.__contains__, self.words))

    def in_region(self, region: list[bytes]) -> tuple[int, bool]:
        """Longest common subsequence with a stretch of text no longer than needed, and whether it is a leak."""
        n = common_subsequence(self.words, region)
        share = n / len(self.words)
        if share >= OVERLAP or len(self.words) < 6:
            return n, share >= (OVERLAP if len(self.words) >= 6 else 1.0)
        return n, share >= LOOSE and common_subsequence(self.answer, region) >= ANSWER * len(self.answer)


def span_of(n):
    """Words of the stretches of text in which an item of ``n`` words is verified."""
    return n + np.maximum(2, n // 4)


def starts_of(n: int, stride: int = STRIDE) -> np.ndarray:
    """First words of the passages of a text of ``n`` words; the last passage ends with the text."""
    last = max(0, n - PASSAGE)
    return np.unique(np.append(np.arange(0, last, stride), last))


class Screen:
    """Items without their most frequent words, a share ``common`` of them, and how many of the others a leak holds at
    least, whichever of the frequent ones it holds as well."""

    def __init__(self, space: Space, df: np.ndarray, common: float):
        kept, needed = [], []
        for item in space.items:
            f = np.array([space.feature[w] for w in item.words])
            need = int(np.ceil(LOOSE * len(f) - 1e-9))
            out = min(int(common * len(f)), need - 1)
            kept.append(np.unique(f[np.argsort(-df[f], kind="stable")[out:]]))
            needed.append(need - out)
        self.size, self.spans, self.needed = space.size, space.spans, np.array(needed, np.int64)
        self.listed = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        self.counts = np.array(list(map(len, kept)), np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        # the items of each word, and where they begin
        owner, order = np.repeat(np.arange(len(kept)), self.counts), np.argsort(self.listed, kind="stable")
        self.holders, self.first = owner[order], np.searchsorted(self.listed[order], np.arange(self.size + 1))

    def _starts(self, item: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of hits sorted by key (which tells the item) and place, those from which on enough others follow in the span."""
        ahead = np.arange(len(item)) + self.needed[item] - 1
        inside = np.flatnonzero(ahead < len(item))
        ahead = ahead[inside]
        return inside[(key[ahead] == key[inside]) & (place[ahead] - place[inside] < self.spans[item[inside]])]

    def plausible(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The items that each of some texts may leak; ``texts``: places and features of their vocabulary words."""
        out: list[np.ndarray] = []
        sizes = np.array([self.first[f + 1].sum() - self.first[f].sum() for _, f in texts])
        k = 0
        while k < len(texts):
            last = k + max(1, int(np.searchsorted(np.cumsum(sizes[k:]), CELLS // 8)))  # texts together, to bound memory
            some = texts[k:last]
            feature, place = np.concatenate([f for _, f in some]), np.concatenate([at for at, _ in some])
            text = np.repeat(np.arange(len(some)), [len(f) for _, f in some])
            begin = self.first[feature]
            n = self.first[feature + 1] - begin
            item = self.holders[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            key, place = np.repeat(text, n) * len(self.counts) + item, np.repeat(place, n)
            order = np.argsort(key, kind="stable")
            item, key = item[order], key[order]
            found = np.unique(key[self._starts(item, key, place[order])])
            parts = np.searchsorted(found // len(self.counts), np.arange(len(some) + 1))
            out += [found[a:b] % len(self.counts) for a, b in zip(parts[:-1], parts[1:])]
            k = last
        return out

    def dense(self, possible: np.ndarray, at: np.ndarray, feature: np.ndarray) -> dict[int, np.ndarray]:
        """Places of each of some items from which on enough of its words follow within its span."""
        out: dict[int, np.ndarray] = {}
        each = max(1, min(CELLS // max(1, len(at)), CELLS // max(1, self.size)))  # items at once, to bound memory
        for k in range(0, len(possible), each):
            items = possible[k : k + each]
            held = np.zeros((len(items), self.size), bool)
            for row, i in enumerate(items.tolist()):
                held[row, self.listed[self.begin[i] : self.begin[i] + self.counts[i]]] = True
            hits = np.flatnonzero(held[:, feature])  # by item, then by place
            row = hits // len(at)
            place = at[hits - row * len(at)]
            starts = self._starts(items[row], row, place)
            row, place = row[starts], place[starts]
            ends = np.searchsorted(row, np.arange(len(items) + 1)).tolist()
            out |= {i: place[a:b] for i, a, b in zip(items.tolist(), ends[:-1], ends[1:]) if b > a}
        return out


class Space:
    """Vocabulary, inverse document frequencies, and (when fitted) word vectors and the items' directions."""

    def __init__(self, items: list[Item]):
        vocabulary = sorted({w for i in items for w in i.words})
        self.vocabulary = frozenset(vocabulary)
        self.items, self.feature = items, {w: k for k, w in enumerate(vocabulary)}
        self.size = len(vocabulary)
        self.idf = np.zeros(self.size, np.float32)
        self.vectors: np.ndarray | None = None
        self.lengths = np.array([len(i.words) for i in items], np.int64)
        self.spans = span_of(self.lengths)
        self.screen(np.zeros(self.size))

    def screen(self, df: np.ndarray) -> None:
        """What tells which items a text may leak at all: enough of an item's rarer words close together, and of all its
        words. Both are necessary for the verification."""
        self.first, self.second = Screen(self, df, COMMON), Screen(self, df, 0.0)

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of vocabulary words and their features."""
        got = np.fromiter(map(self.feature.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(got >= 0)
        return at, got[at]

    def rows(self, words: list[bytes], starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Normalised TF-IDF rows of passages."""
        at, feature = self.features(words)
        out = []
        for s in starts:
            f = feature[(at >= s) & (at < s + PASSAGE)]
            ids, n = np.unique(f, return_counts=True)
            v = n * self.idf[ids]
            out.append((ids, v / max(float(np.linalg.norm(v)), 1e-9)))
        return out

    def finish(self, basis: np.ndarray) -> None:
        """Word vectors in the latent space; directions of the items' passages."""
        self.vectors = (self.idf[:, None] * basis).astype(np.float32)
        owner, rows = [], []
        for k, item in enumerate(self.items):
            starts = starts_of(len(item.words), PASSAGE)  # documents' passages overlap, so an item's need not
            rows.append(self.projected(*self.features(item.words), starts))
            owner += [k] * len(starts)
        self.owner = np.array(owner, np.int64)
        self.directions = np.vstack(rows) if rows else np.zeros((0, basis.shape[1]), np.float32)

    def projected(self, at: np.ndarray, feature: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Unit vectors of passages, given the places and features of vocabulary words; zeros where there are none."""
        lo = np.searchsorted(at, starts)
        n = np.searchsorted(at, starts + PASSAGE) - lo
        some = np.flatnonzero(n)
        out = np.zeros((len(starts), self.vectors.shape[1]), np.float32)
        if len(some):
            lo, n = lo[some], n[some]
            offset = np.cumsum(n) - n
            x = np.add.reduceat(self.vectors[feature[np.arange(n.sum()) + np.repeat(lo - offset, n)]], offset)
            out[some] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
        return out

    def matches(self, texts: list[list[bytes]]) -> list[list[tuple]]:
        """Of each of some texts, (item key, common words, item's words, first word, last word + 1) of each leaked item, best
        place of each."""
        if not self.items:
            return [[] for _ in texts]
        found = list(map(self.features, texts))
        return [self._leaks(words, *f, items) if len(items) else [] for words, f, items in zip(texts, found, self.first.plausible(found))]

    def _leaks(self, words: list[bytes], at: np.ndarray, feature: np.ndarray, items: np.ndarray) -> list[tuple]:
        dense = self.second.dense(items, at, feature)
        if not dense:
            return []
        # passages around which there are enough words of one of those items, close together
        found: dict[int, tuple] = {}
        starts, possible = starts_of(len(words)), np.array(list(dense))
        longest, places = int(self.lengths[possible].max()), np.unique(np.concatenate(list(dense.values())))
        starts = starts[np.searchsorted(places, starts + PASSAGE + longest) > np.searchsorted(places, starts - longest)]
        columns = np.flatnonzero(np.isin(self.owner, possible))
        directions, owner = self.directions[columns].T, self.owner[columns]
        for k in range(0, len(starts), 512):
            near = self.projected(at, feature, starts[k : k + 512]) @ directions
            for place in np.flatnonzero(near.ravel() >= NEAR).tolist():
                r, c = divmod(place, near.shape[1])
                key = int(owner[c])
                item = self.items[key]
                n = len(item.words)
                if key in found and found[key][1] == n:
                    continue
                lo, hi = max(0, int(starts[k + r]) - n), min(len(words), int(starts[k + r]) + PASSAGE + n)
                first, last = np.searchsorted(dense[key], (lo, hi))
                if first == last or item.present(set(words[lo:hi])) < LOOSE * n:
                    continue
                best = self._best(item, words, lo, hi)
                if best and (key not in found or best[1] > found[key][1]):
                    found[key] = best
        return [found[k] for k in sorted(found)]

    @staticmethod
    def _best(item: Item, words: list[bytes], lo: int, hi: int) -> tuple | None:
        """The best stretch in words[lo:hi] of at most a quarter more words than the item."""
        n = len(item.words)
        span = int(span_of(n))
        hit = np.array([w in item.known for w in words[lo:hi]])
        if hit.sum() < LOOSE * n:
            return None
        sums = np.concatenate([[0], np.cumsum(hit)])
        last = max(0, hi - lo - span)
        first = np.unique(np.append(np.arange(0, last, max(1, n // 8)), last))
        counts = sums[np.minimum(first + span, hi - lo)] - sums[first]
        best = None
        for f in first[counts >= LOOSE * n]:
            common, leak = item.in_region(words[lo + f : lo + f + span])
            if leak and (best is None or common > best[1]):
                best = (item.key, common, n, int(lo + f), int(min(hi, lo + f + span)))
                if common == n:
                    break
        return best


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    count, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n = max(1, -(-count // BLOCK), -(-chars // CHARS))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _frequencies(texts: DataFrame, spaces: list[Space]) -> None:
    """Inverse document frequencies over every document, once for all blocks."""
    with shared(texts.sparkSession, spaces) as bare:

        def count(batches):
            spaces = bare.value
            totals, n = [np.zeros(s.size, np.int64) for s in spaces], 0
            for batch in slices(batches):
                for text in batch.column(1):
                    words = words_of(text.as_py())
                    for space, total in zip(spaces, totals):
                        total[[space.feature[w] for w in space.vocabulary.intersection(words)]] += 1  # once a document
                n += batch.num_rows
            found = [np.flatnonzero(t) for t in totals]
            block = np.repeat(np.arange(len(found)), list(map(len, found)))
            columns = [np.append(-1, block), np.append(-1, np.concatenate(found)), np.append(n, np.concatenate([t[at] for t, at in zip(totals, found)]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], ["block", "k", "n"])

        counts = texts.mapInArrow(lean(count), "block int, k int, n long").groupBy("block", "k").agg(F.sum("n").alias("n")).collect()  # a row a word of the blocks
    n = sum(r[2] for r in counts if r[0] == -1)
    for b, space in enumerate(spaces):
        df = np.zeros(space.size)
        for block, k, c in counts:
            if block == b:
                df[k] = c
        space.idf = np.log((n + 1.0) / (df + 0.5)).clip(0.0).astype(np.float32)
        space.idf[df > 0.25 * n] = 0.01  # words of everywhere tell nothing
        space.screen(df)


def _added(parts):
    """The sum of one part of a matrix over all tasks, in the order of the tasks."""
    rows = sorted(zip(parts.column("task").to_pylist(), parts.column("part").to_pylist()))
    total = sum(np.frombuffer(p, np.float64) for _, p in rows)
    return pa.table({"k": parts.column("k")[:1], "part": pa.array([total.tobytes()], pa.binary())})


class Moments:
    """Sums of the products of two features over normalised TF-IDF passages: cells feature * size + feature, the lesser feature
    first, those of one feature halved. Held as a table if that has at most DENSE cells, else as sorted cells; ``parts`` gives
    them away."""

    def __init__(self, space: Space, dense: bool):
        self.space, self.rows = space, part_rows(space.size)
        self.table = np.zeros(space.size**2) if dense else None
        self.cells, self.sums, self.held = [], [], 0

    def add(self, words: list[list[bytes]]) -> int:
        """Cuts texts into passages, so that each word is in one; returns how many have words of the vocabulary."""
        size, sizes = self.space.size, np.fromiter(map(len, words), np.int64, len(words))
        feature = np.fromiter(map(self.space.feature.get, chain.from_iterable(words), repeat(-1)), np.int64, sizes.sum())
        at = np.flatnonzero(feature >= 0)
        passages = -(-sizes // PASSAGE)
        text = np.searchsorted(np.cumsum(sizes), at, "right")
        owner = (np.cumsum(passages) - passages)[text] + (at - (np.cumsum(sizes) - sizes)[text]) // PASSAGE
        key, n = np.unique(owner * size + feature[at], return_counts=True)
        owner, feature = key // size, key % size
        v = n * self.space.idf[feature].astype(np.float64)
        v /= np.maximum(np.sqrt(np.bincount(owner, v * v, passages.sum())), 1e-9)[owner]
        for d in range(PASSAGE):
            a = np.flatnonzero(owner[d:] == owner[: len(owner) - d])
            if not len(a):
                break
            self._put(feature[a] * size + feature[a + d], v[a] * v[a + d] * (1.0 if d else 0.5))
        return len(np.unique(owner))

    def _put(self, cells: np.ndarray, sums: np.ndarray) -> None:
        if self.table is not None:
            np.add.at(self.table, cells, sums)
            return
        self.cells.append(cells)
        self.sums.append(sums)
        self.held += len(cells)
        if self.held > DENSE // 2:
            self._join()

    def _join(self) -> None:
        cells, place = np.unique(np.concatenate(self.cells), return_inverse=True)
        self.cells, self.sums, self.held = [cells], [np.bincount(place, np.concatenate(self.sums), len(cells))], len(cells)

    def full(self) -> bool:
        """Whether so many different cells are held that they must go."""
        if self.held > DENSE // 2:
            self._join()
        return self.held > DENSE // 4

    def parts(self):
        """(part of the matrix, cells in it, sums); what was held is gone."""
        if self.table is not None:
            found = np.flatnonzero(self.table)
            sums = self.table[found]
            self.table[:] = 0
        elif self.held:
            self._join()
            found, sums = self.cells[0], self.sums[0]
            self.cells, self.sums, self.held = [], [], 0
        else:
            return
        each = self.rows * self.space.size
        begin = np.flatnonzero(np.diff(found // each, prepend=-1))
        for lo, hi in zip(begin, np.append(begin[1:], len(found))):
            k = int(found[lo] // each)
            yield k, (found[lo:hi] - k * each).astype(np.int32), sums[lo:hi]


def part_rows(size: int) -> int:
    """Rows of a part of a matrix of moments."""
    return max(1, PART // max(1, size))


_MOMENTS = "block int, k int, task int, n long, cells binary, sums binary"


def _moments(texts: DataFrame, spaces: list[Space]) -> DataFrame:
    """Moments of the passages of every text, a row a part of a block's matrix; in rows with k = -1 how many passages."""
    names = [x.split()[0] for x in _MOMENTS.split(", ")]
    types = pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    with shared(texts.sparkSession, spaces) as given:

        def run(batches):
            spaces, task = given.value, TaskContext.get().partitionId()
            dense = sum(s.size**2 for s in spaces) <= DENSE
            moments, n = [Moments(s, dense) for s in spaces], [0] * len(spaces)

            def sent(which: int):
                for k, cells, sums in moments[which].parts():
                    yield batch_of([(which, k, task, 0, cells.tobytes(), sums.tobytes())])

            for batch in slices(batches):
                words = [words_of(t.as_py()) for t in batch.column(1)]
                for which, m in enumerate(moments):
                    n[which] += m.add(words)
                    if m.full():
                        yield from sent(which)
            for which in range(len(moments)):
                yield from sent(which)
            yield batch_of([(which, -1, task, c, b"", b"") for which, c in enumerate(n)])

        def joined(batches):
            """Rows of one part come one after the other: one part is held at a time."""
            spaces, now, table, n = given.value, None, None, 0

            def done():
                found = np.flatnonzero(table)
                return batch_of([(*now, 0, n, found.astype(np.int32).tobytes(), table[found].tobytes())])

            for batch in batches:
                for block, k, _, c, cells, sums in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if now != (block, k):
                        if now is not None:
                            yield done()
                        size = spaces[block].size
                        now, table, n = (block, k), np.zeros(part_rows(size) * size if k >= 0 else 0), 0
                    n += c
                    if k >= 0:
                        table[np.frombuffer(cells, np.int32)] += np.frombuffer(sums)  # a row's cells are different ones
            if now is not None:
                yield done()

        parts = texts.mapInArrow(lean(run), _MOMENTS).repartition("block", "k").sortWithinPartitions("block", "k", "task", F.xxhash64("cells"))
        return staged(parts.mapInArrow(lean(joined), _MOMENTS), "moments")


def _fit(space: Space, moments: DataFrame) -> None:
    """The latent space: power steps over the items' passages and the moments of every document's. Tasks send the parts of a
    matrix that they touched; parts are added up on executors, so the driver gets one matrix of words x RANK a step. The
    corpus weighs as WEIGHT passages, however many it has, so that items keep their share."""
    spark = moments.sparkSession
    count = sum(r[0] for r in moments.where("k < 0").select("n").collect())
    weight = min(1.0, WEIGHT / max(1, count))

    def times(matrix: np.ndarray) -> np.ndarray:
        with shared(spark, (matrix, part_rows(space.size))) as given:

            def run(batches):
                q, rows = given.value
                total = np.zeros_like(q)
                for batch in batches:
                    for k, cells, sums in zip(*(batch.column(i).to_pylist() for i in range(3))):
                        part = np.zeros(rows * len(q))
                        part[np.frombuffer(cells, np.int32)] = np.frombuffer(sums)
                        part = part.reshape(rows, -1)[: len(q) - k * rows]
                        total[k * rows : k * rows + len(part)] += part @ q
                        total += part.T @ q[k * rows : k * rows + len(part)]
                parts = {k: total[k : k + ROWS] for k in range(0, len(total), ROWS)}
                parts = {k: p.tobytes() for k, p in parts.items() if p.any()}
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], ["k", "task", "part"])

            added = moments.where("k >= 0").select("k", "cells", "sums").mapInArrow(lean(run), "k int, task int, part binary").groupBy("k").applyInArrow(_added, "k int, part binary")
            total = np.zeros_like(matrix)
            for k, part in added.toLocalIterator():
                total[k : k + ROWS] += weight * np.frombuffer(part).reshape(-1, total.shape[1])
        for item in space.items:
            for f, v in space.rows(item.words, starts_of(len(item.words))):
                total[f] += v[:, None] * (v @ matrix[f])
        return total

    rank = min(RANK, space.size)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((space.size, rank)))[0]
    for _ in range(1 + POWER_STEPS):
        q = np.linalg.qr(times(q))[0]
    gram = q.T @ times(q)
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    # whitened: directions that all passages share, such as a language's common words, count no more than others
    space.finish((q @ turn) / np.sqrt(np.maximum(values, FLOOR * values.max())))


def fitted(docs: DataFrame, blocks: list[DataFrame]) -> list[Space]:
    """The latent spaces of some blocks of items. Documents are read once for the frequencies and once for the moments."""
    spaces = []
    for items in blocks:
        found = sorted(((r[0], words_of(r[1])) for r in items.collect()), key=lambda x: (x[0] is None, x[0], x[1]))
        spaces.append(Space([Item(k, w) for k, w in found if w]))
    spaces = [s for s in spaces if s.items]
    if not spaces:
        return []
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    _frequencies(texts, spaces)
    moments = _moments(texts, spaces)
    for block, space in enumerate(spaces):
        _fit(space, moments.where(F.col("block") == block))
    return spaces


def _searched(docs: DataFrame, benchmark: DataFrame):
    """Broadcast spaces, TOGETHER blocks at a time."""
    blocks = _blocks(benchmark)
    for k in range(0, len(blocks), TOGETHER):
        if spaces := fitted(docs, blocks[k : k + TOGETHER]):
            yield docs.sparkSession.sparkContext.broadcast(spaces)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a (document, leaked item): doc_id, item_id, common and item words, ratio, the words' place."""
    kind, key = (t.schema[c].dataType for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind.simpleString()}, item_id {key.simpleString()}, common_words int, item_words int, ratio double, first_word int, end_word int"
    out, item_type = None, to_arrow_type(key)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for given in _searched(docs, benchmark):

        def run(batches, given=given):
            spaces = given.value
            for batch in slices(batches):
                texts, rows, owner = [words_of(t.as_py()) for t in batch.column(1)], [], []
                for i, got in enumerate(zip(*(space.matches(texts) for space in spaces))):
                    rows += chain.from_iterable(got)
                    owner += [i] * sum(map(len, got))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array([r[0] for r in rows], item_type), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)), pa.array([r[1] / r[2] for r in rows], pa.float64()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (3, 4))],
                    ["doc_id", "item_id", "common_words", "item_words", "ratio", "first_word", "end_word"],
                )

        part = texts.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leaked item, with all columns. No text is shuffled."""
    columns, given = docs.columns, list(_searched(docs, benchmark))
    for spaces in given:
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.col("text").cast("string").alias("text"))

        def run(batches, spaces=spaces):
            for batch in slices(batches):
                texts = [words_of(t.as_py()) for t in batch.column(1)]
                keep = pa.array([not any(got) for got in zip(*(space.matches(texts) for space in spaces.value))], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], ["doc"])

        docs = whole.mapInArrow(lean(run), f"doc {whole.schema['doc'].dataType.simpleString()}").select("doc.*")
    return docs
