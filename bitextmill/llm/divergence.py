"""How far the sources of a language differ in their words: pairs of sources, and the words that mark a source.

Words that fewer than ``least`` documents of a language hold play no part, and most distinct words of a corpus are such. So
document frequencies are first estimated: every task counts its documents into a count-min sketch, the sketches are added
cell by cell, and a word is impossible if any of its cells stays below ``least``; no estimate is ever too low, so nothing
that counts is lost. The second reading shuffles the other words only and counts them exactly.

The divergence of two sources is a sum over all kept words, of which a source has few. With z the share of a word that a
source lacks (one number a source), f the divergence of two shares:

    sum f(p, q)  =  V f(z, z')  +  sum over words of the one  [f(p, z') - f(z, z')]  +  the same of the other
                    +  sum over words of both  [f(p, q) - f(p, z') - f(z, q) + f(z, z')]

The middle sums run over each source's histogram of shares, the last over joins of words that two sources have. All numbers
are whole.

Nulls: null text, lang and source count as empty strings. Documents without words still make their group, which has rows for
each other source. Empty tables give no rows. Ties in a rank: by the item in UTF-8 order. Repeated rows are documents of
their own; ids are not looked at. Very long texts are split whole, one at a time. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, lean, shared, slices, staged

#: Letters of ASCII in lower case and all bytes beyond it; everything else parts words.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WIDTH, DEPTH = 1 << 22, 3  #: cells of a row of the sketch, and rows: 12 MB a task, 1.5 MB of bits for all tasks
PIECE = 1 << 16  #: cells that are added up together
HELD = 300_000  #: distinct words that a task holds before it sends or sketches them
FEW = 256  #: sources with one word that meet in one group
ONE = 1_000_000_000


def cells(terms: list[bytes], lang: str, width: int, depth: int) -> np.ndarray:
    """The cells of each word, one row for each row of the sketch."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    h = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(r) * step) % np.uint64(width)).astype(np.int64) + r * width for r in range(depth)])


def sketched(docs: DataFrame, least: int, width: int, depth: int) -> DataFrame:
    """The merged sketch of document frequencies of (lang, word), as (piece, bits): which cells reach ``least``."""

    def count(batches):
        sums = np.zeros(width * depth, np.uint32)
        found: dict[str, Counter] = defaultdict(Counter)

        def add():
            for lang, seen in found.items():
                n = np.fromiter(seen.values(), np.uint32, len(seen))
                for row in cells(list(seen), lang, width, depth):
                    np.add.at(sums, row, n)
            found.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found[lang].update(set(text.as_py().translate(LETTERS).split()))
            if sum(map(len, found.values())) > HELD:
                add()
        add()
        low = np.minimum(sums, 255).astype(np.uint8)
        del sums
        at = [k for k in range(0, len(low), PIECE) if low[k : k + PIECE].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k // PIECE for k in at], pa.int32()), pa.array([pa.compress(low[k : k + PIECE], "zstd", asbytes=True) for k in at], pa.binary())], ["piece", "sums"])

    def merge(batches):
        now, total = None, None

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["piece", "bits"])

        for batch in batches:
            for piece, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if piece != now:
                    if now is not None:
                        yield bits()
                    now, total = piece, np.zeros(PIECE, np.uint64)
                part = np.frombuffer(pa.decompress(sums, PIECE, "zstd", asbytes=True), np.uint8)
                total += part  # a cell that is full in one task is full in all
        if now is not None:
            yield bits()

    parts = docs.select("lang", "text").mapInArrow(lean(count), "piece int, sums binary")
    return parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, bits binary")


def counted(docs: DataFrame, least: int = 10, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """Counts of kept words: lang, source, term, cnt, total (of the lang), k (sources with it), first (one row a word)."""
    if least > 255 or width % PIECE:
        raise ValueError(f"least must be at most 255 and width a multiple of {PIECE}")
    full = np.zeros(width * depth, bool)
    for piece, bits in sketched(docs, least, width, depth).collect():  # at most width * depth bits
        full[piece * PIECE : (piece + 1) * PIECE] = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)

    with shared(docs.sparkSession, np.packbits(full)) as given:

        def count(batches):
            found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
            possible = np.unpackbits(given.value).view(bool)

            def rows():
                for (lang, source), (n, df) in found.items():
                    terms = list(n)
                    for i in range(0, len(terms), 10_000):
                        part = terms[i : i + 10_000]
                        left = [t for t, ok in zip(part, possible[cells(part, lang, width, depth)].all(axis=0)) if ok]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(left), pa.string()), pa.array([source] * len(left), pa.string()), pa.array(left, pa.binary()).cast(pa.string()), pa.array([n[t] for t in left], pa.int64()), pa.array([df[t] for t in left], pa.int64())],
                            ["lang", "source", "term", "cnt", "df"],
                        )
                found.clear()

            for batch in slices(batches):
                for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                    n, df = found[lang, source]
                    words = text.as_py().translate(LETTERS).split()
                    n.update(words)
                    df.update(set(words))
                if sum(len(n) for n, _ in found.values()) > HELD:
                    yield from rows()
            yield from rows()

        exact = docs.mapInArrow(lean(count), "lang string, source string, term string, cnt long, df long").groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))
        word = Window.partitionBy("lang", "term")  # one row a source
        kept = exact.withColumn("dfs", F.sum("df").over(word)).where(F.col("dfs") >= least)
        kept = kept.withColumn("first", F.row_number().over(word.orderBy("source")) == 1)
        return staged(kept.select("lang", "source", "term", "cnt", F.sum("cnt").over(word).alias("total"), F.count(F.lit(1)).over(word).alias("k"), "first"), "terms")


def share(count: str, n: str) -> Column:
    """Smoothed share of a count among n occurrences and V words, in units of 1e-9."""
    return F.expr(f"1 + CAST(CAST({ONE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) div CAST({n} + 2 * V AS DECIMAL(20, 0))")


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def meeting(left: DataFrame, right: DataFrame, on: list[str], parts: Column, by: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join with a further key: rows of the left are dealt over ``parts``, rows of the right go to each part."""
    left = left.withColumn("part", F.pmod(F.xxhash64(by), parts))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return left, right, [*on, "part"]


def audit(docs: DataFrame, least: int = 10, top: int = 10, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module's docstring."""
    bounded(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    terms = counted(docs, least, width, depth)
    langs = terms.groupBy("lang").agg(F.count_if("first").alias("V"), F.sum("cnt").alias("M"))
    sums = terms.groupBy("lang", "source").agg(F.sum("cnt").alias("N"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("N", F.lit(0).cast("long")).alias("N"), "M", F.coalesce("V", F.lit(0).cast("long")).alias("V"))
    groups = staged(groups.withColumn("z", F.when(F.col("V") > 0, share("0", "N")).otherwise(1)), "groups")
    shares = terms.join(groups, ["lang", "source"]).select("lang", "source", "term", "k", share("cnt", "N").alias("p"), share("total", "M").alias("q"), "z", "V")
    shares = staged(shares, "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    eight = F.lit(8).cast("long")
    pick = ["lang", "source", "z", "V"]
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    left, right, on = meeting(groups.select(*pick), other, ["lang"], eight, "source")
    lacking = left.join(right, on).where("source < item").select("lang", "source", "item", F.expr(f"V * {gap('z', 'y')}").alias("value"))
    left, right, on = meeting(shares.groupBy(*pick, "p").agg(F.count(F.lit(1)).alias("n")), other, ["lang"], eight, "source")
    single = left.join(right, on).where("source <> item").select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), F.expr(f"n * ({gap('p', 'y')} - {gap('z', 'y')})").alias("value"))
    several = shares.where("k > 1").select("lang", "term", "k", "source", "p", "z")
    left, right, on = meeting(several, several.select("lang", "term", "k", F.col("source").alias("item"), F.col("p").alias("o"), F.col("z").alias("y")), ["lang", "term", "k"], F.expr(f"1 + (k - 1) div {FEW}"), "source")
    both = left.join(right, on).where("source < item").select("lang", "source", "item", F.expr(f"{gap('p', 'o')} - {gap('p', 'y')} - {gap('z', 'o')} + {gap('z', 'y')}").alias("value"))
    pairs = lacking.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    pairs = pairs.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(marks)
