"""Near-duplicate components by SetSketch registers, banding, joint likelihood estimates and exact verification.

1. Each whole text becomes its set of distinct five-word shingles. Documents with equal sets form a class, so a group of
   copies is one row from here on. The class's SetSketch holds REGISTERS values floor(1 - log_b(min)) of exponentially
   distributed hash minima, truncated to 16 bits; registers of a union are the maxima of the registers.
2. Registers are banded. Classes that agree on a band share a bucket; buckets of one class are dropped, and of buckets
   of the same classes all but that of the first band, as no pair is taken in the others. A large bucket is cut into
   blocks of about BLOCK classes and BLOCK_BYTES bytes of sets, so no bucket is one task. The full sets of the classes
   that are left come again from the texts, which a bitmap of their ids selects; its size follows their number, and
   beyond MOST_BITS a join takes its place.
3. In a block the Jaccard similarity of two sketches is estimated by maximum likelihood from the registers that are
   greater, equal and less, given the set sizes. A pair is taken in the first band that its two share. Pairs whose
   estimate is within a margin of the threshold are verified on full sets, likeliest first, unless verified links of the
   block connect them already; verified links leave the task, candidates never do.
4. Blocks of a large bucket are compared within themselves and with a few representatives of the bucket first. What that
   leaves apart is cut into blocks anew, by component, and blocks that hold different components are compared with each
   other; a group of near copies, which is one component by then, is not. A component is thus missed only if a linked
   pair shares no band (2e-7 at the threshold) or is estimated over four standard deviations too low; no bucket, partner
   or candidate is capped.
5. Components come from contracting the verified links, and every document gets its class's component.

Nulls: a null or wordless text has an empty set and is linked with nothing. Null ids are never a component's smallest id
unless it has no other. Repeated rows are copies. Empty tables give no rows; other columns are ignored. Very long texts
are read whole; a set has 8 bytes a shingle. Ties: the threshold itself links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, staged
from .shingles import WordHasher, digest, shingle_set

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_535
BLOCK, BLOCK_BYTES = 384, 32 << 20
REPRESENTATIVES = 8  #: of a large bucket
#: Estimates this far under the threshold are still verified (over four standard deviations at 0.85).
MARGIN = 0.13
#: Bits of a bitmap for each id, if they can be had; its least and largest size (32 MB).
BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


def _multipliers(n: int) -> np.ndarray:
    """Odd 64-bit multipliers, one a register."""
    from .shingles import mixed

    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_MULTIPLIERS = _multipliers(REGISTERS)


def registers(minima: np.ndarray) -> np.ndarray:
    """Register values of uniform 64-bit hash minima."""
    exponential = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) uint16; every set has an element."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    minima, product = np.empty((REGISTERS, len(sets)), np.uint64), np.empty_like(flat)
    for k, a in enumerate(_MULTIPLIERS):
        np.multiply(flat, a, out=product)
        minima[k] = np.minimum.reduceat(product, starts)
    return registers(minima).T


def likelihood(j: float | np.ndarray, less: np.ndarray, equal: np.ndarray, greater: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Log-likelihood of Jaccard similarity ``j`` for sketches whose registers compare so; u and v: shares of the set sizes."""
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    return greater * np.log(up) + less * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def at_least(cut: float, less: np.ndarray, equal: np.ndarray, greater: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the estimate of most likelihood is ``cut`` or more: the likelihood is concave, so it rises at ``cut``."""
    u, v = n / (n + m), m / (n + m)
    return likelihood(cut + 1e-3, less, equal, greater, u, v) >= likelihood(cut, less, equal, greater, u, v)


def compared(first: dict, second: dict | None, band: int, per_cent: int) -> list[tuple[bytes, bytes]]:
    """Verified links between two blocks (or within one) that connect all that their pairs of this band connect."""
    threshold = per_cent / 100
    both = first if second is None else {k: first[k] + second[k] for k in first}
    cut, size = len(first["id"]), len(both["id"])
    sketch = np.frombuffer(b"".join(both["sketch"]), np.uint16).reshape(size, REGISTERS)
    n = np.array([len(e) // 8 for e in both["elements"]], np.float64)
    bands = sketch.reshape(size, BANDS, ROWS)
    out_a, out_b, out_equal, out_greater = [], [], [], []
    for i in range(size if second is None else cut):
        js = np.arange(i + 1, size) if second is None else np.arange(cut, size)
        js = js[(n[js] >= threshold * n[i]) & (n[i] >= threshold * n[js])]
        if not len(js):
            continue
        equal = (sketch[js] == sketch[i]).sum(1)
        near = equal >= (threshold - MARGIN - 0.1) * REGISTERS
        js, equal = js[near], equal[near]
        # each pair is taken in the first band that the two share
        shared = (bands[js] == bands[i]).all(2).argmax(1) == band
        js, equal = js[shared], equal[shared]
        if len(js):
            out_a.append(np.full(len(js), i))
            out_b.append(js)
            out_equal.append(equal)
            out_greater.append((sketch[i] > sketch[js]).sum(1))
    if not out_a:
        return []
    a, b, equal, greater = map(np.concatenate, (out_a, out_b, out_equal, out_greater))
    good = at_least(threshold - MARGIN, REGISTERS - equal - greater, equal, greater, n[a], n[b])
    a, b, equal = a[good], b[good], equal[good]
    sets = [np.frombuffer(e, np.uint64) for e in both["elements"]]
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for k in np.lexsort((b, a, -equal)).tolist():
        i, j = int(a[k]), int(b[k])
        x, y = root(i), root(j)
        if x == y:
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= per_cent * (len(sets[i]) + len(sets[j]) - common):
            parent[x] = y
            links.append((both["id"][i], both["id"][j]))
    return links


def sketched(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n (set size), id (digest of the set; null if empty), sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher = WordHasher()
        for batch in slices(batches):
            sets = [shingle_set(hasher.of(t.as_py())) for t in batch.column(1)]
            full = [s for s in sets if len(s)]
            rows = iter(sketches(full)) if full else iter(())
            sketch = [next(rows).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n", "id", "sketch"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n long, id binary, sketch binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, band, blocks, block, id): the bands that at least two classes share."""

    def run(batches):
        from .shingles import mixed

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(size, BANDS, ROWS)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (size, 1))
            for k in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k].astype(np.uint64))
            at = pa.array(np.repeat(np.arange(size), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), size)), batch.column(0).take(at), batch.column(2).take(at)], ["key", "band", "id", "n"])

    rows = classes.select("id", "sketch", "n").mapInArrow(lean(run), "key long, band int, id binary, n long")
    # buckets of the same classes: two hashes of 64 bits over all of them
    counts = rows.groupBy("key", "band").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("_sum"), F.bit_xor(F.xxhash64("id")).alias("_a"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("_b")).where("size > 1")
    first = counts.groupBy("size", "_sum", "_a", "_b").agg(F.min(F.struct("band", "key")).alias("_at")).select("_at.key", "_at.band", "size", "_sum")
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(8 * F.col("_sum") / F.lit(BLOCK_BYTES))).cast("int")
    return rows.join(first, ["key", "band"]).select("key", "band", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id")


def _bitmap(ids: DataFrame, column: str) -> tuple[np.ndarray, int] | None:
    """Bits of the hashed ids, and how many bits there are; None if there are too many ids for one."""
    n = ids.count()
    if n * BITS > 4 * MOST_BITS:
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS).bit_length()))
    maps = ids.select(_bit(column, bits)).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for k, found in maps.toLocalIterator():
        # buckets count positive values from 1 and have 0 in the first bucket's first place
        out[(k - 1) * 4096 : k * 4096] |= np.frombuffer(found, np.uint8)
    return out, bits


def _bit(column: str, bits: int) -> Column:
    return (F.pmod(F.xxhash64(column), F.lit(bits - 1)) + 1).alias("bit")


def _parted(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose doc_id may be among the ``column`` of ``ids``, and the rest, where it surely is not; with the
    columns of ``docs``. Rows are told apart by a bitmap, which shuffles nothing, or by a join if there are too many ids."""
    found = _bitmap(ids, column)
    if found is None:
        wanted = ids.select(F.col(column).alias("_wanted")).distinct()
        same = docs["doc_id"].eqNullSafe(F.col("_wanted"))
        return docs.join(wanted, same, "left_semi"), docs.join(wanted, same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(found[0])
    columns = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), _bit("doc_id", found[1]))
    schema = f"doc {whole.schema['doc'].dataType.simpleString()}"

    def part(wanted: bool) -> DataFrame:
        def run(batches):
            bitmap = shared.value
            for batch in batches:
                at = batch.column(1).to_numpy(zero_copy_only=False) - 1
                held = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(held == wanted))], ["doc"])

        return whole.mapInArrow(lean(run), schema).select("doc.*")

    return part(True), part(False)


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, elements): full sets of the classes ``members`` (id, first), made again from the texts."""

    def run(batches):
        hasher = WordHasher()
        for batch in slices(batches):
            sets = [s for t in batch.column(0) if len(s := shingle_set(hasher.of(t.as_py())))]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "elements"])

    texts = _parted(docs.select("doc_id", F.col("text").cast("string").alias("text")), members, "first")[0]
    found = texts.select("text").mapInArrow(lean(run), "id binary, elements binary")
    # rows that repeat an id and text give the set again
    return found.join(members.select("id"), "id", "left_semi").groupBy("id").agg(F.first("elements").alias("elements"))


def _compared(work: DataFrame, per_cent: int) -> DataFrame:
    """Verified links (a, b) of rows (band, sides): one block, which is compared within itself, or two."""

    def run(batches):
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for r in range(batch.num_rows):
                sides = [{k: [m[k] for m in side] for k in ("id", "sketch", "elements")} for side in batch.column(1)[r].as_py()]
                links += compared(sides[0], sides[1] if len(sides) > 1 else None, batch.column(0)[r].as_py(), per_cent)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return work.select("band", "sides").mapInArrow(lean(run), "a binary, b binary")


def _gathered(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(key, band, block, members): at most about BLOCK classes and BLOCK_BYTES bytes of sets a row."""
    return rows.select("key", "band", "block", "id").join(members, "id").groupBy("key", "band", "block").agg(F.collect_list(F.struct("id", "sketch", "elements")).alias("members"))


def _first_links(buckets: DataFrame, members: DataFrame, per_cent: int) -> DataFrame:
    """Links inside blocks, and between the blocks of a large bucket and its representatives."""
    large = buckets.where("blocks > 1")
    chosen = large.groupBy("key", "band", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(REPRESENTATIVES)).alias("_k")).agg(F.min(F.struct(F.xxhash64("id", F.lit(2)).alias("h"), "id", "block")).alias("r"), F.first("blocks").alias("blocks"))
    sent = chosen.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("r.id").alias("id"), F.col("r.block").alias("_own")).where("block <> _own").drop("_own")
    rows = buckets.select("key", "band", "block", "id").unionByName(sent)
    return _compared(_gathered(rows, members).select("band", F.array("members").alias("sides")), per_cent)


def _further_links(buckets: DataFrame, members: DataFrame, labels: DataFrame, per_cent: int) -> DataFrame:
    """Links between what ``labels`` leave apart in large buckets. Components of many classes have blocks of their own,
    the others share some; a pair of blocks of one component is not compared."""
    bucket = ["key", "band"]
    rows = buckets.where("blocks > 1").select(*bucket, "blocks", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    parts = rows.groupBy(*bucket, "blocks", "label").agg(F.count(F.lit(1)).alias("_m"))
    small = F.col("_m") * 4 < BLOCK
    sums = parts.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_parts"), F.sum("_m").alias("_size"), F.sum(F.when(small, F.col("_m")).otherwise(0)).alias("_small"))
    parts = parts.join(sums.where("_parts > 1"), bucket)
    # blocks in proportion to those of the bucket, which bytes may have made more than the classes do
    share = lambda m: F.greatest(F.lit(1), F.ceil(F.col("blocks") * m / F.col("_size"))).cast("int")
    parts = parts.select(*bucket, "label", F.when(~small, F.col("label")).otherwise(F.lit(b"")).alias("own"), F.when(small, share(F.col("_small"))).otherwise(share(F.col("_m"))).alias("_n"))
    rows = rows.select(*bucket, "id", "label").join(parts, [*bucket, "label"])
    number = F.pmod(F.when(F.col("own") == F.lit(b""), F.xxhash64("label")).otherwise(F.xxhash64("id")), F.col("_n")).cast("int")
    rows = rows.select(*bucket, "id", F.struct("own", number.alias("number")).alias("block"))
    names = rows.select(*bucket, "block").distinct()
    other = names.select(*bucket, F.col("block").alias("other"))
    pairs = names.join(other, bucket).where((F.col("block") <= F.col("other")) & ((F.col("block.own") == F.lit(b"")) | (F.col("block.own") != F.col("other.own"))))
    blocks = _gathered(rows, members)
    both = pairs.join(blocks, [*bucket, "block"]).withColumnRenamed("members", "_a").join(blocks.withColumnRenamed("block", "other"), [*bucket, "other"])
    same = F.col("block") == F.col("other")
    return _compared(both.select("band", F.when(same, F.array("members")).otherwise(F.array("_a", "members")).alias("sides")), per_cent)


def _linked(docs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """(id, label) of the classes that are linked with others."""
    buckets = staged(_buckets(classes), "buckets")
    inside = classes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "first", "sketch")
    members = staged(inside.select("id", "sketch").join(_sets(docs, inside), "id"), "members")
    labels = components(staged(_first_links(buckets, members, per_cent), "links"))
    if buckets.where("blocks > 1").isEmpty():
        return labels
    more = staged(_further_links(buckets, members, labels, per_cent), "links")
    if more.isEmpty():
        return labels
    # links between components join them
    to = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"_{c}"))
    ends = [F.coalesce(f"_{c}", c).alias(c) for c in ("a", "b")]
    joined = components(more.join(to("a"), "a", "left").join(to("b"), "b", "left").select(*ends))
    all_ = labels.unionByName(joined.select("id", F.col("id").alias("label")).join(labels.select("id"), "id", "left_anti"))
    above = joined.select(F.col("id").alias("label"), F.col("label").alias("_up"))
    return staged(all_.join(above, "label", "left").select("id", F.coalesce("_up", "label").alias("label")), "components")


def _stars(batches):
    """The edges of some batches as edges from the least node of each of their components, a few batches at a time."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flushed(schema):
        pairs = [(root(x), x) for x in list(parent)]
        pairs = [(r, x) for r, x in pairs if r != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], schema.field(k).type) for k in (0, 1)], ["a", "b"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield flushed(schema)
    if schema is not None:
        yield flushed(schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of ``edges`` (a, b): the least id of its component. Rounds of contraction.

    Each round every node points at its least neighbour, pointers are followed twice, and edges inside a node vanish.
    Before, each task replaces the edges it has by a star for each of their components, which needs no shuffle.
    """
    labels = None
    edges = edges.where("a <> b")
    while True:
        edges = edges.mapInArrow(lean(_stars), edges.schema)
        edges = staged(edges.distinct(), "edges")
        if edges.isEmpty():
            break
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = ways.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p"))
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        parent = staged(parent, "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("id"), F.col("p").alias("label"))
        else:
            labels = labels.join(parent.select(F.col("a").alias("label"), "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
        labels = staged(labels, "components")
        to = lambda c: parent.select(F.col("a").alias(c), F.col("p").alias(f"_{c}"))  # noqa: E731, B023
        edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b")
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label"))


def link(docs: DataFrame, per_cent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (its least reachable doc_id), kept."""
    rows = staged(sketched(docs), "sketches")
    classes = staged(rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "classes")
    return _with_components(rows, classes, _linked(docs, classes, per_cent))


def _with_components(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    least = classes.join(labels, "id").groupBy("label").agg(F.min("first").alias("least"))
    linked = labels.join(least, "label").select("id", "least")
    found = classes.select("id", "first").join(linked, "id", "left").select("id", F.coalesce("least", "first").alias("_least"))
    component = F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n", "id").join(found, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id").eqNullSafe(component), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, per_cent: int = 85) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id (of rows that repeat it, one)."""
    found = staged(link(docs, per_cent), "linked")
    gone = found.where("not kept").select("doc_id").distinct()
    again = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "component_id").count().where("count > 1").select("doc_id")
    # rows that surely stay are parted from the few that a join decides: no text of theirs is shuffled
    asked, sure = _parted(docs, gone.unionByName(again), "doc_id")
    columns = docs.columns
    decided = asked.join(gone, "doc_id", "left_anti").select(*columns)
    once = decided.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*columns)
    return sure.unionByName(decided.join(again, "doc_id", "left_anti").select(*columns)).unionByName(once)
