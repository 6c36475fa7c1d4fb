"""The prefix trie of conversations: who shares which first turns, and how much text a shared prefix saves.

Every conversation is a path from the textless root, one node a turn; two conversations meet in a node if all turns up to
it have equal role and text. A node belongs to its smallest member. Members of a node are members of its parent, so the
smallest member never gets smaller along a path, and the nodes that a conversation owns are a suffix of its path. So a
conversation says all it brings to its ancestors in four numbers: where its own nodes begin, the characters before them,
the owner of the node before them, and whether its end is a leaf. One aggregation by prefix adds these up:

* saved text of a subtree: each node but for one copy, that is characters of all members less characters of owned nodes;
* leaves: ends that are owned and that no member passes; children: members whose next node is their own.

A prefix is named by its depth and 128 bits, the exclusive or of hashes of (place, SHA-256 of role and text), so running
names are window aggregates. Equal prefixes have equal names; that different ones do rests on the hashes.

Long conversations are numbered and named in blocks of ``BLOCK`` turns whose totals are added afterwards, popular prefixes
are first reduced in ``SALTS`` parts, and ids that end in one node are joined to texts of ``CHUNK`` ids before one task reads
them in order (SHA-256 has no other way).

Nulls: null roles and texts are empty, null turns come first; rows without conv_id belong to no conversation and are left
out. Empty tables give no rows, not even the root. Ties: rows of one turn number come in the order of the SHA-256 of
length of role, colon, role and text. Repeated rows are turns of their own. Very long texts only ever meet the hash
function. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK = 1024  #: turns of one conversation in one group
SALTS = 64  #: parts of the members of one prefix
CHUNK = 16_384  #: range of ids that are joined to one text
NODE = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and chars of each turn, with the turns of its conversation (n) and its block."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    rows = rows.withColumn("block", F.coalesce(F.expr(f"CAST(turn AS LONG) div {BLOCK}"), F.lit(-(1 << 62))))
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n_block"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("n_block").over(before), F.lit(0)).alias("before"), F.sum("n_block").over(whole).alias("n"))
    return rows.withColumn("place", place).join(sizes, ["conv_id", "block"]).select("conv_id", "block", "n", (F.col("before") + F.col("place")).alias("pos"), "digest", "chars")


def rebuilt(rows: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, length, depth, digest, chars of every rebuilt conversation, depth 0 included.

    The first h turns are those of the first conversation of its ``group``; h is the id's crc32 modulo ``most``.
    """
    convs = rows.select("conv_id", "n").where("pos = 1")
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = rows.where((F.col("pos") < most) & (first == F.col("conv_id")))
    heads = heads.groupBy(F.col("conv_id").alias("first")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))  # fewer than `most` each
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = convs.withColumn("first", first).withColumn("h", F.when(F.col("first") == F.col("conv_id"), 0).otherwise(h)).join(heads, "first", "left")
    taken = F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("h").cast("int"))
    convs = convs.withColumn("head", taken).withColumn("b", F.size("head").cast("long")).withColumn("length", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = staged(convs.select("conv_id", "h", "b", "length", "head"), "conversations")

    blocks = rows.select("conv_id", "block").distinct().join(convs.drop("head"), "conv_id")
    own = rows.join(blocks, ["conv_id", "block"]).where("pos > h").select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("b")).alias("depth"), "digest", "chars")
    borrowed = convs.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "length", F.col("t.pos").alias("depth"), "t.digest", "t.chars")
    roots = convs.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(borrowed).unionByName(roots)


def paths(turns: DataFrame) -> DataFrame:
    """Adds the name of the prefix (k1, k2) and its characters (upto) to each turn of (conv_id, length, depth, digest, chars)."""

    def part(seed: int) -> Column:
        return F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(F.lit(0).cast("long"))

    rows = turns.select("conv_id", "length", "depth", "chars", F.expr(f"depth div {BLOCK}").alias("block"), part(1).alias("f1"), part(2).alias("f2"))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.where(F.col("length") >= BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("f1").alias("t1"), F.bit_xor("f2").alias("t2"), F.sum("chars").alias("t3"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", F.bit_xor("t1").over(before).alias("b1"), F.bit_xor("t2").over(before).alias("b2"), F.sum("t3").over(before).alias("b3"))
    named = rows.select("conv_id", "length", "depth", "chars", "block", F.bit_xor("f1").over(within).alias("w1"), F.bit_xor("f2").over(within).alias("w2"), F.sum("chars").over(within).alias("w3"))
    none = F.lit(0).cast("long")
    return named.join(totals, ["conv_id", "block"], "left").select(
        "conv_id",
        "block",
        "length",
        "depth",
        "chars",
        F.col("w1").bitwiseXOR(F.coalesce("b1", none)).alias("k1"),
        F.col("w2").bitwiseXOR(F.coalesce("b2", none)).alias("k2"),
        (F.col("w3") + F.coalesce("b3", none)).alias("upto"),
    )


def owned(named: DataFrame) -> DataFrame:
    """Adds the smallest member (own) and the longest member's length (longest) of each prefix to its occurrences."""
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")
    parts = named.groupBy(*NODE, salt).agg(F.min("conv_id").alias("least"), F.max("length").alias("far"))
    node = Window.partitionBy(*NODE)  # at most SALTS rows
    parts = parts.select(*NODE, "salt", F.min("least").over(node).alias("own"), F.max("far").over(node).alias("longest"))
    return named.withColumn("salt", salt).join(parts, [*NODE, "salt"]).drop("salt")


def hashed_ids(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending conv_ids of each node, joined by commas."""
    chunk = F.expr(f"conv_id div {CHUNK}")
    texts = ends.groupBy(*NODE, chunk.alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        key, digest = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in key] + [pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])

        for batch in batches:
            done: list[tuple] = []
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if node == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*NODE, "ends_sha256"])
        if key is not None:
            yield row()

    ordered = texts.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return ordered.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = staged(turns(conversations), "turns")
    marked = staged(owned(staged(paths(rebuilt(rows, group, most)), "paths")), "owned")
    mine = F.col("own") == F.col("conv_id")
    convs = marked.groupBy("conv_id").agg(
        F.count_if(~mine).alias("start"),
        F.max(F.when(~mine, F.col("upto"))).alias("before"),
        F.max(F.when(~mine, F.col("own"))).alias("above"),
        F.max(mine & (F.col("longest") == F.col("depth"))).cast("int").alias("leaf"),
        F.max("length").alias("last"),
    )
    convs = convs.select("conv_id", "start", "before", "above", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {BLOCK}"))).alias("block"))
    given, start = F.col("depth"), F.col("start")
    nodes = (
        marked.join(convs, ["conv_id", "block"])
        .groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.max(F.when(mine & (given > start), F.col("conv_id")).when(mine, F.col("above"))).alias("parent_conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.count_if((given < F.col("length")) & (given + 1 >= start)).alias("n_children"),
            F.sum("leaf").cast("long").alias("n_leaves"),
            F.sum(F.when(given < start, F.col("before") - F.col("upto") + F.col("chars")).otherwise(0)).cast("long").alias("saved_tokens"),
        )
    )
    ends = hashed_ids(marked.where("depth = length").select(*NODE, "conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
