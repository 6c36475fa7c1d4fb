"""Balanced label propagation: linked documents gather in shards whose row counts stay at most one apart.

Links are memberships (document, hub): documents that share a hub, here those with equal texts, are neighbours, which
stands for all pairs of a group without making them. Every document starts with a label of its own, by the hash of its
id. Each round is a join of labels and hubs: a hub's documents ask to move to the label that most of them have, among the
shards with room, unless their own label has more of them. Quotas decide who may: the driver walks through the counts of
requests by (shard now, shard wanted, grain), takes what fits and frees the places that were left. So loads never exceed
the capacity, swaps included. A hub of more documents than a shard holds is parted into pieces by document hash before
any join, each of which gathers for itself; so no key has more rows than a shard. The last step ranks the documents of
a shard, keeps as many as its exact target and deals all others, unlinked ones too, into the room left.

Nulls: a null text has size 16, crc 0 and no link. Equal ids, empty tables and extra columns are fine; rows that repeat
are each placed. Empty texts are equal texts. Very long texts count by their hash and size only. Ties between labels are
broken by a hash of hub and label, so groups do not crowd one shard.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, ranked, staged

ROUNDS = 5
GRAIN = 64  #: parts in which requests are granted
SLACK = 4  #: shards take one row in so many more while labels move, else nothing could; the last step deals it out


def _unit(*cols: Column | str) -> Column:
    """A hash of the row in [0, 1)."""
    return F.pmod(F.xxhash64(*cols, F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def granted(load: dict[int, int], requests: list[tuple[int, int, int, int]], capacity: int) -> set[tuple[int, int]]:
    """The (wanted, grain) that may move, of requests (shard now, wanted, grain, rows). ``load`` is brought up to date and
    is nowhere above ``capacity``, or above what it was."""
    waiting: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for now, want, grain, n in requests:
        waiting[want, grain].append((now, n))
    out: set[tuple[int, int]] = set()
    while True:
        fit = 0
        for cell in sorted(waiting, key=lambda x: (x[1], x[0])):
            n = sum(k for _, k in waiting[cell])
            if load[cell[0]] + n <= capacity:
                load[cell[0]] += n
                for now, k in waiting.pop(cell):
                    load[now] -= k
                out.add(cell)
                fit += 1
        if not fit:
            return out


def propagate(linked: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (doc_id, text_crc32, hub, piece, ...) with one label column ``shard`` added, after ``rounds`` rounds.

    Only counts reach the driver: shards x shards x GRAIN numbers at most.
    """
    unit = ["hub", "piece"]
    labels = staged(linked.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(3)), F.lit(shards)).cast("int")), "labels")
    most = capacity + -(-capacity // SLACK)
    load = dict.fromkeys(range(shards), 0)
    if rounds:
        load |= {r[0]: r[1] for r in labels.groupBy("shard").count().collect()}
    for _ in range(rounds):
        roomy = [s for s in load if load[s] < most]
        cells = labels.groupBy(*unit, "shard").agg(F.count(F.lit(1)).alias("_n"))
        best = F.struct("_n", F.xxhash64(*unit, "shard"), "shard")
        votes = cells.groupBy(*unit).agg(F.max(F.when(F.col("shard").isin(roomy), best)).alias("_best"), F.sum("_n").alias("_size"))
        moves = cells.join(votes, unit).where((F.col("shard") != F.col("_best.shard")) & (F.col("_n") <= F.col("_best._n")))
        moves = moves.select(*unit, "shard", F.col("_best.shard").alias("_want"), "_size")
        # a small group moves as a whole; a large one fills what room there is
        by = F.when(F.col("_size") * 8 > capacity, F.xxhash64("doc_id", "_u")).otherwise(F.xxhash64(*unit))
        asked = labels.join(moves, [*unit, "shard"], "left").withColumn("_cell", F.col("_want") * GRAIN + F.pmod(by, F.lit(GRAIN)).cast("int")).drop("_size")
        asked = staged(asked, "asked")
        requests = asked.where("_want is not null").groupBy("shard", "_want", "_cell").count().collect()
        allowed = granted(load, [(now, want, cell % GRAIN, n) for now, want, cell, n in requests], most)
        if not allowed:
            break
        moved = F.col("_cell").isin([want * GRAIN + grain for want, grain in sorted(allowed)])
        labels = asked.withColumn("shard", F.when(moved, F.col("_want")).otherwise(F.col("shard"))).drop("_want", "_cell")
    return labels


def cut_edges(placed: DataFrame) -> int:
    """Links between documents of different shards, of rows (hub, shard): a group of n with cells of n_i has
    (n^2 - sum n_i^2) / 2 of them. Combined by cell, so no pair is made."""
    cells = placed.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("hub").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return groups.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0)).cast("long")).first()[0]


def _step(value: Column, starts: list[int], results: list[Column]) -> Column:
    """The result of the last start that is not above ``value``."""
    out = results[0]
    for s, r in zip(starts[1:], results[1:]):
        out = F.when(value >= s, r).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text); law ``rows``. Columns as the query's contract names them."""
    text = F.col("text").cast("string")
    nodes = staged(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.md5(F.encode(text, "UTF-8")).alias("hub"),
        ).withColumn("_u", _unit("doc_id", "text_crc32")),
        "nodes",
    )
    total = nodes.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    capacity = max(1, total // shards)
    # groups that no shard holds: at most one a shard
    large = nodes.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > capacity)
    piece = F.coalesce(F.floor(F.col("_u") * F.ceil(F.col("_n") / F.lit(capacity))), F.lit(0)).cast("int")
    nodes = nodes.join(F.broadcast(large), "hub", "left").withColumn("piece", piece).drop("_n")
    groups = nodes.where("hub is not null").groupBy("hub", "piece").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hub", "piece", F.lit(True).alias("_linked"))
    nodes = staged(nodes.join(groups, ["hub", "piece"], "left").withColumn("_linked", F.coalesce("_linked", F.lit(False))), "nodes")
    labels = propagate(nodes.where("_linked").drop("_linked"), shards, capacity, rounds)
    buckets = bucket_count(total)
    order = ["hub", "piece", "doc_id", "size"]
    # whole groups stay together: the bucket follows the group's piece, so an overflow cuts few groups
    placed = ranked(labels, ["shard"], order, F.pmod(F.xxhash64("hub", "piece"), F.lit(max(1, buckets // 8))), "slot")
    target = _step(F.col("shard"), list(range(shards)), [F.lit(t) for t in targets])
    placed = staged(placed.withColumn("_kept", F.col("slot") < target), "placed")
    kept = {s: n for s, n in placed.where("_kept").groupBy("shard").count().collect()}
    columns = ["doc_id", "size", "text_crc32", "hub", "piece"]
    pool = nodes.where("not _linked").select(*columns, F.lit(False).alias("_linked")).unionByName(placed.where("not _kept").select(*columns, F.lit(True).alias("_linked")))
    # what overflows of linked groups comes first and stays together; documents without links fill what is left
    grouped = F.pmod(F.xxhash64("hub", "piece"), F.lit(buckets))
    pool = pool.withColumn("_all", F.lit(0)).withColumn("_b", F.when(F.col("_linked"), grouped).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)) + buckets))
    pool = ranked(pool, ["_all"], order, F.col("_b"), "_r")
    starts, results, slots, at = [], [], [], 0
    for s in range(shards):
        if (room := targets[s] - kept.get(s, 0)) > 0:
            starts.append(at)
            results.append(F.lit(s))
            slots.append(F.col("_r") - at + kept.get(s, 0))
            at += room
    if starts:
        pool = pool.withColumn("shard", _step(F.col("_r"), starts, results)).withColumn("slot", _step(F.col("_r"), starts, slots))
    else:
        pool = pool.withColumn("shard", F.lit(None).cast("int")).withColumn("slot", F.lit(None).cast("long"))
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return placed.where("_kept").select(*columns).unionByName(pool.select(*columns))
