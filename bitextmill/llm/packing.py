"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens.

A bin is filled greedily with the longest pieces that fit; then its smallest piece is replaced by two unpacked
pieces whose sum fills the expanded gap more tightly, if there are such two. Pieces of one length are alike, so the
plan is made on the histogram of lengths (at most ``capacity`` rows, whatever the corpus) and one step fills as many
equal bins as the counts allow. Pieces are then dealt into the planned places by their rank within their length.

Nulls: a null text counts as empty (one end id). Empty tables give no rows. Repeated rows are packed as often as they
occur. Columns other than doc_id and text are ignored, whatever their names. Very long texts are cut into pieces of a
whole sequence; the first takes the rest. Ties: pieces of one length take places in the order of a hash of id and piece.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, lean, ranked, slices, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The split of text that byte-level vocabularies of this family are made with: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The printable character that a byte-level vocabulary file writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _in_merge_order(file: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE without other steps, in which a piece's id tells when it is merged."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [model["vocab"].get("".join(p), -1) for p in pairs]
    single = [i for t, i in model["vocab"].items() if len(t) == 1]
    return made == sorted(made) and (not made or max(single) < made[0])


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file.

    Where the file is plain byte-level BPE whose ids are in merge order, its vocabulary is read as merge ranks and run by
    the faster of the two libraries that know this kind; texts that hold a special token's string, and all texts of any
    other file, go through ``tokenizers`` itself. Both give the same ids.
    """

    def __init__(self, path: str, end_id: int = 0):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if _in_merge_order(json.loads(self.tokenizer.to_str())):
            byte = _byte_of()
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text, special tokens read as text where the fast way knows none."""
        return self.fast.encode_ordinary(text) if self.fast else self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids, the end id last."""
        if not text:
            return np.array([self.end_id], np.uint32)
        if not self.fast or any(s in text for s in self.special):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.append(ids, np.uint32(self.end_id)).astype(np.uint32, copy=False)


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. Longer documents are cut; the first piece takes the rest."""

    def run(batches):
        encoder = Encoder(tokenizer_path, end_id)
        for batch in slices(batches):
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py())
                n, start, k = len(ids), 0, 0
                stop = n - (-(-n // capacity) - 1) * capacity
                while start < n:
                    for c, v in zip(cols, (doc_id, k, start, stop - start, zlib.crc32(ids[start:stop]))):
                        c.append(v)
                    start, stop, k = stop, stop + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins); counts[l]: pieces of length l, 1 <= l <= capacity."""
    left, bins = counts.astype(np.int64).copy(), []
    while True:
        lens = np.flatnonzero(left)
        if not len(lens):
            return bins
        items, free = [], left.copy()
        gap = capacity
        while gap:
            k = np.searchsorted(lens, gap, "right") - 1
            while k >= 0 and not free[lens[k]]:
                k -= 1
            if k < 0:
                break
            items.append(int(lens[k]))
            free[lens[k]] -= 1
            gap -= items[-1]
        if gap:
            wide, open_ = gap + items[-1], lens[free[lens] > 0]
            if len(open_):
                at = np.searchsorted(open_, wide - open_, "right") - 1
                same = (at >= 0) & (open_[at] == open_) & (free[open_] < 2)
                at = np.where(same, at - 1, at)
                sums = np.where(at >= 0, open_ + open_[at], 0)
                best = int(np.argmax(sums))
                if sums[best] > items[-1]:
                    items[-1:] = [int(open_[best]), int(open_[at[best]])]
        need = np.bincount(items, minlength=len(left))
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left[used] -= need[used] * times
        bins.append((items, times))


def places(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Runs of ranks, sorted: length, first rank, first sequence, offset. One run is one item of one kind of bin."""
    runs, seen, base = [], {}, 0
    for items, times in bins:
        offset = 0
        for length in items:
            runs.append((length, seen.get(length, 0), base, offset))
            seen[length] = seen.get(length, 0) + times
            offset += length
        base += times
    return tuple(np.array(sorted(runs), dtype=np.int64).reshape(-1, 4).T)


def packed(spark: SparkSession, pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset (in tokens, gapless from 0) to each piece; see the module's docstring."""
    pieces = staged(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    length, first, sequence, offset = places(best_two_fit(counts, capacity))
    plan = spark.sparkContext.broadcast((length * (1 << 44) + first, first, sequence, offset))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, first, sequence, offset = plan.value
        at = np.searchsorted(key, length.to_numpy() * (1 << 44) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - first[at], "offset": offset[at]})

    buckets = bucket_count(int(counts.sum()))
    row = ranked(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    return row.withColumn("_place", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise whole texts, cut what is longer than ``capacity`` and pack the pieces; one row a piece."""
    return packed(docs.sparkSession, tokenised(docs, tokenizer_path, capacity, end_id), capacity)
