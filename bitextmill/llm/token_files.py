"""Token ids as files of Arrow's stream format: equal-length sequences and masks that are read in place.

Documents are put in ascending order of id over as many partitions as their texts need; each task encodes whole texts, ends
each with an id of its own and cuts the run of ids into sequences of ``length``. A file is one Arrow stream

    ids   fixed-size list of uint16, or of uint32 where the vocabulary needs it
    mask  fixed-size list of bits (1: an id, 0: padding behind the last one)

in record batches of ``rows`` sequences. Full batches take the same number of bytes, so sequence i of a mapped file is found
by arithmetic and read without a copy (``sequence``). Beside it lies the table of its documents, a stream too: doc_id, where
the document starts in the file's ids, and its number of ids. Only the last sequences of a file hold padding; a document may
go over sequences and batches, never over files.

What the writing job returns is the list of files (``manifest``): each attempt of a task writes names of its own, so files
of lost attempts are never read. ``start`` over all files is a sum over the list.

Nulls: null texts are empty (one end id); rows without doc_id come first and stay. Empty tables write no files. Ties: rows of
one doc_id come in the order of a hash of the text; repeated rows are documents of their own. Very long texts are encoded
whole and span as many sequences as they need. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, lean, shared_dir, slices, staged

MANIFEST = "part int, file int, path string, n_docs long, n_ids long"
COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32"]
MOST_TASKS = 10_000  #: tasks that read files; each reads as many as it must
FILE_IDS = 1 << 24  #: ids after which a task begins another file
HELD = 600_000  #: distinct words whose ids a task remembers
WORD = 64  #: bytes of the longest word that is remembered


#: Places between a letter of ASCII and a mark that is no apostrophe: no word of such a file goes over one.
PARTS = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])").sub

#: Letters of ASCII in lower case, and those of U+00C0 to U+00FF.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


class Encoder:
    """Ids of whole texts by a tokenizer file, the end id last, in the narrowest unsigned type that holds its vocabulary.

    Where the file drops white space and takes the words between one by one, each distinct word is encoded once and texts are
    put together from their words; other files and texts that hold a special token's string are encoded whole. Both give the
    same ids.
    """

    def __init__(self, path: str, end_id: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = id_type(path)
        self.end = np.array([end_id], self.type).tobytes()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        file = json.loads(self.tokenizer.to_str())
        self.by_word, suffix, vocabulary = self._by_word(file), file["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}

    @staticmethod
    def _by_word(file: dict) -> bool:
        """Whether no step of the file looks past white space: it is dropped by a split that matches none of it."""
        steps = file.get("normalizer") or {}
        steps = steps.get("normalizers", [steps])
        kinds = [s.get("type") for s in steps if s]
        blank = [s for s in steps if s.get("type") == "Replace"]
        splits = file.get("pre_tokenizer") or {}
        splits = splits.get("pretokenizers", [splits])
        first = splits[0] if splits else {}
        return (
            set(kinds) <= {"NFC", "Lowercase", "Replace"}
            and all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in blank)
            and first.get("type") == "Split"
            and first.get("invert") is True
            and first.get("behavior") == "Removed"
            and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
            and all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in splits[1:])
            and not file["model"].get("dropout")
        )

    def whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, self.type).tobytes() for x in found]

    def together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are letters only, encoded as one text and parted behind the ids that end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.type)
        ends = (np.flatnonzero(self.last[ids]) + 1) * ids.itemsize
        if len(ends) != len(words):
            return self.whole(words)
        joined = ids.tobytes()
        return [joined[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]

    def learn(self, unseen: set[bytes]) -> None:
        plain = [w for w in unseen if LETTERS(w)] if self.last.any() else []
        for words, ids in ((plain, self.together), (list(unseen.difference(plain)), self.whole)):
            for i in range(0, len(words), 4096):
                part = words[i : i + 4096]
                self.words.update(zip(part, ids(part)))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text of a batch; words that the batch does not hold go when too many are remembered."""
        split = [PARTS(rb" ", t.lower()).split() if self.by_word and not any(s in t for s in self.special) else None for t in texts]
        found = [ws and list(map(self.words.get, ws)) for ws in split]
        gaps = [(ws, ids, [i for i, x in enumerate(ids) if x is None]) for ws, ids in zip(split, found) if ws and None in ids]
        unseen = {ws[i] for ws, _, at in gaps for i in at}
        if len(self.words) + len(unseen) > HELD:
            here = set().union(*filter(None, split))
            self.words = {w: self.words[w] for w in here & self.words.keys()}
        self.learn(unseen)
        for ws, ids, at in gaps:
            for i in at:
                ids[i] = self.words[ws[i]]
        for w in (w for w in unseen if len(w) > WORD):
            del self.words[w]
        joined = [self.whole([t])[0] if ids is None else b"".join(ids) for ids, t in zip(found, texts)]
        return [np.frombuffer(x + self.end, self.type) for x in joined]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> Encoder:
    """The encoder of a worker process, which keeps what it has learnt from task to task."""
    return Encoder(path, end_id)


def id_type(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _batch(ids: np.ndarray, mask: np.ndarray, length: int) -> pa.RecordBatch:
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)]
    return pa.RecordBatch.from_arrays(lists, schema=_schema(ids.dtype, length))


def _schema(kind: np.dtype | str, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """One stream of sequences and the stream of its documents; holds one batch at most."""

    def __init__(self, folder: str, name: str, kind: str, length: int, rows: int):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        self.kind, self.length, self.room = kind, length, rows * length
        self.path, self.n_ids, self.n_docs = f"{folder}/{name}.arrows", 0, 0
        self.files = [store.open_output_stream(f"{path}/{name}.arrows"), store.open_output_stream(f"{path}/{name}.documents.arrows")]
        self.ids = pa.ipc.new_stream(self.files[0], _schema(kind, length))
        self.index = pa.ipc.new_stream(self.files[1], pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())]))
        self.buffer, self.held, self.docs = [], 0, ([], [], [])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, value in zip(self.docs, (doc_id, self.n_ids, len(ids))):
            column.append(value)
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + 1
        if len(self.docs[0]) >= 10_000:
            self._documents()
        while self.held + len(ids) >= self.room:
            now, ids = ids[: self.room - self.held], ids[self.room - self.held :]
            full = np.concatenate([*self.buffer, now])
            self.ids.write_batch(_batch(full, np.ones(self.room, bool), self.length))
            self.buffer, self.held = [], 0
        if len(ids):
            self.buffer.append(ids)
            self.held += len(ids)

    def _documents(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.docs], ["doc_id", "at", "n_tokens"]))
        self.docs = ([], [], [])

    def close(self) -> None:
        if self.held:
            n = -(-self.held // self.length) * self.length
            ids, mask = np.zeros(n, self.kind), np.zeros(n, bool)
            ids[: self.held], mask[: self.held] = np.concatenate(self.buffer), True
            self.ids.write_batch(_batch(ids, mask, self.length))
        if self.docs[0]:
            self._documents()
        for x in (self.ids, self.index, *self.files):
            x.close()


def write(docs: DataFrame, tokenizer_path: str, folder: str, length: int = 2048, rows: int = 256, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents to ``folder`` (a URI that driver and executors share) in ascending order of doc_id.

    Returns the list of files (``MANIFEST``), in the order of part and file.
    """
    bounded(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    keys = ["doc_id", "tie", "row"]  # the last deals copies of one row over partitions
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches):
        encoder, part, attempt = encoder_of(tokenizer_path, end_id), TaskContext.get().partitionId(), uuid.uuid4().hex
        writer, file = None, 0

        def done():
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (file, pa.int32()), (writer.path, pa.string()), (writer.n_docs, pa.int64()), (writer.n_ids, pa.int64()))], ["part", "file", "path", "n_docs", "n_ids"])

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                if writer is None:
                    writer = Writer(folder, f"{part:06d}-{file:04d}-{attempt}", encoder.type, length, rows)
                writer.add(doc_id, ids)
                if writer.n_ids >= file_ids:
                    yield done()
                    writer, file = None, file + 1
        if writer is not None:
            yield done()

    return staged(ordered.mapInArrow(lean(run), MANIFEST), "manifest")


@contextlib.contextmanager
def opened(path: str):
    """The stream of a file in place: mapped where the file lies on this machine's disks, else as the store reads it."""
    store, inner = fs.FileSystem.from_uri(path)
    with pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner) as source:
        yield source


def documents(path: str):
    """(doc_id, at, ids) of each document of a file, in order; ids are views of the file where one batch holds them."""
    with opened(path) as source, opened(path.removesuffix(".arrows") + ".documents.arrows") as index:
        stream = pa.ipc.open_stream(source)
        here, base = np.zeros(0, np.uint16), 0  # the batch at hand and the place of its first id
        for batch in pa.ipc.open_stream(index):
            for doc_id, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                parts, need = [], n
                while need:
                    if at + n - need >= base + len(here):
                        base += len(here)
                        now = stream.read_next_batch()
                        here = now.column("ids").flatten().to_numpy()[: now.column("mask").flatten().true_count]
                    first = at + n - need - base
                    parts.append(here[first : first + need])
                    need -= len(parts[-1])
                yield doc_id, at, parts


def sequence(path: str, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``i`` of a file on this machine, read in place: all full batches are of one size."""
    source = pa.memory_map(fs.FileSystem.from_uri(path)[1])
    schema = pa.ipc.read_schema(source)
    first = source.tell()
    message = pa.ipc.read_message(source)
    size, rows = source.tell() - first, pa.ipc.read_record_batch(message, schema).num_rows
    source.seek(first + i // rows * size)
    batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    if i % rows >= batch.num_rows:
        raise IndexError(i)
    ids, mask = (batch.column(c).slice(i % rows, 1).flatten() for c in ("ids", "mask"))
    return ids.to_numpy(), mask


def read(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base"))):
                found: list[list] = [[], [], [], []]
                for doc_id, at, parts in documents(path):
                    crc = 0
                    for x in parts:
                        crc = zlib.crc32(x.astype("<u4"), crc)
                    for c, v in zip(found, (doc_id, base + at, sum(map(len, parts)), crc)):
                        c.append(v)
                    if len(found[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], COLUMNS)
                        found = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], COLUMNS)

    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return files.repartition(tasks, "path").mapInArrow(lean(run), ", ".join(f"{c} long" for c in COLUMNS))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/bitextmill/token-files-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, tokenizer_path: str, length: int = 2048, rows: int = 256, end_id: int = 2) -> DataFrame:
    """Write all documents to a new folder and read them back."""
    return read(write(docs, tokenizer_path, new_folder(docs.sparkSession), length, rows, end_id))
