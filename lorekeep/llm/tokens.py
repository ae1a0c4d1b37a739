"""Token-ID output: one zstandard frame a document, with a shared dictionary.

A shard is two files.  `<name>.bin` holds the frames one after another; each is a
document's ids as little-endian integers of the width in the index header,
compressed with the shared dictionary.  `<name>.idx` has a header (magic, version,
id width, number of documents, SHA-256 of the dictionary), then the document ids
(int64, null as the smallest), byte offsets and token offsets (uint64, one more
than documents).  `dictionary` holds the dictionary, the table `manifest` the
shards that count: a task that runs twice leaves a second pair of files that no
manifest row names.  One document is read by its index entry and one short range
of bytes.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from dataclasses import dataclass
from itertools import chain, pairwise
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import textbuf
from .session import map_batches

MAGIC, VERSION = b"LKTOKENS", 1
HEADER = "<8sHHQ32s"
NO_ID = -(1 << 63)
#: Documents that the dictionary is trained on at most, bytes of ids of them, and its size.
DICT_DOCS, DICT_BYTES, DICT_SIZE = 2_000, 8 << 20, 64 << 10
#: Bytes of text that go to one shard; inputs of fewer than MIN_SHARDS such get smaller shards.
SHARD_BYTES, MIN_SHARDS, LEAST_SHARD = 256 << 20, 48, 8 << 20
#: Distinct units whose ids a Python worker remembers.
CACHE = 600_000
LEVEL = 3
#: Units that the tokenizer gets at once, and bytes of a slice: what both leave in memory follows them.
LEARN, SLICE_BYTES = 4_096, 1 << 19

_SPACE = ~textbuf.NON_SPACE
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?"]] = True
_ODD = np.zeros(256, bool)
_ODD[[0x80, 0x81, 0x9A, 0xC2]] = True


def units(s: textbuf.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of pieces that the tokenizer treats independently.

    The byte-level pre-tokenizer never joins a non-space character with white
    space behind it, nor a letter with a following stop.  Cuts after characters
    that may themselves be Unicode white space are left out.
    """
    d = s.data
    if not len(d):
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(len(d), bool)
    prev = d[:-1]
    before = np.concatenate([[0], d[:-2]]).astype(np.uint8)
    cut[1:] = (_SPACE[d[1:]] & ~_SPACE[prev] & ~((prev >= 0x80) & _ODD[before])) | (_STOP[d[1:]] & _ASCII_LETTER[prev])
    cut[s.offsets[:-1][s.lengths() > 0]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(d))
    return start, end, np.searchsorted(s.offsets, start, "right") - 1


class Encoder:
    """Ids of whole texts; distinct units are encoded by the tokenizers library once and remembered."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and every thread a heap of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def clear(self) -> None:
        """Forget all units: hashes in order, and where their ids begin in the pool and how many they are."""
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, place: np.ndarray, hashes: np.ndarray, texts: list[str]) -> None:
        """Encode new units; place: where their hashes go among the known ones."""
        sizes, first = [], self.used
        for i in range(0, len(texts), LEARN):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + LEARN], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            end = self.used + int(sizes[-1].sum())
            if end > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * end - self.used, np.uint32)])
            self.pool[self.used : end] = np.fromiter(chain.from_iterable(found), np.uint32, end - self.used)
            self.used = end
        size = np.concatenate(sizes)
        self.keys = np.insert(self.keys, place, hashes)
        self.begin = np.insert(self.begin, place, first + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)

    def encode(self, s: textbuf.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and how many each has."""
        start, end, doc = units(s)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(s.n, np.int64)
        uniq, first, back = np.unique(textbuf.span_hash(s.data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == uniq[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = s.data.tobytes()
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            self._learn(at[new], uniq[new], [raw[a:b].decode("utf-8", "replace") for a, b in spans])
            at = np.searchsorted(self.keys, uniq)
        row = at[back]
        size = self.size[row].astype(np.int64)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.pool[np.repeat(self.begin[row], size) + step], np.bincount(doc, weights=size, minlength=s.n).astype(np.int64)

    def with_end(self, s: textbuf.Slice, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The same with end_id behind each document; offsets instead of counts."""
        ids, counts = self.encode(s)
        if end_id is None:
            return ids, np.concatenate([[0], np.cumsum(counts)])
        offsets = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(offsets[-1], end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[offsets[1:] - 1] = False
        out[inside] = ids
        return out, offsets


def id_width(path: str, end_id: int | None) -> int:
    size = Encoder.of(path).tokenizer.get_vocab_size(with_added_tokens=True)
    return 2 if max(size, (end_id or 0) + 1) <= 1 << 16 else 4


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int | None, width: int) -> bytes:
    """A dictionary from the id arrays of the DICT_DOCS documents with the smallest hashes of their ids.

    With too few of them for zstandard's trainer, their bytes themselves; empty without documents.
    """
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(41)), "doc_id").limit(DICT_DOCS)

    def make():
        def run(batch: pa.RecordBatch):
            out = []
            for s in textbuf.slices(batch.column("text"), SLICE_BYTES):
                ids, offsets = Encoder.of(tokenizer).with_end(s, end_id)
                raw = ids.astype(f"<u{width}")
                out += [raw[a:b].tobytes() for a, b in pairwise(offsets)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

        return run

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # DICT_DOCS ids
    samples, total = [], 0
    for r in map_batches(chosen, make, "doc_id long, ids binary").select("doc_id", F.substring("ids", 1, DICT_BYTES // 64).alias("ids")).orderBy("doc_id", "ids").limit(DICT_DOCS).collect():
        if total + len(r["ids"]) <= DICT_BYTES:
            samples.append(bytes(r["ids"]))
            total += len(samples[-1])
    try:
        return zstandard.train_dictionary(DICT_SIZE, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_SIZE:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


@dataclass
class Written:
    """Where the files are; manifest: shard, file, n_docs, n_tokens, n_bytes of the shards that count."""

    path: str
    manifest: DataFrame


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2) -> Written:
    """Encode every whole text (null: empty) and write shards in ascending doc_id order (null first).

    Shards are ranges of doc_id, cut so as to hold about equal numbers of rows.
    Rows with the same doc_id go in one shard, ordered by their bytes.  The text
    is read once for encoding and is not shuffled: what moves are compressed ids.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    total = size["bytes"] or 0
    n = max(1, -(-total // SHARD_BYTES), min(MIN_SHARDS, -(-total // LEAST_SHARD)))
    cuts = np.zeros(0, np.int64)
    if n > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0]
        cuts = np.unique(np.array(found or [], np.int64))
    width = id_width(tokenizer, end_id)
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).digest()
    store, root = _file_system(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast((dictionary, cuts))  # DICT_SIZE bytes and a number for each shard

    def encode():
        data, bounds = shared.value
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data))

        def run(batch: pa.RecordBatch):
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            frames, counts = [], []
            for s in textbuf.slices(batch.column("text"), SLICE_BYTES):
                tokens, offsets = Encoder.of(tokenizer).with_end(s, end_id)
                raw = tokens.astype(f"<u{width}")
                frames += [press.compress(raw[a:b].tobytes()) for a, b in pairwise(offsets)]
                counts.append(np.diff(offsets))
            shard = np.searchsorted(bounds, ids, "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids), pa.array(np.concatenate(counts)), pa.array(frames, pa.binary())], ["shard", "doc_id", "n", "frame"])

        return run

    def write_shards(batches):
        now, out, index = None, None, []

        def close():
            nonlocal out
            out.close()
            ids, sizes, counts = (np.concatenate(x) for x in zip(*index, strict=True))
            with store.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(struct.pack(HEADER, MAGIC, VERSION, width, len(ids), digest))
                f.write(ids.astype("<i8").tobytes())
                for x in (sizes, counts):
                    f.write(np.concatenate([[0], np.cumsum(x)]).astype("<u8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), *[pa.array([int(x)], pa.int64()) for x in (len(ids), counts.sum(), sizes.sum())]], ["shard", "file", "n_docs", "n_tokens", "n_bytes"])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in pairwise(edge):
                if a == b:
                    continue
                if shard[a] != now:
                    if out is not None:
                        yield close()
                    now, index = int(shard[a]), []
                    name = f"shard-{now:06d}-{uuid.uuid4().hex[:12]}"
                    out = store.open_output_stream(f"{root}/{name}.bin")
                frames = batch.column("frame").slice(a, b - a).to_pylist()
                out.write(b"".join(frames))
                index.append((batch.column("doc_id").slice(a, b - a).to_numpy(), np.array([len(x) for x in frames]), batch.column("n").slice(a, b - a).to_numpy()))
        if out is not None:
            yield close()

    rows = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "shard int, doc_id long, n long, frame binary")
    by_shard = rows.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "doc_id", "frame")
    manifest = stored(by_shard.mapInArrow(write_shards, "shard int, file string, n_docs long, n_tokens long, n_bytes long"), "manifest")
    return Written(path, manifest)


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, path: str, file: str, dictionary: bytes | None = None) -> None:
        self.store, root = _file_system(path)
        if dictionary is None:
            with self.store.open_input_stream(f"{root}/dictionary") as f:
                dictionary = f.read()
        with self.store.open_input_stream(f"{root}/{file}.idx") as f:
            magic, version, self.width, n, digest = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
            if magic != MAGIC or version != VERSION:
                raise ValueError(f"{file}.idx is no index of this version")
            if digest != hashlib.sha256(dictionary).digest():
                raise ValueError(f"{file} was written with another dictionary")
            self.doc_ids = np.frombuffer(f.read(8 * n), "<i8")
            self.offsets = np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)
            self.starts = np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.data = self.store.open_input_file(f"{root}/{file}.bin")
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document: one range read."""
        raw = self.data.read_at(int(self.offsets[i + 1] - self.offsets[i]), int(self.offsets[i]))
        return np.frombuffer(self.press.decompress(raw), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this id."""
        a, b = np.searchsorted(self.doc_ids, doc_id, "left"), np.searchsorted(self.doc_ids, doc_id, "right")
        return [self.document(i) for i in range(a, b)]

    def close(self) -> None:
        self.data.close()


def read_back(spark: SparkSession, written: Written) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and n_bytes of every document, read from the files."""
    base = 0
    rows = []
    for r in written.manifest.orderBy("shard").collect():  # a row for each shard of SHARD_BYTES
        rows.append((r["file"], base))
        base += r["n_tokens"]
    path = written.path

    def run(batches):
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path, file)
                n = len(shard.doc_ids)
                for a in range(0, n, 4096):
                    b = min(n, a + 4096)
                    crc = [zlib.crc32(shard.document(i).tobytes()) for i in range(a, b)]
                    ids = shard.doc_ids[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(shard.starts[a:b] + first), pa.array(np.diff(shard.starts[a : b + 1])), pa.array(crc, pa.int64()), pa.array(np.diff(shard.offsets[a : b + 1]))], ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"])
                shard.close()

    shards = spark.createDataFrame(rows, "file string, base long")
    if rows:
        shards = shards.repartition(len(rows))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long")


def token_counts(docs: DataFrame, tokenizer: str, end_id: int | None = 2, columns: list[str] | None = None) -> DataFrame:
    """The columns (else doc_id) of every row with n_tokens, the end id included."""
    names = columns or ["doc_id"]

    def make():
        def run(batch: pa.RecordBatch):
            counts = [np.diff(Encoder.of(tokenizer).with_end(s, end_id)[1]) for s in textbuf.slices(batch.column("text"), SLICE_BYTES)]
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(counts))], ["row", "n_tokens"])

        return run

    row = docs.select(F.struct(*names).alias("row"), "text")
    kind = row.schema["row"].dataType.simpleString()
    return map_batches(row, make, f"row {kind}, n_tokens long").select(*[F.col("row").getField(c).alias(c) for c in names], "n_tokens")
