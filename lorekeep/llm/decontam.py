"""Benchmark decontamination with training suffix arrays.

Each slice of the training documents gets a sparse suffix array over its words:
the positions whose first words begin some benchmark suffix, sorted by the words
that follow, to a depth of MAX_DEPTH words at most.  Every benchmark suffix is
looked up in it by binary search, which gives the range of positions that a
window of it occurs at, and the longest verbatim match of each such position.
Where a match reaches that depth, it is followed to its end among the benchmark
suffixes sorted by all their words.
Documents never leave their slice, so there is no shuffle; the benchmark is
broadcast in blocks of BLOCK_WORDS words, one pass of a block after the other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .session import map_batches

WINDOW = 10
#: First words of a position that have to begin a benchmark suffix for it to enter the array.
SEED_WORDS = 3
#: Words by which the array is sorted; longer matches are followed from there.
MAX_DEPTH = 64
#: Words of the benchmark that are broadcast at once.
BLOCK_WORDS = 1_000_000


@dataclass
class Block:
    """Benchmark items: word hashes one after another."""

    items: list[str | None]
    words: np.ndarray
    begin: np.ndarray

    def __post_init__(self) -> None:
        self.vocabulary = np.unique(self.words)
        code = np.searchsorted(self.vocabulary, self.words).astype(np.int64) + 1
        n = np.diff(self.begin)
        self.depth = int(min(max(MAX_DEPTH, WINDOW), n.max(initial=1)))
        item = np.repeat(np.arange(len(n)), n)
        left = np.repeat(self.begin[1:], n) - np.arange(len(code))
        place = np.arange(len(code))[:, None] + np.arange(self.depth)
        rows = np.where(np.arange(self.depth) < left[:, None], code[np.minimum(place, len(code) - 1)], 0) if len(code) else np.zeros((0, self.depth), np.int64)
        self.suffixes = _text(rows)
        self.order = np.argsort(self.suffixes, kind="stable")
        self.code, self.left = code.astype(">u4"), left
        self.deep = bool(n.max(initial=0) > self.depth)
        if self.deep:
            self.order = self._full_order()
        # windows: WINDOW words, or the whole of a shorter item
        short = n < WINDOW
        whole = np.repeat(short, n)
        offset = np.arange(len(code)) - np.repeat(self.begin[:-1], n)
        self.is_window = np.where(whole, offset == 0, left >= WINDOW)
        size = np.where(whole, left, WINDOW)
        at = np.flatnonzero(self.is_window)
        text = _text(np.where(np.arange(self.depth) < size[at][:, None], rows[at], 0))
        self.windows, inverse = np.unique(text, return_inverse=True)
        self.window_size = np.zeros(len(self.windows), np.int64)
        self.window_size[inverse] = size[at]
        pairs = np.unique(np.stack([inverse, item[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.window_item = pairs[:, 1]
        self.window_begin = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.seeds = {}
        for k in range(1, SEED_WORDS + 1):
            h = textbuf.gram_hash(self.words, k)
            ok = left[: len(h)] >= k
            if k < SEED_WORDS:
                ok &= (left[: len(h)] == k) & (offset[: len(h)] == 0)  # items of k words
            if ok.any():
                self.seeds[k] = np.unique(h[ok])

    def _full_order(self) -> np.ndarray:
        """Suffixes in the order of all their words, by doubling the words that ranks tell apart."""
        rank, n, told = np.unique(self.suffixes, return_inverse=True)[1].astype(np.int64), len(self.left), self.depth
        while told < self.left.max():
            after = np.where(self.left > told, rank[np.minimum(np.arange(n) + told, n - 1)] + 1, 0)
            order = np.lexsort((after, rank))
            new = (np.diff(rank[order], prepend=-1) != 0) | (np.diff(after[order], prepend=-1) != 0)
            before = rank.max()
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if rank.max() == before:  # no suffixes were told apart, so none will be
                break
            told *= 2
        return np.argsort(rank, kind="stable")

    def match(self, text: bytes) -> int:
        """The most first words of text (codes in 4 bytes) that stand in an item."""
        code, size = memoryview(self.code).cast("B"), len(text)

        def suffix(i: int) -> bytes:
            return bytes(code[4 * i : 4 * i + min(4 * int(self.left[i]), size)])

        at = bisect_left(self.order, text, key=suffix)
        best = 0
        for i in self.order[max(0, at - 1) : at + 1]:
            own = np.frombuffer(suffix(i), ">u4")
            other = np.frombuffer(text, ">u4", len(own))
            unlike = np.flatnonzero(own != other)
            best = max(best, int(unlike[0]) if len(unlike) else len(own))
        return best


def _text(codes: np.ndarray) -> np.ndarray:
    """Rows of word codes as byte strings that sort like the rows; 0 ends a string."""
    return np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * codes.shape[1]}").ravel()


@dataclass
class Found:
    n_words: np.ndarray
    hit: np.ndarray
    begin: np.ndarray
    items: list[set[int]]
    longest: np.ndarray
    longest_at: np.ndarray


def search(s: textbuf.Slice, block: Block) -> Found:
    """Word hits, items and longest matches of each document of a slice."""
    w = textbuf.words(s, textbuf.ALNUM)
    counts = w.counts(s.n)
    begin = np.concatenate([[0], np.cumsum(counts)])
    end = begin[1:][w.doc] if w.n else np.zeros(0, np.int64)
    out = Found(counts, np.zeros(w.n, bool), begin, [set() for _ in range(s.n)], np.zeros(s.n, np.int64), np.full(s.n, -1, np.int64))
    if not w.n or not len(block.words):
        return out
    start = np.zeros(w.n, bool)
    for k, seeds in block.seeds.items():
        h = textbuf.gram_hash(w.hash, k)
        at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
        start[: len(h)] |= (seeds[at] == h) & (np.arange(len(h)) + k <= end[: len(h)])
    pos = np.flatnonzero(start)
    if not len(pos):
        return out
    # the suffix array of the slice
    steps = np.arange(block.depth)
    place = pos[:, None] + steps
    inside = place < end[pos][:, None]
    h = w.hash[np.minimum(place, w.n - 1)]
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    codes = np.where(inside & (block.vocabulary[at] == h), at + 1, 0)
    codes[np.cumsum(codes == 0, axis=1) > 0] = 0  # no benchmark word, no match beyond
    text = _text(codes)
    order = np.argsort(text, kind="stable")
    suffixes, pos, codes = text[order], pos[order], codes[order]
    # binary search of each benchmark suffix: where its window's words begin and end in the array
    size = 4 * block.depth
    low = np.searchsorted(suffixes, block.windows, "left")
    upper = block.windows.astype(f"S{size + 1}")
    flat = upper.view(np.uint8).reshape(len(upper), size + 1)
    for i in range(4):
        column = np.minimum(4 * block.window_size + i, size)
        flat[np.arange(len(flat)), column] = 255
    high = np.searchsorted(suffixes.astype(f"S{size + 1}"), upper, "right")
    delta = np.zeros(w.n + 1, np.int64)
    for k in np.flatnonzero(high > low):
        p = pos[low[k] : high[k]]
        np.add.at(delta, p, 1)
        np.add.at(delta, p + block.window_size[k], -1)
        own = block.window_item[block.window_begin[k] : block.window_begin[k + 1]].tolist()
        for d in np.unique(w.doc[p]):
            out.items[d].update(own)
    out.hit = np.cumsum(delta[:-1]) > 0
    # longest verbatim match of a position: with a neighbour among the sorted benchmark suffixes
    ordered = block.suffixes[block.order]
    right = np.searchsorted(ordered, suffixes)
    best = np.zeros(len(pos), np.int64)
    for near in (right - 1, right):
        ok = (near >= 0) & (near < len(ordered))
        other = ordered[np.clip(near, 0, len(ordered) - 1)].view(np.uint8).reshape(len(pos), size).view(">u4")
        same = np.cumprod((other == codes) & (codes > 0), axis=1).sum(1)
        best = np.maximum(best, np.where(ok, same, 0))
    for i in np.lexsort((pos, -best))[::-1]:
        d = w.doc[pos[i]]
        out.longest[d], out.longest_at[d] = best[i], pos[i] - begin[d]
    if block.deep:
        _follow(out, block, w.doc, pos, codes, best)
    return out


def _follow(out: Found, block: Block, doc: np.ndarray, pos: np.ndarray, codes: np.ndarray, best: np.ndarray) -> None:
    """The longest matches of documents where some reach the depth of the array.

    Such positions stand in runs, one for each verbatim match or several that
    overlap.  No match goes beyond the words of its run, so positions that have
    too few of them left need no search.
    """
    full = np.flatnonzero(best == block.depth)
    full = full[np.argsort(pos[full])]
    p = pos[full]
    # a run ends where the next position is not full or belongs to another document
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(doc[p]) != 0)) + 1
    for run in np.split(full, cut) if len(full) else []:
        d = doc[pos[run[0]]]
        words = np.concatenate([codes[run, 0], codes[run[-1], 1:]]).astype(">u4").tobytes()
        n, i = len(words) // 4, 0
        while n - i > out.longest[d]:
            if (size := block.match(words[4 * i :])) > out.longest[d]:
                out.longest[d], out.longest_at[d] = size, pos[run[i]] - out.begin[d]
            i += 1


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of whole items, of block_words words unless one item is longer. Items without words are left out."""

    def make():
        def run(batch: pa.RecordBatch):
            hashes, offsets = [], [0]
            for s in textbuf.slices(batch.column("text")):
                w = textbuf.words(s, textbuf.ALNUM)
                hashes.append(w.hash)
                offsets += (offsets[-1] + np.cumsum(w.counts(s.n))).tolist()
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column("item"), words], ["item", "words"])

        return run

    rows = map_batches(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null"), make, "item string, words array<long>")
    items: list[str] = []
    words: list[np.ndarray] = []
    total = 0

    def block() -> Block:
        return Block([*items], np.concatenate(words), np.concatenate([[0], np.cumsum([len(x) for x in words])]))

    for r in rows.toLocalIterator():
        own = np.array(r["words"], np.int64).view(np.uint64)
        if not len(own):
            continue
        if total and total + len(own) > block_words:
            yield block()
            items, words, total = [], [], 0
        items.append(r["item"])
        words.append(own)
        total += len(own)
    if items:
        yield block()


def _merged(a: list, b: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [tuple(x) for x in out]


def matches(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, columns: list[str] | None = None) -> DataFrame:
    """Every row of docs (columns, else doc_id) with n_words, hits, items, longest and longest_at.

    hits are merged half-open ranges of hit words, items the sorted ids whose
    windows occur, longest the longest verbatim match in words, of any length, and
    longest_at the first word it begins at, -1 without any.  Matches of fewer than
    SEED_WORDS words are not told, unless they are whole items.  Items without an
    id mark hits and matches, and only the id is left out of items.  Null and
    empty texts have no words; an empty benchmark hits nothing.  Repeated rows are searched each,
    and columns of docs may have any other names.
    """
    names = columns or ["doc_id"]
    spark = docs.sparkSession
    row = docs.select(F.struct(*names).alias("row"), "text").select("row", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("longest"), F.lit(-1).cast("long").alias("longest_at"))
    found = False
    for block in item_blocks(benchmark, block_words):
        found = True
        row = map_batches(row, _pass(spark.sparkContext.broadcast(block)), row.schema)
    if not found:
        row = map_batches(row, _pass(spark.sparkContext.broadcast(Block([], np.zeros(0, np.uint64), np.zeros(1, np.int64)))), row.schema)
    return row


def _pass(block_b):
    def make():
        def run(batch: pa.RecordBatch):
            block, out = block_b.value, {k: batch.column(k).to_pylist() for k in ("n_words", "hits", "items", "longest", "longest_at")}
            for s in textbuf.slices(batch.column("text")):
                f = search(s, block)
                out["n_words"][s.row : s.row + s.n] = f.n_words.tolist()
                for d in np.flatnonzero(f.longest > 0):
                    if (f.longest[d], -f.longest_at[d]) > (out["longest"][s.row + d], -out["longest_at"][s.row + d]):
                        out["longest"][s.row + d], out["longest_at"][s.row + d] = int(f.longest[d]), int(f.longest_at[d])
                    if not f.items[d]:
                        continue
                    own = np.flatnonzero(np.diff(f.hit[f.begin[d] : f.begin[d + 1]].astype(np.int8), prepend=0, append=0))
                    ranges = list(zip(own[::2].tolist(), own[1::2].tolist(), strict=True))
                    out["hits"][s.row + d] = _merged([(x["a"], x["b"]) for x in out["hits"][s.row + d]], ranges)
                    out["items"][s.row + d] = sorted({*out["items"][s.row + d], *(x for i in f.items[d] if (x := block.items[i]) is not None)})
            hits = pa.array([[{"a": x[0], "b": x[1]} if isinstance(x, tuple) else x for x in r] for r in out["hits"]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            cols = [batch.column("row"), batch.column("text"), pa.array(out["n_words"], pa.int64()), hits, pa.array(out["items"], pa.list_(pa.string())), pa.array(out["longest"], pa.int64()), pa.array(out["longest_at"], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["row", "text", "n_words", "hits", "items", "longest", "longest_at"])

        return run

    return make


def report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match, of every row."""
    m = matches(docs, benchmark, block_words)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda t, x: t + (x["b"] - x["a"]))
    return m.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("longest").alias("longest_match"), F.col("longest_at").alias("longest_at"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that no benchmark window occurs in."""
    m = matches(docs, benchmark, block_words, docs.columns).filter("size(hits) = 0")
    return m.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
