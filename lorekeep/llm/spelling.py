"""Spelling variants: words one edit apart, found by automata in a trie of the vocabulary.

The vocabulary is a table of distinct words and counts.  Its sorted words are cut
into shards, each a trie that is compact: a branch that leads to one word ends
there, and the rest of the word is its tail.  Shards are broadcast a bounded
number of bytes at a time.  Every word's Levenshtein automaton of distance one
runs through every shard depth first.  After d characters of a path it can only
be in places d - 1, d and d + 1 of the word, so its state is four bits and its
moves are one table for all words; a branch whose state is empty is left.

Each word then keeps its number of neighbours and the best one, and forms are
followed to their root by doubling steps, as a form's count is at least a
multiple of its word's, so ways are short and have no circles.

Cost is words times shards, where a shard that a word has no neighbour in is
left after a few characters.  Memory of a task: one pass of shards and a batch
of words.  Null texts hold no words, an empty table has no rows; a text of any
length is cut into words in the JVM, and a word of any length is one row.
Columns other than the id and the text are not read.  A run in a row without an
id keeps its characters, as there is no key to choose one by.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, stored
from .session import map_batches

#: A shard holds at most so many words and characters (a longer word is a shard of its own), a broadcast at most so many bytes.
SHARD_WORDS, SHARD_CHARS, PASS_BYTES = 100_000, 2_000_000, 32 << 20
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (word, node) pairs that are moved at once.
BLOCK = 1 << 16
#: Bits of a state after d characters: place d without an error; places d - 1, d and d + 1 with one.
EXACT, BEHIND, LEVEL, AHEAD = 1, 2, 4, 8


def _moves() -> np.ndarray:
    """moves[state, match]: bits of match tell whether the character is that of places d - 1, d and d + 1."""
    out = np.zeros((16, 8), np.int8)
    for s in range(16):
        for match in range(8):
            exact = s & EXACT and match & 2
            behind, level, ahead = s & BEHIND and match & 1, s & LEVEL and match & 2, s & AHEAD and match & 4
            wrong = s & EXACT  # the character is inserted (the place stays) or replaces one (it moves on)
            out[s, match] = bool(exact) * (EXACT | AHEAD) | bool(behind or wrong) * BEHIND | bool(level or wrong) * LEVEL | bool(ahead) * AHEAD
    return out


MOVES = _moves()


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words one after another, and where each begins (one more: the end)."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32), np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)


def char_at(text: tuple[np.ndarray, np.ndarray], i: np.ndarray, place: int) -> np.ndarray:
    """Code points at a place of words i, -1 outside of them."""
    flat, begin = text
    at = begin[i] + place
    inside = (at < begin[i + 1]) & (place >= 0)
    return np.where(inside, flat[np.where(inside, at, 0)], -1) if len(flat) else np.full(len(i), -1)


@dataclass
class Shard:
    """A trie in level order: edges of node i are first[i]..first[i+1], edge e leads to node e + 1; word: index of the word at a node or -1."""

    labels: np.ndarray
    first: np.ndarray
    word: np.ndarray
    words: list[str]
    counts: np.ndarray

    @property
    def size(self) -> int:
        """Bytes in a worker."""
        return 4 * (len(self.labels) + len(self.first) + len(self.word)) + 80 * len(self.words) + 2 * sum(map(len, self.words))


def build(words: list[str], counts: list[int]) -> Shard:
    """The trie of sorted distinct words."""
    labels, first, word = array("i"), array("i"), array("i")
    level = [(0, len(words), 0)]
    while level:
        below = []
        for lo, hi, d in level:
            first.append(len(labels))
            if hi - lo <= 1:
                word.append(lo if hi > lo else -1)
                continue
            ends = len(words[lo]) == d
            word.append(lo if ends else -1)
            lo += ends
            while lo < hi:
                c = words[lo][d]
                to = bisect_left(words, words[lo][:d] + chr(ord(c) + 1), lo, hi) if ord(c) < 0x10FFFF else hi
                labels.append(ord(c))
                below.append((lo, to, d + 1))
                lo = to
        level = below
    first.append(len(labels))
    return Shard(*(np.array(x, np.int32) for x in (labels, first, word)), words, np.array(counts, np.int64))


def within_one(a: str, b: str) -> bool:
    """Whether one edit or none leads from a to b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the common prefix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return a[lo + 1 :] == b[lo + 1 :] or a[lo:] == b[lo + 1 :] or a[lo + 1 :] == b[lo:]


def neighbours(batch: list[str], shard: Shard) -> list[tuple[int, int]]:
    """(index in batch, index in the shard) of all pairs at distance one, each once.

    The stack holds blocks of (word, node, state) at one depth; the one pushed
    last is moved first, so it holds some blocks a level, however many words.
    """
    own, other = codes(batch), codes(shard.words)
    n, m = np.diff(own[1]), np.diff(other[1])
    edge_key = np.repeat(np.arange(len(shard.word), dtype=np.int64), np.diff(shard.first)) << 21 | shard.labels
    found = []
    stack = [(0, np.arange(len(batch)), np.zeros(len(batch), np.int64), np.where(n > 0, EXACT | AHEAD, EXACT).astype(np.int8))]
    while stack:
        d, w, node, s = stack.pop()
        if len(w) > BLOCK:
            half = len(w) // 2
            stack += [(d, w[:half], node[:half], s[:half]), (d, w[half:], node[half:], s[half:])]
            continue
        a, b, c = (char_at(own, w, d + i) for i in (-1, 0, 1))
        k = shard.word[node]
        if (ends := np.flatnonzero(k >= 0)).size:
            i, j, t = w[ends], k[ends], s[ends]
            x, more = char_at(other, j, d), n[i] - m[j]  # the tail's first character; -1, as that of the word's end, if it is empty
            ok = (t & EXACT > 0) & (abs(more) <= 1)
            for bit, y, longer in ((BEHIND, a, -1), (LEVEL, b, 0), (AHEAD, c, 1)):
                ok |= (t & bit > 0) & (more == longer) & (x == y[ends])
            found += [(p, q) for p, q in zip(i[ok].tolist(), j[ok].tolist(), strict=True) if batch[p] != shard.words[q] and within_one(batch[p], shard.words[q])]
        size = shard.first[node + 1] - shard.first[node]
        parts = []

        def go(at: np.ndarray, e: np.ndarray) -> None:
            x = shard.labels[e]
            to = MOVES[s[at], (x == a[at]) | (x == b[at]) << 1 | (x == c[at]) << 2]  # noqa: B023  called at once
            live = to > 0
            parts.append((w[at[live]], e[live].astype(np.int64) + 1, to[live]))  # noqa: B023

        if (exact := np.flatnonzero((s & EXACT > 0) & (size > 0))).size:  # any character can be the wrong one
            at = np.repeat(exact, size[exact])
            go(at, np.arange(len(at)) - np.repeat(np.cumsum(size[exact]) - size[exact], size[exact]) + np.repeat(shard.first[node[exact]], size[exact]))
        wrong = (s & EXACT == 0) & (size > 0)
        taken = []
        for bit, x in ((BEHIND, a), (LEVEL, b), (AHEAD, c)):  # only characters of the word can go on
            want = wrong & (s & bit > 0) & (x >= 0)
            for before, y in taken:
                want &= ~(before & (x == y))
            taken.append((want, x))
            at = np.flatnonzero(want)
            key = node[at] << 21 | x[at]
            e = np.searchsorted(edge_key, key)
            there = edge_key[np.minimum(e, len(edge_key) - 1)] == key if len(edge_key) else np.zeros(len(at), bool)
            go(at[there], e[there])
        below = [np.concatenate(p) for p in zip(*parts, strict=True)]
        if len(below[0]):
            stack.append((d + 1, *below))
    return found


def lowered(run: Column) -> Column:
    """A-Z in lower case, and no other character changed."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, slip: int | None = 97, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of runs of letters with A-Z in lower case, of min_length characters or more and n >= min_count.

    slip: where it divides the crc32 of `<id>:<run>`, the run loses the character
    at that crc32 modulo its length, so a table without misspellings gets some.
    """
    run = F.col("run")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    rows = rows.select("id", lowered(run).alias("run"))
    if slip:
        h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        rows = rows.select(F.when(h % slip == 0, cut).otherwise(run).alias("run"))
    words = rows.filter(F.length("run") >= min_length).groupBy(run.alias("word")).agg(F.count("*").alias("n"))
    return words.filter(F.col("n") >= min_count)


def shards(words: DataFrame) -> DataFrame:
    """(size, labels, first, word, words, counts): a shard of the sorted words of (word, n) in each row."""
    names = ["size", "labels", "first", "word", "words", "counts"]

    def packed(words: list[str], counts: list[int]) -> pa.RecordBatch:
        s = build(words, counts)
        blobs = [pa.array([a.tobytes()]) for a in (s.labels, s.first, s.word)]
        return pa.RecordBatch.from_arrays([pa.array([s.size], pa.int64()), *blobs, pa.array([words]), pa.array([counts])], names)

    def cut(batches):
        words, counts, chars = [], [], 0
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words and (len(words) == SHARD_WORDS or chars + len(w) > SHARD_CHARS):
                    yield packed(words, counts)
                    words, counts, chars = [], [], 0
                words.append(w)
                counts.append(n)
                chars += len(w)
        if words:
            yield packed(words, counts)

    parts = max(1, -(-words.count() // SHARD_WORDS))
    runs = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return runs.mapInArrow(cut, "size long, labels binary, first binary, word binary, words array<string>, counts array<long>")


def passes(table: DataFrame) -> Iterator[list[Shard]]:
    """The shards of (word, n), in lists of PASS_BYTES at most (one shard at least)."""
    cut, held, size = stored(shards(table), "spelling-shards"), [], 0
    for row in cut.toLocalIterator():  # a shard at a time
        if held and size + row["size"] > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append(Shard(*(np.frombuffer(row[c], np.int32) for c in ("labels", "first", "word")), row["words"], np.array(row["counts"], np.int64)))
        size += row["size"]
    if held:
        yield held
    drop_stored(cut)


def near_words(words: DataFrame, block: Broadcast) -> DataFrame:
    """(word, near, near_n): words of the shards of block at distance one of those of words."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = batch.column(0).to_pylist()
            found = [(words[i], shard.words[k], int(shard.counts[k])) for shard in block.value for i, k in neighbours(words, shard)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

        return run

    return map_batches(words.select("word"), make, "word string, near string, near_n long")


def best_near(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, n_near, best) of words that have near ones in table (word, n); best: (-n, word) of that of largest n."""
    spark, out = words.sparkSession, None
    dealt = words.repartition(4 * spark.sparkContext.defaultParallelism, "word")
    for block in passes(table):
        block = spark.sparkContext.broadcast(block)
        near = near_words(dealt, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
        part = stored(near, "spelling-near")
        block.destroy()
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "word string, n_near long, best struct<m:long,near:string>")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of forms (word, form): the end of the way word, form, form of the form and so on."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then, now = now, stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_stored(then)
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of words (word, n), distinct ones.

    The form is the near word of largest n, ties to the first in the order of code
    points, if its n is at least ratio times the word's; root is where forms lead.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    best = best_near(words.select("word"), words)
    fits = -F.col("best.m") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    rows = stored(rows, "spelling-forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
