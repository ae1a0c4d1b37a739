"""Language-model scoring: prediction by partial matching over bytes.

A text is scored as its lower-cased words joined by single spaces, then an end
symbol.  A trie holds, for each context of up to ORDER bytes, how often each byte
followed it in training.  A byte is predicted in its longest known context; where
it never followed, the model escapes to the next shorter one with probability
q / (N + q) (q different bytes among N), and bytes that followed the longer
context are excluded from the counts of the shorter one.  After order 0 the bytes
never seen are equally likely.

Counts of the longest contexts are gathered from all training documents by one
aggregation; shorter ones are their sums.  They are looked up in segments of at
most MAX_TRIE entries, chosen by the last two bytes of the context so that a
segment answers its positions alone; word counts of the base score likewise in
segments of at most MAX_WORDS.  A pass over the documents takes one segment of
each; with one segment each, as here, there is one pass.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import textbuf
from .session import fold, map_batches

ORDER = 5
END, START = 0xFF, 0xFE  # never bytes of UTF-8
MAX_TRIE = 4_000_000
MAX_WORDS = 6_000_000
#: Distinct codes that a counting task holds before it hands them on.
FLUSH = 1_500_000


def stream(s: textbuf.Slice, w: textbuf.Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes with order START bytes before each document, the predicted positions, and their documents."""
    count = w.counts(s.n)
    size = w.end - w.start
    parts = count + (count == 0)  # words, or the end alone
    pieces = np.bincount(w.doc, weights=size, minlength=s.n).astype(np.int64) + parts
    begin = np.concatenate([[0], np.cumsum(pieces + order)])
    out = np.full(begin[-1], START, np.uint8)
    is_text = np.ones(begin[-1], bool)
    is_text[(begin[:-1][:, None] + np.arange(order)).ravel()] = False
    at = np.flatnonzero(is_text)
    doc = np.repeat(np.arange(s.n), pieces)
    # behind each word stands a space, behind the last of a document the end
    text = np.full(len(at), 0x20, np.uint8)
    if w.n:
        first = np.concatenate([[0], np.cumsum(pieces)[:-1]])[w.doc]
        inside = np.cumsum(size + 1) - (size + 1)
        doc_first = np.concatenate([[0], np.cumsum(count)[:-1]])
        where = first + inside - inside[np.minimum(doc_first[w.doc], w.n - 1)]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(where, size) + step] = textbuf.LOWER[s.data[np.repeat(w.start, size) + step]]
    text[np.cumsum(pieces) - 1] = END
    out[at] = text
    return out, at, doc


def codes(out: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Each predicted byte (lowest) with the order bytes before it."""
    c = out[at].astype(np.uint64)
    for j in range(1, order + 1):
        c |= out[at - j].astype(np.uint64) << np.uint64(8 * j)
    return c


def segment_of(code: np.ndarray, n: int) -> np.ndarray:
    """By the last two context bytes."""
    return (textbuf.mix((code >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(n)).astype(np.int64)


class Table:
    """Open-addressing map from 64-bit keys to row numbers."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.rows[at] < 0
            self.rows[at[free]] = todo[free]  # of several for one place the last stays
            self.keys[at[free]] = keys[todo[free]]
            lost = self.rows[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & int(self.mask)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 for unknown ones."""
        at = self._home(keys)
        out = self.rows[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & int(self.mask)
            out[wrong] = self.rows[at]
            more = (out[wrong] >= 0) & (self.keys[at] != keys[wrong])
            wrong, at = wrong[more], at[more]
        return out


@dataclass
class Level:
    """One order: entries (context and byte) with counts, contexts with totals."""

    entry: Table
    count: np.ndarray
    context: Table
    total: np.ndarray
    distinct: np.ndarray
    #: as seen from the next shorter order: its total and distinct bytes without those of this context
    rest_total: np.ndarray
    rest_distinct: np.ndarray


class Trie:
    """A pretrained model of the contexts in one segment."""

    def __init__(self, order: int, code: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> None:
        """code, n: counts of the longest contexts; low: the same for one byte of context, over all segments."""
        self.order, self.levels = order, []
        by_order = {1: low}
        for k in range(order, 1, -1):
            own = code & np.uint64((1 << 8 * (k + 1)) - 1) if k < 7 else code
            keys, back = np.unique(own, return_inverse=True)
            by_order[k] = keys, np.bincount(back, weights=n, minlength=len(keys)).astype(np.int64)
        keys, back = np.unique(low[0] & np.uint64(0xFF), return_inverse=True)
        by_order[0] = keys, np.bincount(back, weights=low[1], minlength=len(keys)).astype(np.int64)
        if order < 1:
            by_order = {0: by_order[0]}
        for k in range(order + 1):
            keys, count = by_order[k]
            ctx, back = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(back, weights=count, minlength=len(ctx)).astype(np.int64)
            distinct = np.bincount(back, minlength=len(ctx))
            rest_total, rest_distinct = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.int64)
            if k:
                below = self.levels[k - 1]
                shorter = keys & np.uint64((1 << 8 * k) - 1)
                known = below.count[below.entry.find(shorter)]
                parent = below.context.find(shorter >> np.uint64(8))
                of = np.zeros(len(ctx), np.int64)
                of[back] = parent
                rest_total = below.total[of] - np.bincount(back, weights=known, minlength=len(ctx)).astype(np.int64)
                rest_distinct = below.distinct[of] - distinct
            self.levels.append(Level(Table(keys), count, Table(ctx), total, distinct, rest_total, rest_distinct))
        if self.levels[-1].count.size:
            top = self.levels[-1]
            keys, count = by_order[order]
            row = top.context.find(keys >> np.uint64(8))
            self.top_log = np.log10((2 * count - 1) / (2 * top.total[row]))
        else:
            self.top_log = np.zeros(0)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's byte in its context."""
        out = np.zeros(len(code))
        if not len(self.top_log):
            return np.full(len(code), -math.log10(256))
        row = self.levels[-1].entry.find(code)
        hit = row >= 0
        out[hit] = self.top_log[row[hit]]
        live = np.flatnonzero(~hit)
        child = np.full(len(live), -1, np.int64)  # row of the longer context just escaped from
        for k in range(self.order, -1, -1):
            if not len(live):
                break
            level = self.levels[k]
            own = code[live] & np.uint64((1 << 8 * (k + 1)) - 1)
            ctx = level.context.find(own >> np.uint64(8))
            seen = ctx >= 0
            entry = np.where(seen, level.entry.find(own), -1)
            upper = self.levels[k + 1] if k < self.order else None
            after = child >= 0
            safe_c, safe_x = np.maximum(child, 0), np.maximum(ctx, 0)
            total = np.where(after, upper.rest_total[safe_c], level.total[safe_x]) if upper else level.total[safe_x]
            distinct = np.where(after, upper.rest_distinct[safe_c], level.distinct[safe_x]) if upper else level.distinct[safe_x]
            found = entry >= 0
            out[live[found]] += np.log10((2 * level.count[entry[found]] - 1) / (2 * total[found]))
            fall = seen & ~found & (distinct > 0)
            out[live[fall]] += np.log10(distinct[fall] / (2 * total[fall]))
            child = np.where(seen, ctx, -1)[~found]
            live = live[~found]
        if len(live):
            out[live] -= math.log10(max(1, 256 - int(self.levels[0].distinct.sum())))
        return out


class AdaptivePPM:
    """The same model in plain Python, updated as it reads: code length of single texts."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))

    def update(self, context: bytes, byte: int) -> None:
        for k in range(self.order + 1):
            self.counts[context[len(context) - k :]][byte] += 1

    def log10(self, context: bytes, byte: int) -> float:
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            known = self.counts.get(context[len(context) - k :])
            if not known:
                continue
            own = {b: n for b, n in known.items() if b not in excluded}
            total, distinct = sum(own.values()), len(own)
            if byte in own:
                return out + math.log10((2 * own[byte] - 1) / (2 * total))
            if distinct:
                out += math.log10(distinct / (2 * total))
            excluded |= set(known)
        return out - math.log10(max(1, 256 - len(excluded)))

    def read(self, text: str | None, learn: bool = True, score: bool = True) -> float:
        """log10 probability of the normalised text; learn: adapt on each byte after it was predicted."""
        s = textbuf.Slice(0, np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        out, at, _ = stream(s, textbuf.words(s, textbuf.NON_SPACE), self.order)
        data, total = out.tobytes(), 0.0
        for i in at:
            context = data[i - self.order : i]
            if score:
                total += self.log10(context, data[i])
            if learn:
                self.update(context, data[i])
        return total


def _counts(docs: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Counts over all rows of docs: (code, n) of the longest contexts, (hash, n) of words; their sums by key."""

    def run(batches):
        def handed(kind: int, parts: list):
            key = np.concatenate([p[0] for p in parts])
            uniq, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(uniq)).astype(np.int64)
            return uniq, n

        def rows(kind: int, held: tuple):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held[0]), kind, np.int32)), pa.array(held[0].view(np.int64)), pa.array(held[1])], ["kind", "key", "n"])

        held: dict[int, list] = {0: [], 1: []}
        for batch in batches:
            for s in textbuf.slices(batch.column("text")):
                w = textbuf.words(s, textbuf.NON_SPACE)
                out, at, _ = stream(s, w, order)
                for kind, key in ((0, codes(out, at, order)), (1, w.hash)):
                    held[kind].append(np.unique(key, return_counts=True))
                    if sum(len(x[0]) for x in held[kind]) > FLUSH:
                        held[kind] = [handed(kind, held[kind])]
                        if len(held[kind][0][0]) > FLUSH // 2:
                            yield rows(kind, held[kind].pop())
        for kind in held:
            if held[kind]:
                yield rows(kind, handed(kind, held[kind]))

    table = stored(docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm")
    return tuple(table.filter(F.col("kind") == k).select("key", "n") for k in (0, 1))


def _fetch(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("key", F.col("n").cast("long").alias("n")).toArrow()
    return t["key"].to_numpy().view(np.uint64), t["n"].to_numpy()


def score(docs: DataFrame, modulus: int = 10, held_out: int = 0, order: int = ORDER, max_trie: int = MAX_TRIE, max_words: int = MAX_WORDS) -> DataFrame:
    """Learn from the rows outside the held-out fold, then score all whole texts.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Null and empty texts are the end alone.  Without training rows every byte has
    probability 1/256 and base counts are 0.  Repeated rows count and are scored each.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select("doc_id", (fold("doc_id", modulus) == held_out).alias("held_out"), "text")
    train = rows.filter("not held_out")
    trie_counts, word_counts = _counts(train, order)
    ends = train.count()
    size = word_counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    v, total = size["v"] + (ends > 0), (size["n"] or 0) + ends
    n_trie = max(1, -(-trie_counts.count() // max_trie))
    n_words = max(1, -(-size["v"] // max_words))
    low_key = F.col("key").bitwiseAND(0xFFFF)
    low = _fetch(trie_counts.groupBy(low_key.alias("key")).agg(F.sum("n").alias("n")))  # 65,536 rows at most

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (total + 0.1 * (v + 1)))

    state = rows.select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    schema = state.schema
    n_passes = max(n_trie, n_words)
    for k in range(n_passes):
        trie = words = None
        if k < n_trie:
            part = trie_counts
            if n_trie > 1:  # the segment of the last two context bytes, over their 65,536 values
                pairs = np.arange(1 << 16, dtype=np.uint64)
                own = pairs[segment_of(pairs << np.uint64(8), n_trie) == k].astype(np.int64)
                pair = F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF)
                part = part.join(F.broadcast(spark.createDataFrame([(int(x),) for x in own], "pair long")), pair == F.col("pair"), "left_semi")
            trie = sc.broadcast(Trie(order, *_fetch(part), low))  # at most MAX_TRIE entries
        if k < n_words:
            part = word_counts if n_words == 1 else word_counts.filter(F.pmod(F.col("key"), F.lit(n_words)) == k)
            key, n = _fetch(part)
            by = np.argsort(key)
            words = sc.broadcast((key[by], n[by].astype(np.uint32)))  # at most about MAX_WORDS words
        state = map_batches(state, _pass(k, n_trie, n_words, trie, words, order, base, ends), schema)
        if k + 1 < n_passes:
            state = stored(state, "lm-scores")
    return state.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _pass(k: int, n_trie: int, n_words: int, trie_b, words_b, order: int, base, ends: int):
    def make():
        def run(batch: pa.RecordBatch):
            tokens, known, low, high = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("n_tokens", "n_known", "base_score", "score"))
            for s in textbuf.slices(batch.column("text")):
                w = textbuf.words(s, textbuf.NON_SPACE)
                own = slice(s.row, s.row + s.n)
                if words_b is not None:
                    keys, counts = words_b.value
                    uniq, back = np.unique(w.hash, return_inverse=True)
                    at = np.minimum(np.searchsorted(keys, uniq), max(0, len(keys) - 1))
                    c = np.where(keys[at] == uniq, counts[at], 0) if len(keys) else np.zeros(len(uniq))
                    mine = (uniq.view(np.int64) % n_words == k)[back]
                    low[own] += np.bincount(w.doc, weights=np.where(mine, base(c)[back], 0), minlength=s.n)
                    known[own] += np.bincount(w.doc, weights=mine & (c > 0)[back], minlength=s.n).astype(np.int64)
                    if k == 0:
                        tokens[own] = w.counts(s.n) + 1
                        low[own] += base(np.array(ends))
                        known[own] += ends > 0
                if trie_b is not None:
                    out, at, doc = stream(s, w, order)
                    c = codes(out, at, order)
                    if n_trie > 1:
                        mine = segment_of(c, n_trie) == k
                        c, doc = c[mine], doc[mine]
                    high[own] += np.bincount(doc, weights=trie_b.value.log10(c), minlength=s.n)
            cols = [batch.column(c) for c in ("doc_id", "held_out", "text")]
            return pa.RecordBatch.from_arrays([*cols, pa.array(tokens), pa.array(known), pa.array(low), pa.array(high)], ["doc_id", "held_out", "text", "n_tokens", "n_known", "base_score", "score"])

        return run

    return make
