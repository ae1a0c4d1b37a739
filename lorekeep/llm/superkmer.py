"""Removal of repeated passages by super-k-mers of words.

A window is so many consecutive words of a document.  Its minimiser is the least
hash of its short word grams, so neighbouring windows often share it; such a run
of windows travels as one packed string, the words of all of them once, to the
bucket of the minimiser.  Equal windows have equal minimisers and meet there.
A bucket numbers the words of its strings, sorts the windows and compares the
numbers of those that stand side by side, so windows are told apart exactly; it
answers with the least id that each repeated window occurs in.

Documents are cut in units of some megabytes.  A string is sent once by a unit,
with the least and the largest id it occurs in, however many copies there are;
the places in the documents go along as a packed list that the bucket hands back
unread together with its answers.  So no key is hotter than the number of units,
and a unit works out by itself which words of its documents go.

A first pass adds up how many bytes each of `bins` hashes of minimisers will get;
bins under bucket_bytes are joined to buckets of about that size, and the
strings of larger ones are cut into single windows, which spread evenly over as
many buckets as it takes.  Memory: a unit with its strings, or the distinct
strings of a bucket.  A document is never cut, so one of 100 MB makes a unit of
about 300 MB of strings, and needs several times that (largest tested: 200,000
words).

Null and empty texts hold no words.  Rows without an id neither lose words nor
make others lose them.  Rows of one id don't remove each other's words, nor do
windows within one row.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import textbuf
from .session import bounded_batches, map_batches

_U64 = np.uint64


@dataclass(frozen=True)
class Rule:
    """Windows of so many words, whose minimisers are grams of so many; and the sizes that work is cut to."""

    window: int = 13
    gram: int = 2
    #: Windows that a packed string holds at most.
    run: int = 32
    bins: int = 1 << 16
    bucket_bytes: int = 24 << 20
    unit_bytes: int = 8 << 20


@dataclass(frozen=True)
class Deal:
    """bucket of each bin, and over how many buckets its windows are spread: 1 if they stay together."""

    bucket: np.ndarray
    ways: np.ndarray


def pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = np.array([len(body), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return head + pa.Codec("zstd", compression_level=6).compress(body, asbytes=True)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, len(kinds) + 1)
    body = pa.decompress(blob[head.nbytes :], decompressed_size=int(head[0]), codec="zstd", asbytes=True)
    ends = np.cumsum(head[1:])
    return [np.frombuffer(body[e - n : e], k) for k, n, e in zip(kinds, head[1:], ends, strict=True)]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then start[1] and so on."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binaries one after another, and where each begins (one more: the end)."""
    _, offs, data = a.buffers()
    offsets = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    n = max(len(x) - width + 1, 0)
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[:n], x[width - have : width - have + n])


@dataclass
class Runs:
    """Runs of windows with one minimiser in a slice: first word, number of words, document of the slice, minimiser."""

    first: np.ndarray
    words: np.ndarray
    doc: np.ndarray
    key: np.ndarray


def runs_of(w: textbuf.Words, rule: Rule) -> Runs:
    k = rule.window
    if w.n < k:
        return Runs(*[np.zeros(0, np.int64)] * 3, np.zeros(0, _U64))
    at = np.flatnonzero(w.doc[: w.n - k + 1] == w.doc[k - 1 :])
    least = sliding_min(textbuf.gram_hash(w.hash, rule.gram), k - rule.gram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])
    i = np.arange(len(at))
    begun = np.maximum.accumulate(np.where(new, i, 0))
    new |= (i - begun) % rule.run == 0
    s = np.flatnonzero(new)
    n = np.diff(np.append(s, len(at)))
    return Runs(at[s], n + k - 1, w.doc[at[s]], least[s])


def bins(key: np.ndarray, rule: Rule) -> np.ndarray:
    return (textbuf.mix(key) % _U64(rule.bins)).astype(np.int64)


def loads(docs: DataFrame, rule: Rule) -> DataFrame:
    """(bin, bytes): what the strings of each bin will hold, before copies are put together."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            total = np.zeros(rule.bins, np.int64)
            for s in textbuf.slices(batch.column("text")):
                w = textbuf.words(s, textbuf.NON_SPACE, lower=False)
                r = runs_of(w, rule)
                size = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
                total += np.bincount(bins(r.key, rule), size[r.first + r.words] - size[r.first], minlength=rule.bins).astype(np.int64)
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bin", "bytes"])

        return run

    return map_batches(docs.select("text"), make, "bin int, bytes long").groupBy("bin").agg(F.sum("bytes").alias("bytes"))


def deal(docs: DataFrame, rule: Rule, least: int) -> Deal:
    """Buckets of about bucket_bytes, at least so many, from the loads of all bins."""
    load, limit = np.zeros(rule.bins, np.int64), rule.bucket_bytes
    for r in loads(docs, rule).toLocalIterator():  # a row a bin at most
        load[r["bin"]] = r["bytes"]
    target = max(1, min(limit, int(load.sum()) // least))
    ways = np.where(load > max(4 * target, limit), -(-2 * load // limit), 1)
    share = np.where(ways > 1, 0, load)
    together = (np.cumsum(share) - share) // target
    alone = together.max() + 1 + np.cumsum(np.where(ways > 1, ways, 0)) - ways
    return Deal(np.where(ways > 1, alone, together), ways)


class Unit:
    """Documents cut together, and their strings."""

    def __init__(self, rule: Rule, dealt: Deal):
        self.rule, self.dealt = rule, dealt
        self.text = self.n_words = 0
        self.ids, self.keys, self.words = [], [], []
        self.data, self.size, self.bucket, self.doc, self.first = [], [], [], [], []

    def add(self, s: textbuf.Slice, ids: np.ndarray, keys: list[bytes]) -> None:
        w = textbuf.words(s, textbuf.NON_SPACE, lower=False)
        r = runs_of(w, self.rule)
        bin_ = bins(r.key, self.rule)
        bucket = self.dealt.bucket[bin_]
        k, ways = self.rule.window, self.dealt.ways[bin_]
        if (split := ways > 1).any():  # these go window by window
            n = r.words[split] - k + 1
            at = ranges(r.first[split], n)
            h = textbuf.gram_hash(w.hash, k)[at]
            spread = np.repeat(bucket[split], n) + (textbuf.mix(h) % np.repeat(ways[split], n).astype(_U64)).astype(np.int64)
            r = Runs(np.append(r.first[~split], at), np.append(r.words[~split], np.full(len(at), k)), np.append(r.doc[~split], np.repeat(r.doc[split], n)), r.key)
            bucket = np.append(bucket[~split], spread)
        length = w.end - w.start + 1
        plain = np.append(s.data, np.uint8(32))[ranges(w.start, length)]  # words, each with a space behind it
        ends = np.cumsum(length)
        plain[ends - 1] = 32
        begin = np.concatenate([[0], ends])
        size = begin[r.first + r.words] - begin[r.first]
        self.data.append(plain[ranges(begin[r.first], size)])
        self.size.append(size)
        self.bucket.append(bucket)
        self.doc.append(r.doc + len(self.ids))
        self.first.append(r.first + self.n_words)
        self.ids += ids.tolist()
        self.keys += keys
        self.words += w.counts(s.n).tolist()
        self.n_words += w.n
        self.text += len(s.data)

    def rows(self, number: int) -> Iterator[tuple]:
        """The unit's documents, then a row for each bucket with its distinct strings and their places."""
        ids = np.array(self.ids, np.int64)
        yield (number, 0, -1 - number, None, pack(ids, np.frombuffer(b"".join(self.keys), np.uint8), np.array(self.words, np.int64)))
        bucket, doc, first = (np.concatenate(x) for x in (self.bucket, self.doc, self.first))
        if not len(bucket):
            return
        coded = strings(np.concatenate(self.data), np.concatenate(self.size)).dictionary_encode()
        code = coded.indices.to_numpy()
        of = np.zeros(len(coded.dictionary), np.int64)
        of[code] = bucket
        order = np.argsort(of, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[code]
        by = np.argsort(code, kind="stable")
        doc, first, n = doc[by], first[by], np.bincount(code, minlength=len(order))
        head = np.cumsum(n) - n
        low, high = np.minimum.reduceat(ids[doc], head), np.maximum.reduceat(ids[doc], head)
        data, begin = bytes_of(coded.dictionary.take(pa.array(order)))
        of = of[order]
        cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        tail = np.append(head, len(doc))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            p, q = tail[i], tail[j]
            sent = pack(data[begin[i] : begin[j]], np.diff(begin[i : j + 1]).astype(np.int32), low[i:j], high[i:j] - low[i:j])
            yield (number, 1, int(of[i]), sent, pack(n[i:j].astype(np.int32), doc[p:q].astype(np.int32), first[p:q].astype(np.int64)))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


CUT = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("strings", pa.binary()), ("places", pa.binary())])


def cut(docs: DataFrame, rule: Rule, dealt: Deal) -> DataFrame:
    """(unit, kind, bucket, strings, places) of docs (id, key, text) without null ids."""
    held = docs.sparkSession.sparkContext.broadcast(dealt)  # two numbers a bin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, part, number = None, None, 0
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("key").to_pylist()
            for s in textbuf.slices(batch.column("text")):
                if unit is None:
                    unit, part = Unit(rule, held.value), part if part is not None else batch.column("part")[0].as_py()
                unit.add(s, ids[s.row : s.row + s.n], keys[s.row : s.row + s.n])
                if unit.text >= rule.unit_bytes:
                    yield from told(unit, part << 32 | number)
                    unit, number = None, number + 1
        if unit is not None:
            yield from told(unit, part << 32 | number)

    def told(unit: Unit, number: int) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r in unit.rows(number):
            rows.append(r)
            size += len(r[3] or b"") + len(r[4])
            if size > 1 << 20:
                yield as_batch(rows, CUT)
                rows, size = [], 0
        if rows:
            yield as_batch(rows, CUT)

    bounded_batches(docs.sparkSession)
    return docs.withColumn("part", F.spark_partition_id()).mapInArrow(run, "unit long, kind int, bucket long, strings binary, places binary")


class Bucket:
    """Distinct strings of a bucket; code: for each row of a unit, which of them it sent."""

    def __init__(self, number: int, rule: Rule):
        self.number, self.rule, self.known, self.low, self.high = number, rule, None, None, None
        self.rows, self.code, self.top, self.new, self.size = [], [], [], [], 0

    def add(self, unit: int, sent: bytes, places: bytes) -> None:
        data, size, low, more = unpack(sent, np.uint8, np.int32, np.int64, np.int64)
        self.rows.append((unit, places))
        self.top.append(low + more)
        self.new.append((data, size, low, low + more))
        self.size += len(data)
        if self.size > self.rule.bucket_bytes:
            self.settle()

    def settle(self) -> None:
        """Put equal strings together; known ones keep their codes."""
        if not self.new:
            return
        data, size, low, high = (np.concatenate(x) for x in zip(*self.new, strict=True))
        rows = [len(x[1]) for x in self.new]
        self.new, self.size = [], 0
        fresh = strings(data, size.astype(np.int64))
        if self.known is not None:
            fresh = pa.concat_arrays([self.known, fresh])
            low, high = np.append(self.low, low), np.append(self.high, high)
        coded = fresh.dictionary_encode()
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        by = np.argsort(code, kind="stable")
        head = np.searchsorted(code[by], np.arange(n))
        at = len(code) - sum(rows)
        self.code += np.split(code[at:].astype(np.int32), np.cumsum(rows)[:-1])
        self.known, self.low, self.high = coded.dictionary, np.minimum.reduceat(low[by], head), np.maximum.reduceat(high[by], head)

    def answers(self) -> Iterator[tuple]:
        """(unit, places, answer) of rows with a window that also occurs in a smaller id than the row's largest."""
        self.settle()
        k = self.rule.window
        data, begin = bytes_of(self.known)
        stop = np.flatnonzero(data == 32) + 1
        word = strings(data, np.diff(stop, prepend=0)).dictionary_encode().indices.to_numpy()
        n = np.searchsorted(stop, begin[1:], "right") - np.searchsorted(stop, begin[:-1], "right")
        windows = n - k + 1
        start, of = ranges(np.cumsum(n) - n, windows), np.repeat(np.arange(len(n)), windows)
        by, same = sorted_windows(word, start, k)
        head = np.flatnonzero(~same)
        low, high = np.minimum.reduceat(self.low[of[by]], head), np.maximum.reduceat(self.high[of[by]], head)
        least = np.empty(len(by), np.int64)
        least[by] = np.repeat(np.where(low < high, low, np.iinfo(np.int64).max), np.diff(np.append(head, len(by))))
        first = np.cumsum(windows) - windows
        some = np.minimum.reduceat(least, first)
        for (unit, places), code, top in zip(self.rows, self.code, self.top, strict=True):
            hit = np.flatnonzero(some[code] < top)
            if len(hit):
                c = code[hit]
                i, at = np.repeat(hit, windows[c]), ranges(first[c], windows[c])
                ok = least[at] < top[i]
                yield unit, 1, places, pack(i[ok].astype(np.int32), (at - first[code[i]])[ok].astype(np.int16), least[at[ok]])


def sorted_windows(word: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows of k words that puts equal ones side by side, and whether each is equal to the one before.

    They are sorted by a hash, and the words of neighbours compared; if two
    different windows share a hash, another one is taken.
    """
    for seed in count(1):
        h = textbuf.mix((word.astype(_U64) + _U64(1)) * _U64(0x9E3779B97F4A7C15) + _U64(seed))
        full, width = h, 1
        for bit in bin(k)[3:]:  # of twice as many words, and of one more where k needs it
            full, width = _followed(full, full, width), 2 * width
            if bit == "1":
                full, width = _followed(full, h, width), width + 1
        key = full[start]
        by = np.argsort(key, kind="stable")
        same = np.zeros(len(by), bool)
        same[1:] = key[by[1:]] == key[by[:-1]]
        i = np.flatnonzero(same)
        a, b = start[by[i]], start[by[i - 1]]
        if all((word[a + j] == word[b + j]).all() for j in range(k)):
            return by, same


def _followed(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Hashes of x[i] and y[i + width]."""
    n = min(len(x), len(y) - width)
    return textbuf.mix(x[:n] * _U64(0xC2B2AE3D27D4EB4F) + y[width : width + n])


def told_windows(rows: DataFrame, rule: Rule) -> DataFrame:
    """(unit, kind, places, answer) from rows sorted by bucket; rows of documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("places", pa.binary()), ("answer", pa.binary())])
        bucket = None

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield as_batch(rows, schema)

        for batch in batches:
            for unit, kind, number, sent, places in zip(*[batch.column(c).to_pylist() for c in ("unit", "kind", "bucket", "strings", "places")], strict=True):
                if kind == 0:
                    yield from out([(unit, 0, places, None)])
                    continue
                if bucket is not None and bucket.number != number:
                    yield from out(list(bucket.answers()))
                    bucket = None
                bucket = bucket or Bucket(number, rule)
                bucket.add(unit, sent, places)
        if bucket is not None:
            yield from out(list(bucket.answers()))

    return rows.mapInArrow(run, "unit long, kind int, places binary, answer binary")


def gone_words(rows: DataFrame, k: int) -> DataFrame:
    """(id, key, gone) of documents that lose words, from rows sorted by unit, its documents first; gone: first and last word, one more, of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = ids = keys = head = edge = None

        def out() -> Iterator[pa.RecordBatch]:
            if edge is None or not edge.any():
                return
            off = np.cumsum(edge[:-1]) > 0
            out = []
            for i in np.flatnonzero(np.add.reduceat(np.append(off, False), np.minimum(head[:-1], len(off))) * (np.diff(head) > 0)):
                own = np.concatenate([[False], off[head[i] : head[i + 1]], [False]])
                out.append((int(ids[i]), keys[32 * i : 32 * i + 32].tobytes(), np.flatnonzero(own[1:] != own[:-1]).astype(np.int64).tobytes()))
            yield as_batch(out, pa.schema([("id", pa.int64()), ("key", pa.binary()), ("gone", pa.binary())]))

        for batch in batches:
            for unit, kind, places, answer in zip(*[batch.column(c).to_pylist() for c in ("unit", "kind", "places", "answer")], strict=True):
                if kind == 0:
                    yield from out()
                    now = unit
                    ids, keys, words = unpack(places, np.int64, np.uint8, np.int64)
                    head = np.concatenate([[0], np.cumsum(words)])
                    edge = np.zeros(head[-1] + 1, np.int32)
                    continue
                assert unit == now
                n, doc, first = unpack(places, np.int32, np.int32, np.int64)
                string, at, least = unpack(answer, np.int32, np.int16, np.int64)
                begin = np.cumsum(n) - n
                i = ranges(begin[string].astype(np.int64), n[string].astype(np.int64))
                at, least = np.repeat(at, n[string]), np.repeat(least, n[string])
                hit = least < ids[doc[i]]
                p = first[i[hit]] + at[hit]
                np.add.at(edge, p, 1)
                np.add.at(edge, p + k, -1)
        yield from out()

    return rows.mapInArrow(run, "id long, key binary, gone binary")


def stretches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, key, gone) of docs (id, key, text), a row for each id and key that loses words, in the shared folder."""
    spark = docs.sparkSession
    known = docs.filter("id is not null")
    dealt = deal(known, rule, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = cut(known, rule, dealt).repartition("bucket").sortWithinPartitions("bucket")
    back = told_windows(sent, rule).repartition("unit").sortWithinPartitions("unit", "kind")
    return stored(gone_words(back, rule.window).groupBy("id", "key").agg(F.first("gone").alias("gone")), "superkmer-gone")  # rows of one id and text lose the same


def _applied(batch: pa.RecordBatch, text: str, gone: str) -> tuple[list[str], list[int], list[int]]:
    """The kept words joined by one space, the number of words and of those gone."""
    kept, n_words, n_gone = [], [], []
    stretch = batch.column(gone).to_pylist()
    for s in textbuf.slices(batch.column(text)):
        start, end = textbuf.spans(textbuf.NON_SPACE[s.data], s.offsets)
        doc = np.searchsorted(s.offsets, start, "right") - 1
        n = np.bincount(doc, minlength=s.n)
        off = np.zeros(len(start) + 1, np.int32)
        head = np.cumsum(n) - n
        for i, g in enumerate(stretch[s.row : s.row + s.n]):
            if g:
                edges = np.frombuffer(g, np.int64) + head[i]
                off[edges[::2]] += 1
                off[edges[1::2]] -= 1
        stay = np.cumsum(off[:-1]) == 0
        left = np.bincount(doc[stay], minlength=s.n)
        length = (end - start)[stay] + 1
        plain = np.append(s.data, np.uint8(32))[ranges(start[stay], length)]
        ends = np.cumsum(length)
        plain[ends - 1] = 32
        tail = np.concatenate([[0], ends])[np.cumsum(left)]
        raw = plain.tobytes()
        kept += [raw[a : max(a, b - 1)].decode() for a, b in zip(np.append(0, tail[:-1]), tail, strict=True)]
        n_words += n.tolist()
        n_gone += (n - left).tolist()
    return kept, n_words, n_gone


def _with_gone(docs: DataFrame, rule: Rule, id_col: str, text: str) -> tuple[DataFrame, str]:
    key, gone, id_ = (textbuf.first_column_named(docs.columns, c) for c in ("_key", "_gone", "_id"))
    of = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    found = stretches(docs.select(F.col(id_col).cast("long").alias("id"), of.alias("key"), F.col(text).alias("text")), rule)
    keyed = docs.withColumns({id_: F.col(id_col).cast("long"), key: of})
    rows = keyed.join(found.select(F.col("id").alias(id_), F.col("key").alias(key), F.col("gone").alias(gone)), [id_, key], "left")
    return rows.select(*[F.col(c) for c in docs.columns], gone), gone


def report(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """(id, n_words, n_removed, kept) of every row of docs, null ids as well."""
    rows, gone = _with_gone(docs.select(id_col, text), rule, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, n, off = _applied(batch, text, gone)
            return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(off, pa.int64()), pa.array(kept, pa.string())], [id_col, "n_words", "n_removed", "kept"])

        return run

    return map_batches(rows, make, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def clean(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """docs with the kept words as text; texts that lose none, null ones too, stay as they are."""
    rows, gone = _with_gone(docs, rule, id_col, text)
    names = docs.columns

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, _, off = _applied(batch, text, gone)
            old = batch.column(text).to_pylist()
            new = pa.array([k if o else t for k, o, t in zip(kept, off, old, strict=True)], pa.string())
            return pa.RecordBatch.from_arrays([new if c == text else batch.column(c) for c in names], names)

        return run

    return map_batches(rows, make, docs.schema)
