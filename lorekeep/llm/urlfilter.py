"""URL filters by Bloom filter cascades.

Rules name a host (with all subdomains) and a path prefix.  A url's lookup keys
are its host suffixes with as many labels as some rule has, each followed by the
prefixes of its path that are as long as some rule's path.  A cascade holds one
set of listed keys: level 1 is a Bloom filter of the listed keys, level 2 one of
the other keys of the corpus that pass level 1, level 3 one of the listed keys
that pass level 2, and so on until nothing passes wrongly.  As the false
positives come from the complete key universe of the corpus, membership of any of
its keys is exact, without a join.  The first level is sized so that about as
many keys pass wrongly as are listed, so the filters' size follows the list, not
the corpus.  One pass over the urls builds the cascades of all verdicts, a second
one judges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .session import map_batches

DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and urls without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Behind the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def lookup_keys(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """Keys of a url, the longest first, ties to the longer host."""
    labels = sorted({r.host.count(".") + 1 for r in rules}, reverse=True)
    paths = sorted({len(r.path) for r in rules}, reverse=True)
    keys = []
    for n in labels:
        suffix = F.substring_index(host, ".", -n)
        has = (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))) >= n - 1
        for m in paths:
            keys.append(F.when(has & (host != "") & (F.length(path) >= m), F.struct(F.concat(suffix, F.substring(path, 1, m)).alias("key"), F.length(suffix).alias("n"))))
    found = F.filter(F.array(*keys), lambda k: k.isNotNull())
    order = F.array_sort(F.transform(found, lambda k: F.struct((-F.length(k["key"])).alias("a"), (-k["n"]).alias("b"), k["key"].alias("key"))))
    return F.transform(order, lambda k: k["key"])


@dataclass
class Bloom:
    bits: np.ndarray
    size: int
    hashes: int
    seed: np.uint64

    @classmethod
    def of(cls, h: np.ndarray, rate: float, seed: int) -> Bloom:
        size = max(64, int(np.ceil(len(h) * np.log2(1 / rate) / np.log(2))))
        hashes = max(1, round(np.log2(1 / rate)))
        out = cls(np.zeros(-(-size // 8), np.uint8), size, hashes, np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        for at in out._places(h):
            np.bitwise_or.at(out.bits, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        return out

    def _places(self, h: np.ndarray):
        a = textbuf.mix(h ^ self.seed)
        b = textbuf.mix(a ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        for i in range(self.hashes):
            yield (a + np.uint64(i) * b) % np.uint64(self.size)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self._places(h):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


@dataclass
class Cascade:
    """exceptions: keys of the universe with the 64-bit hash of a listed one."""

    filters: list[Bloom]
    exceptions: frozenset[str] = frozenset()

    def has(self, h: np.ndarray) -> np.ndarray:
        """Exact for the keys of the universe it was built over."""
        out, live = np.zeros(len(h), bool), np.arange(len(h))
        for k, f in enumerate(self.filters):
            live = live[f.has(h[live])]
            out[live] = k % 2 == 0
            if not len(live):
                break
        return out


def _hashes(keys: list[str]) -> np.ndarray:
    buf = [k.encode() for k in keys]
    data = np.frombuffer(b"".join(buf), np.uint8)
    ends = np.cumsum([len(b) for b in buf])
    return textbuf.span_hash(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)) if buf else np.zeros(0, np.uint64)


def _column_hashes(column: pa.Array) -> np.ndarray:
    out = []
    for s in textbuf.slices(column):
        out.append(textbuf.span_hash(s.data, s.offsets[:-1], s.offsets[1:]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def build(universe: DataFrame, lists: list[list[str]], bound: int) -> list[Cascade]:
    """A cascade for each list of keys over all keys of universe (key string), which has bound rows at most.

    One scan finds the keys that pass level 1 wrongly, for all lists; later levels
    work on those.  Lists come from the driver and so do their filters; the false
    positives are about as many as listed keys.
    """
    spark = universe.sparkSession
    lists = [sorted(set(x)) for x in lists]
    first = [Bloom.of(_hashes(keys), min(0.5, max(1e-9, len(keys) / max(1, bound))), 1) for keys in lists]
    state_b = spark.sparkContext.broadcast([(f, frozenset(keys)) for f, keys in zip(first, lists, strict=True)])

    def make():
        def run(batch: pa.RecordBatch):
            column = batch.column(0)
            h = _column_hashes(column)
            for i, (level, known) in enumerate(state_b.value):
                passed = pc.unique(column.filter(pa.array(level.has(h)))).to_pylist()
                passed = [k for k in passed if k not in known]
                if passed:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(passed), pa.int32()), pa.array(passed, pa.string())], ["list", "key"])

        return run

    wrong: list[list[str]] = [[] for _ in lists]
    for r in map_batches(universe.select("key"), make, "list int, key string").distinct().toLocalIterator():
        wrong[r["list"]].append(r["key"])
    return [_cascade(f, keys, sorted(w)) for f, keys, w in zip(first, lists, wrong, strict=True)]


def _cascade(first: Bloom, keys: list[str], wrong: list[str]) -> Cascade:
    inside, outside = _hashes(keys), _hashes(wrong)
    same = np.isin(outside, inside)
    exceptions = frozenset(k for k, x in zip(wrong, same.tolist(), strict=True) if x)
    outside, filters = outside[~same], [first]
    while len(outside):  # a level halves what is left
        filters.append(Bloom.of(outside, 0.5, len(filters) + 1))
        inside = inside[filters[-1].has(inside)]
        if not len(inside):
            break
        filters.append(Bloom.of(inside, 0.5, len(filters) + 1))
        outside = outside[filters[-1].has(outside)]
    return Cascade(filters, exceptions)


def judge(pages: DataFrame, rules: list[UrlRule], default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    The longest rule that fits decides (ties: the longer host).  Urls that no
    rule fits, null ones and ones without :// among them, have rule null and the
    default verdict.  Repeated rows are judged each; other columns are not read.
    Of rules with the same host and path the first counts.
    """
    first: dict[str, UrlRule] = {}
    for r in rules:
        first.setdefault(r.key, r)
    rules = list(first.values())
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = parts.withColumn("keys", lookup_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("keys").alias("key"))
    verdicts = sorted({r.verdict for r in rules})
    most = len({r.host.count(".") for r in rules}) * len({len(r.path) for r in rules})  # keys of a url
    built = build(universe, [[r.key for r in rules if r.verdict == v] for v in verdicts], most * pages.count())
    cascades_b = pages.sparkSession.sparkContext.broadcast(built)

    def make():
        def run(batch: pa.RecordBatch):
            keys = batch.column("keys")
            flat, row = keys.flatten(), pc.list_parent_indices(keys).to_numpy(zero_copy_only=False)
            h, n = _column_hashes(flat), batch.num_rows
            which = np.full(len(flat), -1)
            for i, c in enumerate(cascades_b.value):
                hit = c.has(h)
                if c.exceptions:
                    hit[np.flatnonzero(hit)[[flat[int(j)].as_py() in c.exceptions for j in np.flatnonzero(hit)]]] = False
                which[hit] = i
            hit = np.flatnonzero(which >= 0)
            rows, at = np.unique(row[hit], return_index=True)  # keys stand longest first
            rule = np.full(n, -1, np.int64)
            rule[rows] = hit[at]
            has = rule >= 0
            names = flat.take(pa.array(np.where(has, rule, 0), mask=~has)) if len(flat) else pa.nulls(n, pa.string())
            told = np.array([*verdicts, default], dtype=object)[np.where(has, which[rule] if len(which) else -1, len(verdicts))]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "host", "path")], names.cast(pa.string()), pa.array(told, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

        return run

    return map_batches(keyed, make, "page_id long, host string, path string, rule string, verdict string")

