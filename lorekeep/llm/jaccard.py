"""N-gram Jaccard join by prefix filters under several global token orders.

A document's tokens are the hashes of its distinct word shingles.  Documents
with equal sets form a class, and only classes are compared.  Under any global
order of the tokens two sets of Jaccard similarity t or more share a token among
the first n - ceil(t * n) + 1 of each.  Order 1 gives candidates: shared tokens
of those prefixes, cut by length and position.  Under orders 2 and 3 each set
has a longer prefix, kept as a bit map of 256 places, of which similar sets must
share a computed number of tokens; candidates have to pass every order before
the whole sets are compared.

All orders put frequent tokens last, by a count sketch of fixed size: order 1 by
the counts themselves, orders 2 and 3 by their magnitudes; each then goes by a
hash of its own.

The members of a token's list are never paired off.  In every round each member
is compared with the pivots of its list: one in round 0, at most PIVOTS**r in
round r.  A pivot has then met all it can be similar to and leaves the list, and
a list ends when its members are known to be connected.  A list of near copies so
costs a comparison for each member, as its first pivot is the one with the fewest
tokens of its own, likely what the others were copied from.  Nothing is sampled
or capped, and nothing depends on the size of the input.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.shared import drop_stored, release, stored
from . import textbuf
from .session import bounded_batches, map_batches, small_table

#: Counters of the sketch, and places of the bit maps, as powers of 2; counters of one row when they are summed.
SKETCH_BITS, MARK_BITS, CHUNK_BITS = 24, 22, 16
#: Bytes of a slice: every word has hashes, places and a shingle.
SLICE_BYTES = 1 << 18
#: Tokens by which the prefixes of orders 2 and 3 are longer than needed; they must share as many more.
EXTRA = 48
#: Pivots of a list grow by this factor from round to round.
PIVOTS = 64
#: Places of the bit maps of orders 2 and 3, as longs.
MAP_LONGS = 4
#: Longs of the bit maps of whole sets that are compared before the sets.
SET_LONGS = 64
#: Size classes that lists are cut by after round 0: sizes of one class differ by 2 % at most.
SIZE_STEP = 1.02
#: Class keys that a task remembers so as not to repeat postings of copies.
SEEN = 200_000
_SEEDS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words; linked when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def overlap(self, n: int | np.ndarray):
        """Least intersection of a set of n with any similar set."""
        return -(-self.percent * n // 100)

    def pair_overlap(self, n: Column, m: Column) -> Column:
        """Least intersection of similar sets of n and m."""
        return F.ceil(F.lit(self.percent) * (n + m) / F.lit(100.0 + self.percent) - F.lit(1e-9))

    def can_link(self, n: int) -> bool:
        """Whether a set of n can be similar to one that is not equal."""
        return 100 * n >= self.percent * (n + 1)

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return F.lit(100) * F.least(n, m) >= F.lit(self.percent) * F.greatest(n, m)


def shingle_sets(s: textbuf.Slice, width: int):
    """For each document of the slice its sorted distinct shingle hashes."""
    w = textbuf.words(s, textbuf.NON_SPACE)
    counts = w.counts(s.n)
    begin = np.concatenate([[0], np.cumsum(counts)])
    grams = textbuf.gram_hash(w.hash, width)
    for i in range(s.n):
        n = counts[i]
        if n >= width:
            yield np.unique(grams[begin[i] : begin[i + 1] - width + 1])
        elif n:
            yield textbuf.gram_hash(w.hash[begin[i] : begin[i + 1]], int(n))
        else:
            yield np.zeros(0, np.uint64)


def class_key(tokens: np.ndarray) -> int:
    """64 bits that depend on the set alone, as a signed integer."""
    a, b = textbuf.mix(tokens ^ _SEEDS[0]), textbuf.mix(tokens ^ _SEEDS[1])
    both = np.array([np.add.reduce(a), np.bitwise_xor.reduce(b), len(tokens)], np.uint64)
    return int(textbuf.gram_hash(both, 3).view(np.int64)[0])


def buckets(h: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (textbuf.mix(h ^ _SEEDS[2]) >> np.uint64(64 - bits)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counters of 4 bytes, compressed byte by byte: the low bytes have a few values, the others are zero or few."""
    out = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    low = out.compress(counts.astype(np.uint8).tobytes()) + out.flush()
    rest = b"" if counts.max() < 256 else zlib.compress((counts.astype(np.uint32) >> np.uint32(8)).tobytes(), 1)
    return len(low).to_bytes(4, "little") + low + rest


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little") + 4
    low = np.frombuffer(zlib.decompress(data[4:n]), np.uint8).astype(np.int64)
    return low if n == len(data) else low + (np.frombuffer(zlib.decompress(data[n:]), np.uint32).astype(np.int64) << 8)


def chunk_rows(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    parts = counts.reshape(-1, 1 << CHUNK_BITS)
    used = [i for i in range(len(parts)) if parts[i].any()]
    return used, [packed(parts[i]) for i in used]


def summed_chunks(rows: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Add up rows (chunk, counts) of 2**bits counters, whatever the input."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + unpacked(c)
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(np.minimum(c, 2**32 - 1))], pa.binary())], ["chunk", "counts"])

    out = np.zeros((1 << bits - CHUNK_BITS, 1 << CHUNK_BITS), np.uint32)
    dealt = rows.repartition(16, "chunk") if bits == SKETCH_BITS else rows.coalesce(4)  # bit maps are small
    for r in dealt.mapInArrow(run, "chunk int, counts binary").toLocalIterator():
        out[r["chunk"]] = np.minimum(out[r["chunk"]] + unpacked(bytes(r["counts"])), 2**32 - 1)
    return out.ravel()


#: Steps of a level up to the most frequent that aren't told from chance; above, one for each doubling.
FINE = 192


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as 0..255 in order: fine steps around the mean, magnitudes far above it."""
    mean = float(counts.mean(dtype=np.float64))
    step = 12 * np.sqrt(mean) / FINE if mean > 256 else max(1.0, 12 * np.sqrt(mean) / FINE)
    low = max(0.0, mean - 4 * np.sqrt(mean))
    out = np.empty(len(counts), np.uint8)
    for i in range(0, len(counts), 1 << 20):
        fine = np.maximum(counts[i : i + (1 << 20)] - low, 0) / step
        coarse = FINE + np.log2(np.maximum(fine / FINE, 1))
        out[i : i + (1 << 20)] = np.where(fine < FINE, fine, np.minimum(coarse, 255))
    return out


def magnitudes(level: np.ndarray) -> np.ndarray:
    """Levels of orders 2 and 3: chance level as one."""
    return np.where(level < FINE, 0, level)


def ranked(tokens: np.ndarray, level: np.ndarray, seed: np.uint64, k: int) -> np.ndarray:
    """The first k tokens in the order (level of each token, hash with seed)."""
    key = (level.astype(np.uint64) << np.uint64(56)) | (textbuf.mix(tokens ^ seed) >> np.uint64(8))
    order = np.argpartition(key, k - 1)[:k] if k < len(key) else np.arange(len(key))
    return tokens[order[np.argsort(key[order])]]


def _counted(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How many documents hold a token of each of the sketch's buckets: a level each."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in batches:
            for s in textbuf.slices(batch.column("text"), SLICE_BYTES):
                at, more = np.unique(buckets(np.concatenate(list(shingle_sets(s, rule.words)))).astype(np.uint32), return_counts=True)
                counts[at] = np.minimum(counts[at] + more, 2**16 - 1)
        chunk, data = chunk_rows(counts)
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(data, pa.binary())], ["chunk", "counts"])

    bounded_batches(docs.sparkSession)
    return levels(summed_chunks(docs.select("text").mapInArrow(run, "chunk int, counts binary")))


def bit_map(tokens: np.ndarray, longs: int = MAP_LONGS) -> np.ndarray:
    """Which of 64 * longs places hold one of the tokens, as signed longs."""
    place = (textbuf.mix(tokens) >> np.uint64(40)).astype(np.int64) % (64 * longs)
    bits = np.zeros(64 * longs, np.uint8)
    bits[place] = 1
    return np.packbits(bits).view(np.int64)


#: A row of _rows: a document (kind 0), a class (1) or a posting (2). order: its first byte says how frequent the
#: prefix tokens of the class are (0: most), then come the size and the position.
MAPS = [f"m{i}" for i in range(2 * MAP_LONGS)]
ROW_SCHEMA = "kind int, doc_id long, key long, n int, token long, order long, " + ", ".join(f"{c} long" for c in MAPS)
_SIZE = (1 << 28) - 1


def _rows(docs: DataFrame, rule: Rule, level_b) -> DataFrame:
    """Documents, classes with the bit maps of orders 2 and 3, and postings of the order-1 prefixes.

    A class and its postings may come more than once. Documents without id have no postings.
    """

    def make():
        seen: set[int] = set()

        def run(batch: pa.RecordBatch):
            level = level_b.value
            has_id, done = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False), 0
            for s in textbuf.slices(batch.column("text"), SLICE_BYTES):  # a slice's rows leave before the next one's are made
                doc_ns, doc_keys = [], []
                keys, ns, maps = [], [], []
                toks, orders, sizes = [], [], []
                for tokens in shingle_sets(s, rule.words):
                    n, i = len(tokens), done + len(doc_ns)
                    key = class_key(tokens) if n else None
                    doc_ns.append(n)
                    doc_keys.append(key)
                    if not has_id[i] or not rule.can_link(n) or key in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(key)
                    own = level[buckets(tokens)]
                    p = n - rule.overlap(n) + 1
                    first = ranked(tokens, own, _SEEDS[0], p)
                    rare = 255 - int(level[buckets(first)].mean())
                    keys.append(key)
                    ns.append(n)
                    k, own = prefix_size(n, rule), magnitudes(own)
                    maps.append(np.concatenate([bit_map(ranked(tokens, own, seed, k)) for seed in _SEEDS[1:]]))
                    toks.append(first)
                    orders.append((rare << 55) + (n << 27) + np.arange(p))
                    sizes.append(p)
                yield _batch(0, len(doc_ns), doc_id=batch.column("doc_id").slice(done, len(doc_ns)), key=pa.array(doc_keys, pa.int64()), n=pa.array(doc_ns, pa.int32()))
                done += len(doc_ns)
                if keys:
                    m = np.stack(maps)
                    yield _batch(1, len(keys), key=pa.array(keys, pa.int64()), n=pa.array(ns, pa.int32()), **{c: pa.array(m[:, i]) for i, c in enumerate(MAPS)})
                    yield _batch(2, sum(sizes), key=pa.array(np.repeat(np.array(keys, np.int64), sizes)), token=pa.array(np.concatenate(toks).view(np.int64)), order=pa.array(np.concatenate(orders)))

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, ROW_SCHEMA)


def _batch(kind: int, size: int, /, **columns: pa.Array) -> pa.RecordBatch:
    names = ["doc_id", "key", "n", "token", "order", *MAPS]
    types = {"n": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *[columns[c] if c in columns else pa.nulls(size, types.get(c, pa.int64())) for c in names]], ["kind", *names])


def prefix_size(n: int, rule: Rule) -> int:
    """Tokens of orders 2 and 3 that a bit map stands for."""
    return min(n, n - rule.overlap(n) + 1 + EXTRA)


def size_of(order: Column) -> Column:
    return F.shiftright(order, 27).bitwiseAND(_SIZE).cast("int")


def place_of(order: Column) -> Column:
    return order.bitwiseAND((1 << 27) - 1).cast("int")


def _marked(ids: DataFrame) -> np.ndarray:
    """Which of 2**MARK_BITS places hold an id."""

    def run(batches):
        counts = np.zeros(1 << MARK_BITS, np.uint16)
        for batch in batches:
            counts[buckets(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), MARK_BITS)] = 1
        chunk, data = chunk_rows(counts)
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(data, pa.binary())], ["chunk", "counts"])

    return summed_chunks(ids.mapInArrow(run, "chunk int, counts binary"), MARK_BITS) > 0


def _sets(docs: DataFrame, keys: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(key, n, map, tokens), stored, of the classes in keys (key); perhaps of some others, and of one class more than once.

    A bit map of fixed size sorts out most documents before their sets are made.
    What passes by chance drops out where sets meet pairs.
    """
    reps = stored(classes.join(keys, "key").select("key", "doc_id"), "reps")
    marked_b = docs.sparkSession.sparkContext.broadcast(np.packbits(_marked(reps.select("doc_id"))))

    def make():
        marked, seen = np.unpackbits(marked_b.value).astype(bool), set()

        def run(batch: pa.RecordBatch):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(marked[buckets(ids.view(np.uint64), MARK_BITS)]))
            for s in textbuf.slices(batch.column("text"), SLICE_BYTES):
                rows = []
                for tokens in shingle_sets(s, rule.words):
                    if len(tokens) and (key := class_key(tokens)) not in seen:
                        rows.append((key, tokens))
                        if len(seen) < SEEN:
                            seen.add(key)
                if rows:
                    own = [x[1] for x in rows]
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32), np.concatenate(own).view(np.int64))
                    maps = pa.ListArray.from_arrays(np.arange(0, SET_LONGS * len(own) + 1, SET_LONGS, dtype=np.int32), np.concatenate([bit_map(x, SET_LONGS) for x in own]))
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([len(x) for x in own], pa.int32()), maps, lists], ["key", "n", "map", "tokens"])

        return run

    rows = map_batches(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "key long, n int, map array<long>, tokens array<long>")
    out = stored(rows, "sets")
    drop_stored(reps)
    return out


def _with(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of both classes."""
    for name in ("a", "b"):
        pairs = pairs.join(table.select(F.col("key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in table.columns if c != "key"]), name)
    return pairs


def _sifted(pairs: DataFrame, maps: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that share tokens enough under orders 2 and 3."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    need = rule.pair_overlap(n_a, n_b)

    def k(n: Column) -> Column:
        return F.least(n, n - F.ceil(F.lit(rule.percent) * n / F.lit(100.0) - F.lit(1e-9)) + F.lit(1 + EXTRA))

    shared = need - F.greatest(n_a - k(n_a), n_b - k(n_b))
    most = k(n_a) + k(n_b) - F.lit(2) * F.greatest(shared, F.lit(0))
    both = _with(pairs, maps)
    for half in (MAPS[:MAP_LONGS], MAPS[MAP_LONGS:]):
        unlike = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in half), F.lit(0))
        both = both.filter(unlike <= most)
    return both.filter(rule.sizes_fit(n_a, n_b)).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that are similar, by whole sets. Maps of the sets tell most others before sets are moved."""
    unlike = F.aggregate(F.zip_with("map_a", "map_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.col("n_a") + F.col("n_b") - F.lit(2) * rule.pair_overlap(F.col("n_a"), F.col("n_b"))
    likely = stored(_with(pairs, sets.select("key", "n", "map")).filter(unlike <= most).select("a", "b").distinct(), "likely")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.col("n_a") + F.col("n_b") - common
    keys = likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct()
    whole = _with(likely, sets.select("key", "n", "tokens").join(keys, "key", "left_semi"))
    return whole.filter(F.lit(100) * common >= F.lit(rule.percent) * union).select("a", "b").distinct()


@dataclass
class Join:
    """profiles: (doc_id, n, key) of all rows; links: similar pairs (a, b) of class keys; labels: (id, component) of linked classes."""

    profiles: DataFrame
    links: DataFrame
    labels: DataFrame


def _pairs(cand: DataFrame) -> DataFrame:
    return stored(cand.select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b")).distinct(), "pairs")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """lists with label, the component of the class as far as it is known."""
    if labels is None:
        return lists.withColumn("label", F.col("key"))
    return lists.join(labels.select(F.col("id").alias("key"), "component"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")


def jaccard_join(docs: DataFrame, rule: Rule | None = None, all_links: bool = True) -> Join:
    """Similar pairs among the classes of docs.

    Without all_links, pairs within a component may be missing, as long as the
    links that are there connect the same classes; long lists of near copies then
    cost a linear number of comparisons.

    A document of fewer words than a shingle has its whole word sequence as only
    token; one without words, null or empty, has key null and links with none.
    Of rows of one doc_id with different texts each counts by itself.  A text of any
    length is handled whole, in memory of some 60 times its size.
    """
    rule = rule or Rule()
    spark = docs.sparkSession
    level_b = spark.sparkContext.broadcast(_counted(docs, rule))
    rows = stored(_rows(docs, rule, level_b), "jaccard")
    profiles = stored(rows.filter("kind = 0").select("doc_id", "n", "key"), "profiles")
    maps = stored(rows.filter("kind = 1").select("key", "n", *MAPS).dropDuplicates(["key"]), "maps")
    postings = rows.filter("kind = 2").select("token", "key", "order")
    classes = profiles.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    def fit(a: Column, b: Column) -> Column:
        # of a similar pair the row of its first common token stays: all it shares stands from there on
        n, m = size_of(a), size_of(b)
        shared = F.least(n - place_of(a), m - place_of(b))
        return rule.sizes_fit(n, m) & (shared >= rule.pair_overlap(n, m))

    # round 0: one pivot for each token
    pivots = postings.groupBy("token").agg(F.min("order").alias("p_order"), F.min_by("key", "order").alias("p"))
    x, y = postings.alias("x"), pivots.alias("y")
    members = stored(x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.key") != F.col("y.p"))).select("x.token", "key", "order", "p", "p_order"), "members")
    drop_stored(rows)
    release(spark)
    pairs = _pairs(members.filter(fit(F.col("order"), F.col("p_order"))))
    sifted = stored(_sifted(pairs, maps, rule), "sifted")
    sets = _sets(docs, sifted.select(F.col("a").alias("key")).union(sifted.select("b")).distinct(), classes, rule)
    found = stored(_similar(sifted, sets, rule), "links")
    links = found if found.take(1) else small_table(spark, [], "a long, b long")
    labels = None if all_links else connected_components(links)
    for table in (pairs, sifted, sets):
        drop_stored(table)

    # what is left: lists of two members and more besides the pivot, cut by sizes that fit
    many = members.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("token")
    lists = members.join(many, "token", "left_semi").select("token", "key", "order")
    n, place = size_of(F.col("order")), place_of(F.col("order"))
    t = rule.percent / 100
    # sets up to this size can share with this one what stands from its place on
    most = F.least(n, F.floor((n - place) * F.lit((1 + t) / t) + F.lit(1e-6)) - n)
    least = F.ceil(n * F.lit(t) - F.lit(1e-9))
    lists = lists.select("*", F.explode(F.when(most >= least, F.sequence(_size_class(least), _size_class(most))).otherwise(F.array())).alias("c"))
    # of a similar pair the smaller set (or either, of two of one size) has the token in this part of its prefix
    can_lead = (place <= n - rule.pair_overlap(n, n)) & (F.col("c") == _size_class(n))
    lists = lists.withColumn("leads", can_lead)
    done, sets, r = [members, maps], None, 1
    state = stored(_live(_labelled(lists, labels)), "lists")
    release(spark)
    while state.take(1):
        if sets is None:  # all that later rounds compare
            sets = _sets(docs, state.select("key").distinct(), classes, rule)
        salt = F.pmod(F.xxhash64("key", F.lit(r)), F.lit(PIVOTS**r))
        state_s = state.withColumn("salt", salt)
        pivots = state_s.filter("leads").groupBy("token", "c", "salt").agg(F.min("order").alias("p_order"), F.min_by("key", "order").alias("p"), F.min_by("label", "order").alias("p_label"))
        x, y = state_s.alias("x"), pivots.alias("y")
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.c") == F.col("y.c"))
        cand = x.join(y, same & (F.col("label") != F.col("p_label")) & (size_of(F.col("order")) >= size_of(F.col("p_order"))) & fit(F.col("order"), F.col("p_order")))
        pairs = _pairs(cand.select("key", "p"))
        sifted = stored(_sifted(pairs, maps, rule), "sifted")
        new = stored(_similar(sifted, sets, rule), "links")
        links = links.union(new)
        if labels is not None and new.take(1):
            labels = connected_components(new.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        led = pivots.select("token", "c", F.col("p").alias("key"), F.lit(True).alias("led"))
        left = state.join(led, ["token", "c", "key"], "left").withColumn("leads", F.col("leads") & F.col("led").isNull()).drop("led", "label")
        then, state = state, stored(_live(_labelled(left, labels)), "lists")
        for table in (then, pairs, sifted):
            drop_stored(table)
        r += 1
        release(spark)
    for table in [*done, state, *([sets] if sets is not None else [])]:
        drop_stored(table)
    return Join(profiles, links, connected_components(links) if labels is None else labels)


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(float(np.log(SIZE_STEP))) + F.lit(1e-9)).cast("int")


def _live(lists: DataFrame) -> DataFrame:
    """Rows of lists where a pivot is left and labels differ."""
    live = lists.groupBy("token", "c").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("leads").alias("any")).filter("lo < hi and any").select("token", "c")
    return lists.join(live, ["token", "c"], "left_semi").select("token", "c", "key", "order", "leads", "label")


def components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    component_id is the smallest doc_id that links reach, the row's own included.
    Rows without words are their own component; a null doc_id has no component.
    Repeated rows each appear; other columns are not read.
    """
    join = jaccard_join(docs, rule, all_links=False)
    classes = join.profiles.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    labels = join.labels.withColumnRenamed("id", "key")
    labelled = stored(classes.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key")), "classes")
    roots = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = labelled.join(roots, "component").select("key", "component_id")
    return (
        join.profiles.join(by_key, "key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, rule: Rule | None = None, with_null_ids: bool = False) -> DataFrame:
    """The rows of docs, all columns, that stand first in their component: one row of each.

    A row is a doc_id with its text, so the other texts of a repeated id stay
    or go by themselves, and near copies under one id count as copies.  First is
    the smallest doc_id, of those the smallest 64-bit hash of id and text.  Rows
    with a null id are grouped among themselves or, with_null_ids, with all rows,
    where they come last.  Texts without words are in no group; of those, as of
    all rows, equal texts of one id (or of none) stay once.
    """
    row = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())
    join = jaccard_join(docs.select(row.alias("doc_id"), "text"), rule, all_links=False)
    labels = join.labels.withColumnRenamed("id", "key")
    rows = join.profiles.withColumnRenamed("doc_id", "row").distinct().join(docs.select(row.alias("row"), "doc_id").distinct(), "row")
    rows = rows.withColumn("no_id", F.col("doc_id").isNull())
    least = F.min(F.struct("no_id", "doc_id", "row")).alias("f")
    classes = rows.filter("key is not null").groupBy("key", "no_id").agg(least).join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = classes.groupBy("component", *([] if with_null_ids else ["no_id"])).agg(F.min("f").alias("f")).select("f.row")
    stay = stored(first.union(rows.filter("key is null").select("row")), "stay").withColumnRenamed("row", _ROW)
    return docs.withColumn(_ROW, row).dropDuplicates([_ROW]).join(stay, _ROW, "left_semi").select(*docs.columns)


#: Column of the hash that stands for a row; no column of docs may have this name.
_ROW = "lorekeep_row"
