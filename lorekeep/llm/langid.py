"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased code points; runs of anything but letters count as one
space.  N-grams of 1 to 3 characters are hashed into a fixed number of buckets.
Executors count buckets of a bounded training sample; the driver turns the counts
into a log-probability matrix (buckets x languages), which is broadcast.  A batch
is scored as sparse rows times that matrix in numpy.  Languages beyond MAX_LANGS
make further matrices, one pass over the documents each.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, stored
from . import textbuf
from .session import fold, map_batches, small_table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Training documents of each language at most, and languages of a matrix.
MAX_ROWS_LANG = 3_000
MAX_LANGS = 256
UNDETERMINED = "und"
#: Bytes of a slice: every character has several n-grams, each with its document.
SLICE_BYTES = 1 << 17
#: In scores, evidence and prior count as of so many independent n-grams at most, which keeps those of long texts from
#: saturating at once. The prediction is that of the full sums.
EVIDENCE = 50.0


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all other characters."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
        elif unicodedata.category(ch)[0] == "M":
            table[c] = c
    return table


def code_points(s: textbuf.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of the slice and the document of each, without second spaces in a row."""
    text = s.data.tobytes().decode("utf-8", "replace")
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    lead = np.flatnonzero((s.data & 0xC0) != 0x80)
    if len(lead) == len(raw):
        doc = np.searchsorted(s.offsets, lead, "right") - 1
    else:  # bytes that aren't UTF-8: document by document
        parts = [s.data[s.offsets[i] : s.offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(s.n)]
        raw = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
        doc = np.repeat(np.arange(s.n), [len(p) for p in parts])
    c = _fold_table()[raw]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])
    return c[keep], doc[keep]


def grams(s: textbuf.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of each n-gram, ordered by document within each order; letters of each document."""
    c, doc = code_points(s)
    buckets, docs = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ c[j : len(c) - n + 1 + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        ok = doc[: len(h)] == doc[n - 1 :]
        if n == 1:
            ok &= c != 0
        buckets.append(h[ok] & np.uint32(BUCKETS - 1))
        docs.append(doc[: len(h)][ok])
    letters = np.bincount(doc[c != 0], minlength=s.n)
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), letters
    return np.concatenate(buckets), np.concatenate(docs), letters


@dataclass
class NaiveBayes:
    """A matrix of languages; more() makes those of further languages, one at a time."""

    langs: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    more: Callable[[], Iterator[NaiveBayes]] | None = None

    def sums(self, s: textbuf.Slice) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Best language of each document, its full sum with prior, the log of the sum of tempered likelihoods, and the weight.

        UNDETERMINED and zeros where there is no letter or no language.
        """
        bucket, doc, letters = grams(s)
        n, k = s.n, len(self.langs)
        if not k:
            return [UNDETERMINED] * n, np.zeros(n), np.zeros(n), np.zeros(n)
        total = np.stack([np.bincount(doc, weights=self.log_prob[j][bucket], minlength=n) for j in range(k)], axis=1) + self.log_prior
        best = np.argmax(total, axis=1)
        top = total[np.arange(n), best]
        weight = tempered(np.bincount(doc, minlength=n))
        mass = top * weight + np.log(np.exp((total - top[:, None]) * weight[:, None]).sum(1))
        none = letters == 0
        return [UNDETERMINED if none[i] else self.langs[best[i]] for i in range(n)], np.where(none, 0.0, top), np.where(none, 0.0, mass), np.where(none, 0.0, weight)

    def predict(self, s: textbuf.Slice) -> tuple[list[str], np.ndarray]:
        names, top, mass, weight = self.sums(s)
        return names, np.where([x == UNDETERMINED for x in names], 0.0, np.exp(top * weight - mass))


def tempered(count: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, EVIDENCE / np.maximum(count, 1))


def train(docs: DataFrame, modulus: int = 5, held_out: int = 0, max_rows_lang: int = MAX_ROWS_LANG) -> NaiveBayes:
    """Fit on the rows of each language with the smallest hashes of their ids, max_rows_lang of them at most.

    Every language is learned: the MAX_LANGS most frequent (ties by name) in the
    model's own matrix, others in those that more() makes.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", modulus) != held_out))
    found = sorted(((r["count"], r["lang"]) for r in known.groupBy("lang").count().collect()), key=lambda x: (-x[0], x[1]))  # one row a language
    if not found:
        return NaiveBayes([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    blocks = [sorted(found[i : i + MAX_LANGS], key=lambda x: x[1]) for i in range(0, len(found), MAX_LANGS)]
    sizes = [x for block in blocks for x in block]
    # a threshold on the hash keeps an expected max_rows_lang rows of each language, with no sort and no hot task
    top = 1 << 62
    cuts = [(lang, j, top if n <= max_rows_lang else int(top * (max_rows_lang / n))) for j, (n, lang) in enumerate(sizes)]
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(29)), 2)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", modulus) != held_out))
    small = small_table(spark, cuts, "lang string, j int, cut long")
    sample = rows.join(F.broadcast(small), "lang").filter(rank <= F.col("cut")).select("j", "text")  # one row a language

    def run(batches):
        def flush(counts):
            for j, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])
            counts.clear()

        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = batch.column("j").to_numpy()
            for s in textbuf.slices(batch.column("text"), SLICE_BYTES):
                bucket, doc, _ = grams(s)
                lang_of = codes[s.row : s.row + s.n][doc]
                order = np.argsort(lang_of, kind="stable")
                seen, begin = np.unique(lang_of[order], return_index=True)
                for j, own in zip(seen, np.split(bucket[order], begin[1:]), strict=True):
                    counts[j] = counts.get(j, 0) + np.bincount(own, minlength=BUCKETS)
                    if len(counts) >= MAX_LANGS:
                        yield from flush(counts)
        yield from flush(counts)

    counted = sample.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(blocks) > 1:
        counted = stored(counted, "ngrams")
    total = sum(n for n, _ in sizes)

    def made(i: int) -> NaiveBayes:
        langs, first = [x for _, x in blocks[i]], i * MAX_LANGS
        rows = counted.filter(F.col("lang").between(first, first + len(langs) - 1)).toArrow()  # at most BUCKETS * MAX_LANGS rows
        counts = np.zeros((len(langs), BUCKETS))
        counts[rows["lang"].to_numpy() - first, rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        smooth = 0.5
        log_prob = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BUCKETS)).astype(np.float32)
        return NaiveBayes(langs, log_prob, np.log(np.array([n for n, _ in blocks[i]], float) / total))

    return replace(made(0), more=(lambda: (made(i) for i in range(1, len(blocks)))) if len(blocks) > 1 else None)


def _told(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """Rows (row, name, score) of docs (row, text): the best of all languages, in one pass for each matrix.

    What passes leave is kept in the shared folder, so that a task holds one matrix.
    """
    spark = docs.sparkSession
    state = docs.select("row", "text", F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("top"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("weight"))
    schema = state.schema

    def passed(state: DataFrame, block: NaiveBayes) -> DataFrame:
        block_b = spark.sparkContext.broadcast(replace(block, more=None))  # at most BUCKETS * MAX_LANGS floats

        def make():
            def run(batch: pa.RecordBatch):
                parts = [block_b.value.sums(s) for s in textbuf.slices(batch.column("text"), SLICE_BYTES)]
                names = [x for p in parts for x in p[0]]
                top, mass, weight = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
                before = batch.column("name").to_pylist()
                old, old_mass = (batch.column(c).to_numpy() for c in ("top", "mass"))
                new = np.array([x is None for x in before])
                better = new | (top > old) | ((top == old) & np.array([x is not None and y < x for x, y in zip(before, names, strict=True)]))
                names = [y if b else x for x, y, b in zip(before, names, better, strict=True)]
                mass = np.where(new, mass, np.logaddexp(mass, old_mass))
                return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(names, pa.string()), pa.array(np.where(better, top, old)), pa.array(mass), pa.array(weight)], schema.names)

            return run

        return map_batches(state, make, schema)

    state = passed(state, model)
    if model.more:
        state = stored(state, "langs")
        for block in model.more():
            before, state = state, stored(passed(state, block), "langs")
            drop_stored(before)
    score = F.when(F.col("name") == UNDETERMINED, 0.0).otherwise(F.exp(F.col("top") * F.col("weight") - F.col("mass")))
    return state.select("row", "name", score.alias("score"))


def predict(docs: DataFrame, model: NaiveBayes, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text, without a shuffle, in one pass for each MAX_LANGS languages.

    A text that is null or holds no letter is 'und' with score 0, as is every
    text when nothing could be learned.  Repeated rows are predicted each; other
    columns are not read.
    """
    told = _told(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", modulus) == held_out).alias("held_out")).alias("row"), "text"), model)
    return told.select("row.doc_id", "row.held_out", F.col("name").alias("lang_pred"), "score")


def keep(docs: DataFrame, model: NaiveBayes, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a determined language and a score of at least least."""
    if model.more:
        told = _told(docs.select(F.struct(*docs.columns).alias("row"), "text"), model).filter((F.col("name") != UNDETERMINED) & (F.col("score") >= least))
        return told.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    model_b = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        def run(batch: pa.RecordBatch):
            ok = []
            for s in textbuf.slices(batch.column(at), SLICE_BYTES):
                names, score = model_b.value.predict(s)
                ok += [x != UNDETERMINED and p >= least for x, p in zip(names, score, strict=True)]
            return batch.filter(pa.array(ok, pa.bool_()))

        return run

    return map_batches(docs, make, docs.schema)
