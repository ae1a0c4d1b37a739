"""Labelled rows for the classifiers, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, stored
from .session import fold, small_table

#: Rows and bytes of text that a classifier is fitted on at most.
MAX_ROWS = 8_000
MAX_BYTES = 32 << 20
#: A text of over one LONG-th of the bytes is long.
LONG = 64
#: Bits of the filter that ids with a label set, one each: 8 MB, in bitmaps of 4 KB.
FILTER_BITS = 1 << 26


def known_labels(labels: DataFrame, label: str, modulus: int, out: int) -> DataFrame:
    """doc_id and y, its largest label of 0 and 1, of every id outside the held-out fold that has one."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", modulus) != out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def may_be_known(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id has a label, and a few others: a filter of bounded size before a join that shuffles texts."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(FILTER_BITS)) + 1
    bits = known.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    placed = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return placed.join(F.broadcast(bits), "_bucket").filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*docs.columns)  # FILTER_BITS at most


def sample_ids(docs: DataFrame, labels: DataFrame, label: str, modulus: int, out: int, max_rows: int, max_bytes: int) -> list[tuple[int, int]]:
    """(doc_id, label) of labelled rows of docs outside the held-out fold: those with the smallest hash of the id.

    A doc_id that repeats in labels counts once, with its largest label.  Rows
    with a null id or a label other than 0 and 1 take no part, nor do labels
    without a document.  What doesn't fit in max_bytes any more is passed over.
    Long texts, of over 1 / LONG of max_bytes, have half the bytes, and what
    others leave; only a text of over max_bytes itself takes no part.
    """
    known = known_labels(labels, label, modulus, out)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).filter(fold("doc_id", modulus) != out)
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    both = sizes.groupBy("doc_id").agg(F.max("size").alias("size")).join(known, "doc_id").withColumn("long", F.col("size") > max_bytes // LONG)
    both = stored(both.filter(F.col("size") <= max_bytes), "labelled")
    short = both.filter("not long").orderBy(*order).limit(max_rows)
    rows = short.union(both.filter("long").orderBy(*order).limit(min(LONG, max_rows))).orderBy(*order).collect()  # LONG: more can't fit
    drop_stored(both)
    chosen, total, total_long = set(), 0, 0
    for r in rows:
        if len(chosen) < max_rows and total + r["size"] <= max_bytes and (not r["long"] or total_long + r["size"] <= max_bytes // 2):
            chosen.add(r["doc_id"])
            total += r["size"]
            total_long += r["size"] if r["long"] else 0
    for r in rows:
        if r["doc_id"] not in chosen and len(chosen) < max_rows and total + r["size"] <= max_bytes:
            chosen.add(r["doc_id"])
            total += r["size"]
    return [(r["doc_id"], r["y"]) for r in rows if r["doc_id"] in chosen]


def sampled_docs(docs: DataFrame, ids: list[tuple[int, int]], *columns: str) -> DataFrame:
    """The rows of docs with one of the sampled ids, with their label as y."""
    small = small_table(docs.sparkSession, ids, "doc_id long, y int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).join(F.broadcast(small), "doc_id")  # at most MAX_ROWS rows
