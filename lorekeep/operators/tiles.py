"""Similarity of a corpus with itself or with another one: tiles of near vectors meet by joins, nothing goes through the driver.

Vectors go to the nearest of some pivots, are sorted by cell and distance, and cut
into tiles of a bounded size, one row each with a matrix, a centre and a radius.
Two tiles are compared only if the triangle inequality leaves room for the asked
similarity: with centres D apart, radii r and s and longest vectors of n and m,
an inner product is at most (n^2 + m^2 - max(0, D - r - s)^2) / 2.  Cells rule
pairs out first (there are PIVOTS^2 pairs of them at most), then tiles, then
blocks of rows inside a pair.  What is left is a table of tile pairs, joined with
the tiles on their numbers.

Products are taken by matrix multiplication; those near a threshold, and all
that are returned, are summed again component by component, so results don't
depend on the order of a library's additions.

A tile of vectors that single precision holds travels in it; sums are double.

Vectors of another length don't meet; null vectors and those with a component
that is null or not finite take no part.  Rows of one id are each a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

#: Pivots, vectors they are drawn from (those of the smallest hashes of their ids), rows and bytes of a tile, rows of a block.
PIVOTS, SAMPLE, TILE_ROWS, TILE_BYTES, BLOCK = 64, 512, 2_048, 4 << 20, 256
#: Consecutive tiles that go to a task together, and pairs of tiles of a task.
TEAM, TASK_PAIRS = 8, 4_096
#: Products closer than this to a threshold are summed again.
NEAR = 1e-9
SCHEMA = "tile long, cell int, dim int, n int, centre array<double>, radius double, longest double, reach double, ids binary, data binary, extra array<binary>"


def _batches(spark: SparkSession) -> None:
    """Arrow batches of some tiles at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, str(1 << 30))).rstrip("bB")
    if now.isdigit() and int(now) > 2 * TILE_BYTES:
        spark.conf.set(key, str(2 * TILE_BYTES))


@dataclass
class Tile:
    ids: np.ndarray
    x: np.ndarray
    extra: dict[str, np.ndarray]
    number: int
    found: object = None
    _single: np.ndarray | None = None
    _longest: float | None = None

    def single(self) -> np.ndarray:
        """x in single precision, if that can hold it."""
        if self._single is None:
            self._single = single(self.x)
        return self._single

    def longest(self) -> float:
        if self._longest is None:
            self._longest = float(np.sqrt((self.x * self.x).sum(1).max(initial=0)))
        return self._longest

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, float, float]]:
        """Rows, centre, radius and longest vector of each block."""
        for i in range(0, len(self.ids), BLOCK):
            x = self.x[i : i + BLOCK]
            c = x.mean(0)
            yield slice(i, i + len(x)), c, float(np.sqrt(((x - c) ** 2).sum(1).max())), float(np.sqrt((x * x).sum(1).max()))


def most(n, m, apart, r, s):
    """Upper bound of inner products, with room for rounding; for numbers or columns."""
    gap = (F.greatest(F.lit(0.0), apart - r - s) if isinstance(apart, Column) else max(0.0, apart - r - s)) - 1e-7
    gap = F.greatest(F.lit(0.0), gap) if isinstance(gap, Column) else max(0.0, gap)
    return (n * n + m * m - gap * gap) / 2 + 1e-9


def single(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) if len(x) and np.abs(x).max() < 1e15 else x


def room(dim: int, n: float, m: float) -> float:
    """How far inner products in single precision of vectors no longer than n and m may be from those summed in double precision."""
    return 2e-7 * (dim + 2) * n * m + NEAR


def found_at(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix with few true values."""
    return np.divmod(np.flatnonzero(marked), marked.shape[1])


def equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of equal ids."""
    some = np.flatnonzero(np.isin(b, a))
    p, q = np.nonzero(a[:, None] == b[some][None, :])
    return p, some[q]


def pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length, one for two tiles and PIVOTS at most: each is the one of a bounded sample that is farthest from those before."""
    by: dict[int, list] = {}
    sample = vectors.select("id", "vector").filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = sample.collect()
    many = min(PIVOTS, 1 + (vectors.count() if len(rows) == SAMPLE else len(rows)) // (2 * TILE_ROWS))
    for r in rows:
        by.setdefault(len(r["vector"]), []).append(r["vector"])
    out = {}
    for dim, rows in by.items():
        x = np.array(rows, np.float64).reshape(len(rows), dim)
        chosen, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < many and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[dim] = x[chosen]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(~F.coalesce(bad, F.lit(True)))


@dataclass
class Tiles:
    rows: DataFrame
    pivots: dict[int, np.ndarray]
    extra: tuple[str, ...] = ()
    grouped: bool = False


def tiled(vectors: DataFrame, extra: tuple[str, ...] = (), at: dict[int, np.ndarray] | None = None, group: str | None = None) -> Tiles:
    """Tiles of vectors (id, vector, *extra), extra being doubles without nulls; at: pivots of another table; group: one of extra, whole numbers that take the place of cells."""
    spark = vectors.sparkSession
    vectors = usable(vectors)
    at = at if at is not None else pivots(vectors)
    _batches(spark)
    held = spark.sparkContext.broadcast(at)  # PIVOTS vectors for each length in the sample

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column("vector")
            flat, offs = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            dim = np.diff(offs)
            cell, reach = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                p = held.value.get(int(d), np.zeros((1, d)))
                x = flat[offs[rows][:, None] + np.arange(d)]
                far = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T)
                cell[rows] = far.argmin(1)
                reach[rows] = np.sqrt(((x - p[cell[rows]]) ** 2).sum(1))
            if group:
                reach, cell = cell + reach / (1 + reach), batch.column(group).to_numpy().astype(np.int32)  # near ones stay together within a group
            yield pa.RecordBatch.from_arrays([pa.array(dim.astype(np.int32)), pa.array(cell), pa.array(reach), *batch.columns], ["dim", "cell", "reach", *batch.schema.names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, rows, number = [], None, 0, 0

        def tile(number: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            d = key[0]
            x = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            c = x.mean(0)
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            one = {
                "tile": int(t.column("part")[0].as_py()) << 32 | number, "cell": int(key[1]), "dim": int(d), "n": len(x), "centre": c.tolist(), "radius": float(np.sqrt(((x - c) ** 2).sum(1).max())),
                "longest": float(np.sqrt((x * x).sum(1).max())), "reach": float(t.column("reach").to_numpy().max()), "ids": t.column("id").to_numpy().astype(np.int64).tobytes(),
                "data": (short if (short == x).all() else x).tobytes(), "extra": [t.column(e).to_numpy().astype(np.float64).tobytes() for e in extra],
            }
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one.values(), kinds, strict=True)], list(one))

        for batch in batches:
            dim, cell = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            edges = np.flatnonzero((np.diff(dim) != 0) | (np.diff(cell) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                while a < b:
                    now = (dim[a], cell[a])
                    room = max(1, min(TILE_ROWS, TILE_BYTES // (8 * int(dim[a])))) - rows
                    if held and (now != key or room <= 0):
                        yield tile(number)
                        held, rows, number = [], 0, number + 1
                        continue
                    key, took = now, min(room, b - a)
                    held.append(batch.slice(a, took))
                    a, rows = a + took, rows + took
        if held:
            yield tile(number)

    names = ", ".join(f"`{e}` double" for e in extra)
    near = vectors.select("id", "vector", *[F.col(e).cast("double").alias(e) for e in extra]).withColumn("vector", F.col("vector").cast("array<double>"))
    near = near.select(F.col("id").cast("long").alias("id"), *near.columns[1:]).mapInArrow(placed, "dim int, cell int, reach double, id long, vector array<double>" + (f", {names}" if names else ""))
    runs = near.repartitionByRange("dim", "cell", "reach", "id").sortWithinPartitions("dim", "cell", "reach", "id").withColumn("part", F.spark_partition_id())
    return Tiles(stored(runs.mapInArrow(cut, SCHEMA), "tiles"), at, tuple(extra), bool(group))


def tile_pairs(a: Tiles, b: Tiles, least: float | None = None, half: bool = False) -> DataFrame:
    """(x, y): tiles of a and b that may hold a pair of similarity least or more; half: x <= y, for a table with itself."""
    side = lambda t, n: t.rows.select(*[F.col(c).alias(f"{c}_{n}") for c in ("tile", "cell", "dim", "centre", "radius", "longest", "reach")])
    x, y, spark = side(a, "x"), side(b, "y"), a.rows.sparkSession
    if least is None or a.grouped or b.grouped:
        met = x.join(y, F.col("dim_x") == F.col("dim_y"))
    else:
        size = lambda t: {(r["dim"], r["cell"]): (r["reach"], r["longest"]) for r in t.rows.groupBy("dim", "cell").agg(F.max("reach").alias("reach"), F.max("longest").alias("longest")).collect()}  # noqa: E731  PIVOTS rows for each length
        cells_a, cells_b, near = size(a), size(b), []
        for (dim, i), (r, n) in cells_a.items():
            p = a.pivots.get(dim, np.zeros((1, dim)))
            for (other, j), (s, m) in cells_b.items():
                if other == dim and most(n, m, float(np.linalg.norm(p[i] - p[j])), r, s) >= least:
                    near.append((dim, i, j))
        cells = F.broadcast(spark.createDataFrame(near, "dim_x int, cell_x int, cell_y int"))  # PIVOTS^2 rows for each length
        met = x.join(cells, ["dim_x", "cell_x"]).join(y.withColumnRenamed("dim_y", "dim_x"), ["dim_x", "cell_y"])
    if least is not None:
        apart = F.sqrt(F.aggregate(F.zip_with("centre_x", "centre_y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v))
        met = met.filter(most(F.col("longest_x"), F.col("longest_y"), apart, F.col("radius_x"), F.col("radius_y")) >= least)
    if half:
        met = met.filter("tile_x <= tile_y")
    return met.select(F.col("tile_x").alias("x"), F.col("tile_y").alias("y"))


def share_compared(a: Tiles, least: float) -> DataFrame:
    """One row: tiles, pairs of them (each with itself and every other of its length), those left to compare, and their share."""
    n = a.rows.groupBy("dim").agg(F.count("*").alias("t")).agg(F.sum("t").alias("tiles"), F.sum(F.col("t") * (F.col("t") + 1) / 2).cast("long").alias("tile_pairs"))
    left = tile_pairs(a, a, least, half=True).agg(F.count("*").alias("compared"))
    return n.crossJoin(F.broadcast(left)).withColumn("share", F.round(F.col("compared") / F.col("tile_pairs"), 6))  # one row each


Kernel = Callable[[Tile, Tile], Iterator[pa.RecordBatch]]


def teams(a: Tiles) -> DataFrame:
    """(x, team): tiles in their order, as many in a team as fill TEAM whole ones; small tiles, as many partitions make them, are more."""
    order = Window.orderBy("dim", "cell", "tile")  # a row a tile
    whole = F.least(F.lit(TILE_ROWS), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim")))))
    share = F.col("n") / whole
    return a.rows.select(F.col("tile").alias("x"), F.floor((F.sum(share).over(order) - share) / TEAM).alias("team"))


def meet(a: Tiles, b: Tiles, pairs: DataFrame, kernel: Kernel, schema: str, end: Callable[[Tile], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """kernel(tile of a, tile of b) of every pair, and end(tile of a) when a task has met all its partners of a tile; `found` of a tile is the kernel's own.

    A task gets a team of consecutive tiles of a, and tiles of b one after
    another, each with the members it is to be compared with.  So a tile of b is
    sent once for a team, and one of a as often as its team's work is split.
    Tiles of b that are grouped come to a task group after group, each whole.
    """
    spark = a.rows.sparkSession
    load = ["ids", "data", "dim", "extra"]
    with_team = stored(pairs.join(teams(a), "x"), "tile-pairs")
    n = with_team.agg(F.countDistinct("team").alias("teams"), F.count("*").alias("pairs")).first()
    splits = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(n["teams"], 1)), -(-n["pairs"] // (TASK_PAIRS * max(n["teams"], 1))))
    dealt = with_team.withColumn("turn", F.lit(0))
    if b.grouped:
        dealt = with_team.join(b.rows.select(F.col("tile").alias("y"), F.col("cell").alias("turn")), "y")
    dealt = dealt.withColumn("split", F.pmod(F.xxhash64("turn" if b.grouped else "y"), F.lit(splits)).cast("int"))
    own = dealt.select("team", "split", "x").distinct().join(a.rows.select(F.col("tile").alias("x"), *load), "x")
    met = dealt.groupBy("team", "split", "turn", "y").agg(F.collect_list("x").alias("xs")).join(b.rows.select(F.col("tile").alias("y"), *load), "y")  # a team's tiles
    sent = own.select("team", "split", F.lit(0).alias("side"), F.lit(0).alias("turn"), F.col("x").alias("tile"), F.array().cast("array<long>").alias("xs"), *load).union(met.select("team", "split", F.lit(1), "turn", "y", "xs", *load))
    names = (a.extra, b.extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, team = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if (r["team"], r["split"]) != now:
                    for t in team.values():
                        yield from end(t) if end else ()
                    now, team = (r["team"], r["split"]), {}
                x = np.frombuffer(r["data"], np.float32 if len(r["data"]) * 2 == len(r["ids"]) * r["dim"] else np.float64).reshape(-1, r["dim"]).astype(np.float64)
                more = {n: np.frombuffer(e) for n, e in zip(names[r["side"]], r["extra"], strict=True)}
                t = Tile(np.frombuffer(r["ids"], np.int64), x, more, r["tile"])
                if r["side"] == 0:
                    team[r["tile"]] = t
                else:
                    for x in r["xs"]:
                        yield from kernel(team[x], t)
        for t in team.values():
            yield from end(t) if end else ()

    _batches(spark)
    return sent.repartition("team", "split").sortWithinPartitions("team", "split", "side", "turn").mapInArrow(run, schema)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows, components added one after another."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def marks(x: np.ndarray) -> np.ndarray:
    """Number of true values in each row."""
    return np.bitwise_count(np.packbits(x, axis=1)).sum(1, dtype=np.int64)


def _batch(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def similar(a: Tiles, least: float, over: bool = False, at_most: float | None = None, below: float | None = None) -> DataFrame:
    """(a, b, sim), a < b, of similarity >= least (> least if over), and if given <= at_most or < below; two rows of one id are no pair."""

    def kernel(t: Tile, u: Tile) -> Iterator[pa.RecordBatch]:
        for i, c, r, n in t.blocks():
            for j, d, s, m in u.blocks():
                if (t.number == u.number and j.start < i.start) or most(n, m, float(np.linalg.norm(c - d)), r, s) < least:
                    continue
                p, q = np.nonzero(t.x[i] @ u.x[j].T >= least - NEAR)
                p, q = p + i.start, q + j.start
                if t.number == u.number:
                    p, q = p[p < q], q[p < q]
                sim = exact(t.x[p], u.x[q])
                ok = (sim > least if over else sim >= least) & (t.ids[p] != u.ids[q])
                ok &= (sim <= at_most) if at_most is not None else True
                ok &= (sim < below) if below is not None else True
                p, q = t.ids[p[ok]], u.ids[q[ok]]
                if len(p):
                    yield _batch(["a", "b", "sim"], np.minimum(p, q), np.maximum(p, q), sim[ok])

    return meet(a, a, tile_pairs(a, a, least, half=True), kernel, "a long, b long, sim double")


#: pick(tile of a, rows of it, tile of b, the least that counts for each row): rows (from 0), places in b and similarities, none of the best left out.
Pick = Callable[[Tile, slice, Tile, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def most_similar(k: int, drop_self: bool = False) -> Pick:
    """The k most similar rows and what is as near to them as single precision can tell; drop_self: other ids only."""

    def pick(t: Tile, i: slice, v: Tile, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = t.single()[i], v.single()
        s, off = x @ y.T, room(x.shape[1], t.longest(), v.longest())
        if drop_self:
            s[equal(t.ids[i], v.ids)] = -np.inf
        floor = low - off
        if s.shape[1] > k and (low == -np.inf).any():
            floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * off)
        p, q = found_at(s >= floor.astype(s.dtype)[:, None] - s.dtype.type(off))
        other = s[p, q] > -np.inf
        p, q = p[other], q[other]
        return p, q, exact(t.x[i][p], v.x[q])

    return pick


def keep_best(t: Tile, v: Tile, k: int, pick: Pick) -> None:
    """`found` of t becomes (rows, similarities, ids), in that order, of the k best of what it was and of v."""
    row, sim, ids = t.found or (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    low = np.full(len(t.ids), -np.inf)
    last = np.flatnonzero(np.bincount(row, minlength=len(t.ids)) == k)
    low[last] = sim[np.searchsorted(row, last, "right") - 1]
    parts = [(row, sim, ids)]
    for i, _, _, _ in t.blocks():
        p, q, found = pick(t, i, v, low[i])
        parts.append((p + i.start, found, v.ids[q]))
    row, sim, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.lexsort((ids, -sim, row))
    row, sim, ids = row[by], sim[by], ids[by]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    t.found = (row[keep], sim[keep], ids[keep])


def topk(a: Tiles, b: Tiles, k: int, drop_self: bool = False, pick: Pick | None = None) -> DataFrame:
    """(query, id, sim, rank): the k most similar vectors in b of each one in a, ties to the smaller id; drop_self: other ids only.

    A task keeps the best k of each of its rows, and what they have found is the
    least that counts in the next tile; k rows a query and task are shuffled.
    pick: another way to tell what may be among the best.
    """
    pick = pick or most_similar(k, drop_self)

    def kernel(t: Tile, v: Tile) -> Iterator[pa.RecordBatch]:
        keep_best(t, v, k, pick)
        return iter(())

    def end(t: Tile) -> Iterator[pa.RecordBatch]:
        if t.found and len(t.found[0]):
            row, sim, ids = t.found
            yield _batch(["tile", "place", "query", "id", "sim"], np.full(len(row), t.number), row.astype(np.int32), t.ids[row], ids, sim)

    found = meet(a, b, tile_pairs(a, b), kernel, "tile long, place int, query long, id long, sim double", end)
    order = Window.partitionBy("tile", "place").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "id", "sim", "rank")


def better(a: Tiles, b: Tiles, target: str, weight: str | None = None, scope: str | None = None, part: str | None = None, places: int | None = None) -> DataFrame:
    """(query, part, above, tied): for each vector in a, how many in b are more similar than its target, and as similar.

    Ids equal to the query's don't count.  weight: an extra column of b that
    similarities are multiplied by; places: what they are rounded to then, as the
    targets have to be.  scope: an extra column of both that has to be equal;
    part: one of b that counts are kept by (0 if none).  A NaN target counts
    nothing.  What comes out is a row for each query and part, not for each pair.
    """

    def kernel(t: Tile, v: Tile) -> Iterator[pa.RecordBatch]:
        goal = t.extra[target]
        w = v.extra[weight] if weight else np.ones(len(v.ids))
        if v.found is None:  # places in the order of parts, vectors times weights, and what lies between the ends of parts
            parts = v.extra[part].astype(np.int64) if part else np.zeros(len(v.ids), np.int64)
            order = np.argsort(parts, kind="stable")
            kinds, first = np.unique(parts[order], return_index=True)
            v.found = (order, single(v.x[order] * w[order, None]), list(zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True)))
        order, y, spans = v.found
        t.found = t.found or {}
        for i, _, _, _ in t.blocks():
            x = t.single()[i]
            s = x @ y.T
            off = room(x.shape[1], t.longest(), v.longest() * float(np.abs(w).max(initial=0))) + (10.0**-places if places else 0) + 1e-8
            low, high = ((goal[i] + d).astype(s.dtype) for d in (-off, off))
            low, high = np.nextafter(low, -np.inf, dtype=s.dtype), np.nextafter(high, np.inf, dtype=s.dtype)
            up = s > high[:, None]
            p, q = found_at((s >= low[:, None]) ^ up)
            sim = exact(t.x[i][p], v.x[order[q]]) * w[order[q]]
            diff = (np.round(sim, places) if places else sim) - goal[i][p]
            up[p, q] = diff > 0
            level = np.zeros_like(up) if (diff == 0).any() else None
            if level is not None:
                level[p, q] = diff == 0
            own = equal(t.ids[i], v.ids[order])
            same = t.extra[scope][i][:, None] == v.extra[scope][order][None, :] if scope else None
            for g, a, b in spans:
                n, m = t.found.setdefault(g, (np.zeros(len(t.ids), np.int64), np.zeros(len(t.ids), np.int64)))
                for count, marked in ((n, up), (m, level)):
                    if marked is not None:
                        marked[own] = False
                        count[i] += marks(marked[:, a:b] if same is None else marked[:, a:b] & same[:, a:b])
        return iter(())

    def end(t: Tile) -> Iterator[pa.RecordBatch]:
        for g, (n, m) in (t.found or {}).items():
            some = np.flatnonzero((n > 0) | (m > 0))
            if len(some):
                yield _batch(["query", "part", "above", "tied"], t.ids[some], np.full(len(some), g), n[some], m[some])

    found = meet(a, b, tile_pairs(a, b), kernel, "query long, part long, above long, tied long", end)
    return found.groupBy("query", "part").agg(F.sum("above").alias("above"), F.sum("tied").alias("tied"))


def groups_near(a: Tiles, b: Tiles, least: float, below: float) -> DataFrame:
    """(query, n): of the units in b how many, other than the query's own, hold a vector of least <= similarity < below; queries of none have no row.

    A unit is a place in a group (extras of both, whole numbers from 0; b is
    tiled by group).  A task meets a group whole, so it counts the group's units
    by itself.  Rows of a repeated id (extra of a: twice, 1 for those) name their
    units instead, which are counted together.
    """

    def told(t: Tile) -> Iterator[pa.RecordBatch]:
        now, seen, n = t.found
        own = np.flatnonzero((t.extra["group"] == now) & (t.extra["place"] < seen.shape[1]))
        seen[own, t.extra["place"][own].astype(np.int64)] = False
        twice = t.extra["twice"] > 0
        n += np.where(twice, 0, seen.sum(1))
        p, q = np.nonzero(seen & twice[:, None])
        if len(p):
            yield _batch(["query", "group", "place", "n"], t.ids[p], np.full(len(p), now), q.astype(np.int64), np.zeros(len(p), np.int64))

    def kernel(t: Tile, v: Tile) -> Iterator[pa.RecordBatch]:
        now, place = int(v.extra["group"][0]), v.extra["place"].astype(np.int64)
        if t.found and t.found[0] != now:
            yield from told(t)
        if not t.found or t.found[0] != now:
            t.found = (now, np.zeros((len(t.ids), 0), bool), t.found[2] if t.found else np.zeros(len(t.ids), np.int64))
        now, seen, n = t.found
        more = int(place.max()) + 1 - seen.shape[1]
        if more > 0:
            seen = np.hstack([seen, np.zeros((len(t.ids), more), bool)])
        t.found = (now, seen, n)
        near = list(v.blocks())
        for i, c, r, long in t.blocks():
            x = t.single()[i]
            for j, d, s, m in near:
                if most(long, m, float(np.linalg.norm(c - d)), r, s) < least:
                    continue
                y = v.single()[j]
                sim, off = x @ y.T, room(x.shape[1], long, m)
                p, q = found_at((sim >= least - 2 * off) & (sim < below + 2 * off))
                sim = sim[p, q].astype(np.float64)
                p, q = p + i.start, q + j.start
                close = np.flatnonzero((sim < least + off) | (sim >= below - off))
                if len(close):
                    sim[close] = exact(t.x[p[close]], v.x[q[close]])
                ok = (sim >= least) & (sim < below) & (t.ids[p] != v.ids[q])
                seen[p[ok], place[q[ok]]] = True

    def end(t: Tile) -> Iterator[pa.RecordBatch]:
        if t.found:
            yield from told(t)
            n = t.found[2]
            some = np.flatnonzero(n)
            if len(some):
                yield _batch(["query", "group", "place", "n"], t.ids[some], np.full(len(some), -1), np.full(len(some), -1), n[some])

    found = meet(a, b, tile_pairs(a, b, least), kernel, "query long, group long, place long, n long", end)
    units = found.groupBy("query", "group", "place").agg(F.sum("n").alias("n"))
    return units.groupBy("query").agg(F.sum(F.when(F.col("group") < 0, F.col("n")).otherwise(1)).alias("n"))
