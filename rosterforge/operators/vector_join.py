"""Exact similarity join of dense vectors, in blocks that meet two by two, or first by pivots.

A bounded sample of the vectors are pivots. Each vector lives in the cell of its nearest pivot; two vectors with a dot product of t or more are at most
rho = sqrt(2m - 2t) apart, m being the largest squared length (1 for unit vectors), so a vector also visits every later cell that its ball of radius rho can meet: the cell's own ball must reach it,
and so must the plane that halves the way between the two pivots. Inside a cell, rows are dealt in blocks, each two blocks of which are one task,
and rows whose distances from the pivot differ by more than rho are not compared (triangle bound). Where the visits of all vectors, which are counted first, cost more than
they save (distances in many dimensions crowd together), all vectors are one cell, and each goes to as many tasks as there are blocks. Pairs are found by float32
products within the bound of their rounding, and decided by float64 ones; nothing is approximate, and a cell of any size is compared in blocks of bounded memory.

What is found in two blocks can be reduced in their task: to pairs whose sets of members pass a test, or to stars that link what the pairs link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterforge.plans.storage import broadcast_if_small, materialize

#: Pivots at most, rows of one block of a cell, and of one block of nearest_others(), which holds all products of two.
MAX_PIVOTS, BLOCK_ROWS, NEAREST_ROWS = 1024, 8192, 2048
#: Rows that are multiplied with a block at once, and pairs that are decided at once.
STEP_ROWS, STEP_PAIRS = 256, 16384
#: Dot products that take as long as dealing one row to a task.
ROW_COST = 500
#: Tasks at most of one join's blocks.
MAX_TASKS = 4096
#: What rounding may take from a bound.
SLACK = 1e-6


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b."""
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T))


def sampled_pivots(rows: DataFrame, vector: str, n: int) -> np.ndarray:
    """n vectors at most (few enough for the driver), by hash of the id."""
    found = rows.orderBy(F.xxhash64("team_id", F.lit("pivot")), "team_id").limit(n).select(vector).collect()
    return np.unique(np.array([r[0] for r in found], dtype=np.float64), axis=0) if found else np.zeros((0, 0))


def _going(batches, pivots: np.ndarray, rho: float | None, radii: np.ndarray | None):
    """Of each few rows (team_id, v): the rows, their distances from the pivots, homes, and where they go to."""
    gap = np.sqrt(_squared(pivots, pivots)) if rho is not None else None
    for whole in batches:
        for k in range(0, whole.num_rows, STEP_ROWS * 4):
            batch = whole.slice(k, STEP_ROWS * 4)
            squared = _squared(_matrix(batch.column(1)), pivots)
            home, far = squared.argmin(axis=1), np.sqrt(squared)
            at = np.arange(len(home))
            goes = np.zeros(far.shape, dtype=bool)
            if rho is not None:
                ball = far <= radii + rho + SLACK
                plane = (squared - squared[at, home][:, None]) / 2.0 <= rho * gap[home] + SLACK
                goes = ball & plane & (np.arange(len(pivots)) > home[:, None])
            goes[at, home] = True
            yield batch, far, home, goes


def placed(rows: DataFrame, pivots: np.ndarray, vector: str, rho: float | None = None, radii: np.ndarray | None = None) -> DataFrame:
    """cell, home, team_id, v, d (distance from the cell's pivot): each vector at home and, given rho and the cells' radii, where it visits."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, rho, radii))

    def work(batches):
        for batch, far, home, goes in _going(batches, *shared.value):
            row, cell = np.nonzero(goes)
            for k in range(0, len(row), STEP_PAIRS):
                r, c = row[k : k + STEP_PAIRS], cell[k : k + STEP_PAIRS]
                picked = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32()), pa.array(home[r] == c), batch.column(0).take(picked), batch.column(1).take(picked), pa.array(far[r, c])],
                    names=["cell", "home", "team_id", "v", "d"],
                )

    return rows.select("team_id", F.col(vector).alias("v")).mapInArrow(work, "cell int, home boolean, team_id long, v array<double>, d double")


def visits(rows: DataFrame, pivots: np.ndarray, rho: float, radii: np.ndarray) -> DataFrame:
    """cell, homes, visitors: how many rows (team_id, v) placed() would deal to each cell."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, rho, radii))

    def work(batches):
        homes, all_ = (np.zeros(len(shared.value[0]), dtype=np.int64) for _ in range(2))
        for _, _, home, goes in _going(batches, *shared.value):
            homes += np.bincount(home, minlength=len(homes))
            all_ += goes.sum(axis=0)
        cell = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(homes[cell]), pa.array((all_ - homes)[cell])], names=["cell", "homes", "visitors"])

    counts = rows.select("team_id", "v").mapInArrow(work, "cell int, homes long, visitors long")
    return counts.groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))


class Sets:
    """The sets of members of a task's rows, for counting what pairs of rows share."""

    BUCKETS = 1024

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        self.length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        names, member = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.span = max(1, len(names))
        self.keys = np.unique(np.repeat(np.arange(len(lists)), self.length) * self.span + member)
        row, self.member = np.divmod(self.keys, self.span)
        self.size = np.bincount(row, minlength=len(lists))
        self.begin = np.cumsum(self.size) - self.size
        self.bucket = self.member % self.BUCKETS
        self.seen = np.zeros((len(lists), self.BUCKETS), dtype=bool)
        self.seen[row, self.bucket] = True
        self.bits = np.packbits(self.seen, axis=1).view(np.uint64)
        self.hidden = self.size - self.seen.sum(axis=1)  # members that share a bucket with another one of their set

    def most(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A bound of shared()."""
        return np.bitwise_count(self.bits[p] & self.bits[q]).sum(axis=1, dtype=np.int64) + np.minimum(self.hidden[p], self.hidden[q])

    def shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The number of members that each row of p shares with its row of q."""
        n = self.size[p]
        pair = np.repeat(np.arange(len(p)), n)
        at = np.arange(len(pair)) + np.repeat(self.begin[p] - np.cumsum(n) + n, n)
        maybe = self.seen[q[pair], self.bucket[at]]
        pair, at = pair[maybe], at[maybe]
        key = q[pair] * self.span + self.member[at]
        found = np.searchsorted(self.keys, key)
        hit = self.keys[np.minimum(found, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(0, dtype=bool)
        return np.bincount(pair[hit], minlength=len(p))


class _Pairs:
    """Every pair: cell, a, b (a < b), similarity, and what the test of members adds."""

    def __init__(self, cell: int, ids: np.ndarray):
        self.cell, self.ids = cell, ids

    def add(self, p: np.ndarray, q: np.ndarray, dots: np.ndarray, more: list[np.ndarray]) -> Iterator[list]:
        a, b = self.ids[p], self.ids[q]
        yield [np.full(len(p), self.cell, dtype=np.int64), np.minimum(a, b), np.maximum(a, b), dots, *more]

    def end(self) -> Iterator[list]:
        return iter(())


class _Stars(_Pairs):
    """a, b: each row that has a pair, with one row of its component in the two blocks."""

    def __init__(self, cell: int, ids: np.ndarray):
        super().__init__(cell, ids)
        self.root = np.arange(len(ids))

    def add(self, p, q, dots, more):
        while True:
            x, y = self.root[p], self.root[q]
            apart = x != y
            if not apart.any():
                return iter(())
            p, q, x, y = p[apart], q[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up

    def end(self):
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        yield [self.ids[at], self.ids[self.root[at]]]


class _Sums(_Stars):
    """cell, a, b as in _Stars, and of the pairs counted at a: their number, sum, least and largest similarity, least and largest first value of the test."""

    def __init__(self, cell: int, ids: np.ndarray):
        super().__init__(cell, ids)
        self.n, self.total = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
        self.least, self.most = ([np.full(len(ids), x) for _ in range(2)] for x in (math.inf, -math.inf))

    def add(self, p, q, dots, more):
        self.n += np.bincount(p, minlength=len(self.ids))
        self.total += np.bincount(p, weights=dots, minlength=len(self.ids))
        for k, values in enumerate((dots, more[0])):
            np.minimum.at(self.least[k], p, values)
            np.maximum.at(self.most[k], p, values)
        return super().add(p, q, dots, more)

    def end(self):
        at = np.flatnonzero((self.n > 0) | (self.root != np.arange(len(self.root))))
        ends = [c[k][at] for k in range(2) for c in (self.least, self.most)]
        yield [np.full(len(at), self.cell, dtype=np.int64), self.ids[at], self.ids[self.root[at]], self.n[at], self.total[at], *ends]


def _units(batches) -> Iterator[tuple[tuple, pa.Table]]:
    """(cell, lo, hi) and rows of each two blocks; the rows are sorted."""
    now, held = None, []
    for batch in batches:
        keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if (key := tuple(keys[x].tolist())) != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = key, []
            held.append(batch.slice(x, y - x))
    if held:
        yield now, pa.Table.from_batches(held)


def _near(vectors: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, rho: float):
    """Positions and dot products of rows of x and y that reach the threshold, and the number of pairs looked at. Of equal x and y each pair is looked at once."""
    half = len(x) == len(y) and np.array_equal(x, y)
    x, y = x[np.argsort(d[x], kind="stable")], y[np.argsort(d[y], kind="stable")]
    longest = np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0)
    quick, low = vectors, threshold
    if 0.0 < longest < math.inf:
        quick, low = (vectors / math.sqrt(longest)).astype(np.float32), threshold / longest - (vectors.shape[1] + 8) * 2.0**-23
    begin, end = np.searchsorted(d[y], d[x] - rho - SLACK), np.searchsorted(d[y], d[x] + rho + SLACK, side="right")
    right = quick[y].T
    for k in range(0, len(x), STEP_ROWS):  # rows that are near in distance share one window of the other side
        part = x[k : k + STEP_ROWS]
        first, last = begin[k : k + STEP_ROWS].min(), end[k : k + STEP_ROWS].max()
        first = max(first, k) if half else first
        dots = quick[part] @ right[:, first:last]
        i, j = np.divmod(np.flatnonzero(dots >= low), max(1, dots.shape[1]))
        if half:
            i, j = (c[j + first > i + k] for c in (i, j))
        looked, size = dots.size, dots.size
        for m in range(0, max(1, len(i)), STEP_PAIRS):
            p, q = part[i[m : m + STEP_PAIRS]], y[first + j[m : m + STEP_PAIRS]]
            exact = np.einsum("ij,ij->i", vectors[p], vectors[q])
            fits = exact >= threshold
            yield p[fits], q[fits], exact[fits], looked
            looked = 0


def _compare(threshold: float, rho: float, fold=_Pairs, test=None, count: bool = False):
    """Rows (cell, lo, hi, side, home, team_id, v, d, and members with a test), sorted; side 0 is block lo, side 1 block hi; one block alone has side 0 only.

    test(sets, p, q): which pairs of rows stay, and columns of theirs. count: a last row of each two blocks has the number of pairs looked at alone.
    """

    def work(batches):
        for (cell, lo, hi), unit in _units(batches):
            side, home, ids, d = (unit.column(k).to_numpy() for k in ("side", "home", "team_id", "d"))
            vectors, sets = _matrix(unit.column("v")), Sets(unit.column("members")) if test else None
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if lo == hi else 1))
            # Two visitors are compared elsewhere; in one block, home rows meet each other and then the visitors.
            meets = [(x[home[x]], y[home[y]]), (x[home[x]], y[~home[y]])] + ([] if lo == hi else [(x[~home[x]], y[home[y]])])
            found, compared = fold(cell, ids), 0
            for p, q, dots, looked in (m for xs, ys in meets if len(xs) and len(ys) for m in _near(vectors, d, xs, ys, threshold, rho)):
                compared += looked
                other = ids[p] != ids[q]
                p, q, dots, more = p[other], q[other], dots[other], []
                if test and len(p):
                    stay, more = test(sets, p, q)
                    p, q, dots, more = p[stay], q[stay], dots[stay], [c[stay] for c in more]
                if len(p):
                    for columns in found.add(p, q, dots, more):
                        yield _batch(columns)
            for columns in found.end():
                yield _batch(columns)
            if count:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())), pa.array([compared], pa.int64())], names=[f"c{k}" for k in range(5)])

    def _batch(columns):
        arrays = [pa.array(c) for c in columns]
        if count:
            arrays.append(pa.nulls(len(arrays[0]), pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    return work


def _dealt(rows: DataFrame, sizes: DataFrame, block_rows: int, *more: str) -> DataFrame:
    """Rows (cell, home, team_id, v, d, more) for _compare(); sizes: cell, n."""
    spark = rows.sparkSession
    blocks = materialize(sizes.select("cell", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    sent = blocks.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, sent // BLOCK_ROWS))
    blocks = blocks.drop("n")
    own = F.pmod(F.xxhash64("team_id"), F.col("blocks")).cast("int")
    met = rows.join(broadcast_if_small(blocks), "cell").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    met = met.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side, "home", "team_id", "v", "d", *more)
    return met.repartition(tasks, "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")


def _cells(rows: DataFrame, n: int, threshold: float, pivots: int | None, block_rows: int) -> tuple[DataFrame, float, int]:
    """Rows (cell, home, team_id, v, d) dealt to cells, the largest difference of d in a pair, and the number of pivots."""
    alone = rows.select(F.lit(0).alias("cell"), F.lit(True).alias("home"), "team_id", "v", F.lit(0.0).alias("d"))
    if pivots is None and n <= block_rows:
        return alone, math.inf, 1
    centres = sampled_pivots(rows, "v", min(MAX_PIVOTS, max(1, pivots or n // 2)))
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))).first()[0]
    rho = math.sqrt(max(0.0, 2.0 * longest - 2.0 * threshold))
    reach = placed(rows, centres, "v").groupBy("cell").agg(F.max("d").alias("r")).collect()  # a number a pivot
    radii = np.full(len(centres), -np.inf)
    for r in reach:
        radii[r["cell"]] = r["r"]
    if pivots is None:
        cost = F.sum(ROW_COST * (F.col("homes") + F.col("visitors")) * F.ceil((F.col("homes") + F.col("visitors")) / block_rows) + F.col("homes") * (F.col("homes") / 2 + F.col("visitors")))
        if visits(rows, centres, rho, radii).agg(cost).first()[0] >= ROW_COST * n * math.ceil(n / block_rows) + n * (n / 2):
            return alone, math.inf, 1
    return materialize(placed(rows, centres, "v", rho, radii)), rho, len(centres)


def similarity_join(rows: DataFrame, threshold: float, vector: str = "final_vector", pivots: int | None = None, block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """a, b (a < b), similarity: all pairs of vectors (rows: team_id, vector) with a dot product of threshold or more; each action finds them anew, unless there is a report.

    pivots: by default none, or half the number of rows, MAX_PIVOTS at most, where a vector with a pivot nearby visits so few cells that this costs less. report gets rows, pivots,
    sent (rows dealt, visits included) and compared (pairs of vectors).
    """
    rows = materialize(rows.select("team_id", F.col(vector).alias("v")).where(F.col("v").isNotNull()))
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "a long, b long, similarity double")
    dealt, rho, centres = _cells(rows, n, threshold, pivots, block_rows)
    met = _dealt(dealt, dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), block_rows)
    if report is None:
        return met.mapInArrow(_compare(threshold, rho), "cell long, a long, b long, similarity double").drop("cell")
    found = materialize(met.mapInArrow(_compare(threshold, rho, count=True), "cell long, a long, b long, similarity double, compared long"))
    report |= {"rows": n, "pivots": centres, "sent": met.count(), "compared": found.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]}
    return found.where("a IS NOT NULL").select("a", "b", "similarity")


def similarity_stars(rows: DataFrame, threshold: float, vector: str = "final_vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b: links between what similarity_join() links, as few as a row of two blocks, so that their components are those of all pairs."""
    rows = materialize(rows.select("team_id", F.col(vector).alias("v")).where(F.col("v").isNotNull()))
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "a long, b long")
    dealt, rho, _ = _cells(rows, n, threshold, None, block_rows)
    met = _dealt(dealt, dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), block_rows)
    return met.mapInArrow(_compare(threshold, rho, _Stars), "a long, b long")


def _enough(least: float):
    def test(sets: Sets, p, q):
        small = np.minimum(sets.length[p], sets.length[q])
        share = lambda n, small: np.divide(n, small, out=np.zeros(len(n)), where=small > 0)
        stay = share(sets.most(p, q), small) >= least
        stay[stay] = share(sets.shared(p[stay], q[stay]), small[stay]) >= least
        return stay, []

    return test


def sharing_stars(rows: DataFrame, members: DataFrame, threshold: float, min_shared: float, vector: str = "final_vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b: links as of similarity_stars(), of pairs that share min_shared or more of the smaller set. members: team_id, members."""
    rows = materialize(rows.select("team_id", F.col(vector).alias("v")).where(F.col("v").isNotNull()).join(members, "team_id"))
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "a long, b long")
    dealt, rho, _ = _cells(rows, n, threshold, None, block_rows)
    dealt = dealt.join(rows.select("team_id", "members"), "team_id")
    met = _dealt(dealt, dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), block_rows, "members")
    return met.mapInArrow(_compare(threshold, rho, _Stars, _enough(min_shared)), "a long, b long")


def _apart(most: float):
    def test(sets: Sets, p, q):
        shared = sets.shared(p, q)
        union = sets.size[p] + sets.size[q] - shared
        overlap = np.divide(shared, union, out=np.zeros(len(p)), where=union > 0)
        return overlap <= most, [overlap, union, shared]

    return test


def similar_within(rows: DataFrame, threshold: float, key: str, vector: str = "final_vector", max_overlap: float | None = None, sums: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key (a long), a, b, similarity of pairs of the same group (rows: key, team_id, vector).

    max_overlap: only pairs whose sets (rows: members) overlap by so much at most, with overlap, pool and shared (members of either and of both). sums: no pairs, but key, a, b
    as of similarity_stars(), and pair_count, similarity_sum, similarity_min, similarity_max, overlap_min, overlap_max of the pairs counted at a.
    """
    more = [] if max_overlap is None else ["members"]
    rows = materialize(rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("cell"), F.lit(True).alias("home"), "team_id", F.col(vector).alias("v"), F.lit(0.0).alias("d"), *more))
    met = _dealt(rows, rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), block_rows, *more)
    columns = f"{key} long, a long, b long, similarity double" + ", overlap double, pool long, shared long" * bool(more)
    if sums:
        columns = f"{key} long, a long, b long, pair_count long, similarity_sum double, similarity_min double, similarity_max double, overlap_min double, overlap_max double"
    return met.mapInArrow(_compare(threshold, math.inf, _Sums if sums else _Pairs, _apart(max_overlap) if more else None), columns)


def nearest_others(rows: DataFrame, block_rows: int = NEAREST_ROWS) -> DataFrame:
    """id, similarity: the largest dot product of each vector (rows: id, v) with another row's; a row alone is absent.

    Blocks of rows meet two by two in tasks of bounded memory, and each row's best is kept before anything is shuffled again.
    """
    rows = materialize(rows.select(F.col("id").cast("long").alias("id"), "v"))
    blocks = max(1, -(-rows.count() // block_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "v")

    def best(batches):
        now, held = None, []

        def met():
            side, ids = (np.array([r[k] for r in held]) for k in (0, 1))
            vectors = np.array([r[2] for r in held], dtype=np.float64)
            x = np.flatnonzero(side == 0)
            y = x if now[0] == now[1] else np.flatnonzero(side == 1)
            if not len(x) or not len(y):
                return
            dots = vectors[x] @ vectors[y].T
            if now[0] == now[1]:
                np.fill_diagonal(dots, -np.inf)
            for at, top in ((x, dots.max(axis=1)), *(() if now[0] == now[1] else ((y, dots.max(axis=0)),))):
                some = np.isfinite(top)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][some]), pa.array(top[some])], names=["id", "similarity"])

        for batch in batches:
            for lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (lo, hi) != now:
                    if held:
                        yield from met()
                    now, held = (lo, hi), []
                held.append(row)
        if held:
            yield from met()

    tasks = dealt.repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    return tasks.mapInArrow(best, "id long, similarity double").groupBy("id").agg(F.max("similarity").alias("similarity"))
