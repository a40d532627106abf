"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words by water-filling: shares follow the weights, none passes its cap, the
excess is shared again by weight. Inside a source each document gets an expected number of copies, in proportion to its
size class (bits of its size, so that longer documents are likelier) and at most the cap, such that the expected words are
the target. The whole part of it is taken for certain; its fraction is the document's inclusion probability in a Pareto order
sample: documents are ranked by the odds of a fixed hash-based uniform divided by the odds of their inclusion probability, and
taken in that order while they bring the sum nearer the target.

The cut in the order is found without sorting a source: the rank is an integer key of 27 bits, and three passes over narrow rows sum sizes
by 9-bit digits of it (map-side combined, at most 512 sums a source); only documents with the very key of the cut are sorted. Sources
that take whole copies only have no cut. What a document is taken for follows from its source's few numbers, so no document is shuffled.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; every row has a fate of its own:
its number is drawn from its id, and where rows share an id (or have none) from id, source, text and its number among rows that are alike in all three, so
that reruns agree however the table is dealt; equal ranks fall back to doc_id, null first, then to the place; an empty table gives an empty result; other columns are ignored, and kept by `apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.llm.common import ROW, broadcast_if_small, keyed, materialize, word_count

DIGIT_BITS, DIGITS = 9, 3
KEY_BITS = DIGIT_BITS * DIGITS


def uniform(ident: Column, seed: int) -> Column:
    """In (0, 1), from the first 48 bits of an MD5 of the id: the same in every run and engine."""
    digest = F.md5(F.concat(ident.cast("string"), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def pareto_rank(u: Column, probability: Column) -> Column:
    """Odds of u over odds of the inclusion probability, mapped to (0, 1) by x / (1 + x); smaller is taken first."""
    ratio = (u / (1.0 - u)) / (probability / (1.0 - probability))
    return ratio / (1.0 + ratio)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """source, source_size, target: shares of `share` times all sizes by the weights, none above cap times its size."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * cap)
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing))
    per = (
        per.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("place", F.row_number().over(level))
        .withColumn("water", (F.lit(float(share)) * F.col("total") - before) / ahead)
    )
    free = F.col("cap") / F.col("w") > F.col("water")
    per = per.withColumn("level", F.min_by("water", F.when(free, F.col("place"))).over(whole))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def copy_rates(sizes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """src, weight, source_size, target, whole, part, rest: for every source and size class, the certain copies and the
    inclusion probability of one more; rest is what the target leaves to the sample.

    The rates are cap or level times the weight, whichever is less; the level is found over a source's few classes,
    the heaviest first, as the first at which its own class stays under the cap.
    """
    per = sizes.groupBy(F.col("source").alias("src"), "weight").agg(F.sum("size").alias("held"))
    known = targets.withColumnRenamed("source", "own")
    per = per.join(broadcast_if_small(known), F.col("src").eqNullSafe(F.col("own"))).drop("own")
    source = Window.partitionBy("src")
    heavy = source.orderBy(F.desc("weight"))
    before = F.coalesce(F.sum("held").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    ahead = F.sum(F.col("held") * F.col("weight")).over(heavy.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("target") - before) / F.nullif(ahead, F.lit(0))
    per = per.withColumn("level", level)
    free = (F.col("level") * F.col("weight") < cap) & (F.col("target") < F.col("source_size") * cap)
    per = per.withColumn("level", F.max_by("level", F.when(free, F.col("weight"))).over(source))
    rate = F.least(F.lit(float(cap)), F.coalesce(F.col("level") * F.col("weight"), F.lit(float(cap))))
    per = per.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    certain = F.sum(F.col("whole") * F.col("held")).over(source)
    return per.withColumn("rest", F.greatest(F.col("target") - certain, F.lit(0.0))).drop("level", "held")


class Mix:
    """What a mix of docs takes: a few numbers for each source, found in passes over narrow rows."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...], share: float, cap: int, seed: int, id_col: str, text_col: str, source_col: str):
        self.seed = seed
        self.sizes = materialize(self.sized(keyed(docs).select(
            ROW, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("mark")
        )))
        # Narrow rows only; an id of very many rows is one row of the map side's sums.
        repeated = materialize(self.sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("of")))
        sharing = self.sizes.join(broadcast_if_small(repeated), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
        like = Window.partitionBy("doc_id", "source", "mark").orderBy(ROW)
        drawn = F.concat_ws("@", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "source", "mark", F.row_number().over(like))
        self.drawn = materialize(sharing.select(F.col(ROW).alias("of"), drawn.alias("drawn")))
        targets = materialize(source_targets(self.sizes, weights, share, cap))
        self.rates = materialize(copy_rates(self.sizes, targets, cap))
        ranked = materialize(self.ranked(self.sizes).where("part > 0").select("source", "doc_id", ROW, "size", "rank", "key", "rest"))
        self.cuts = materialize(_boundaries(ranked, _cuts(ranked)))

    @staticmethod
    def sized(rows: DataFrame) -> DataFrame:
        """rows (size) with the weight of their size class."""
        return rows.withColumn("weight", F.length(F.bin("size")))

    def ranked(self, rows: DataFrame) -> DataFrame:
        """rows (ROW, doc_id, source, size, weight) with their rates, rank and key."""
        rates = broadcast_if_small(self.rates.withColumnRenamed("weight", "own"))
        known = rows.join(rates, F.col("source").eqNullSafe(F.col("src")) & (F.col("weight") == F.col("own"))).drop("src", "own")
        known = known.join(broadcast_if_small(self.drawn), F.col(ROW) == F.col("of"), "left")
        u = uniform(F.coalesce("drawn", F.col("doc_id").cast("string")), self.seed)
        known = known.withColumn("rank", F.when(F.col("part") > 0.0, pareto_rank(u, F.col("part"))))
        return known.drop("of", "drawn").withColumn("key", F.least(F.floor(F.col("rank") * float(2**KEY_BITS)), F.lit(2**KEY_BITS - 1)))

    def decided(self, rows: DataFrame) -> DataFrame:
        """rows (ROW, doc_id, source, size, weight) with source_size, target, copies, taken."""
        placed = self.ranked(rows).join(broadcast_if_small(self.cuts), F.col("source").eqNullSafe(F.col("cut_source")), "left")
        at_cut = (F.col("key") == F.col("cut")) & (F.struct("rank", "doc_id", ROW) <= F.col("last"))
        inside = F.coalesce((F.col("key") < F.col("cut")) | at_cut, F.lit(False))
        copies = (F.col("whole") + inside.cast("long")).cast("long")
        return placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies (taken = copies * size)."""
    plan = Mix(docs, weights, share, cap, seed, id_col, text_col, source_col)
    return plan.decided(plan.sizes).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _cuts(ranked: DataFrame) -> DataFrame:
    """cut_source, cut, below: the first key at which a source's running sum passes its rest, and the sum before it."""
    cuts = None
    for digit in reversed(range(DIGITS)):
        shift = DIGIT_BITS * digit
        step = F.shiftright(F.col("key"), shift)
        if cuts is None:
            rows = ranked.withColumn("below", F.lit(0).cast("long"))
        else:
            rows = ranked.join(broadcast_if_small(cuts), F.col("source").eqNullSafe(F.col("cut_source")))
            rows = rows.where(F.shiftright(F.col("key"), shift + DIGIT_BITS) == F.col("cut"))
        sums = rows.groupBy("source", "rest", "below", step.alias("step")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("step")
        run = sums.withColumn("before", F.col("below") + F.sum("size").over(order) - F.col("size"))
        # The last step that starts at or under the rest; all earlier steps are taken whole.
        reached = run.where(F.col("before") <= F.col("rest"))
        cuts = materialize(reached.groupBy(F.col("source").alias("cut_source")).agg(
            F.max("step").alias("cut"), F.max_by("before", "step").alias("below")
        ))
    return cuts


def _boundaries(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """cut_source, cut, last: the last (rank, doc_id, ROW) that the sample takes among those with the key of the cut; null if none."""
    at_cut = ranked.join(broadcast_if_small(cuts), F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("key") == F.col("cut")))
    order = Window.partitionBy("cut_source").orderBy("rank", "doc_id", ROW).rowsBetween(Window.unboundedPreceding, -1)
    fits = F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2.0 <= F.col("rest")
    last = F.max(F.when(F.col("fits"), F.struct("rank", "doc_id", ROW)))
    return at_cut.withColumn("fits", fits).groupBy("cut_source", "cut").agg(last.alias("last"))


def apply_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of docs, each repeated as often as the mix takes it; documents without words are not taken."""
    rows = keyed(docs)
    plan = Mix(rows, weights, share, cap, seed, id_col, text_col, source_col)
    rows = rows.select(
        ROW, F.struct(*(c for c in docs.columns if c != ROW)).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    taken = plan.decided(plan.sized(rows)).where("taken > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
