"""Pairs of player sets that share enough players, by a join on prefixes of rare players.

With the players of every set in one order, rarest first, two sets that share at least c players share k of them among their first size - c + k
players each. So the join keys are the k-tuples of these rare players: pairs by default, which few sets have in common; a player of half of all teams
stands in keys with others only. Single players (depth 1) are fewer keys for very large sets. A key that still has very many sets is dealt in blocks, and each two blocks of it meet under a key of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterforge.plans.storage import broadcast_if_small, materialize

#: Sets of one block of a key.
BLOCK_SETS = 4096


def rare_first(rows: DataFrame, members: str = "lineup", key: str = "team_id") -> DataFrame:
    """key, ordered: the distinct members of each set, those of the fewest sets first."""
    each = rows.select(key, F.explode(F.array_distinct(members)).alias("p"))
    frequency = materialize(each.groupBy("p").agg(F.count(F.lit(1)).alias("sets")))
    placed = each.join(broadcast_if_small(frequency), "p").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sets", "p"))).alias("o"))
    return placed.select(key, F.transform("o", lambda x: x["p"]).alias("ordered"))


def candidate_sets(rows: DataFrame, min_shared: int, members: str = "lineup", key: str = "team_id", block_sets: int = BLOCK_SETS, depth: int = 2) -> DataFrame:
    """a, b (a < b), ordered_a, ordered_b: pairs of sets with a common key, each once; no pair that shares min_shared members is missing.

    depth: members of a key, 1 or 2, and never more than min_shared.
    """
    depth = min(depth, min_shared, 2)
    sets = rare_first(rows, members, key).where(F.size("ordered") >= min_shared)
    prefix = lambda c: F.slice(c, 1, F.size(c) - (min_shared - depth))
    if depth == 1:
        tuples = lambda c: F.transform(c, lambda p: F.array(p))
    else:
        tuples = lambda c: F.flatten(F.transform(c, lambda p, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda q: F.array(p, q))))
    keyed = materialize(sets.select(F.col(key).alias("id"), "ordered", F.explode(tuples(prefix(F.col("ordered")))).alias("p")))
    blocks = keyed.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("blocks")).where("blocks > 1")
    keyed = keyed.join(broadcast_if_small(materialize(blocks)), "p", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = keyed.select("p", "id", "ordered", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    side = lambda own, name: dealt.where(F.col("own") == F.col(own)).select("p", "lo", "hi", F.col("id").alias(name), F.col("ordered").alias(f"ordered_{name}"))
    met = side("lo", "x").join(side("hi", "y"), ["p", "lo", "hi"]).where((F.col("lo") != F.col("hi")) | (F.col("x") < F.col("y")))
    # A pair meets at every common key and is taken at the first one.
    first = F.slice(F.array_intersect(prefix(F.col("ordered_x")), prefix(F.col("ordered_y"))), 1, depth) == F.col("p")
    swap = F.col("x") > F.col("y")
    turned = lambda p, q, name: F.when(swap, F.col(q)).otherwise(F.col(p)).alias(name)
    return met.where(first).select(turned("x", "y", "a"), turned("y", "x", "b"), turned("ordered_x", "ordered_y", "ordered_a"), turned("ordered_y", "ordered_x", "ordered_b"))


def sharing_pairs(rows: DataFrame, min_shared: int, members: str = "lineup", key: str = "team_id", block_sets: int = BLOCK_SETS, depth: int = 2) -> DataFrame:
    """a, b (a < b), shared: sets that share min_shared members or more."""
    pairs = candidate_sets(rows, min_shared, members, key, block_sets, depth)
    return pairs.select("a", "b", F.size(F.array_intersect("ordered_a", "ordered_b")).alias("shared")).where(F.col("shared") >= min_shared)
