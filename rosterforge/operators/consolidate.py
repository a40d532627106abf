"""Consolidation of aliases: eligible pairs, their components, merged and rescored groups, and clusterings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.functions.scalars import casing_penalty, family_key, near_match, qualifier_penalty
from rosterforge.operators.set_join import sharing_pairs
from rosterforge.operators.vector_join import sharing_stars, similarity_join, similarity_stars
from rosterforge.plans.components import connected_components
from rosterforge.plans.storage import broadcast_if_small, materialize, new_folder, remove_tree

MIN_OVERLAP = 0.72


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def candidate_pairs(rows: DataFrame, lineup: str = "lineup", min_shared: int = 3) -> DataFrame:
    """a, b (a < b): rows that share min_shared players, or have equal lineups."""
    shared = sharing_pairs(rows, min_shared, lineup).select("a", "b")
    few = rows.where(F.size(lineup).between(1, min_shared - 1))  # too few players for the join on prefixes
    same = few.select(F.col("team_id").alias("a"), F.col(lineup).alias("l")).join(few.select(F.col("team_id").alias("b"), F.col(lineup).alias("l")), "l").where("a < b")
    return shared.unionByName(same.select("a", "b"))


def with_sides(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("team_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def near_match_pairs(rows: DataFrame) -> DataFrame:
    """a, b of rows (team_id, lineup) whose lineups nearly match."""
    return with_sides(candidate_pairs(rows), rows, "lineup").where(near_match(F.col("lineup_a"), F.col("lineup_b"))).select("a", "b")


def eligible_pairs(rows: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """a, b of rows that may be one entity: equal or nearly equal top lineups, or an overlap with similar counts.

    rows: team_id, lineup, lineup_count, distinct_lineup_count, top_lineup_share. Candidates share enough players for any of the rules, so
    no pair is lost for min_overlap > 0.
    """
    shared = max(1, min(3, math.ceil(3 * min_overlap - 1e-9)))
    p = with_sides(candidate_pairs(rows, min_shared=shared), rows, "lineup", "lineup_count", "distinct_lineup_count", "top_lineup_share")
    a, b = F.col("lineup_a"), F.col("lineup_b")
    most = F.greatest("lineup_count_a", "lineup_count_b", F.lit(1))
    alike = (
        (F.size(a) >= 3) & (F.size(b) >= 3) & (jaccard(a, b) >= min_overlap)
        & (F.abs(F.col("lineup_count_a") - F.col("lineup_count_b")) <= F.greatest(F.lit(5), F.floor(0.35 * most)))
        & (F.abs(F.col("distinct_lineup_count_a") - F.col("distinct_lineup_count_b")) <= 2.5)
        & (F.abs(F.col("top_lineup_share_a") - F.col("top_lineup_share_b")) <= 0.3)
    )
    return p.where((a == b) | near_match(a, b) | alike).select("a", "b")


def groups(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """team_id, group_id (smallest team of its component) of every row, singletons included."""
    found = connected_components(pairs).select(F.col("node").alias("team_id"), F.col("component").alias("group_id"))
    return rows.select("team_id").join(found, "team_id", "left").select("team_id", F.coalesce("group_id", "team_id").alias("group_id"))


def clusters(rows: DataFrame, pairs: DataFrame, min_size: int = 2) -> DataFrame:
    """team_id, cluster_id, cluster_size: components numbered by size descending, then smallest team; smaller ones dropped."""
    member = groups(rows, pairs)
    sizes = member.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    ordered = member.join(broadcast_if_small(materialize(sizes)), "group_id").select("team_id", F.struct((-F.col("n")).alias("o"), "group_id").alias("g"))
    return numbered(materialize(ordered), "g", F.col("team_id"))


def similar_pairs(rows: DataFrame, threshold: float, vector: str = "final_vector") -> DataFrame:
    """a, b, similarity of all pairs of vectors with a dot product of threshold or more."""
    return similarity_join(rows, threshold, vector)


def similar_links(rows: DataFrame, threshold: float, vector: str = "final_vector") -> DataFrame:
    """a, b: links with the components of similar_pairs(), but not all pairs of a dense group."""
    return similarity_stars(rows, threshold, vector)


def similar_roster_links(rows: DataFrame, rosters: DataFrame, vector_threshold: float = 0.88, min_shared: float = 0.60) -> DataFrame:
    """a, b: links with the components of similar vectors whose rosters share enough of the smaller one. rosters: team_id, players."""
    return sharing_stars(rows, rosters.select("team_id", F.col("players").alias("members")), vector_threshold, min_shared)


def hybrid_links(rows: DataFrame, rosters: DataFrame, vector_threshold: float = 0.88, min_shared: float = 0.60, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """a, b: eligible pairs, and similar vectors that share enough of the smaller roster as links. rosters: team_id, players."""
    return eligible_pairs(rows, min_overlap).unionByName(similar_roster_links(rows, rosters, vector_threshold, min_shared))


#: Named clusterings of rows (team_id, lineup, counts, vectors) and rosters.
CLUSTERINGS = {
    "family": lambda rows, rosters: clusters(rows, eligible_pairs(rows)),
    "vector_union": lambda rows, rosters: clusters(rows, similar_links(rows, 0.88)),
    "hybrid": lambda rows, rosters: clusters(rows, hybrid_links(rows, rosters)),
}


def greedy_clusters(rows: DataFrame, threshold: float, min_size: int, max_teams: int | None = None, vector: str = "final_vector") -> DataFrame:
    """team_id, cluster_id, cluster_size: teams in order of lineup_count (largest first, then id) take the unassigned teams within threshold.

    A team that finds fewer than min_size teams, itself included, is used up alone. max_teams: only so many of the largest teams take part.
    """
    if max_teams is not None:
        rows = rows.orderBy(F.desc("lineup_count"), "team_id").limit(max_teams)
    rows = materialize(rows.select("team_id", "lineup_count", vector))
    return greedy_choice(rows, similar_pairs(rows, threshold, vector).select("a", "b"), min_size)


def greedy_choice(rows: DataFrame, pairs: DataFrame, min_size: int) -> DataFrame:
    """team_id, cluster_id, cluster_size of the sequential choice over rows (team_id, lineup_count) linked by pairs, in parallel rounds.

    Links point from the earlier team to the later one. An open team that no chosen team reaches and that no open team comes before among its links will be a seed: nobody
    can take it any more. It is chosen if the teams that no earlier open team reaches are enough for it, used up alone if all that it may still take are too few, and else
    waits; from min_size 2 on down it is chosen at once, as a seed without a member changes nothing. A team that a chosen one reaches is no seed, and belongs to the earliest chosen one that reaches it,
    so links to it from later teams go, and so do those from teams that are decided. The first open team is always decided, so rounds end; each round is written out, and
    clusters are numbered in the order of their seeds.
    """
    spark = rows.sparkSession
    held, at = new_folder(spark), new_folder(spark)
    key = F.struct((-F.col("lineup_count")).alias("o"), F.col("team_id").alias("t"))
    keys = materialize(rows.select("team_id", key.alias("k")), held)
    named = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        named = named.join(broadcast_if_small(keys.select(F.col("team_id").alias(side), F.col("k").alias(f"k{side}"))), side)
    links = materialize(named.select(F.least("ka", "kb").alias("e"), F.greatest("ka", "kb").alias("l")), at)
    owners = materialize(links.select("l", F.col("e").alias("m")).limit(0), at)
    while not links.isEmpty():
        first = materialize(links.groupBy("l").agg(F.min("e").alias("first")), at)
        reached = broadcast_if_small(first.select("l").union(owners.select("l")).distinct().withColumnRenamed("l", "e"))
        per = links.join(broadcast_if_small(first), "l").groupBy("e").agg(F.count(F.lit(1)).alias("most"), F.count_if(F.col("first") == F.col("e")).alias("sure")).join(reached, "e", "left_anti")
        chosen = F.lit(True) if min_size <= 2 else F.col("sure") >= min_size - 1
        decided = materialize(per.select("e", chosen.alias("chosen")).where(F.col("chosen") | (F.col("most") < min_size - 1)), at)
        won = links.join(broadcast_if_small(decided.where("chosen").select("e")), "e").select("l", F.col("e").alias("m"))
        done, at = at, new_folder(spark)
        owners = materialize(owners.unionByName(won).groupBy("l").agg(F.min("m").alias("m")), at)
        closed = broadcast_if_small(decided.select("e").union(owners.select("l")).distinct())
        left = links.join(closed, "e", "left_anti").join(broadcast_if_small(owners), "l", "left")
        links = materialize(left.where("m IS NULL OR e < m").select("e", "l"), at)
        remove_tree(spark, done)
    seeds = keys.join(broadcast_if_small(owners.select(F.col("l").alias("k"))), "k", "left_anti").select("k") if min_size <= 1 else owners.select(F.col("m").alias("k")).distinct()
    every = materialize(owners.select(F.col("m").alias("seed"), F.col("l").alias("k")).unionByName(seeds.select(F.col("k").alias("seed"), "k")))
    for folder in (held, at):
        remove_tree(spark, folder)
    return numbered(every, "seed", F.col("k.t"))


def numbered(members: DataFrame, group: str, team: Column) -> DataFrame:
    """team_id, cluster_id, cluster_size: groups numbered from 0 in order of their key, without a window over all of them."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("cluster_size"))
    placed = materialize(sizes.repartitionByRange(group).sortWithinPartitions(group).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    parts = placed.groupBy("part").agg(F.min("row").alias("begin"), F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    ids = placed.join(F.broadcast(parts.drop("n")), "part").select(group, "cluster_size", (F.col("before") + F.col("row") - F.col("begin")).alias("cluster_id"))
    return members.join(broadcast_if_small(materialize(ids)), group).select(team.alias("team_id"), "cluster_id", "cluster_size")


def representative_names(members: DataFrame, family: bool) -> DataFrame:
    """cluster_id, name of members (cluster_id, team_id, name, lineup_count, event_time_ms)."""
    named = members.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Team "), F.col("team_id").cast("string"))))
    exact = named.groupBy("cluster_id", "name").agg(F.sum("lineup_count").alias("weight"), F.max("event_time_ms").alias("latest"))
    if family:
        exact = exact.withColumn("bucket", F.coalesce(F.nullif(family_key(F.col("name")), F.lit("")), F.lower("name")))
        buckets = exact.groupBy("cluster_id", "bucket").agg(F.sum("weight").alias("bw"), F.max("latest").alias("bl"), F.max("weight").alias("most"))
        first = Window.partitionBy("cluster_id").orderBy(F.desc("bw"), F.desc("bl"), "bucket")
        won = buckets.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("cluster_id", "bucket", "most")
        exact = exact.join(won, ["cluster_id", "bucket"]).where(F.col("weight") >= F.greatest(F.lit(1), F.ceil(F.col("most") * 0.4)))
        order = [qualifier_penalty(F.col("name")), casing_penalty(F.col("name")), F.desc("weight"), F.desc("latest"), F.length("name"), F.lower("name"), F.col("name")]
    else:
        order = [F.desc("weight"), F.lower("name"), F.col("name")]
    best = Window.partitionBy("cluster_id").orderBy(*order)
    return exact.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("cluster_id", "name")


def canonical_name(members: DataFrame) -> DataFrame:
    """group_id, name with the most lineups; shorter, then alphabetical names win ties."""
    per = members.where(F.trim("name") != "").groupBy("group_id", "name").agg(F.sum("lineup_count").alias("w"))
    best = Window.partitionBy("group_id").orderBy(F.desc("w"), F.length("name"), F.lower("name"), "name")
    return per.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("group_id", "name")


def merged_groups(rows: DataFrame, member: DataFrame) -> DataFrame:
    """group_id, members, lineup_count, team_ids of consolidated rows."""
    return rows.join(member, "team_id").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"), F.sum("lineup_count").alias("lineup_count"), F.array_sort(F.collect_list("team_id")).alias("team_ids")
    )


def merged_variants(counted: DataFrame, member: DataFrame) -> DataFrame:
    """group_id, lineup, n summed over a group's teams."""
    return counted.join(member, "team_id").groupBy("group_id", "lineup").agg(F.sum("n").alias("n"))


def merged_support(support: DataFrame, rows: DataFrame, member: DataFrame, keys: list[str]) -> DataFrame:
    """group_id, keys..., support: mean of the members' support weighted by max(lineup_count, 1), absent keys counting as zero."""
    weighted = rows.join(member, "team_id").select("team_id", "group_id", F.greatest(F.col("lineup_count"), F.lit(1)).alias("w"))
    total = weighted.groupBy("group_id").agg(F.sum("w").alias("total"))
    sums = support.join(weighted, "team_id").groupBy("group_id", *keys).agg(F.sum(F.col("w") * F.col("support")).alias("s"))
    return sums.join(total, "group_id").select("group_id", *keys, (F.col("s") / F.col("total")).alias("support"))
