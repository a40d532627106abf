"""Analytics over a snapshot: cluster health, leaders, matchups, outliers, drift and roster diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.functions.scalars import rivalry, stability_hint, volatility
from rosterforge.functions.vectors import dot
from rosterforge.operators.vector_join import nearest_others, similar_within
from rosterforge.operators.vectors import weighted_centroid
from rosterforge.plans.components import connected_components
from rosterforge.plans.storage import materialize


def volatility_of() -> Column:
    return volatility(F.col("lineup_entropy"), F.col("top_lineup_share"), F.col("distinct_lineup_count"), F.col("lineup_count"))


def clustered(rows: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """rows with cluster_id and cluster_size of the map; teams in noise (negative ids) and unmapped ones are left out."""
    return rows.drop("cluster_id").join(cluster_map.where("cluster_id >= 0"), "team_id")


def centroids(members: DataFrame) -> DataFrame:
    """cluster_id, centroid: unit vector of the mean member."""
    return weighted_centroid(members, "final_vector", F.lit(1.0), ["cluster_id"])


def with_centroid_similarity(members: DataFrame) -> DataFrame:
    c = centroids(members)
    return members.join(c, "cluster_id").withColumn("similarity", dot(F.col("final_vector"), F.col("centroid"))).drop("centroid")


def cluster_health(members: DataFrame) -> DataFrame:
    """cluster_id, cluster_size, cohesion_mean, cohesion_p10, nearest_cluster_similarity, separation_gap, avg_lineup_entropy."""
    per = with_centroid_similarity(members).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.avg("similarity").alias("cohesion_mean"),
        F.percentile("similarity", 0.1).alias("cohesion_p10"), F.avg("lineup_entropy").alias("avg_lineup_entropy"),
    )
    nearest = nearest_others(centroids(members).select(F.col("cluster_id").alias("id"), F.col("centroid").alias("v"))).select(F.col("id").alias("cluster_id"), F.col("similarity").alias("nearest"))
    out = per.join(nearest, "cluster_id", "left").withColumn("nearest_cluster_similarity", F.coalesce("nearest", F.lit(0.0)))
    return out.withColumn("separation_gap", F.col("cohesion_mean") - F.col("nearest_cluster_similarity")).drop("nearest")


def top_members(members: DataFrame, k: int) -> DataFrame:
    """cluster_id, place, team_id, lineup_count of the k largest teams of each cluster."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("lineup_count"), "team_id"))
    return members.withColumn("place", place).where(F.col("place") <= k).select("cluster_id", "place", "team_id", "lineup_count")


def overview(rows: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """One row: teams_indexed, clustered_teams, noise_teams, cluster_count, coverage_pct, avg and median lineups per team."""
    named = rows.drop("cluster_id").join(cluster_map.where("cluster_id >= 0").select("team_id", "cluster_id"), "team_id", "left")
    return named.agg(
        F.count(F.lit(1)).alias("teams_indexed"), F.count("cluster_id").alias("clustered_teams"),
        F.count_if(F.col("cluster_id").isNull()).alias("noise_teams"), F.countDistinct("cluster_id").alias("cluster_count"),
        F.round(100.0 * F.count("cluster_id") / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("coverage_pct"),
        F.round(F.avg("lineup_count"), 2).alias("avg_lineups_per_team"), F.round(F.median("lineup_count"), 2).alias("median_lineups_per_team"),
    )


def leaders(rows: DataFrame, by: Column, k: int) -> DataFrame:
    return rows.withColumn("score", by).orderBy(F.desc("score"), "team_id").limit(k)


def archetypes(rows: DataFrame) -> DataFrame:
    """kind, team_id, score: most unique, most stable and largest team; ties to the smaller id."""
    scored = rows.withColumn("v", F.round(volatility_of(), 9))
    best = scored.agg(
        F.max(F.struct("v", -F.col("team_id"))).alias("most_unique"), F.min(F.struct("v", "team_id")).alias("most_stable"),
        F.max(F.struct(F.col("lineup_count").cast("double").alias("v"), -F.col("team_id"))).alias("largest_volume"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.abs(F.col(f"{k}")["col2" if k != "most_stable" else "team_id"]).alias("team_id"), F.col(k)["v"].alias("score")) for k in ("most_unique", "most_stable", "largest_volume")))
    return best.select(F.explode(kinds).alias("k")).select("k.*")


def cluster_matchups(matches: DataFrame, cluster_map: DataFrame, min_matches: int = 1) -> DataFrame:
    """cluster_a < cluster_b, matches, wins and rates of each side, close factor and rivalry score."""
    c = cluster_map.where("cluster_id >= 0").select("team_id", "cluster_id")
    both = matches
    for side in ("1", "2"):
        both = both.join(c.select(F.col("team_id").alias(f"team{side}_id"), F.col("cluster_id").alias(f"c{side}")), f"team{side}_id")
    both = both.where("c1 <> c2").withColumns({"a": F.least("c1", "c2"), "b": F.greatest("c1", "c2")})
    won = F.when(F.col("winner_team_id") == F.col("team1_id"), F.col("c1")).when(F.col("winner_team_id") == F.col("team2_id"), F.col("c2"))
    per = both.withColumn("won", won).groupBy(F.col("a").alias("cluster_a"), F.col("b").alias("cluster_b")).agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.col("won") == F.col("a")).alias("wins_a"), F.count_if(F.col("won") == F.col("b")).alias("wins_b")
    ).where(F.col("matches") >= min_matches)
    rate = F.col("wins_a") / F.col("matches")
    return per.withColumns({"win_rate_a": rate, "win_rate_b": 1.0 - rate, "close_factor": 1.0 - 2.0 * F.abs(rate - 0.5), "rivalry_score": rivalry(F.col("matches"), rate)})


def outliers(members: DataFrame) -> DataFrame:
    """members with similarity to their centroid, its cluster's mean, z and outlier_score."""
    per = Window.partitionBy("cluster_id")
    s = with_centroid_similarity(members)
    s = s.withColumns({"mean": F.avg("similarity").over(per), "std": F.greatest(F.stddev_pop("similarity").over(per), F.lit(1e-6))})
    s = s.withColumn("z", (F.col("mean") - F.col("similarity")) / F.col("std"))
    return s.withColumn("outlier_score", F.greatest(F.lit(0.0), F.col("z")) + 0.35 * (1.0 - F.col("similarity")))


def drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """team_id, drift, clusters and lineup counts then and now of the teams in both snapshots."""
    now = current.select("team_id", F.col("final_vector").alias("v"), F.col("cluster_id").alias("current_cluster_id"), F.col("lineup_count").alias("lineups_current"))
    old = previous.select("team_id", F.col("final_vector").alias("w"), F.col("cluster_id").alias("prev_cluster_id"), F.col("lineup_count").alias("lineups_prev"))
    moved = F.greatest(F.lit(0.0), 1.0 - dot(F.col("v"), F.col("w")))
    return now.join(old, "team_id").select("team_id", moved.alias("drift"), "prev_cluster_id", "current_cluster_id", "lineups_prev", "lineups_current")


def drift_summary(moves: DataFrame) -> DataFrame:
    inside = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False))
    now, old = inside("current_cluster_id"), inside("prev_cluster_id")
    return moves.agg(
        F.count(F.lit(1)).alias("shared_teams"), F.count_if(now & old & (F.col("current_cluster_id") != F.col("prev_cluster_id"))).alias("cluster_switches"),
        F.count_if(now & ~old).alias("newly_clustered"), F.count_if(old & ~now).alias("newly_noise"),
        F.round(F.avg("drift"), 4).alias("avg_drift"), F.round(F.percentile("drift", 0.9), 4).alias("p90_drift"),
    )


def membership_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """team_id, change: shared, new or dropped."""
    a, b = current.select("team_id"), previous.select("team_id")
    tag = lambda frame, name: frame.select("team_id", F.lit(name).alias("change"))
    return tag(a.join(b, "team_id"), "shared").unionByName(tag(a.join(b, "team_id", "left_anti"), "new")).unionByName(tag(b.join(a, "team_id", "left_anti"), "dropped"))


def diversity_pairs(members: DataFrame, rosters: DataFrame, min_similarity: float, max_overlap: float) -> DataFrame:
    """cluster_id, a, b, similarity, overlap, pool, shared: similar teams of a cluster with different players. rosters: team_id, players."""
    known = members.join(rosters.select("team_id", F.col("players").alias("members")), "team_id")
    return similar_within(known, min_similarity, "cluster_id", max_overlap=max_overlap)


def diversity_cohorts(members: DataFrame, rosters: DataFrame, min_similarity: float, max_overlap: float) -> DataFrame:
    """Components of the pairs: cohort_id (smallest team), teams, pairs, roster pool, players common to all, similarity and overlap ranges.

    The pairs stay in the tasks that find them: these give links and sums by team.
    """
    known = members.join(rosters.select("team_id", F.col("players").alias("members")), "team_id")
    sums = materialize(similar_within(known, min_similarity, "cluster_id", max_overlap=max_overlap, sums=True))
    comp = materialize(connected_components(sums.where("a <> b")).select(F.col("node").alias("team_id"), F.col("component").alias("cohort_id")))
    numbers = sums.where("pair_count > 0").join(comp.withColumnRenamed("team_id", "a"), "a").groupBy("cohort_id").agg(
        F.sum("pair_count").alias("pair_count"), (F.sum("similarity_sum") / F.sum("pair_count")).alias("similarity_avg"), F.min("similarity_min").alias("similarity_min"),
        F.max("similarity_max").alias("similarity_max"), F.min("overlap_min").alias("overlap_min"), F.max("overlap_max").alias("overlap_max"), F.first("cluster_id").alias("cluster_id"))
    each = comp.join(rosters.select("team_id", F.explode("players").alias("p")), "team_id")
    size = comp.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("team_count"))
    pool = each.groupBy("cohort_id", "p").agg(F.count(F.lit(1)).alias("n")).join(size, "cohort_id").groupBy("cohort_id", "team_count").agg(
        F.count(F.lit(1)).alias("pool"), F.count_if(F.col("n") == F.col("team_count")).alias("shared_by_all"))
    return numbers.join(pool, "cohort_id")


def cluster_list(rows: DataFrame, cluster_map: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """cluster_id, cluster_size, shown teams, lineups, hint and the names of the k largest teams."""
    members = clustered(rows, cluster_map).join(names, "team_id", "left")
    per = members.groupBy("cluster_id", "cluster_size").agg(F.count(F.lit(1)).alias("teams"), F.sum("lineup_count").alias("lineup_count"))
    top = top_members(members, k).join(names, "team_id", "left").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("t"))
    shown = F.array_join(F.transform("t", lambda s: s["name"]), ",")
    return per.join(top, "cluster_id").select("cluster_id", "cluster_size", "teams", "lineup_count", stability_hint(F.col("cluster_size")).alias("hint"), shown.alias("top_teams"))


def lab_summary(sides: DataFrame, cluster_map: DataFrame, own: list[int]) -> tuple[DataFrame, DataFrame]:
    """(one-row summary, breakdown by opponent cluster) of a scope's decided matches (opponent_team_id, is_win)."""
    mine = cluster_map.where(F.col("team_id").isin(own) & (F.col("cluster_id") >= 0)).agg(F.min("cluster_id").alias("own_cluster"))
    rows = sides.where(~F.col("opponent_team_id").isin(own)).join(cluster_map.select(F.col("team_id").alias("opponent_team_id"), "cluster_id"), "opponent_team_id", "left")
    rows = rows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).join(F.broadcast(mine)).withColumn("same", F.coalesce(F.col("cluster_id") == F.col("own_cluster"), F.lit(False)))
    rate = lambda w, m: F.round(w / F.greatest(m, F.lit(1)), 4)
    n, w = F.count(F.lit(1)), F.coalesce(F.sum("is_win"), F.lit(0))
    same, same_w = F.count_if("same"), F.count_if(F.col("same") & (F.col("is_win") == 1))
    cross, cross_w = F.count_if(~F.col("same")), F.count_if(~F.col("same") & (F.col("is_win") == 1))
    summary = rows.agg(n.alias("matches"), w.alias("wins"), rate(w, n).alias("win_rate"), same.alias("same_cluster_matches"), rate(same_w, same).alias("same_cluster_win_rate"),
                       cross.alias("cross_cluster_matches"), rate(cross_w, cross).alias("cross_cluster_win_rate"))
    breakdown = rows.groupBy("cluster_id").agg(n.alias("matches"), F.sum("is_win").alias("wins"), rate(F.sum("is_win"), n).alias("win_rate"))
    return summary, breakdown.orderBy(F.desc("matches"), "cluster_id").limit(10)


def scope_aggregate(counted: DataFrame, support: DataFrame) -> DataFrame:
    """One row for a scope of aliased teams: merged lineups, top lineup, share, plain entropy and number of players."""
    merged = counted.groupBy("lineup").agg(F.sum("n").alias("n"))
    total = merged.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    stats = merged.join(F.broadcast(total)).agg(
        F.sum("n").alias("lineup_count"), F.count(F.lit(1)).alias("distinct_lineup_count"), F.max(p).alias("top_lineup_share"),
        F.sum(-p * F.log(p)).alias("lineup_entropy"), F.max(F.struct("n", "lineup")).alias("top"))
    players = support.select("player_id").distinct().agg(F.count(F.lit(1)).alias("unique_player_count"))
    return stats.join(F.broadcast(players)).withColumn("effective_lineups", F.exp("lineup_entropy")).select(
        "lineup_count", "distinct_lineup_count", "top_lineup_share", "lineup_entropy", "effective_lineups", "unique_player_count", F.col("top.n").alias("top_lineup_matches"), F.col("top.lineup").alias("top_lineup"))


def core_players(support: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """player_id, matches, name of a scope's players over all its teams, most matches first."""
    per = support.groupBy("player_id").agg(F.sum("matches").alias("matches")).orderBy(F.desc("matches"), "player_id").limit(k)
    return per.join(names, "player_id", "left").select("player_id", "matches", F.coalesce("name", F.col("player_id").cast("string")).alias("name"))
