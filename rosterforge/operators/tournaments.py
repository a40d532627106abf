"""Tournament strength, tiers and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRENGTH_POSITION = 10


def latest_rankings(rankings: DataFrame) -> DataFrame:
    """player_id, score, player_rank of the latest calculation."""
    newest = rankings.agg(F.max("calculated_at_ms").alias("newest"))
    return rankings.join(F.broadcast(newest), F.col("calculated_at_ms") == F.col("newest")).select("player_id", "score", "player_rank")


def strength(rosters: DataFrame, rankings: DataFrame, position: int = STRENGTH_POSITION) -> DataFrame:
    """tournament_id, ranked_players, strength: the rank at place min(position, players) of a tournament's players.

    Players with a rank come first, by rank; those without (a rank of 0 is none) follow by score, and their place is their rank.
    Players with neither are left out.
    """
    known = rosters.join(latest_rankings(rankings), "player_id").withColumn("rank", F.nullif(F.col("player_rank"), F.lit(0.0)))
    known = known.where("rank IS NOT NULL OR score IS NOT NULL")
    per = Window.partitionBy("tournament_id")
    order = per.orderBy(F.col("rank").isNull(), F.coalesce(F.col("rank"), -F.col("score")), "player_id")
    placed = known.withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(per))
    value = F.coalesce("rank", F.col("place").cast("double"))
    at = F.max(F.when(F.col("place") == F.least(F.lit(position), F.col("n")), value))
    return placed.groupBy("tournament_id").agg(F.max("n").alias("ranked_players"), at.alias("strength"))


def merged_strength(registered: DataFrame, appeared: DataFrame) -> DataFrame:
    """Strength from registrations where there are any, else from appearances."""
    a, b = registered.withColumnRenamed("strength", "by_entry"), appeared.select("tournament_id", F.col("strength").alias("by_appearance"))
    return a.join(b, "tournament_id", "full").select(
        "tournament_id", F.coalesce("by_entry", "by_appearance").alias("strength"), F.col("by_entry").isNotNull().alias("from_entries")
    )


def tournament_counts(teams: DataFrame, windowed: DataFrame, unbounded: DataFrame, entries_windowed: DataFrame, entries: DataFrame, lineups: DataFrame) -> DataFrame:
    """team_id, tournament_count: appearances in the window, else ever, else registrations in the window, else ever, else 1 with any lineup."""
    out = teams.select("team_id")
    for k, frame in enumerate((windowed, unbounded, entries_windowed, entries)):
        out = out.join(frame.groupBy("team_id").agg(F.countDistinct("tournament_id").alias(f"c{k}")), "team_id", "left")
    out = out.join(lineups.groupBy("team_id").agg(F.count(F.lit(1)).alias("lineup_count")), "team_id", "left")
    one = F.when(F.col("lineup_count") > 0, F.lit(1).cast("long"))
    return out.select("team_id", F.coalesce("c0", "c1", "c2", "c3", one, F.lit(0)).cast("long").alias("tournament_count"))
