"""Match queries: head-to-head, a team's matches, rosters per side, rounds and rollups by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.functions.scalars import match_time, tier

MAX_MAPS = 20


def winner_side(winner: Column, in_a: Column, in_b: Column, score_a: Column, score_b: Column) -> Column:
    """team_a, team_b or null: by the winner's id, else by the higher score."""
    return (
        F.when(winner.isNotNull() & in_a, "team_a").when(winner.isNotNull() & in_b, "team_b")
        .when(score_a > score_b, "team_a").when(score_a < score_b, "team_b")
    )


def oriented(matches: DataFrame, tournaments: DataFrame, team_a: list[int], team_b: list[int] | None) -> DataFrame:
    """Matches of team_a (against team_b, or against anyone outside the scope), seen from team_a's side."""
    first = F.col("team1_id").isin(team_a)
    if team_b is not None:
        wanted = (first & F.col("team2_id").isin(team_b)) | (F.col("team2_id").isin(team_a) & F.col("team1_id").isin(team_b))
    else:
        wanted = first | F.col("team2_id").isin(team_a)
        if len(team_a) > 1:
            wanted = wanted & ~(first & F.col("team2_id").isin(team_a))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    rows = matches.where(wanted).join(tournaments.select("tournament_id", F.col("name").alias("tournament_name"), "start_time_ms"), "tournament_id", "left")
    opponent, winner = pick("team2_id", "team1_id"), F.col("winner_team_id")
    a, b = pick("team1_score", "team2_score"), pick("team2_score", "team1_score")
    side = winner_side(winner, winner == pick("team1_id", "team2_id"), winner == opponent, a, b)
    when = match_time(F.col("last_game_finished_at_ms"), F.col("created_at_ms"), F.col("start_time_ms"))
    return rows.select(
        "match_id", "tournament_id", "tournament_name", "round_id", pick("team1_id", "team2_id").alias("team_id"), opponent.alias("opponent_team_id"),
        a.alias("team_a_score"), b.alias("team_b_score"), "winner_team_id", side.alias("winner_side"), when.alias("event_time_s"),
    )


def newest_first(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.col("event_time_s").desc_nulls_last(), F.desc("match_id")).limit(limit)


def windowed_or_all(rows: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Rows inside the window, or all of them if it is empty; matched_all_time tells which."""
    if since is None:
        return rows.withColumn("matched_all_time", F.lit(False))
    inside = F.col("event_time_s").between(since, until)
    any_inside = rows.agg(F.coalesce(F.max(inside), F.lit(False)).alias("any_inside"))
    return rows.join(F.broadcast(any_inside)).where(~F.col("any_inside") | inside).withColumn("matched_all_time", ~F.col("any_inside")).drop("any_inside")


def results_summary(rows: DataFrame) -> DataFrame:
    """One row: total, decided, wins of each side, unresolved, tournaments and win rates."""
    a, b = F.count_if(F.col("winner_side") == "team_a"), F.count_if(F.col("winner_side") == "team_b")
    rate = lambda x: F.when(a + b > 0, F.round(x / (a + b), 4)).otherwise(0.0)
    return rows.agg(
        F.count(F.lit(1)).alias("total_matches"), (a + b).alias("decided_matches"), a.alias("team_a_wins"), b.alias("team_b_wins"),
        F.count_if(F.col("winner_side").isNull()).alias("unresolved_matches"), F.countDistinct("tournament_id").alias("tournaments"),
        rate(a).alias("team_a_win_rate"), rate(b).alias("team_b_win_rate"),
    )


def tier_distribution(rows: DataFrame, strength: DataFrame) -> DataFrame:
    """tier, tournaments, matches."""
    tiers = rows.join(strength.select("tournament_id", "strength"), "tournament_id", "left").withColumn("tier", tier(F.col("strength")))
    return tiers.groupBy("tier").agg(F.countDistinct("tournament_id").alias("tournaments"), F.count(F.lit(1)).alias("matches"))


def match_rosters(matches: DataFrame, sides: DataFrame, names: DataFrame) -> DataFrame:
    """match_id, side (team1 or team2), players (ascending), names."""
    side = F.when(F.col("team_id") == F.col("team1_id"), "team1").when(F.col("team_id") == F.col("team2_id"), "team2")
    rows = sides.join(matches.select("match_id", "team1_id", "team2_id"), "match_id").withColumn("side", side).where("side IS NOT NULL")
    distinct = rows.select("match_id", "side", "player_id").distinct().join(names, "player_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("player_id", "name")))
    return distinct.groupBy("match_id", "side").agg(ordered.alias("r")).select(
        "match_id", "side", F.transform("r", lambda x: x["player_id"]).alias("players"), F.transform("r", lambda x: x["name"]).alias("names"))


def match_rounds(matches: DataFrame, rounds: DataFrame) -> DataFrame:
    """match_id, round_no, map_index, maps_count, map_mode: a round's maps, clamped to 1..20; without a number the map's index stands in."""
    maps = F.least(F.greatest(F.coalesce("maps_count", F.lit(1)), F.lit(1)), F.lit(MAX_MAPS))
    rows = matches.join(rounds, "round_id", "left").select("match_id", "number", maps.alias("maps_count"), F.col("maps_type").alias("map_mode"))
    rows = rows.withColumn("map_index", F.explode(F.sequence(F.lit(1), F.col("maps_count"))))
    return rows.select("match_id", F.coalesce("number", "map_index").alias("round_no"), "map_index", "maps_count", "map_mode")


def running_map_index(rounds: DataFrame, key: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """map_index per match where none was given, counted on from the last explicit one; positions are consecutive."""
    per = Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.max(F.when(F.col("map_index").isNotNull(), F.col("position"))).over(per)
    last = F.last("map_index", ignorenulls=True).over(per)
    index = F.coalesce("map_index", last + F.col("position") - anchor, F.row_number().over(Window.partitionBy(*key).orderBy("position")))
    return rounds.withColumn("map_index", index)


def by_opponent(rows: DataFrame) -> DataFrame:
    """opponent_team_id, matches, wins, losses, last_played_s."""
    return rows.groupBy("opponent_team_id").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.col("winner_side") == "team_a").alias("wins"),
        F.count_if(F.col("winner_side") == "team_b").alias("losses"), F.max("event_time_s").alias("last_played_s"))


def by_tournament(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tournament_id", "tournament_name").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.col("winner_side") == "team_a").alias("wins"), F.count_if(F.col("winner_side") == "team_b").alias("losses"))


def name_timeline(entries: DataFrame, tournaments: DataFrame) -> DataFrame:
    """team_id, name, first_seen_ms, last_seen_ms, tournaments."""
    return entries.join(tournaments.select("tournament_id", "start_time_ms"), "tournament_id").groupBy("team_id", "name").agg(
        F.min("start_time_ms").alias("first_seen_ms"), F.max("start_time_ms").alias("last_seen_ms"), F.count(F.lit(1)).alias("tournaments"))


def team_sides(matches: DataFrame) -> DataFrame:
    """team_id, match_id, opponent_team_id, is_win, event key of both sides of every decided match."""
    one = lambda me, other: F.struct(F.col(me).alias("team_id"), F.col(other).alias("opponent_team_id"), (F.col("winner_team_id") == F.col(me)).cast("long").alias("is_win"))
    decided = matches.where("winner_team_id IS NOT NULL")
    return decided.select("match_id", "tournament_id", F.explode(F.array(one("team1_id", "team2_id"), one("team2_id", "team1_id"))).alias("s")).select("match_id", "tournament_id", "s.*")


def recent_form(sides: DataFrame, k: int = 5) -> DataFrame:
    """team_id, form (W and L, newest first), wins of the last k decided matches."""
    newest = Window.partitionBy("team_id").orderBy(F.desc("match_id"))
    last = sides.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= k)
    letters = F.array_sort(F.collect_list(F.struct("rn", F.when(F.col("is_win") == 1, "W").otherwise("L").alias("x"))))
    return last.groupBy("team_id").agg(letters.alias("f"), F.sum("is_win").alias("wins")).select("team_id", F.array_join(F.transform("f", lambda s: s["x"]), "").alias("form"), "wins")
