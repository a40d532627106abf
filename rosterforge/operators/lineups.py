"""Lineups: who played a match for a team, and what follows from counting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.functions.scalars import match_time

DAY_SECONDS = 86_400


def window_bounds(days: int | None, now_ms: int) -> tuple[int | None, int | None]:
    """(since, until) in seconds; no or negative days leave the window open."""
    if days is None or days < 0:
        return None, None
    return (now_ms - days * DAY_SECONDS * 1000) // 1000, now_ms // 1000


def lineup_scan(
    appearances: DataFrame, matches: DataFrame, tournaments: DataFrame, min_players: int = 4, max_players: int = 4,
    since: int | None = None, until: int | None = None,
) -> DataFrame:
    """tournament_id, match_id, team_id, lineup (ascending distinct players), event_time_s.

    Appearances of known matches and tournaments, within [since, until] (seconds), whose number of distinct players is
    in range. Ids of zero and less are dropped first.
    """
    when = match_time(F.col("last_game_finished_at_ms"), F.col("created_at_ms"), F.col("start_time_ms")).alias("event_time_s")
    timed = matches.join(tournaments.select("tournament_id", "start_time_ms"), "tournament_id").select("tournament_id", "match_id", when)
    if since is not None:
        timed = timed.where(F.col("event_time_s") >= since)
    if until is not None:
        timed = timed.where(F.col("event_time_s") <= until)
    valid = appearances.where("player_id > 0 AND team_id > 0").select("tournament_id", "match_id", "team_id", "player_id")
    grouped = valid.groupBy("tournament_id", "match_id", "team_id").agg(F.array_sort(F.collect_set("player_id")).alias("lineup"))
    sized = grouped.where(F.size("lineup").between(min_players, max_players))
    return sized.join(timed, ["tournament_id", "match_id"])


def key_of(lineup: Column) -> Column:
    return F.array_join(lineup.cast("array<string>"), "|")


def variants(lineups: DataFrame) -> DataFrame:
    """team_id, lineup, n: how often a team played each lineup."""
    return lineups.groupBy("team_id", "lineup").agg(F.count(F.lit(1)).alias("n"))


def team_stats(counted: DataFrame) -> DataFrame:
    """Per team: lineups, distinct ones, share of the top one, entropy over its maximum, and the effective number."""
    total = counted.withColumn("total", F.sum("n").over(Window.partitionBy("team_id")))
    p = F.col("n") / F.col("total")
    per = total.groupBy("team_id").agg(
        F.sum("n").alias("lineup_count"), F.count(F.lit(1)).alias("distinct_lineup_count"),
        F.max(p).alias("top_lineup_share"), F.sum(-p * F.log(p + 1e-12)).alias("raw_entropy"),
    )
    normal = F.when(F.col("distinct_lineup_count") > 1, F.col("raw_entropy") / F.log(F.col("distinct_lineup_count").cast("double"))).otherwise(0.0)
    per = per.withColumn("lineup_entropy", normal)
    return per.withColumn("effective_lineups", F.exp("lineup_entropy")).withColumn("effective_lineups_raw", F.exp("raw_entropy")).drop("raw_entropy")


def top_lineup(counted: DataFrame) -> DataFrame:
    """team_id, lineup, n of the most frequent lineup; ties go to the smaller lineup."""
    best = Window.partitionBy("team_id").orderBy(F.desc("n"), F.asc("lineup"))
    return counted.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def merged_top_variant(counted: DataFrame) -> DataFrame:
    """The top lineup by (count, size, ids), as used when rows are merged."""
    return counted.groupBy("team_id").agg(F.max(F.struct("n", F.size("lineup").alias("size"), "lineup")).alias("best")).select(
        "team_id", "best.lineup", "best.n"
    )


def player_support(counted: DataFrame) -> DataFrame:
    """team_id, player_id, matches, support: share of a team's lineups with the player."""
    total = counted.groupBy("team_id").agg(F.sum("n").alias("total"))
    each = counted.select("team_id", "n", F.explode("lineup").alias("player_id")).groupBy("team_id", "player_id").agg(F.sum("n").alias("matches"))
    return each.join(total, "team_id").select("team_id", "player_id", "matches", (F.col("matches") / F.col("total")).alias("support"))


def pairs_of(lineup: Column) -> Column:
    """All (lo, hi) pairs of an ascending array."""
    return F.flatten(F.transform(lineup, lambda a: F.transform(F.filter(lineup, lambda b: b > a), lambda b: F.struct(a.alias("lo"), b.alias("hi")))))


def pair_support(counted: DataFrame) -> DataFrame:
    """team_id, lo, hi, matches, support: share of a team's lineups with both players."""
    total = counted.groupBy("team_id").agg(F.sum("n").alias("total"))
    each = counted.select("team_id", "n", F.explode(pairs_of(F.col("lineup"))).alias("p")).groupBy("team_id", "p.lo", "p.hi").agg(F.sum("n").alias("matches"))
    return each.join(total, "team_id").select("team_id", "lo", "hi", "matches", (F.col("matches") / F.col("total")).alias("support"))


def player_idf(support: DataFrame, cap: float = 3.0) -> DataFrame:
    """player_id, teams, idf = ln((N + 1) / (teams + 1)), capped if cap > 0; N teams have a player at all."""
    n = support.agg(F.countDistinct("team_id").alias("n_teams"))
    each = support.groupBy("player_id").agg(F.countDistinct("team_id").alias("teams"))
    value = F.log((F.col("n_teams") + 1.0) / (F.col("teams") + 1.0))
    # n is one row: a scalar beside every player.
    return each.crossJoin(F.broadcast(n)).select("player_id", "teams", (F.least(value, F.lit(cap)) if cap > 0 else value).alias("idf"))


def roster(support: DataFrame) -> DataFrame:
    """team_id, players (by matches descending, then id), match_counts, unique_player_count."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("matches")).alias("m"), F.col("player_id").alias("p"))))
    per = support.groupBy("team_id").agg(ranked.alias("r"))
    return per.select("team_id", F.transform("r", lambda x: x["p"]).alias("players"), F.transform("r", lambda x: -x["m"]).alias("match_counts"), F.size("r").alias("unique_player_count"))


def tournament_sets(lineups: DataFrame) -> DataFrame:
    return lineups.groupBy("team_id").agg(F.countDistinct("tournament_id").alias("tournament_count"), F.max("event_time_s").alias("event_time_s"))


def player_names(players: DataFrame) -> DataFrame:
    """player_id, name of players whose name is neither blank nor digits only."""
    name = F.trim("display_name")
    return players.where((name != "") & ~name.rlike("^[0-9]+$")).select("player_id", name.alias("name"))


def display_names(players: DataFrame) -> DataFrame:
    """player_id, name for reading: a missing or blank name falls back to the id."""
    return players.select("player_id", F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.col("player_id").cast("string")).alias("name"))


def team_metadata(entries: DataFrame, tournaments: DataFrame) -> DataFrame:
    """team_id, tournament_id, name: a team's entry in its latest tournament (ties to the larger id)."""
    timed = entries.join(tournaments.select("tournament_id", "start_time_ms"), "tournament_id")
    latest = F.max_by(F.struct("tournament_id", "name"), F.struct("start_time_ms", "tournament_id"))
    return timed.groupBy("team_id").agg(latest.alias("m")).select("team_id", "m.tournament_id", "m.name")


def top_lineup_summary(top: DataFrame, names: DataFrame) -> DataFrame:
    """team_id, summary `{n}x:{names}` of the top lineup; players without a name show their id."""
    each = top.select("team_id", "n", F.posexplode("lineup").alias("pos", "player_id")).join(names, "player_id", "left")
    named = each.groupBy("team_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.col("player_id").cast("string")).alias("x")))).alias("l"))
    return named.select("team_id", F.concat(F.col("n").cast("string"), F.lit("x:"), F.array_join(F.transform("l", lambda s: s["x"]), ",")).alias("summary"))


def estimated_top_matches(summary: Column, share: Column, lineup_count: Column) -> Column:
    """Matches of the top lineup: parsed from its summary, else share * count rounded, at least 1."""
    parsed = F.try_element_at(F.regexp_extract_all(F.coalesce(summary, F.lit("")), F.lit(r"^\s*(\d+)x:"), F.lit(1)), F.lit(1)).cast("long")
    return F.greatest(F.coalesce(parsed, F.round(share * lineup_count).cast("long"), F.lit(1)), F.lit(1))
