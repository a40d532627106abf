"""Ordered lists, look-ups and client views over the results of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.operators import analytics as N

#: Orders of the lists; the last key makes each one definite.
CLUSTERS = ("cluster_size DESC", "cluster_id")
HEALTH = ("cluster_size DESC", "separation_gap DESC", "cohesion_mean DESC", "cluster_id")
MATCHUPS = ("rivalry_score DESC", "matches DESC", "cluster_a", "cluster_b")
DIVERSE_PAIRS = ("pool DESC", "similarity DESC", "overlap", "a", "b")
COHORTS = ("pool DESC", "pair_count DESC", "similarity_avg DESC", "cohort_id")
MOVERS = ("drift DESC", "team_id")
OUTLIERS = ("outlier_score DESC", "team_id")
PLAYER_TEAMS = {
    "matches": ("matches DESC", "lineup_count DESC", "team_id"),
    "lineups": ("lineup_count DESC", "matches DESC", "team_id"),
    "recency": ("event_time_ms DESC NULLS LAST", "team_id"),
}


def placed(rows: DataFrame, order: tuple[str, ...], k: int) -> DataFrame:
    """The first k rows in an order ("column" or "column DESC"), with their place from 1."""
    keys = [F.expr(o.split()[0]).desc_nulls_last() if "DESC" in o else F.expr(o).asc_nulls_last() for o in order]
    # The window sees k rows.
    return rows.orderBy(*keys).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long"))


def drift_movers(moves: DataFrame, k: int = 15) -> DataFrame:
    """The k teams whose vectors moved most between two snapshots, with the change of their lineup count."""
    rows = moves.withColumns({"drift": F.round("drift", 4), "lineup_delta": F.col("lineups_current") - F.col("lineups_prev")})
    return placed(rows, MOVERS, k)


def volatility_shifts(current: DataFrame, previous: DataFrame, k: int = 15) -> DataFrame:
    """place, team_id, volatility then, now and the difference; the k largest differences of either sign."""
    now = current.select("team_id", N.volatility_of().alias("now"))
    old = previous.select("team_id", N.volatility_of().alias("old"))
    rows = now.join(old, "team_id").select(
        "team_id", F.round("old", 4).alias("volatility_prev"), F.round("now", 4).alias("volatility_current"), (F.round(F.col("now") - F.col("old"), 4) + 0.0).alias("volatility_delta"))
    return placed(rows.withColumn("size", F.abs("volatility_delta")), ("size DESC", "team_id"), k).drop("size")


def run_detail(runs: DataFrame, run_id: int) -> DataFrame:
    """All columns of one run; no row if there is none."""
    return runs.where(F.col("run_id") == run_id).limit(1)


def cluster_names(clusters: DataFrame) -> DataFrame:
    """cluster_id, cluster_name: the smallest name that isn't blank of each cluster (cluster_id, name); noise has none."""
    named = clusters.where((F.col("cluster_id") >= 0) & (F.trim("name") != ""))
    return named.groupBy("cluster_id").agg(F.min("name").alias("cluster_name"))


def side_rosters(sides: DataFrame, names: DataFrame) -> DataFrame:
    """match_id, team_id, players (ascending) with their names, of the players of a match's sides."""
    listed = sides.select("match_id", "team_id", "player_id").distinct().join(names, "player_id", "left")
    per = listed.groupBy("match_id", "team_id").agg(F.array_sort(F.collect_list(F.struct("player_id", F.col("name")))).alias("r"))
    return per.select("match_id", "team_id", F.col("r.player_id").alias("players"), F.col("r.name").alias("names"))


def enriched_matches(rows: DataFrame, rosters: DataFrame, rounds: DataFrame) -> DataFrame:
    """Oriented matches with both rosters and the maps played, by round and map; a match without either has empty lists."""
    held = rosters.join(rows.select("match_id"), "match_id", "left_semi")
    out = rows
    for side, team in (("team_a", "team_id"), ("team_b", "opponent_team_id")):
        of_side = held.select("match_id", F.col("team_id").alias(team), F.col("players").alias(f"{side}_players"), F.col("names").alias(f"{side}_names"))
        out = out.join(of_side, ["match_id", team], "left")
        for c in (f"{side}_players", f"{side}_names"):
            out = out.withColumn(c, F.coalesce(c, F.array().cast(out.schema[c].dataType)))
    played = F.struct(F.col("round_no").isNull().alias("unknown"), "round_no", "map_index", "maps_count", "map_mode")
    maps = rounds.join(rows.select("match_id"), "match_id", "left_semi").groupBy("match_id").agg(F.array_sort(F.collect_list(played)).alias("match_rounds"))
    out = out.join(maps, "match_id", "left")
    return out.withColumn("match_rounds", F.coalesce("match_rounds", F.array().cast(out.schema["match_rounds"].dataType)))


def map_rows(matches: DataFrame) -> DataFrame:
    """One row a map of enriched matches; a match without maps is one synthetic row that carries the match's scores."""
    rows = matches.withColumn("m", F.explode_outer("match_rounds")).drop("match_rounds")
    synthetic = F.col("m").isNull()
    rows = rows.withColumns({c: F.when(synthetic, F.col(c)) for c in ("team_a_score", "team_b_score")})
    return rows.select("*", "m.round_no", "m.map_index", "m.maps_count", "m.map_mode", synthetic.alias("is_synthetic_round")).drop("m")


def search_summary(results: DataFrame) -> DataFrame:
    """One row over results (team_ids, is_clustered): result_groups, teams, clustered and consolidated ones."""
    size = F.greatest(F.size("team_ids"), F.lit(1))
    return results.agg(
        F.count(F.lit(1)).alias("result_groups"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("teams"),
        F.count_if("is_clustered").alias("clustered"), F.count_if(size > 1).alias("consolidated"))


def against_first(results: DataFrame, *columns: str) -> DataFrame:
    """Placed results with the difference of each column to the first place's; null for the first place."""
    first = results.where("place = 1").select(*(F.col(c).alias(f"__{c}") for c in columns))
    out = results.join(F.broadcast(first))  # one row
    return out.withColumns({f"{c}_delta": F.when(F.col("place") > 1, F.col(c) - F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def confidence(overall: Column, semantic: Column, identity: Column) -> Column:
    """The overall similarity, or the mean of the known others; between 0 and 1."""
    clamp = lambda c: F.when(c.isNotNull() & ~F.isnan(c), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    s, i = clamp(semantic), clamp(identity)
    return F.coalesce(clamp(overall), (s + i) / 2, s, i)


def confidence_band(score: Column) -> Column:
    return F.when(score.isNull(), "n/a").when(score >= 0.95, "High").when(score >= 0.85, "Medium").otherwise("Low")


def continuity(top_share: Column, distinct_lineups: Column) -> Column:
    """How steady a team's lineup is, in words."""
    return (
        F.when(top_share.isNull(), "Continuity unavailable").when(top_share >= 0.75, "Very stable core")
        .when((top_share >= 0.5) & (distinct_lineups > 2), "Stable core with rotation").when(top_share >= 0.5, "Mostly stable core")
        .when(distinct_lineups > 3, "Heavy rotation").otherwise("Rotating around the core"))


def usage(matches: Column, of: Column, place: Column) -> Column:
    """A player's part in a team: matches played of the team's `of`; place counts from 1 and decides where `of` is unknown."""
    share = matches / of
    known = F.when(share >= 0.75, "core").when(share >= 0.4, "regular").when(matches <= 1, "one-off").otherwise("sub")
    return F.when(matches <= 0, "top-lineup reference").when(of <= 0, F.when(place <= 4, "core").otherwise("sub")).otherwise(known)
