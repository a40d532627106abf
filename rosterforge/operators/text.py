"""Name search and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.functions.scalars import alnum_key, tokens, trigram_similarity, trigrams

TRIGRAM_THRESHOLD = 0.3

#: Most teams of a tournament that one list may show.
MAX_TEAMS = 700


def name_search(names: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """team_id, priority of rows (team_id, name, lineup_count): exact name, id, same letters and digits, then containment."""
    q = F.lower(F.lit(text.strip()))
    name, ident = F.lower("name"), F.col("team_id").cast("string")
    key = alnum_key(q)
    priority = F.when(name == q, 0).when(ident == q, 1).when((key != "") & (alnum_key(F.col("name")) == key), 2).when(name.contains(q), 3)
    hits = names.withColumn("priority", priority).where("priority IS NOT NULL")
    return hits.orderBy("priority", F.desc("lineup_count"), "team_id").limit(limit).select("team_id", "name", "priority")


def trigram_search(names: DataFrame, text: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """rows with similarity of their name to text of threshold or more."""
    sim = trigram_similarity(trigrams(F.col("name")), trigrams(F.lit(text)))
    return names.withColumn("similarity", sim).where(F.col("similarity") >= threshold)


def token_search(names: DataFrame, text: str, scan: int = 200, limit: int = 20) -> DataFrame:
    """Last resort over the `scan` largest teams: short queries equal a token, longer ones are contained."""
    q = text.strip().lower()
    top = names.orderBy(F.desc("lineup_count"), "team_id").limit(scan)
    hit = F.array_contains(tokens(F.col("name")), q) if len(q) <= 4 else F.lower("name").contains(q)
    return top.where(hit).orderBy(F.desc("lineup_count"), "team_id").limit(limit)


def unique_by_name(names: DataFrame) -> DataFrame:
    """The largest row of each lower-cased name."""
    best = Window.partitionBy(F.lower("name")).orderBy(F.desc("lineup_count"), "team_id")
    return names.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def suggest(names: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Names that start with prefix, then those like it by trigrams; each name once, in order."""
    q = prefix.strip().lower()
    starts = F.lower("name").startswith(q)
    sim = trigram_similarity(trigrams(F.col("name")), trigrams(F.lit(q)))
    hits = unique_by_name(names.withColumns({"starts": starts, "similarity": sim}).where(starts | (sim >= TRIGRAM_THRESHOLD)))
    order = [F.desc("starts"), F.when(F.col("starts"), 0.0).otherwise(-F.col("similarity")), F.lower("name")]
    return hits.orderBy(*order).limit(limit).select("team_id", "name", "starts")


def player_suggest(names: DataFrame, rosters: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """player_id, name, teams of players whose name starts with prefix, most teams first."""
    hits = names.where(F.lower("name").startswith(prefix.strip().lower()))
    per = rosters.join(hits, "player_id").groupBy("player_id", "name").agg(F.countDistinct("team_id").alias("teams"))
    return per.orderBy(F.desc("teams"), F.lower("name"), "player_id").limit(limit)


def player_teams(support: DataFrame, player_id: int, limit: int = 50) -> DataFrame:
    """team_id, matches of a player, most first."""
    return support.where(F.col("player_id") == player_id).select("team_id", "matches").orderBy(F.desc("matches"), "team_id").limit(limit)


def tournament_teams(entries: DataFrame, tournament_id: int, text: str | None = None, limit: int = 100) -> DataFrame:
    """team_id, name of a tournament's teams, filtered by name; unnamed ones last."""
    rows = entries.where(F.col("tournament_id") == tournament_id)
    if text:
        rows = rows.where(F.lower("name").contains(text.strip().lower()))
    return rows.orderBy(F.col("name").asc_nulls_last(), "team_id").limit(limit).select("team_id", "name")


def listed_tournament_teams(entries: DataFrame, rosters: DataFrame, tournament_id: int, text: str = "", limit: int = 100) -> DataFrame:
    """team_id, team_name, display_name, lineup_count, event_time_ms, member_user_ids, member_names, source of a tournament's teams.

    Rows of entries (tournament_id, team_id, name, lineup_count, event_time_ms) that text names come first, the ones with most lineups; only
    if there are none, the remote rosters that text names, in the order of their payload. A text without letters and digits passes all rows;
    limit is held between 1 and 700.
    """
    most, q = max(1, min(limit, MAX_TEAMS)), text.strip().lower()
    key, name = alnum_key(F.lit(q)), F.lower(F.coalesce("name", F.lit("")))
    wanted = (key == "") | name.contains(q) | (alnum_key(name) == key)
    none = lambda kind: F.lit(None).cast(kind)
    shown = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.col("team_id").cast("string"))
    known = entries.where((F.col("tournament_id") == tournament_id) & wanted).orderBy(F.desc("lineup_count"), F.col("name").asc_nulls_last(), "team_id").limit(most).select(
        "team_id", shown.alias("team_name"), shown.alias("display_name"), F.coalesce("lineup_count", F.lit(0)).cast("long").alias("lineup_count"), "event_time_ms",
        F.array().cast("array<long>").alias("member_user_ids"), F.array().cast("array<string>").alias("member_names"), F.lit("dataset").alias("source"),
    )
    unknown = known.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(tournament_id).cast("long").alias("tournament_id"))
    remote = remote_team_match(rosters.where(F.col("tournament_id") == tournament_id), text).join(F.broadcast(unknown), "tournament_id", "left_semi")
    fallback = remote.orderBy("position", "team_id").limit(most).select(
        "team_id", "team_name", "display_name", F.lit(0).cast("long").alias("lineup_count"), none("long").alias("event_time_ms"),
        "member_user_ids", "member_names", F.lit("remote").alias("source"),
    )
    return known.unionByName(fallback)


def remote_team_match(teams: DataFrame, text: str) -> DataFrame:
    """Remote roster rows that text names, by team_name, display_name or one of member_names (as far as teams has these columns).

    A name fits if its letters and digits contain those of text, if it has a short text as a token, or all tokens of text;
    a text without letters and digits passes every row.
    """
    q = text.strip().lower()
    names = [F.array(*(F.col(c) for c in ("team_name", "display_name") if c in teams.columns))]
    if "member_names" in teams.columns:
        names.append(F.coalesce("member_names", F.array().cast("array<string>")))
    key = alnum_key(F.lit(q))
    want = tokens(F.lit(q))

    def fits(name):
        have = tokens(name)
        short = (F.length(key) <= 4) & F.array_contains(have, key)
        return alnum_key(name).contains(key) | short | ((F.size(want) > 0) & (F.size(F.array_except(want, have)) == 0))

    return teams.where((key == "") | F.exists(F.filter(F.concat(*names), lambda n: F.trim(n) != ""), fits))
