"""Queries over lineups and tournaments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterforge.functions.scalars import tier
from rosterforge.operators import lineups as L
from rosterforge.operators import tournaments as T
from rosterforge.plans.registry import query
from rosterforge.sources import adapter as A

#: The window of the windowed queries: a little over four years before this moment.
NOW_MS, DAYS = 880_000_000_000, 1_500

_TIME = """coalesce(CASE WHEN last_game_finished_at_ms >= 1000000000000 THEN last_game_finished_at_ms // 1000 ELSE last_game_finished_at_ms END,
    CASE WHEN created_at_ms >= 1000000000000 THEN created_at_ms // 1000 ELSE created_at_ms END,
    CASE WHEN start_time_ms >= 1000000000000 THEN start_time_ms // 1000 ELSE start_time_ms END)"""


def lineup_sql(low: int = 4, high: int = 4, where: str = "true") -> str:
    """WITH ... lineups(tournament_id, match_id, team_id, lineup, event_time_s), variants, totals."""
    return A.with_frames("appearances", "match_rows", "tournaments") + f""",
timed AS (SELECT m.tournament_id, match_id, {_TIME} AS event_time_s FROM match_rows m JOIN tournaments t USING (tournament_id)),
grouped AS (SELECT tournament_id, match_id, team_id, list_sort(list_distinct(list(player_id))) AS lineup FROM appearances GROUP BY ALL),
lineups AS (SELECT g.*, event_time_s FROM grouped g JOIN timed USING (tournament_id, match_id) WHERE len(lineup) BETWEEN {low} AND {high} AND {where}),
variants AS (SELECT team_id, lineup, count(*) AS n FROM lineups GROUP BY ALL),
totals AS (SELECT team_id, sum(n)::BIGINT AS total FROM variants GROUP BY ALL),
support AS (SELECT team_id, player_id, sum(n)::BIGINT AS matches, sum(n)::DOUBLE / any_value(total) AS support
  FROM (SELECT team_id, n, unnest(lineup) AS player_id FROM variants) JOIN totals USING (team_id) GROUP BY team_id, player_id)
"""


def lineups(spark: SparkSession, d: str, low: int = 4, high: int = 4, **window) -> DataFrame:
    return L.lineup_scan(A.appearances(spark, d), A.match_rows(spark, d), A.tournaments(spark, d), low, high, **window)


def counted(spark: SparkSession, d: str) -> DataFrame:
    return L.variants(lineups(spark, d))


_KEY = "array_to_string(lineup, '|')"


@query(lineup_sql() + f"SELECT tournament_id, match_id, team_id, {_KEY} AS lineup, event_time_s FROM lineups")
def lineup_scan(spark, d):
    return lineups(spark, d).select("tournament_id", "match_id", "team_id", L.key_of(F.col("lineup")).alias("lineup"), "event_time_s")


_SINCE, _UNTIL = L.window_bounds(DAYS, NOW_MS)


@query(lineup_sql(2, 6, f"event_time_s BETWEEN {_SINCE} AND {_UNTIL}") + f"SELECT tournament_id, match_id, team_id, {_KEY} AS lineup, event_time_s FROM lineups")
def lineup_scan_windowed(spark, d):
    rows = lineups(spark, d, 2, 6, since=_SINCE, until=_UNTIL)
    return rows.select("tournament_id", "match_id", "team_id", L.key_of(F.col("lineup")).alias("lineup"), "event_time_s")


@query(lineup_sql() + """, p AS (SELECT team_id, n, n::DOUBLE / total AS p FROM variants JOIN totals USING (team_id)),
s AS (SELECT team_id, sum(n)::BIGINT AS lineup_count, count(*) AS distinct_lineup_count, max(p) AS top_lineup_share, sum(-p * ln(p + 1e-12::DOUBLE)) AS h FROM p GROUP BY team_id),
e AS (SELECT *, CASE WHEN distinct_lineup_count > 1 THEN h / ln(distinct_lineup_count) ELSE 0 END AS x FROM s)
SELECT team_id, lineup_count, distinct_lineup_count, round(top_lineup_share, 6) AS top_lineup_share, round(x, 6) + 0.0::DOUBLE AS lineup_entropy, round(exp(x), 6) AS effective_lineups, round(exp(h), 6) AS effective_lineups_raw FROM e""")
def team_lineup_stats(spark, d):
    s = L.team_stats(counted(spark, d))
    return s.select("team_id", "lineup_count", "distinct_lineup_count", *(F.round(c, 6).alias(c) for c in ("top_lineup_share",)),
                    (F.round("lineup_entropy", 6) + 0.0).alias("lineup_entropy"), F.round("effective_lineups", 6).alias("effective_lineups"), F.round("effective_lineups_raw", 6).alias("effective_lineups_raw"))


@query(lineup_sql() + f"SELECT team_id, {_KEY} AS lineup, n FROM variants QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY n DESC, lineup) = 1")
def team_top_lineup(spark, d):
    return L.top_lineup(counted(spark, d)).select("team_id", L.key_of(F.col("lineup")).alias("lineup"), "n")


@query(lineup_sql(2, 6) + f"SELECT team_id, {_KEY} AS lineup, n FROM variants QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY n DESC, len(lineup) DESC, lineup DESC) = 1")
def merged_top_variant(spark, d):
    return L.merged_top_variant(L.variants(lineups(spark, d, 2, 6))).select("team_id", L.key_of(F.col("lineup")).alias("lineup"), "n")


@query(lineup_sql() + f"SELECT team_id, {_KEY} AS lineup, n FROM variants")
def lineup_variants(spark, d):
    return counted(spark, d).select("team_id", L.key_of(F.col("lineup")).alias("lineup"), "n")


@query(lineup_sql() + "SELECT team_id, player_id, matches, round(support, 6) AS support FROM support")
def player_support(spark, d):
    return L.player_support(counted(spark, d)).withColumn("support", F.round("support", 6))


@query(lineup_sql() + """, m AS (SELECT team_id, n, unnest(lineup) AS a, lineup FROM variants), p AS (SELECT team_id, n, a AS lo, unnest(lineup) AS hi FROM m)
SELECT team_id, lo, hi, sum(n)::BIGINT AS matches, round(sum(n)::DOUBLE / any_value(total), 6) AS support FROM p JOIN totals USING (team_id) WHERE lo < hi GROUP BY team_id, lo, hi""")
def pair_support(spark, d):
    return L.pair_support(counted(spark, d)).withColumn("support", F.round("support", 6))


@query(lineup_sql() + """SELECT player_id, count(DISTINCT team_id) AS teams, round(least(ln(((SELECT count(DISTINCT team_id) FROM support) + 1.0::DOUBLE) / (count(DISTINCT team_id) + 1.0::DOUBLE)), 3.0::DOUBLE), 6) AS idf
FROM support GROUP BY player_id""")
def player_idf(spark, d):
    return L.player_idf(L.player_support(counted(spark, d))).withColumn("idf", F.round("idf", 6))


@query(lineup_sql() + """SELECT team_id, array_to_string(list(player_id ORDER BY matches DESC, player_id), ',') AS players, array_to_string(list(matches ORDER BY matches DESC, player_id), ',') AS match_counts, count(*) AS unique_player_count
FROM support GROUP BY team_id""")
def roster_counts(spark, d):
    r = L.roster(L.player_support(counted(spark, d)))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return r.select("team_id", text("players"), text("match_counts"), F.col("unique_player_count").cast("long").alias("unique_player_count"))


@query(A.with_frames("tournament_teams", "tournaments") + """SELECT team_id, e.tournament_id, e.name FROM tournament_teams e JOIN tournaments t USING (tournament_id)
QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY start_time_ms DESC, e.tournament_id DESC) = 1""")
def team_metadata(spark, d):
    return L.team_metadata(A.tournament_teams(spark, d), A.tournaments(spark, d))


@query(A.with_frames("players") + "SELECT player_id, trim(display_name) AS name FROM players WHERE trim(display_name) <> '' AND NOT regexp_full_match(trim(display_name), '[0-9]+')")
def player_names(spark, d):
    return L.player_names(A.players(spark, d))


@query(A.with_frames("players") + "SELECT player_id, coalesce(nullif(trim(display_name), ''), player_id::VARCHAR) AS name FROM players")
def player_display_names(spark, d):
    return L.display_names(A.players(spark, d))


@query(lineup_sql().replace("WITH appearances", "WITH players AS (" + A.FRAMES["players"] + "), appearances", 1) + """, top AS (SELECT team_id, lineup, n FROM variants QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY n DESC, lineup) = 1),
x AS (SELECT team_id, n, unnest(lineup) AS player_id FROM top), nm AS (SELECT player_id, trim(display_name) AS name FROM players WHERE trim(display_name) <> '' AND NOT regexp_full_match(trim(display_name), '[0-9]+'))
SELECT team_id, n::VARCHAR || 'x:' || string_agg(coalesce(name, player_id::VARCHAR), ',' ORDER BY player_id) AS summary, n AS top_matches FROM x LEFT JOIN nm USING (player_id) GROUP BY team_id, n""")
def top_lineup_summary(spark, d):
    s = L.top_lineup_summary(L.top_lineup(counted(spark, d)), L.player_names(A.players(spark, d)))
    return s.withColumn("top_matches", L.estimated_top_matches(F.col("summary"), F.lit(0.0), F.lit(0)))


_STRENGTH = """
latest AS (SELECT player_id, score, player_rank FROM player_rankings WHERE calculated_at_ms = (SELECT max(calculated_at_ms) FROM player_rankings)),
v{x} AS (SELECT tournament_id, player_id, nullif(player_rank, 0)::DOUBLE AS player_rank, score FROM {source} JOIN latest USING (player_id) WHERE score IS NOT NULL OR nullif(player_rank, 0) IS NOT NULL),
b{x} AS (SELECT *, count(player_rank) OVER t AS n_ranked, count(*) OVER t AS n FROM v{x} WINDOW t AS (PARTITION BY tournament_id)),
p{x} AS (
  SELECT tournament_id, n, player_rank AS value, row_number() OVER (PARTITION BY tournament_id ORDER BY player_rank, player_id) AS place FROM b{x} WHERE player_rank IS NOT NULL
  UNION ALL
  SELECT tournament_id, n, place::DOUBLE, place FROM (SELECT *, n_ranked + row_number() OVER (PARTITION BY tournament_id ORDER BY score DESC, player_id) AS place FROM b{x} WHERE player_rank IS NULL)
),
strength{x} AS (SELECT tournament_id, max(n) AS ranked_players, max(value) FILTER (WHERE place = least(10, n)) AS strength FROM p{x} GROUP BY tournament_id)
"""
_ENTRY = A.with_frames("appearances", "roster_entries", "player_rankings") + "," + _STRENGTH.format(x="", source="roster_entries")


def entry_strength(spark, d):
    return T.strength(A.roster_entries(spark, d), A.player_rankings(spark, d))


@query(_ENTRY + "SELECT tournament_id, ranked_players, strength FROM strength")
def tournament_strength(spark, d):
    return entry_strength(spark, d)


@query(_ENTRY + """SELECT tournament_id, CASE WHEN strength IS NULL THEN 'Unscored' WHEN strength <= 5 THEN 'X' WHEN strength <= 10 THEN 'S+' WHEN strength <= 20 THEN 'S' WHEN strength <= 40 THEN 'A+' WHEN strength <= 80 THEN 'A' ELSE 'A-' END AS tier
FROM tournaments LEFT JOIN strength USING (tournament_id)""".replace("FROM tournaments", f"FROM ({A.FRAMES['tournaments']}) t"))
def tournament_tiers(spark, d):
    scored = A.tournaments(spark, d).select("tournament_id").join(entry_strength(spark, d), "tournament_id", "left")
    return scored.select("tournament_id", tier(F.col("strength")).alias("tier"))


@query(_ENTRY + "," + _STRENGTH[_STRENGTH.index("v{x}"):].format(x="2", source="(SELECT DISTINCT tournament_id, player_id FROM appearances) a") + """
SELECT tournament_id, coalesce(s.strength, s2.strength) AS strength, s.strength IS NOT NULL AS from_entries
FROM strength s FULL JOIN strength2 s2 USING (tournament_id)""")
def tournament_strength_merged(spark, d):
    appeared = T.strength(A.appearances(spark, d).select("tournament_id", "player_id").distinct(), A.player_rankings(spark, d))
    return T.merged_strength(entry_strength(spark, d), appeared)


_W = f"start_time_ms // 1000 BETWEEN {_SINCE} AND {_UNTIL}"


@query(lineup_sql().replace("WITH appearances", "WITH teams AS (" + A.FRAMES["teams"] + "), tournament_teams AS (" + A.FRAMES["tournament_teams"] + "), appearances", 1) + f""",
a AS (SELECT * FROM appearances JOIN tournaments USING (tournament_id)), e AS (SELECT * FROM tournament_teams JOIN tournaments USING (tournament_id)),
c0 AS (SELECT team_id, count(DISTINCT tournament_id) AS c0 FROM a WHERE {_W} GROUP BY 1), c1 AS (SELECT team_id, count(DISTINCT tournament_id) AS c1 FROM a GROUP BY 1),
c2 AS (SELECT team_id, count(DISTINCT tournament_id) AS c2 FROM e WHERE {_W} GROUP BY 1), c3 AS (SELECT team_id, count(DISTINCT tournament_id) AS c3 FROM e GROUP BY 1)
SELECT t.team_id, coalesce(c0, c1, c2, c3, CASE WHEN total > 0 THEN 1 END, 0)::BIGINT AS tournament_count
FROM teams t LEFT JOIN c0 USING (team_id) LEFT JOIN c1 USING (team_id) LEFT JOIN c2 USING (team_id) LEFT JOIN c3 USING (team_id) LEFT JOIN totals USING (team_id)""")
def tournament_counts(spark, d):
    starts = A.tournaments(spark, d).select("tournament_id", "start_time_ms")
    inside = F.floor(F.col("start_time_ms") / 1000).between(_SINCE, _UNTIL)
    a = A.appearances(spark, d).join(starts, "tournament_id")
    e = A.tournament_teams(spark, d).join(starts, "tournament_id")
    return T.tournament_counts(A.teams(spark, d), a.where(inside), a, e.where(inside), e, lineups(spark, d))
