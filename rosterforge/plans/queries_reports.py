"""Queries of ordered lists, look-ups and client views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.operators import lineups as L
from rosterforge.operators import matches as M
from rosterforge.operators import refresh as J
from rosterforge.operators import reports as R
from rosterforge.operators import snapshots as P
from rosterforge.plans import queries_analytics as QA
from rosterforge.plans import queries_matches as QM
from rosterforge.plans.queries_lineups import lineup_sql
from rosterforge.plans.queries_search import wide_counted
from rosterforge.plans.registry import ORACLE, query
from rosterforge.plans.storage import new_folder
from rosterforge.sources import adapter as A


def top(name: str, order: tuple[str, ...], k: int) -> str:
    """The first k rows of a registered query's own SQL, with their place."""
    by = ", ".join(f"{o} NULLS LAST" if "NULLS" not in o else o for o in order)
    return f"SELECT *, row_number() OVER (ORDER BY {by}) AS place FROM ({ORACLE[name]}) QUALIFY place <= {k}"


@query(top("cluster_list", R.CLUSTERS, 8))
def ranked_clusters(spark, d):
    return R.placed(QA.cluster_list(spark, d), R.CLUSTERS, 8)


@query(top("cluster_health", R.HEALTH, 8))
def ranked_health(spark, d):
    return R.placed(QA.cluster_health(spark, d), R.HEALTH, 8)


@query(top("cluster_matchups", R.MATCHUPS, 12))
def ranked_matchups(spark, d):
    return R.placed(QA.cluster_matchups(spark, d), R.MATCHUPS, 12)


@query(top("roster_diversity_pairs", R.DIVERSE_PAIRS, 25))
def ranked_diversity_pairs(spark, d):
    return R.placed(QA.roster_diversity_pairs(spark, d), R.DIVERSE_PAIRS, 25)


@query(top("roster_cohorts", R.COHORTS, 10))
def ranked_cohorts(spark, d):
    return R.placed(QA.roster_cohorts(spark, d), R.COHORTS, 10)


@query(top("outliers", R.OUTLIERS, 15))
def ranked_outliers(spark, d):
    return R.placed(QA.outliers(spark, d), R.OUTLIERS, 15)


@query("SELECT *, lineups_current - lineups_prev AS lineup_delta, row_number() OVER (ORDER BY drift DESC, team_id) AS place FROM (" + ORACLE["snapshot_drift"] + ") QUALIFY place <= 15")
def drift_movers(spark, d):
    return R.drift_movers(QA.moves(spark, d), 15)


_SHIFT = A.with_frames("snapshot", "current_snapshot", "previous_snapshot") + f""", p AS (SELECT team_id, p.lineup_entropy, s.top_lineup_share, s.distinct_lineup_count, p.lineup_count FROM previous_snapshot p JOIN snapshot s USING (team_id)),
n AS (SELECT team_id, {QA._VOL} AS now FROM current_snapshot), o AS (SELECT team_id, {QA._VOL} AS old FROM p),
v AS (SELECT team_id, round(old, 4) AS volatility_prev, round(now, 4) AS volatility_current, round(now - old, 4) + 0.0::DOUBLE AS volatility_delta FROM n JOIN o USING (team_id))
SELECT *, row_number() OVER (ORDER BY abs(volatility_delta) DESC, team_id) AS place FROM v QUALIFY place <= 15"""


@query(_SHIFT)
def volatility_shifts(spark, d):
    old = A.previous_snapshot(spark, d).join(A.snapshot(spark, d).select("team_id", "top_lineup_share", "distinct_lineup_count"), "team_id")
    return R.volatility_shifts(A.current_snapshot(spark, d), old, 15)


_NOISE = A.with_frames("snapshot", "current_snapshot", "previous_snapshot", "cluster_map") + """, j AS (SELECT c.team_id, greatest(0, 1 - list_dot_product(c.final_vector, p.final_vector)) AS drift, coalesce(m.cluster_id, -1) >= 0 AS now_in,
  (c.team_id - 1) % 7 <> 2 AS old_in, m.cluster_id AS now_id, p.cluster_id AS old_id FROM current_snapshot c JOIN previous_snapshot p USING (team_id) LEFT JOIN cluster_map m USING (team_id))
SELECT count(*) AS shared_teams, count(*) FILTER (WHERE now_in AND old_in AND now_id <> old_id) AS cluster_switches, count(*) FILTER (WHERE now_in AND NOT old_in) AS newly_clustered, count(*) FILTER (WHERE old_in AND NOT now_in) AS newly_noise,
round(avg(drift), 4) AS avg_drift, round(quantile_cont(drift, 0.9), 4) AS p90_drift FROM j"""


@query(_NOISE)
def drift_summary_noise(spark, d):
    """Teams enter and leave noise: now by the cluster map; then a seventh of the teams had no cluster."""
    now = A.current_snapshot(spark, d).drop("cluster_id").join(A.cluster_map(spark, d).select("team_id", "cluster_id"), "team_id", "left")
    old = A.previous_snapshot(spark, d).withColumn("cluster_id", F.when((F.col("team_id") - 1) % 7 != 2, F.col("cluster_id")))
    return QA.N.drift_summary(QA.N.drift(now, old))


@query(A.with_frames("runs") + "SELECT * FROM runs WHERE run_id = (SELECT max(run_id) - 5 FROM runs)")
def run_detail(spark, d):
    runs = A.runs(spark, d)
    return R.run_detail(runs, runs.agg(F.max("run_id")).first()[0] - 5)


@query(A.with_frames("cluster_map", "teams") + "SELECT cluster_id, min(name) AS cluster_name FROM cluster_map JOIN teams USING (team_id) WHERE cluster_id >= 0 AND trim(name) <> '' GROUP BY 1")
def cluster_names(spark, d):
    return R.cluster_names(A.cluster_map(spark, d).join(A.teams(spark, d), "team_id"))


_ENRICH = A.with_frames("matches", "tournaments", "match_sides", "players", "rounds") + QM.oriented_sql(QM.TEAM_A, QM.TEAM_B) + """, pn AS (SELECT player_id, coalesce(nullif(trim(display_name), ''), player_id::VARCHAR) AS name FROM players),
sr AS (SELECT match_id, team_id, array_to_string(list(player_id ORDER BY player_id), ',') AS ids, array_to_string(list(name ORDER BY player_id), ',') AS names FROM (SELECT DISTINCT match_id, team_id, player_id FROM match_sides) LEFT JOIN pn USING (player_id) GROUP BY 1, 2),
mr AS (SELECT match_id, number, maps_type AS map_mode, least(greatest(coalesce(maps_count, 1), 1), 20)::INT AS maps_count FROM matches JOIN rounds USING (round_id)),
mm AS (SELECT match_id, coalesce(number, i)::INT AS round_no, i::INT AS map_index, maps_count, map_mode FROM (SELECT *, unnest(range(1, maps_count + 1)) AS i FROM mr)),
en AS (SELECT m.*, coalesce(a.ids, '') AS team_a_players, coalesce(a.names, '') AS team_a_names, coalesce(b.ids, '') AS team_b_players, coalesce(b.names, '') AS team_b_names
  FROM m LEFT JOIN sr a ON a.match_id = m.match_id AND a.team_id = m.team_id LEFT JOIN sr b ON b.match_id = m.match_id AND b.team_id = m.opponent_team_id)
"""


def enriched(spark, d):
    """Matches without a round's number have no maps."""
    maps = M.match_rounds(A.matches(spark, d).where("round_id IS NOT NULL"), A.rounds(spark, d))
    return R.enriched_matches(QM.h2h(spark, d), R.side_rosters(A.match_sides(spark, d), L.display_names(A.players(spark, d))), maps)


_LISTS = ("team_a_players", "team_a_names", "team_b_players", "team_b_names")


@query(_ENRICH + "SELECT match_id, winner_side, " + ", ".join(_LISTS) + ", (SELECT coalesce(string_agg(round_no || ':' || map_index || '/' || maps_count || ' ' || map_mode, ' ' ORDER BY round_no, map_index), '') FROM mm WHERE mm.match_id = en.match_id) AS maps FROM en")
def enriched_matches(spark, d):
    shown = F.transform("match_rounds", lambda m: F.format_string("%d:%d/%d %s", m["round_no"], m["map_index"], m["maps_count"], m["map_mode"]))
    return enriched(spark, d).select("match_id", "winner_side", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in _LISTS), F.array_join(shown, " ").alias("maps"))


@query(_ENRICH + """SELECT en.match_id, round_no, map_index, maps_count, map_mode, winner_side, CASE WHEN map_index IS NULL THEN team_a_score END AS team_a_score, CASE WHEN map_index IS NULL THEN team_b_score END AS team_b_score,
map_index IS NULL AS is_synthetic_round FROM en LEFT JOIN mm ON mm.match_id = en.match_id""")
def match_map_rows(spark, d):
    return R.map_rows(enriched(spark, d)).select("match_id", "round_no", "map_index", "maps_count", "map_mode", "winner_side", "team_a_score", "team_b_score", "is_synthetic_round")


_VIEW = A.with_frames("snapshot", "cluster_map") + """, r AS (SELECT *, row_number() OVER (ORDER BY lineup_count DESC, team_id) AS place FROM snapshot QUALIFY place <= 20)"""


def results(spark, d):
    return R.placed(A.snapshot(spark, d), ("lineup_count DESC", "team_id"), 20)


@query(_VIEW + """, f AS (SELECT lineup_count AS lc, distinct_lineup_count AS dl FROM r WHERE place = 1)
SELECT place, team_id, CASE WHEN place > 1 THEN lineup_count - lc END AS lineup_count_delta, CASE WHEN place > 1 THEN distinct_lineup_count - dl END AS distinct_lineup_count_delta,
CASE WHEN top_lineup_share >= 0.75 THEN 'Very stable core' WHEN top_lineup_share >= 0.5 THEN CASE WHEN distinct_lineup_count > 2 THEN 'Stable core with rotation' ELSE 'Mostly stable core' END WHEN distinct_lineup_count > 3 THEN 'Heavy rotation' ELSE 'Rotating around the core' END AS continuity,
CASE WHEN top_lineup_share >= 0.95 THEN 'High' WHEN top_lineup_share >= 0.85 THEN 'Medium' ELSE 'Low' END AS band FROM r, f""")
def result_view(spark, d):
    rows = R.against_first(results(spark, d), "lineup_count", "distinct_lineup_count")
    share = F.col("top_lineup_share")
    return rows.select("place", "team_id", "lineup_count_delta", "distinct_lineup_count_delta", R.continuity(share, F.col("distinct_lineup_count")).alias("continuity"),
                       R.confidence_band(R.confidence(share, F.lit(None).cast("double"), F.lit(0.5))).alias("band"))


@query(_VIEW + """SELECT count(*) AS result_groups, sum(1 + place % 3)::BIGINT AS teams, count(*) FILTER (WHERE c.cluster_id >= 0) AS clustered, count(*) FILTER (WHERE place % 3 > 0) AS consolidated FROM r LEFT JOIN cluster_map c USING (team_id)""")
def search_summary(spark, d):
    """Groups of one to three teams: every result stands for its own team and the next ones."""
    rows = results(spark, d).drop("cluster_id").join(A.cluster_map(spark, d), "team_id", "left")
    ids = F.sequence(F.col("team_id"), F.col("team_id") + F.col("place") % 3)
    return R.search_summary(rows.select(ids.alias("team_ids"), F.coalesce(F.col("cluster_id") >= 0, F.lit(False)).alias("is_clustered")))


_TEAMS_OF = lineup_sql(2, 6) + ", lc AS (SELECT team_id, sum(n)::BIGINT AS lineup_count FROM variants GROUP BY 1), pt AS (SELECT team_id, matches, lineup_count FROM support JOIN lc USING (team_id) WHERE player_id = 6)"


@query(_TEAMS_OF + """, k AS (SELECT *, row_number() OVER (ORDER BY matches DESC, lineup_count DESC, team_id) AS by_matches, row_number() OVER (ORDER BY lineup_count DESC, matches DESC, team_id) AS by_lineups FROM pt)
SELECT team_id, by_matches, CASE WHEN matches::DOUBLE / lineup_count >= 0.75 THEN 'core' WHEN matches::DOUBLE / lineup_count >= 0.4 THEN 'regular' WHEN matches <= 1 THEN 'one-off' ELSE 'sub' END AS usage,
by_lineups FROM k WHERE by_matches <= 20 AND by_lineups <= 20""")
def player_team_sorts(spark, d):
    """A player's teams by matches and by lineups, those within the first 20 of both."""
    counted = wide_counted(spark, d)
    rows = L.player_support(counted).where("player_id = 6").join(counted.groupBy("team_id").agg(F.sum("n").alias("lineup_count")), "team_id")
    rows = rows.select("team_id", "matches", "lineup_count")
    a, b = (R.placed(rows, R.PLAYER_TEAMS[k], 20).withColumnRenamed("place", f"by_{k}") for k in ("matches", "lineups"))
    both = a.join(b.select("team_id", "by_lineups"), "team_id")
    return both.select("team_id", "by_matches", R.usage(F.col("matches"), F.col("lineup_count"), F.col("by_matches")).alias("usage"), "by_lineups")


@query(lineup_sql(2, 6) + """, t AS (SELECT team_id, sum(n)::BIGINT AS lineup_count, count(*) AS distinct_lineup_count, round(max(n)::DOUBLE / sum(n), 6) AS top_lineup_share FROM variants GROUP BY 1),
b AS (SELECT team_id, array_to_string(lineup, '|') AS top_lineup FROM variants QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY n DESC, lineup) = 1),
s AS (SELECT team_id, count(*)::INT AS unique_player_count, max(matches)::BIGINT AS most_matches FROM support GROUP BY 1)
SELECT *, 64 + 256 AS final_dim FROM t JOIN b USING (team_id) JOIN s USING (team_id)""")
def refreshed_embeddings(spark, d):
    """The refresh job into a new store, and the embeddings read back from its snapshot."""
    store = P.SnapshotStore(spark, new_folder(spark))
    rows = store.read("embeddings", J.refresh(store, wide_counted(spark, d), 1_700_000_000_000))
    return P.of_dimension(rows, 320).select(
        "team_id", "lineup_count", "distinct_lineup_count", F.round("top_lineup_share", 6).alias("top_lineup_share"), L.key_of(F.col("top_lineup")).alias("top_lineup"),
        "unique_player_count", F.col("match_counts")[0].alias("most_matches"), F.size("final_vector").alias("final_dim"))
