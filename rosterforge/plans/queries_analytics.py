"""Queries over snapshots, clusters and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.operators import analytics as N
from rosterforge.operators import lineups as L
from rosterforge.operators import snapshots as P
from rosterforge.operators import vectors as V
from rosterforge.plans.queries_lineups import lineup_sql
from rosterforge.plans.queries_search import wide_counted
from rosterforge.plans.registry import query
from rosterforge.plans.storage import materialize
from rosterforge.sources import adapter as A

_DOT = "list_dot_product"
_VOL = "(0.45::DOUBLE * lineup_entropy + 0.35::DOUBLE * (1 - top_lineup_share) + 0.20::DOUBLE * least(1, distinct_lineup_count::DOUBLE / greatest(lineup_count, 1)))"
_C = A.with_frames("snapshot", "cluster_map") + """, mem AS MATERIALIZED (SELECT s.* EXCLUDE (cluster_id), c.cluster_id, c.cluster_size FROM snapshot s JOIN cluster_map c USING (team_id) WHERE c.cluster_id >= 0),
cm AS (SELECT cluster_id, list(x ORDER BY i) AS v FROM (SELECT cluster_id, i, avg(final_vector[i]) AS x FROM mem, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
cen AS MATERIALIZED (SELECT cluster_id, [x / sqrt(list_dot_product(v, v)) for x in v] AS centroid FROM cm),
sim AS MATERIALIZED (SELECT mem.*, list_dot_product(final_vector, centroid) AS similarity FROM mem JOIN cen USING (cluster_id))
"""


def members(spark, d):
    return N.clustered(A.snapshot(spark, d), A.cluster_map(spark, d))


@query(_C + "SELECT cluster_id, i - 1 AS pos, round(centroid[i], 5) + 0.0::DOUBLE AS x FROM cen, range(1, 65) r(i)")
def cluster_centroids(spark, d):
    return N.centroids(members(spark, d)).select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 5) + 0.0).alias("x"))


@query(_C + """, o AS (SELECT a.cluster_id, max(list_dot_product(a.centroid, b.centroid)) AS nearest FROM cen a JOIN cen b ON a.cluster_id <> b.cluster_id GROUP BY 1)
SELECT cluster_id, count(*) AS cluster_size, round(avg(similarity), 4) AS cohesion_mean, round(quantile_cont(similarity, 0.1), 4) AS cohesion_p10, round(coalesce(any_value(nearest), 0), 4) AS nearest_cluster_similarity,
round(avg(similarity) - coalesce(any_value(nearest), 0), 4) AS separation_gap, round(avg(lineup_entropy), 4) AS avg_lineup_entropy FROM sim LEFT JOIN o USING (cluster_id) GROUP BY cluster_id""")
def cluster_health(spark, d):
    h = N.cluster_health(members(spark, d))
    return h.select("cluster_id", "cluster_size", *(F.round(c, 4).alias(c) for c in ("cohesion_mean", "cohesion_p10", "nearest_cluster_similarity", "separation_gap", "avg_lineup_entropy")))


@query(_C + "SELECT cluster_id, place, team_id, lineup_count FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY lineup_count DESC, team_id) AS place FROM mem) WHERE place <= 3")
def cluster_top_members(spark, d):
    return N.top_members(members(spark, d), 3).withColumn("place", F.col("place").cast("long"))


@query(_C + "SELECT count(*) AS teams_indexed, count(c.team_id) AS clustered_teams, count(*) - count(c.team_id) AS noise_teams, count(DISTINCT c.cluster_id) AS cluster_count, round(100.0::DOUBLE * count(c.team_id) / count(*), 2) AS coverage_pct, "
       "round(avg(lineup_count), 2) AS avg_lineups_per_team, round(median(lineup_count), 2) AS median_lineups_per_team FROM snapshot s LEFT JOIN (SELECT * FROM cluster_map WHERE cluster_id >= 0) c USING (team_id)")
def overview_summary(spark, d):
    return N.overview(A.snapshot(spark, d), A.cluster_map(spark, d))


@query(A.with_frames("snapshot") + f"SELECT team_id, round({_VOL}, 6) AS volatility FROM snapshot ORDER BY round({_VOL}, 9) DESC, team_id LIMIT 15")
def volatility_leaders(spark, d):
    return N.leaders(A.snapshot(spark, d), F.round(N.volatility_of(), 9), 15).select("team_id", F.round("score", 6).alias("volatility"))


@query(A.with_frames("snapshot") + "SELECT team_id, lineup_count FROM snapshot ORDER BY lineup_count DESC, team_id LIMIT 15")
def volume_leaders(spark, d):
    return N.leaders(A.snapshot(spark, d), F.col("lineup_count"), 15).select("team_id", "lineup_count")


@query(A.with_frames("snapshot") + f""", v AS (SELECT *, round({_VOL}, 9) AS v FROM snapshot) SELECT 'most_unique' AS kind, team_id, v AS score FROM (FROM v ORDER BY v DESC, team_id LIMIT 1)
UNION ALL SELECT 'most_stable', team_id, v FROM (FROM v ORDER BY v, team_id LIMIT 1) UNION ALL SELECT 'largest_volume', team_id, lineup_count::DOUBLE FROM (FROM v ORDER BY lineup_count DESC, team_id LIMIT 1)""")
def archetypes(spark, d):
    return N.archetypes(A.snapshot(spark, d))


@query(A.with_frames("matches", "cluster_map") + """, k AS (SELECT least(a.cluster_id, b.cluster_id) AS cluster_a, greatest(a.cluster_id, b.cluster_id) AS cluster_b, CASE WHEN winner_team_id = team1_id THEN a.cluster_id WHEN winner_team_id = team2_id THEN b.cluster_id END AS won
  FROM matches JOIN cluster_map a ON a.team_id = team1_id JOIN cluster_map b ON b.team_id = team2_id WHERE a.cluster_id >= 0 AND b.cluster_id >= 0 AND a.cluster_id <> b.cluster_id),
g AS (SELECT cluster_a, cluster_b, count(*) AS matches, count(*) FILTER (WHERE won = cluster_a) AS wins_a, count(*) FILTER (WHERE won = cluster_b) AS wins_b FROM k GROUP BY 1, 2), r AS (SELECT *, wins_a::DOUBLE / matches AS wr FROM g)
SELECT cluster_a, cluster_b, matches, wins_a, wins_b, round(wr, 4) AS win_rate_a, round(1 - wr, 4) AS win_rate_b, round(1 - 2 * abs(wr - 0.5::DOUBLE), 4) AS close_factor, round(matches * (0.4::DOUBLE + 0.6::DOUBLE * (1 - 2 * abs(wr - 0.5::DOUBLE))), 4) AS rivalry_score FROM r""")
def cluster_matchups(spark, d):
    m = N.cluster_matchups(A.matches(spark, d), A.cluster_map(spark, d))
    return m.select("cluster_a", "cluster_b", "matches", "wins_a", "wins_b", *(F.round(c, 4).alias(c) for c in ("win_rate_a", "win_rate_b", "close_factor", "rivalry_score")))


@query(_C + """, st AS (SELECT *, avg(similarity) OVER p AS m, greatest(stddev_pop(similarity) OVER p, 1e-6::DOUBLE) AS s FROM sim WINDOW p AS (PARTITION BY cluster_id))
SELECT team_id, cluster_id, round(similarity, 4) AS cluster_similarity, round(m, 4) AS cluster_mean_similarity, round((m - similarity) / s, 4) + 0.0::DOUBLE AS outlier_z, round(greatest(0, (m - similarity) / s) + 0.35::DOUBLE * (1 - similarity), 4) AS outlier_score FROM st""")
def outliers(spark, d):
    o = N.outliers(members(spark, d))
    return o.select("team_id", "cluster_id", F.round("similarity", 4).alias("cluster_similarity"), F.round("mean", 4).alias("cluster_mean_similarity"), (F.round("z", 4) + 0.0).alias("outlier_z"), F.round("outlier_score", 4).alias("outlier_score"))


_D = A.with_frames("snapshot", "current_snapshot", "previous_snapshot") + f""", dr AS (SELECT c.team_id, greatest(0, 1 - {_DOT}(c.final_vector, p.final_vector)) AS drift, p.cluster_id AS prev_cluster_id, c.cluster_id AS current_cluster_id, p.lineup_count AS lineups_prev, c.lineup_count AS lineups_current
  FROM current_snapshot c JOIN previous_snapshot p USING (team_id))"""


def moves(spark, d):
    return N.drift(A.current_snapshot(spark, d), A.previous_snapshot(spark, d))


@query(_D + "SELECT team_id, round(drift, 4) AS drift, prev_cluster_id, current_cluster_id, lineups_prev, lineups_current FROM dr")
def snapshot_drift(spark, d):
    return moves(spark, d).withColumn("drift", F.round("drift", 4))


@query(_D + """SELECT count(*) AS shared_teams, count(*) FILTER (WHERE current_cluster_id <> prev_cluster_id) AS cluster_switches, 0::BIGINT AS newly_clustered, 0::BIGINT AS newly_noise, round(avg(drift), 4) AS avg_drift, round(quantile_cont(drift, 0.9), 4) AS p90_drift FROM dr""")
def drift_summary(spark, d):
    return N.drift_summary(moves(spark, d))


@query(_D + """SELECT coalesce(c.team_id, p.team_id) AS team_id, CASE WHEN p.team_id IS NULL THEN 'new' WHEN c.team_id IS NULL THEN 'dropped' ELSE 'shared' END AS change FROM current_snapshot c FULL JOIN previous_snapshot p ON c.team_id = p.team_id""")
def drift_membership(spark, d):
    return N.membership_changes(A.current_snapshot(spark, d), A.previous_snapshot(spark, d))


_DIV = lineup_sql(2, 6).replace("WITH appearances", "WITH RECURSIVE snapshot AS (" + A.FRAMES["snapshot"] + "), appearances", 1) + """, ro AS MATERIALIZED (SELECT team_id, list(player_id) AS players FROM support GROUP BY 1),
k AS MATERIALIZED (SELECT team_id, cluster_id, final_vector, players FROM snapshot JOIN ro USING (team_id)),
dp AS MATERIALIZED (SELECT cluster_id, a, b, similarity, s::DOUBLE / (na + nb - s) AS overlap, na + nb - s AS pool, s AS shared FROM (SELECT x.cluster_id, x.team_id AS a, y.team_id AS b, list_dot_product(x.final_vector, y.final_vector) AS similarity,
  len(x.players) AS na, len(y.players) AS nb, len(list_intersect(x.players, y.players)) AS s FROM k x JOIN k y ON x.cluster_id = y.cluster_id AND x.team_id < y.team_id) WHERE similarity >= 0.25 AND s::DOUBLE / (na + nb - s) <= 0.2)
"""


def rosters(spark, d):
    """The rosters of the snapshot's teams."""
    return L.roster(L.player_support(wide_counted(spark, d).join(A.snapshot(spark, d).select("team_id"), "team_id", "left_semi")))


def diverse(spark, d):
    return N.diversity_pairs(A.snapshot(spark, d), rosters(spark, d), 0.25, 0.2)


@query(_DIV + "SELECT cluster_id, a, b, round(similarity, 4) AS similarity, round(overlap, 4) AS overlap, pool, shared FROM dp")
def roster_diversity_pairs(spark, d):
    return diverse(spark, d).withColumns({"similarity": F.round("similarity", 4), "overlap": F.round("overlap", 4)})


@query(_DIV + """, ed AS MATERIALIZED (SELECT a AS x, b AS y FROM dp UNION SELECT b, a FROM dp), rc AS (SELECT x AS n, x AS r FROM ed UNION SELECT ed.y, rc.r FROM rc JOIN ed ON ed.x = rc.n),
comp AS MATERIALIZED (SELECT n AS team_id, min(r) AS cohort_id FROM rc GROUP BY 1), sz AS (SELECT cohort_id, count(*) AS team_count FROM comp GROUP BY 1),
pl AS (SELECT cohort_id, p, count(*) AS n FROM (SELECT cohort_id, unnest(players) AS p FROM comp JOIN ro USING (team_id)) GROUP BY 1, 2),
po AS (SELECT cohort_id, count(*) AS pool, count(*) FILTER (WHERE n = team_count) AS shared_by_all FROM pl JOIN sz USING (cohort_id) GROUP BY 1),
nu AS (SELECT cohort_id, any_value(cluster_id) AS cluster_id, count(*) AS pair_count, round(avg(similarity), 4) AS similarity_avg, round(min(similarity), 4) AS similarity_min, round(max(similarity), 4) AS similarity_max, round(min(overlap), 4) AS overlap_min, round(max(overlap), 4) AS overlap_max
  FROM dp JOIN comp ON comp.team_id = dp.a GROUP BY 1)
SELECT * FROM nu JOIN sz USING (cohort_id) JOIN po USING (cohort_id)""")
def roster_cohorts(spark, d):
    c = N.diversity_cohorts(A.snapshot(spark, d), materialize(rosters(spark, d)), 0.25, 0.2)
    return c.withColumns({k: F.round(k, 4) for k in ("similarity_avg", "similarity_min", "similarity_max", "overlap_min", "overlap_max")})


@query()
def space_projection(spark, d):
    return V.project(A.snapshot(spark, d), 300).select("team_id", "cluster_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_LIST = A.with_frames("snapshot", "cluster_map", "teams")


@query(_LIST + """, m AS (SELECT c.cluster_id, c.cluster_size, s.team_id, lineup_count, name, row_number() OVER (PARTITION BY c.cluster_id ORDER BY lineup_count DESC, s.team_id) AS place FROM snapshot s JOIN cluster_map c USING (team_id) LEFT JOIN teams USING (team_id) WHERE c.cluster_id >= 0)
SELECT cluster_id, cluster_size, count(*) AS teams, sum(lineup_count)::BIGINT AS lineup_count, CASE WHEN cluster_size >= 8 THEN 'stable' WHEN cluster_size >= 4 THEN 'rotational' ELSE 'small' END AS hint, coalesce(string_agg(name, ',' ORDER BY place) FILTER (WHERE place <= 5), '') AS top_teams FROM m GROUP BY 1, 2""")
def cluster_list(spark, d):
    return N.cluster_list(A.snapshot(spark, d), A.cluster_map(spark, d), A.teams(spark, d))


@query(_LIST + "SELECT s.team_id, name, lineup_count, c.cluster_size FROM snapshot s JOIN cluster_map c USING (team_id) LEFT JOIN teams USING (team_id) WHERE c.cluster_id = 4 ORDER BY lineup_count DESC, s.team_id")
def cluster_detail(spark, d):
    m = N.clustered(A.snapshot(spark, d), A.cluster_map(spark, d)).where("cluster_id = 4").join(A.teams(spark, d), "team_id", "left")
    return m.orderBy(F.desc("lineup_count"), "team_id").select("team_id", "name", "lineup_count", "cluster_size")


_RUNS = A.with_frames("runs")
_ORDER = "ORDER BY finished_at_ms DESC NULLS LAST, run_id DESC"


@query(_RUNS + f"SELECT run_id, finished_at_ms FROM runs WHERE status = 'completed' {_ORDER} LIMIT 1")
def latest_snapshot(spark, d):
    return P.latest_completed(A.runs(spark, d)).select("run_id", "finished_at_ms")


@query(_RUNS + f"SELECT run_id, finished_at_ms FROM runs WHERE status = 'completed' {_ORDER} LIMIT 12")
def completed_snapshots(spark, d):
    return P.completed_runs(A.runs(spark, d), 12).select("run_id", "finished_at_ms")


@query(_RUNS + f"SELECT run_id FROM (SELECT run_id, row_number() OVER ({_ORDER}) AS p FROM runs WHERE status = 'completed') WHERE p > 10")
def retained_runs(spark, d):
    return P.expired_runs(A.runs(spark, d), 10).select("run_id")


_SCOPE = (3, 8, 21)


@query(lineup_sql(2, 6) + f""", v AS (SELECT lineup, sum(n)::BIGINT AS n FROM variants WHERE team_id IN {_SCOPE} GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS t FROM v)
SELECT sum(n)::BIGINT AS lineup_count, count(*) AS distinct_lineup_count, round(max(n::DOUBLE / t), 6) AS top_lineup_share, round(sum(-(n::DOUBLE / t) * ln(n::DOUBLE / t)), 6) AS lineup_entropy, round(exp(sum(-(n::DOUBLE / t) * ln(n::DOUBLE / t))), 6) AS effective_lineups,
(SELECT count(DISTINCT player_id) FROM support WHERE team_id IN {_SCOPE}) AS unique_player_count, max(n) AS top_lineup_matches, array_to_string(arg_max(lineup, (n, lineup)), '|') AS top_lineup FROM v, t""")
def team_aggregate(spark, d):
    inside = F.col("team_id").isin(*_SCOPE)
    counts = wide_counted(spark, d).where(inside)
    s = N.scope_aggregate(counts, L.player_support(counts))
    return s.select("lineup_count", "distinct_lineup_count", *(F.round(c, 6).alias(c) for c in ("top_lineup_share", "lineup_entropy", "effective_lineups")), "unique_player_count", "top_lineup_matches", L.key_of(F.col("top_lineup")).alias("top_lineup"))


@query(lineup_sql(2, 6).replace("WITH appearances", "WITH players AS (" + A.FRAMES["players"] + "), appearances", 1) + f"""SELECT player_id, sum(matches)::BIGINT AS matches, coalesce(any_value(nullif(trim(display_name), '')), player_id::VARCHAR) AS name
FROM support LEFT JOIN players USING (player_id) WHERE team_id IN {_SCOPE} GROUP BY player_id ORDER BY matches DESC, player_id LIMIT 10""")
def core_players(spark, d):
    support = L.player_support(wide_counted(spark, d).where(F.col("team_id").isin(*_SCOPE)))
    return N.core_players(support, L.display_names(A.players(spark, d)))
