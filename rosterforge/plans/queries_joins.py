"""Queries over the similarity joins, the greedy clusterings and the stored search, at the default thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.operators import consolidate as C
from rosterforge.operators import lineups as L
from rosterforge.operators import refresh as R
from rosterforge.operators import serving
from rosterforge.operators.set_join import sharing_pairs
from rosterforge.operators.snapshots import SnapshotStore
from rosterforge.operators.vector_join import similarity_join
from rosterforge.plans.queries_lineups import lineups
from rosterforge.plans.queries_search import _CLUSTERS, _DOT, _RERANK, _ROSTER, _TOP, PLAYERS, SCORES, anchor_vector, counted, recursive, top_rows, wide_counted
from rosterforge.plans.registry import query
from rosterforge.plans.storage import materialize, new_folder
from rosterforge.sources import adapter as A

_FAMILY = A.with_frames("family_snapshot").replace("family_snapshot AS", "family_snapshot AS MATERIALIZED")


def _pairs(threshold: float) -> str:
    return f"SELECT a.team_id AS a, b.team_id AS b, {_DOT}(a.final_vector, b.final_vector) AS s FROM family_snapshot a JOIN family_snapshot b ON a.team_id < b.team_id WHERE {_DOT}(a.final_vector, b.final_vector) >= {threshold}"


@query(_TOP + "SELECT a, b, s AS shared FROM sh WHERE s >= 3")
def lineup_sharing_pairs(spark, d):
    """Teams whose top lineups share three players or more."""
    return sharing_pairs(top_rows(spark, d), 3)


@query(_FAMILY + f" SELECT a, b, round(s, 5) AS similarity FROM ({_pairs(0.88)})")
def vector_similarity_pairs(spark, d):
    return similarity_join(A.family_snapshot(spark, d), 0.88).withColumn("similarity", F.round("similarity", 5))


@query(recursive(_FAMILY + f", sim AS MATERIALIZED ({_pairs(0.88)})", "sim", "family_snapshot", _CLUSTERS))
def vector_union_families(spark, d):
    rows = A.family_snapshot(spark, d)
    return C.clusters(rows, C.similar_links(rows, 0.88))


@query(recursive(_FAMILY + f", hy AS MATERIALIZED (SELECT a, b FROM ({_pairs(0.88)}) JOIN family_snapshot x ON x.team_id = a JOIN family_snapshot y ON y.team_id = b WHERE len(list_intersect(x.players, y.players)) >= 0.6::DOUBLE * 5)", "hy", "family_snapshot", _CLUSTERS))
def vector_roster_families(spark, d):
    """Similar vectors whose rosters overlap by 0.60 or more, at the default thresholds of the hybrid clustering."""
    rows = A.family_snapshot(spark, d)
    return C.clusters(rows, C.similar_roster_links(rows, rows.select("team_id", "players")))


def _greedy(threshold: float, size: int) -> str:
    """One seed after another by recursion over the linked teams in order."""
    return _FAMILY.replace("WITH ", "WITH RECURSIVE ", 1) + f""", pr AS MATERIALIZED ({_pairs(threshold)}),
    nb AS (SELECT t, list(o) AS near FROM (SELECT a AS t, b AS o FROM pr UNION SELECT b, a FROM pr UNION SELECT a, a FROM pr UNION SELECT b, b FROM pr) GROUP BY t),
    od AS MATERIALIZED (SELECT t, near, row_number() OVER (ORDER BY lineup_count DESC, t) AS k FROM nb JOIN family_snapshot ON team_id = t),
    g(k, taken, members, num) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], 0::BIGINT UNION ALL
      SELECT k, CASE WHEN len(m) >= {size} THEN taken || m WHEN len(m) > 0 THEN taken || [t] ELSE taken END, CASE WHEN len(m) >= {size} THEN m ELSE [] END, num + (len(m) >= {size})::BIGINT
      FROM (SELECT od.k, od.t, g.taken, g.num, CASE WHEN list_contains(g.taken, od.t) THEN [] ELSE [x for x in od.near if NOT list_contains(g.taken, x)] END AS m FROM g JOIN od ON od.k = g.k + 1))
    SELECT unnest(members) AS team_id, num - 1 AS cluster_id, len(members) AS cluster_size FROM g WHERE len(members) > 0"""


@query(_greedy(0.94, 3))
def greedy_families_strict(spark, d):
    return C.greedy_clusters(A.family_snapshot(spark, d), 0.94, 3)


@query(_greedy(0.90, 2))
def greedy_families_explore(spark, d):
    return C.greedy_clusters(A.family_snapshot(spark, d), 0.90, 2)


def stored(spark, teams, counts) -> serving.StoredSearch:
    """A store with one published snapshot of teams and lineups, opened for searches."""
    store = SnapshotStore(spark, new_folder(spark))
    run_id = store.start_next(1)
    with store.failing(run_id, 2):
        serving.publish(store, run_id, serving.layout(teams, L.player_support(counts), L.pair_support(counts), counts))
    store.mark(run_id, "completed", 2)
    return serving.StoredSearch(store)


@query(_RERANK.replace("r AS (SELECT *, CASE", "t AS (SELECT * FROM c ORDER BY e DESC, team_id LIMIT 200), r AS (SELECT *, CASE").replace("END AS rr FROM c)", "END AS rr FROM t)"))
def stored_whole_set_search(spark, d):
    """The best teams by embedding, reranked, from the serving tables of a stored snapshot."""
    search = stored(spark, A.snapshot(spark, d), materialize(wide_counted(spark, d)))
    profile = search.profile(PLAYERS)
    profile.vector = list(anchor_vector(spark, d))
    found = search.whole_set_search(profile, min_score=-1.0)
    keyed = found.withColumns({k: F.round(k, 9) for k in ("rerank_score", "lineup_overlap", "embed_score")})
    order = [F.desc("rerank_score"), F.desc("lineup_overlap"), F.desc("embed_score"), F.desc("lineup_count"), F.asc("team_id")]
    return keyed.orderBy(*order).limit(30).select("team_id", F.round("rerank_score", 5).alias("rerank_score"), F.round("embed_score", 5).alias("embed_score"))


@query(_ROSTER + f" SELECT team_id, count(*) AS overlap FROM support WHERE player_id IN {PLAYERS} GROUP BY 1")
def stored_targets(spark, d):
    """Teams with any of the players, from the players' buckets of a stored snapshot."""
    return stored(spark, A.snapshot(spark, d), materialize(wide_counted(spark, d))).teams_of(PLAYERS)


@query()
def stored_entity_search(spark, d):
    """The whole search of a player set over a stored snapshot with the hashed vectors of its teams."""
    counts = materialize(counted(spark, d))
    rows = materialize(R.embeddings(counts, L.player_support(counts), R.Settings()))
    out = stored(spark, rows, counts).entity_search(PLAYERS, top_n=10)
    return out.select("place", "group_id", "team_id", "team_ids", "relaxed", "lineup_count", *(F.round(c, 5).alias(c) for c in SCORES))


@query(recursive(_TOP, "el", "top", _CLUSTERS))
def stored_family_profile(spark, d):
    """The family profile of the newest snapshot of a store, after a refresh: one folder of its clusters is read."""
    store = SnapshotStore(spark, new_folder(spark))
    R.refresh(store, L.variants(lineups(spark, d, 3, 6)), 1_700_000_000_000, R.Settings(semantic_dim=16, identity_dim=48))
    return store.clusters("family").select("team_id", "cluster_id", "cluster_size")
