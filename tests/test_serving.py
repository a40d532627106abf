"""Searches over the serving tables against the same searches over whole frames."""

import random

import numpy as np
import pytest

from rosterforge.operators import entity_search as E
from rosterforge.operators import lineups as L
from rosterforge.operators import refresh as R
from rosterforge.operators import search as S
from rosterforge.operators import serving
from rosterforge.operators.snapshots import SnapshotStore
from rosterforge.plans.storage import materialize


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(12)
    rows = []
    for team in range(1, 121):
        core = rng.sample(range(1 + team % 6 * 10, 14 + team % 6 * 10), 5)
        for lineup in {tuple(sorted(rng.sample(core, 4))) for _ in range(rng.randint(1, 3))}:
            rows.append((team, list(lineup), rng.randint(1, 5)))
    counts = materialize(spark.createDataFrame(rows, "team_id long, lineup array<long>, n long"))
    support, pairs = L.player_support(counts), L.pair_support(counts)
    teams = R.embeddings(counts, support, R.Settings()).selectExpr("*", "team_id * 1000000000 + 1 AS event_time_ms")
    return materialize(teams), materialize(support), materialize(pairs), counts


@pytest.fixture(scope="module")
def stored(spark, frames, tmp_path_factory):
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("store")))
    run_id = store.start(7, 1)
    serving.publish(store, run_id, serving.layout(*frames))
    store.mark(run_id, "completed", 2)
    return serving.StoredSearch(store)


def test_nearest_equals_a_scan_and_skips_cells(frames, stored):
    rows = frames[0].select("team_id", "final_vector").collect()
    for team, k, floor in ((3, 1, 0.0), (40, 5, 0.0), (77, 30, 0.3), (9, 500, -1.0), (5, 10, 0.999)):
        q = next(r.final_vector for r in rows if r.team_id == team)
        scores = sorted(((-float(np.dot(q, r.final_vector)), r.team_id) for r in rows if np.dot(q, r.final_vector) >= floor))[:k]
        found = stored.nearest(q, k, floor)
        assert [r.team_id for r in found.teams.collect()] == [t for _, t in scores]
    assert stored.nearest(rows[0].final_vector, 1).cells_read < len(stored._cells)


def test_only_the_players_folders_are_read(stored):
    plan = stored.index(stored.profile([1, 2])).support._jdf.queryExecution().toString()
    folders = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "bucket" in folders and "player_id" in plan[plan.index("PushedFilters"):]
    files = stored.index(stored.profile([1, 2])).support.inputFiles()
    assert 0 < len(stored._of_players("serving_players", "player_id", [1]).select("player_id", "bucket").distinct().collect()) <= 1 < len(files)


@pytest.mark.parametrize("players,floor,recency", [((1, 2, 3, 4), 0.0, 0.0), ((11, 12, 13, 14, 15, 99), 0.2, 0.3), ((21, 22), 0.9999, 0.0), ((), 0.0, 0.0)])
def test_entity_search_equals_the_scan(frames, stored, players, floor, recency):
    teams, support, pairs, counts = frames
    profile = S.player_profile(players, {r.player_id: r.idf for r in L.player_idf(support).collect()})
    index = S.Index(teams.select("team_id", "final_vector", "lineup_count", "event_time_ms"), support, pairs, counts)
    tops = teams.selectExpr("team_id", "top_lineup AS lineup", "distinct_lineup_count", "top_lineup_share")
    want = E.entity_search(index, tops, profile, 8, floor, 60, recency, 120 * 10**9 + 1).collect() if players else []
    got = stored.entity_search(players, 8, floor, 60, recency).collect() if players else stored.teams_of(players).collect()
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.place, g.group_id, g.team_id, g.team_ids, g.relaxed, g.lineup_count) == (w.place, w.group_id, w.team_id, w.team_ids, w.relaxed, w.lineup_count)
        assert all(abs(g[c] - w[c]) < 1e-9 for c in (*E.PARTS, "rerank_score"))


def test_groups_tied_on_rerank_are_ordered_by_embedding(spark):
    """Two groups with one rerank score: the lineup overlap plays no part in their order."""
    rows = [(1, 0.5, 0.9, 0.2), (2, 0.5, 0.1, 0.4)]
    df = spark.createDataFrame(rows, "team_id long, rerank_score double, lineup_overlap double, embed_score double")
    unchanged = df.selectExpr("team_id AS group_id", "team_id", "array(team_id) AS team_ids", "3L AS lineup_count", "rerank_score", "embed_score", "0.0D AS player_overlap", "0.0D AS pair_overlap", "lineup_overlap")
    rescored, E.rescored = E.rescored, lambda *a: unchanged
    try:
        out = E.finish(df.selectExpr("*", "3L AS lineup_count"), None, None, None, 5, 200, False).collect()
    finally:
        E.rescored = rescored
    assert [r.team_id for r in out] == [2, 1]


def test_no_completed_snapshot_is_an_error(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.start(1, 1)
    with pytest.raises(LookupError):
        serving.StoredSearch(store)
