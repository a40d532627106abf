import json

import pytest
from pyspark.sql import functions as F

from rosterforge.functions import scalars
from rosterforge.functions.hashing import slots
from rosterforge.operators import analytics, consolidate, lineups, matches, refresh, reports, scope, search, snapshots, text, tournaments, vectors
from rosterforge.plans.components import connected_components
from rosterforge.sources import remote_roster


def test_hash_anchors():
    want = {1: (58, -1, 94, 1), 2: (10, 1, 152, 1), 3: (6, 1, 143, -1), 4: (26, -1, 81, 1), 99: (32, 1, 53, -1), 22614: (54, 1, 214, -1)}
    assert {p: slots(p) for p in want} == want


def test_tiers(spark):
    cases = {5.0: "X", 5.1: "S+", 10.0: "S+", 10.1: "S", 20.0: "S", 20.1: "A+", 40.0: "A+", 40.1: "A", 80.0: "A", 80.1: "A-", 160.0: "A-", 500.0: "A-", None: "Unscored"}
    rows = spark.createDataFrame([(k,) for k in cases], "s double").select("s", scalars.tier(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == cases


def test_epoch_normalisation_and_clamp(spark):
    r = spark.sql("SELECT 999999999999L AS a, 1000000000000L AS b, double('NaN') AS c").select(
        scalars.epoch_seconds(F.col("a")).alias("a"), scalars.epoch_seconds(F.col("b")).alias("b"), scalars.clamp01(F.col("c"), 0.5).alias("c")).first()
    assert (r.a, r.b, r.c) == (999_999_999_999, 1_000_000_000, 0.5)


@pytest.mark.parametrize(("a", "b", "want"), [
    ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6], True), ([1, 2, 3, 4, 5], [1, 2, 3, 6, 7], False), ([1, 2, 3, 4], [1, 2, 3, 5], True),
    ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7], True), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 7, 8, 9], False), ([1, 2], [1, 2], False), ([], [1, 2, 3], False),
])
def test_near_match(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert df.select(scalars.near_match(F.col("a"), F.col("b"))).first()[0] is want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_threshold_and_vector_union(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.2, 0.98])], "team_id long, final_vector array<double>")
    scored = vectors.neighbors(rows, [1.0, 0.0], 10).withColumnRenamed("similarity", "embed_score")
    assert sorted(r.team_id for r in vectors.above_threshold(scored, 0.85).collect()) == [1, 2]
    assert [(r.a, r.b) for r in consolidate.similar_pairs(rows, 0.9).collect()] == [(1, 2)]


def test_matchups(spark):
    m = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (1, 2, 2)], "team1_id long, team2_id long, winner_team_id long")
    c = spark.createDataFrame([(1, 1), (2, 2)], "team_id long, cluster_id long")
    r = analytics.cluster_matchups(m, c).first()
    assert (r.cluster_a, r.cluster_b, r.matches, r.wins_a, r.wins_b) == (1, 2, 3, 1, 2)


def test_exact_signature_merges_whatever_the_counts(spark):
    rows = spark.createDataFrame([(1, [1, 2], 500, 9, 0.9), (2, [1, 2], 30, 1, 0.13), (3, [4, 5], 3, 1, 1.0)],
                                 "team_id long, lineup array<long>, lineup_count long, distinct_lineup_count long, top_lineup_share double")
    assert [(r.a, r.b) for r in consolidate.eligible_pairs(rows).collect()] == [(1, 2)]


def test_near_matches_are_transitive(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3, 4, 5], 40, 4, 0.5), (2, [1, 2, 3, 4, 6], 30, 4, 0.5), (3, [1, 2, 3, 6, 4], 20, 4, 0.5)],
                                 "team_id long, lineup array<long>, lineup_count long, distinct_lineup_count long, top_lineup_share double")
    rows = rows.withColumn("lineup", F.array_sort("lineup"))
    got = consolidate.merged_groups(rows, consolidate.groups(rows, consolidate.eligible_pairs(rows))).collect()
    assert [(r.members, r.lineup_count) for r in got] == [(3, 90)]


def test_scope_aggregate(spark):
    counted = spark.createDataFrame([(1, [1, 2, 3, 4], 4), (1, [1, 2, 3, 5], 2), (2, [1, 2, 3, 4], 3), (2, [1, 2, 4, 5], 1)], "team_id long, lineup array<long>, n long")
    r = analytics.scope_aggregate(counted, lineups.player_support(counted)).first()
    assert (r.lineup_count, r.distinct_lineup_count, r.top_lineup_matches, round(r.top_lineup_share, 3), r.unique_player_count) == (10, 3, 7, 0.7, 5)


def test_running_map_index(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 4), (1, 3, None), (1, 4, None), (2, 1, None)], "match_id long, position int, map_index int")
    got = {(r.match_id, r.position): r.map_index for r in matches.running_map_index(rows).collect()}
    assert got == {(1, 1): 1, (1, 2): 4, (1, 3): 5, (1, 4): 6, (2, 1): 1}


def test_subset_projection_counts_subsets(spark):
    rosters = spark.createDataFrame([(101, p, 5, 4) for p in (1, 2, 3, 4)] + [(202, p, 9, 4) for p in (4, 5, 6, 7)] + [(303, 50, 1, 1)],
                                    "team_id long, player_id long, lineup_count long, roster_size long")
    got = {r.team_id for r in search.subset_projection(rosters, range(1, 8)).collect()}
    assert got == {101, 202}
    assert len(list(search.combinations(range(7), 4))) == 35


def test_canonical_ids():
    assert search.canonical_ids([3, "2", [1, [2, -4, 0]], None, "x"]) == (3, 2, 1)
    assert search.player_profile([1, 2, 3], {}).signatures == ()
    assert search.player_profile([4, 3, 2, 1], {}).signatures == ((1, 2, 3, 4),)
    assert len(search.player_profile(range(1, 9), {}).signatures) == 70
    assert search.player_profile(range(1, 10), {}).signatures == ()


def test_representative_family_name(spark):
    m = spark.createDataFrame([(0, 1, "MOONLIGHT", 10, 5), (0, 2, "Moonlight (EU)", 9, 9), (0, 3, "Moonlight", 6, 7), (0, 4, "Other", 12, 1)],
                              "cluster_id long, team_id long, name string, lineup_count long, event_time_ms long")
    assert consolidate.representative_names(m, True).first().name == "Moonlight"
    assert consolidate.representative_names(m, False).first().name == "Other"


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q1", 1, 5), ("q1", 2, 6), ("q2", 4, 7)], "query string, rank int, team_id long")
    expected = spark.createDataFrame([("q1", 5), ("q2", 7), ("q3", 9)], "query string, team_id long")
    r = search.evaluate(ranked, expected).first()
    assert (round(r.recall_at_1, 3), round(r.recall_at_5, 3), round(r.mrr, 3)) == (0.333, 0.667, 0.417)


def test_remote_roster(spark, tmp_path):
    teams = {"tournament": {"ctx": {"teams": [
        {"id": 31921, "name": "Moonlight", "members": [{"userId": 5, "username": "Ann", "inGameName": "ann"}, {"userId": 5, "username": "Bo"}]},
        {"id": 7, "name": " ", "members": [{"username": x} for x in "abcd"]}, {"id": 8}, "junk"]}}}
    payload = [{"_1": 2, "_3": -4}, "some/route", {"_4": 5}, "x", "data", json.dumps(teams)]
    assert remote_roster.plain_teams("{") == "[]"
    assert remote_roster.decode([{"_1": -2}, "flag"]) == {"flag": True}
    (tmp_path / "a.json").write_text(json.dumps(payload))
    frame = remote_roster.read_rosters(spark, str(tmp_path))
    got = {r.team_id: r for r in frame.collect()}
    assert {i: r.display_name for i, r in got.items()} == {31921: "Moonlight", 7: "[No team name] a / b / c +1", 8: "Untitled team 8"}
    assert got[31921].member_user_ids == [5] and got[31921].member_names == ["Ann", "Bo"]
    found = lambda q: sorted(r.team_id for r in text.remote_team_match(frame, q).collect())
    assert found("moonlight") == [31921] and found("onl") == [31921] and found("bo") == [31921] and found("c") == [7]
    assert found(" ") == [7, 8, 31921]


def test_tournament_strength_ranks_unranked_players_behind_all_others(spark):
    """Twelve players, five of them unranked: the tenth place is the third of those by score; rank 0 is none, and neither score nor rank is no player."""
    rosters = spark.createDataFrame([(1, p) for p in range(1, 16)] + [(2, 1), (2, 13), (3, 14)], "tournament_id long, player_id long")
    rows = [(p, 100.0 - p, float(50 + p), 9) for p in range(1, 8)] + [(p, 1000.0 + p, None, 9) for p in range(8, 12)] + [(12, 500.0, 0.0, 9), (13, 1.0, 2.0, 9), (14, None, None, 9), (15, None, 0.0, 9)]
    rankings = spark.createDataFrame([*rows, (1, 5.0, 1.0, 3)], "player_id long, score double, player_rank double, calculated_at_ms long")
    got = {r.tournament_id: (r.ranked_players, r.strength) for r in tournaments.strength(rosters, rankings).collect()}
    assert got == {1: (13, 10.0), 2: (2, 51.0)}


def test_snapshot_store_round_trip(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, [1.0])], "team_id long, final_vector array<double>")
    for run in (1, 2, 3):
        store.start(run, 1000 * run)
        store.publish(run, {"embeddings": rows}, 1000 * run + 500)
    store.start(4, 9000)
    assert snapshots.latest_completed(store.runs()).first().run_id == 3
    assert store.read("embeddings", 2).first().final_vector == [1.0]
    assert store.retain(2, ("embeddings",)) == [1]
    assert sorted(r.run_id for r in snapshots.completed_runs(store.runs()).collect()) == [2, 3]
    with pytest.raises(Exception):
        store.publish(4, {"bad": rows.select(F.raise_error(F.lit("no")))}, 9500)
    assert {r.run_id: r.status for r in store.runs().collect()}[4] == "failed"
    assert snapshots.mirror(rows, str(tmp_path / "copy")) == 1
    assert snapshots.with_columns(rows, {"team_id": "long", "name": "string"}).first().name is None
    assert snapshots.config_of(store.runs(), 3).first().identity_idf_cap == 3.0


def test_refresh_publishes_a_snapshot_and_marks_failures(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    rows = [(1, [1, 2, 3, 4], 5), (2, [1, 2, 3, 4], 3), (3, [1, 2, 3, 4], 2), (4, [7, 8, 9, 10], 6), (4, [7, 8, 9, 11], 1)]
    counted = spark.createDataFrame(rows, "team_id long, lineup array<long>, n long")
    small = refresh.Settings(semantic_dim=8, identity_dim=16)
    assert [refresh.refresh(store, counted, at, small, keep=1) for at in (1000, 2000)] == [1, 2]
    assert {r.run_id: r.status for r in store.runs().collect()} == {1: "deleted", 2: "completed"}
    teams = {r.team_id: r for r in snapshots.of_dimension(store.read("embeddings", 2), 24).collect()}
    assert teams[4].lineup_count == 7 and teams[4].top_lineup == [7, 8, 9, 10] and teams[4].players[:3] == [7, 8, 9]
    found = {p: sorted(r.team_id for r in store.read("clusters", 2).where(F.col("profile") == p).collect()) for p in ("strict", "explore", "family")}
    assert found == {"strict": [1, 2, 3], "explore": [1, 2, 3], "family": [1, 2, 3]}
    assert snapshots.config_of(store.read("configs", 2), 2).first().identity_dim == 16
    with pytest.raises(Exception, match="should have 25"):
        snapshots.of_dimension(store.read("embeddings", 2), 25).collect()
    with pytest.raises(Exception):
        refresh.refresh(store, counted.withColumn("n", F.raise_error(F.lit("no")).cast("long")), 3000, small)
    assert {r.run_id: r.status for r in store.runs().collect()}[3] == "failed"


def test_json_columns_and_identifiers(spark):
    rows = spark.createDataFrame([(1, {"b": 2, "a": 1}, [3, 4])], "team_id long, counts map<string,long>, ids array<long>")
    texts = snapshots.to_json_columns(rows, "counts", "ids")
    assert texts.first().counts == '{"a":1,"b":2}' and texts.first().ids == "[3,4]"
    back = snapshots.from_json_columns(texts, counts="map<string,long>", ids="array<long>").first()
    assert back.counts == {"a": 1, "b": 2} and back.ids == [3, 4]
    assert snapshots.from_json_columns(texts.withColumn("ids", F.lit("x{")), ids="array<long>").first().ids is None
    assert snapshots.identifier(" team_1 ") == "team_1"
    for bad in ("", "1a", "a;b", "a b", "a\n1"):
        with pytest.raises(ValueError):
            snapshots.identifier(bad)


def test_labels_of_reports(spark):
    n, f = F.lit(None).cast("double"), F.lit
    got = spark.range(1).select(
        reports.confidence_band(reports.confidence(n, f(0.8), f(1.2))), reports.confidence_band(reports.confidence(n, n, n)), reports.confidence_band(reports.confidence(f(0.96), n, n)),
        reports.continuity(n, f(1)), reports.continuity(f(0.6), f(2)), reports.usage(f(0), f(5), f(1)), reports.usage(f(3), f(0), f(5)), reports.usage(f(1), f(9), f(1)), reports.usage(f(4), f(9), f(1)),
    ).first()
    assert list(got) == ["Medium", "n/a", "High", "Continuity unavailable", "Mostly stable core", "top-lineup reference", "sub", "one-off", "regular"]


def test_windows():
    assert lineups.window_bounds(None, 10) == (None, None)
    assert lineups.window_bounds(-1, 10) == (None, None)
    assert lineups.window_bounds(1, 86_400_000 * 3) == (86_400 * 2, 86_400 * 3)


def test_family_scopes_by_consensus(spark):
    groups = {1: [1, 2, 3, 9], 2: [1, 2, 3], 3: [2, 3], 9: [1, 9], 5: [5], 6: [6, 7], 7: [6, 7, 8], 8: [7, 8]}
    names = [(1, "Wolves", 9), (2, "wolves!", 3), (3, "Wolves", 0), (9, "Other", 1), (5, " Solo ", 2), (6, None, 4), (7, "", 1), (8, None, None)]
    rows = spark.createDataFrame([(t, m) for t, g in groups.items() for m in g], "team_id long, member long")
    got = {}
    for r in scope.consensus_scopes(rows, spark.createDataFrame(names, "team_id long, name string, lineup_count long")).collect():
        got.setdefault((r.team_id, r.scope_name), []).append(r.member)
    # The anchors of 1 agree on all but 9; the only namesake in the group of 9 is 1, so its group; 6, 7 and 8 have no names, so all members are anchors.
    assert {k: sorted(v) for k, v in got.items()} == {
        (1, "Wolves"): [1, 2, 3], (2, "Wolves"): [1, 2, 3], (3, "wolves!"): [2, 3], (9, "Wolves"): [1, 2, 3, 9],
        (5, "Solo"): [5], (6, None): [6, 7], (7, None): [6, 7, 8], (8, None): [7, 8]}


def test_family_scopes_take_twelve_anchors(spark):
    # Team 1's group holds 14 namesakes; the first twelve keep to the smaller ids, the last two don't count.
    groups = {t: list(range(1, 15)) if t == 1 else [1, 2] if t <= 12 else [1, t] for t in range(1, 15)}
    rows = spark.createDataFrame([(t, m) for t, g in groups.items() for m in g], "team_id long, member long")
    names = spark.createDataFrame([(t, "A", 1) for t in range(1, 15)], "team_id long, name string, lineup_count long")
    found = scope.consensus_scopes(rows, names).where("team_id = 1").collect()
    assert sorted(r.member for r in found) == [1, 2]


def test_family_scopes_of_nothing(spark):
    none = spark.createDataFrame([], "team_id long, member long")
    assert scope.consensus_scopes(none, spark.createDataFrame([], "team_id long, name string, lineup_count long")).collect() == []
