"""Choice of a table of maps from the catalog, and what is read from it."""

from rosterforge.operators import rounds

MATCHES = "match_id long, tournament_id long, round_id long, team1_id long, team2_id long, team1_score double, team2_score double, winner_team_id long"


def found(frame):
    return {(r.match_id, r.map_index): r for r in frame.collect()}


def views(spark, **frames):
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return lambda: [spark.catalog.dropTempView(name) for name in frames]


def test_layouts():
    assert rounds.layout_of(["map", "score1", "score2"]) is None and rounds.layout_of(["match_id", "maps_count", "when"]) is None
    assert rounds.layout_of(["match_id", "score1", "winner"]).usefulness == 1
    full = rounds.layout_of(["MATCH_ID", "Map_No", "number", "mode", "a_score", "b_score", "score_1", "score_2", "victor"])
    assert full.usefulness == 6 and full.columns["round_no"] == "Map_No" and full.scores == ("score_1", "score_2") and full.columns["match_id"] == "MATCH_ID"


def test_the_more_useful_table_wins_and_the_first_among_equals(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    first, second = empty("match_id long, map string"), empty("match_id long, map string, number long")
    assert rounds.most_useful({"a": first, "b": second})[0] == "b" and rounds.most_useful({"b": second, "c": second})[0] == "b"
    assert rounds.most_useful({"a": empty("id long")}) is None and rounds.most_useful({}) is None


def test_no_table_gives_no_rows_of_the_same_columns(spark):
    m = spark.createDataFrame([(1, 1, 1, 5, 6, 1.0, 2.0, 6)], MATCHES)
    got = rounds.rounds_of(spark, m, [5], [6])
    assert got.columns == list(rounds.OUTPUT) and got.isEmpty()


def test_candidates(spark):
    m = spark.createDataFrame([(1, 9, 1, 5, 6, 0.0, 0.0, None), (2, None, 1, 7, 5, 0.0, 0.0, None), (3, 9, 1, 8, None, 0.0, 0.0, None), (0, 9, 1, 5, 6, 0.0, 0.0, None)], MATCHES)
    games = spark.createDataFrame(
        [(1, "2", "3", "1", None), (1, None, "x", "1", "B "), (1, "4", "NaN", "1", "5"), (1, " ", "0", "2", "6"), (2, None, "1", "2", None), (3, "1", "1", "1", "left"), (0, "1", "1", "1", "a"), (4, "1", "1", "1", "a")],
        "match_id long, number string, left_score string, right_score string, winner_side string")
    clear = views(spark, match_game=games, match_map=games.select("match_id", "number"))
    try:
        got = found(rounds.rounds_of(spark, m, [5], [6]))
    finally:
        clear()
    # Numbers 2 and 4 first, then those without a number, ordered by their scores, missing ones first.
    assert {k: (r.round_no, r.team_a_score, r.team_b_score, r.winner_side, r.tournament_id) for k, r in got.items()} == {
        (1, 2): (2, 3.0, 1.0, "team_a", 9), (1, 4): (4, None, 1.0, None, 9), (1, 5): (None, None, 1.0, "team_b", 9), (1, 6): (None, 0.0, 2.0, "team_b", 9),
        (2, 1): (None, 2.0, 1.0, "team_a", 0), (3, 1): (1, 1.0, 1.0, "team_a", 9)}


def test_a_winner_column_stands_for_ids_only(spark):
    m = spark.createDataFrame([(1, 9, 1, 6, 5, 0.0, 0.0, None)], MATCHES)
    games = spark.createDataFrame([(1, 1, "5"), (1, 2, "6"), (1, 3, "left"), (1, 4, "7")], "match_id long, round long, winner string")
    clear = views(spark, match_rounds=games)
    try:
        got = found(rounds.rounds_of(spark, m, [5], [6]))
    finally:
        clear()
    assert {k[1]: (r.winner_team_id, r.winner_side) for k, r in got.items()} == {1: (5, "team_a"), 2: (6, "team_b"), 3: (None, None), 4: (7, None)}


def test_a_complete_rounds_table_comes_first_and_an_incomplete_one_is_passed_over(spark):
    m = spark.createDataFrame([(1, 9, 1, 6, 5, 3.0, 2.0, None), (2, 9, 7, 6, 5, 3.0, 2.0, 5), (3, 9, 2, 5, 6, 1.0, 1.0, None)], MATCHES)
    table = spark.createDataFrame([(1, 4, 2, " X "), (2, None, 99, "")], "round_id long, number long, maps_count long, maps_type string")
    games = spark.createDataFrame([(1, 1)], "match_id long, number long")
    clear = views(spark, rounds=table, match_games=games)
    try:
        got = found(rounds.rounds_of(spark, m, [5], [6]))
        views(spark, rounds=table.drop("maps_type"))
        other = found(rounds.rounds_of(spark, m, [5], [6]))
    finally:
        clear()
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), *((3, i) for i in range(1, 21))] and list(other) == [(1, 1)]
    one, two, three = got[1, 2], got[2, 1], got[3, 7]
    assert (one.round_no, one.map_mode, one.team_a_score, one.team_b_score, one.winner_side) == (4, "X", 2.0, 3.0, "team_b")
    assert (two.round_no, two.round_id, two.maps_count, two.winner_side) == (1, None, 1, "team_a") and (three.round_no, three.map_mode, three.winner_side) == (7, None, None)
