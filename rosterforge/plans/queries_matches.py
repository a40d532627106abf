"""Queries over matches, names and the client's rollups."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterforge.functions.scalars import alnum_key, family_key, trigram_similarity, trigrams
from rosterforge.operators import analytics as N
from rosterforge.operators import lineups as L
from rosterforge.operators import matches as M
from rosterforge.operators import name_index as I
from rosterforge.operators import rounds as R
from rosterforge.operators import text as X
from rosterforge.plans.queries_lineups import _ENTRY, _SINCE, _TIME, _UNTIL, entry_strength, lineup_sql
from rosterforge.plans.queries_search import wide_counted
from rosterforge.plans.registry import query
from rosterforge.plans.storage import new_folder
from rosterforge.sources import adapter as A
from rosterforge.sources.roster_source import rosters

#: Two disjoint sets of teams that meet, and one team.
TEAM_A, TEAM_B, SCOPE = list(range(1, 60)), list(range(60, 200)), [5, 11]


def ids(x) -> str:
    return "(" + ", ".join(map(str, x)) + ")"


def oriented_sql(a, b=None) -> str:
    """m(...): matches seen from a's side."""
    first = f"team1_id IN {ids(a)}"
    wanted = f"(({first} AND team2_id IN {ids(b)}) OR (team2_id IN {ids(a)} AND team1_id IN {ids(b)}))" if b else f"({first} OR team2_id IN {ids(a)}) AND NOT ({first} AND team2_id IN {ids(a)})"
    return f""", o AS (SELECT m.*, t.name AS tournament_name, t.start_time_ms, {first} AS f FROM matches m LEFT JOIN tournaments t USING (tournament_id) WHERE {wanted}),
pm AS (SELECT match_id, tournament_id, tournament_name, round_id, CASE WHEN f THEN team1_id ELSE team2_id END AS team_id, CASE WHEN f THEN team2_id ELSE team1_id END AS opponent_team_id,
  CASE WHEN f THEN team1_score ELSE team2_score END AS team_a_score, CASE WHEN f THEN team2_score ELSE team1_score END AS team_b_score, winner_team_id, {_TIME} AS event_time_s FROM o),
m AS (SELECT *, CASE WHEN winner_team_id = team_id THEN 'team_a' WHEN winner_team_id = opponent_team_id THEN 'team_b' WHEN team_a_score > team_b_score THEN 'team_a' WHEN team_a_score < team_b_score THEN 'team_b' END AS winner_side FROM pm)
"""


_H2H = A.with_frames("matches", "tournaments") + oriented_sql(TEAM_A, TEAM_B)
_TEAM = A.with_frames("matches", "tournaments") + oriented_sql(SCOPE)
_COLS = "match_id, tournament_id, tournament_name, team_id, opponent_team_id, team_a_score, team_b_score, winner_side, event_time_s"
_SUMMARY = """SELECT count(*) AS total_matches, count(winner_side) AS decided_matches, count(*) FILTER (WHERE winner_side = 'team_a') AS team_a_wins, count(*) FILTER (WHERE winner_side = 'team_b') AS team_b_wins, count(*) - count(winner_side) AS unresolved_matches,
count(DISTINCT tournament_id) AS tournaments, CASE WHEN count(winner_side) > 0 THEN round(count(*) FILTER (WHERE winner_side = 'team_a')::DOUBLE / count(winner_side), 4) ELSE 0 END AS team_a_win_rate,
CASE WHEN count(winner_side) > 0 THEN round(count(*) FILTER (WHERE winner_side = 'team_b')::DOUBLE / count(winner_side), 4) ELSE 0 END AS team_b_win_rate FROM m"""


def h2h(spark, d):
    return M.oriented(A.matches(spark, d), A.tournaments(spark, d), TEAM_A, TEAM_B)


def of_scope(spark, d):
    return M.oriented(A.matches(spark, d), A.tournaments(spark, d), SCOPE, None)


@query(_H2H + f"SELECT {_COLS} FROM m ORDER BY event_time_s DESC NULLS LAST, match_id DESC LIMIT 100")
def head_to_head_matches(spark, d):
    return M.newest_first(h2h(spark, d), 100).select(*_COLS.split(", "))


@query(_H2H + f", w AS (SELECT bool_or(event_time_s BETWEEN {_SINCE} AND {_UNTIL}) AS any_in FROM m) SELECT match_id, winner_side, event_time_s, NOT any_in AS matched_all_time FROM m, w WHERE NOT any_in OR event_time_s BETWEEN {_SINCE} AND {_UNTIL}")
def head_to_head_windowed(spark, d):
    return M.windowed_or_all(h2h(spark, d), _SINCE, _UNTIL).select("match_id", "winner_side", "event_time_s", "matched_all_time")


@query(_H2H + "SELECT match_id, true AS matched_all_time FROM m")
def head_to_head_fallback(spark, d):
    return M.windowed_or_all(h2h(spark, d), 1, 2).select("match_id", "matched_all_time")


@query(_H2H + _SUMMARY)
def head_to_head_summary(spark, d):
    return M.results_summary(h2h(spark, d))


@query(_ENTRY.replace("WITH appearances", "WITH matches AS (" + A.FRAMES["matches"] + "), tournaments AS (" + A.FRAMES["tournaments"] + "), appearances", 1) + oriented_sql(TEAM_A, TEAM_B) + """
SELECT CASE WHEN strength IS NULL THEN 'Unscored' WHEN strength <= 5 THEN 'X' WHEN strength <= 10 THEN 'S+' WHEN strength <= 20 THEN 'S' WHEN strength <= 40 THEN 'A+' WHEN strength <= 80 THEN 'A' ELSE 'A-' END AS tier,
count(DISTINCT tournament_id) AS tournaments, count(*) AS matches FROM m LEFT JOIN strength USING (tournament_id) GROUP BY 1""")
def tier_distribution(spark, d):
    return M.tier_distribution(h2h(spark, d), entry_strength(spark, d))


@query(_TEAM + f"SELECT {_COLS} FROM m")
def team_matches(spark, d):
    return of_scope(spark, d).select(*_COLS.split(", "))


@query(_TEAM + _SUMMARY)
def team_match_summary(spark, d):
    return M.results_summary(of_scope(spark, d))


@query(_TEAM + "SELECT opponent_team_id, count(*) AS matches, count(*) FILTER (WHERE winner_side = 'team_a') AS wins, count(*) FILTER (WHERE winner_side = 'team_b') AS losses, max(event_time_s) AS last_played_s FROM m GROUP BY 1")
def opponents(spark, d):
    return M.by_opponent(of_scope(spark, d))


@query(_TEAM + "SELECT tournament_id, tournament_name, count(*) AS matches, count(*) FILTER (WHERE winner_side = 'team_a') AS wins, count(*) FILTER (WHERE winner_side = 'team_b') AS losses FROM m GROUP BY 1, 2")
def events_rollup(spark, d):
    return M.by_tournament(of_scope(spark, d))


@query(A.with_frames("matches", "match_sides", "players") + """SELECT match_id, side, array_to_string(list(player_id ORDER BY player_id), ',') AS players, array_to_string(list(name ORDER BY player_id), ',') AS names FROM (
  SELECT DISTINCT match_id, CASE WHEN team_id = team1_id THEN 'team1' WHEN team_id = team2_id THEN 'team2' END AS side, player_id, coalesce(nullif(trim(display_name), ''), player_id::VARCHAR) AS name
  FROM match_sides JOIN matches USING (match_id) JOIN players USING (player_id)) WHERE side IS NOT NULL GROUP BY 1, 2""")
def match_rosters(spark, d):
    r = M.match_rosters(A.matches(spark, d), A.match_sides(spark, d), L.display_names(A.players(spark, d)))
    return r.select("match_id", "side", F.array_join(F.col("players").cast("array<string>"), ",").alias("players"), F.array_join("names", ",").alias("names"))


@query(A.with_frames("matches", "rounds") + """, r AS (SELECT match_id, number, least(greatest(coalesce(maps_count, 1), 1), 20) AS maps_count, maps_type AS map_mode FROM matches LEFT JOIN rounds USING (round_id))
SELECT match_id, coalesce(number, i)::INT AS round_no, i::INT AS map_index, maps_count::INT AS maps_count, map_mode FROM (SELECT *, unnest(range(1, maps_count + 1)) AS i FROM r)""")
def match_rounds(spark, d):
    return M.match_rounds(A.matches(spark, d), A.rounds(spark, d))


@contextmanager
def views(**frames: DataFrame):
    """Frames as temporary views, for as long as a catalog look-up takes."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name, frame in frames.items():
            frame.sparkSession.catalog.dropTempView(name)


_SEEN = f""", seen AS (SELECT match_id, round_id AS m_round, coalesce(tournament_id, 0) AS tournament_id, team1_score, team2_score, winner_team_id AS m_winner, team1_id IN {ids(TEAM_A)} AS f,
  CASE WHEN team1_id IN {ids(TEAM_A)} THEN team1_id WHEN team2_id IN {ids(TEAM_A)} THEN team2_id END AS a,
  CASE WHEN team1_id IN {ids(TEAM_A)} THEN CASE WHEN team2_id IN {ids(TEAM_B)} THEN team2_id END WHEN team2_id IN {ids(TEAM_A)} THEN CASE WHEN team1_id IN {ids(TEAM_B)} THEN team1_id END END AS b FROM matches)"""
_SIDED = """SELECT match_id, tournament_id, round_id, round_no, map_index, maps_count, map_name, map_mode, CASE WHEN f THEN s1 ELSE s2 END AS team_a_score, CASE WHEN f THEN s2 ELSE s1 END AS team_b_score, winner_team_id,
coalesce(CASE WHEN winner_team_id = a THEN 'team_a' WHEN winner_team_id = b THEN 'team_b' END, told, CASE WHEN (s1 > s2) = f AND s1 <> s2 THEN 'team_a' WHEN s1 <> s2 THEN 'team_b' END) AS winner_side FROM w"""


@query(A.with_frames("matches", "rounds") + _SEEN + """, e AS (SELECT seen.*, r.round_id, number, maps_type, least(greatest(coalesce(maps_count, 1), 1), 20) AS n FROM seen LEFT JOIN rounds r ON m_round = r.round_id),
w AS (SELECT *, coalesce(number, i) AS round_no, i AS map_index, n AS maps_count, NULL::VARCHAR AS map_name, maps_type AS map_mode, team1_score AS s1, team2_score AS s2, m_winner AS winner_team_id, NULL::VARCHAR AS told
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e))
""" + _SIDED)
def catalog_rounds(spark, d):
    """A rounds table with the numbers of maps is preferred to a table of maps."""
    with views(rounds=A.rounds(spark, d), match_games=A.match_games(spark, d)):
        return R.rounds_of(spark, A.matches(spark, d), TEAM_A, TEAM_B)


@query(A.with_frames("matches", "match_games") + _SEEN + """, g AS (SELECT seen.*, map_number AS n, mode, g.team1_points AS s1, g.team2_points AS s2, CASE WHEN victor = 'left' THEN 'team_a' WHEN victor = 'TEAM2' THEN 'team_b' END AS told, victor FROM match_games g JOIN seen USING (match_id)),
w AS (SELECT *, NULL::BIGINT AS round_id, n AS round_no, NULL::BIGINT AS maps_count, NULL::VARCHAR AS map_name, mode AS map_mode, NULL::BIGINT AS winner_team_id,
  coalesce(n, coalesce(max(n) OVER (PARTITION BY match_id), 0) + row_number() OVER (PARTITION BY match_id, n IS NULL ORDER BY mode, s1, s2, victor)) AS map_index FROM g)
""" + _SIDED)
def catalog_rounds_of_candidates(spark, d):
    """Without a rounds table the second candidate is taken, as it tells more than the first."""
    games = A.match_games(spark, d)
    with views(match_maps=games.select("match_id", F.col("mode").alias("map_label")), match_games=games):
        return R.rounds_of(spark, A.matches(spark, d), TEAM_A, TEAM_B)


_LAB = A.with_frames("matches", "cluster_map") + f""", s AS (SELECT CASE WHEN team1_id IN {ids(SCOPE)} THEN team2_id ELSE team1_id END AS opponent_team_id, (winner_team_id IN {ids(SCOPE)})::BIGINT AS is_win
  FROM matches WHERE winner_team_id IS NOT NULL AND ((team1_id IN {ids(SCOPE)}) <> (team2_id IN {ids(SCOPE)}))),
own AS (SELECT min(cluster_id) AS c FROM cluster_map WHERE team_id IN {ids(SCOPE)} AND cluster_id >= 0),
r AS (SELECT opponent_team_id, is_win, coalesce(cluster_id, -1) AS cluster_id, coalesce(coalesce(cluster_id, -1) = c, false) AS same FROM s LEFT JOIN cluster_map ON team_id = opponent_team_id CROSS JOIN own)
"""


def lab(spark, d):
    sides = M.team_sides(A.matches(spark, d)).where(F.col("team_id").isin(SCOPE))
    return N.lab_summary(sides, A.cluster_map(spark, d), SCOPE)


@query(_LAB + """SELECT count(*) AS matches, coalesce(sum(is_win), 0)::BIGINT AS wins, round(coalesce(sum(is_win), 0)::DOUBLE / greatest(count(*), 1), 4) AS win_rate,
count(*) FILTER (WHERE same) AS same_cluster_matches, round(count(*) FILTER (WHERE same AND is_win = 1)::DOUBLE / greatest(count(*) FILTER (WHERE same), 1), 4) AS same_cluster_win_rate,
count(*) FILTER (WHERE NOT same) AS cross_cluster_matches, round(count(*) FILTER (WHERE NOT same AND is_win = 1)::DOUBLE / greatest(count(*) FILTER (WHERE NOT same), 1), 4) AS cross_cluster_win_rate FROM r""")
def team_lab_summary(spark, d):
    return lab(spark, d)[0]


@query(_LAB + "SELECT cluster_id, count(*) AS matches, sum(is_win)::BIGINT AS wins, round(sum(is_win)::DOUBLE / count(*), 4) AS win_rate FROM r GROUP BY 1 ORDER BY matches DESC, cluster_id LIMIT 10")
def opponent_cluster_breakdown(spark, d):
    return lab(spark, d)[1]


@query(A.with_frames("tournament_teams", "tournaments") + "SELECT team_id, e.name, min(start_time_ms) AS first_seen_ms, max(start_time_ms) AS last_seen_ms, count(*) AS tournaments FROM tournament_teams e JOIN tournaments USING (tournament_id) GROUP BY 1, 2")
def name_timeline(spark, d):
    return M.name_timeline(A.tournament_teams(spark, d), A.tournaments(spark, d))


@query(A.with_frames("matches") + """, s AS (SELECT team1_id AS team_id, match_id, winner_team_id = team1_id AS w FROM matches WHERE winner_team_id IS NOT NULL UNION ALL SELECT team2_id, match_id, winner_team_id = team2_id FROM matches WHERE winner_team_id IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_id DESC) AS rn FROM s) SELECT team_id, string_agg(CASE WHEN w THEN 'W' ELSE 'L' END, '' ORDER BY rn) AS form, count(*) FILTER (WHERE w) AS wins FROM l WHERE rn <= 5 GROUP BY 1""")
def recent_form(spark, d):
    return M.recent_form(M.team_sides(A.matches(spark, d)))


# Names: parts stand for teams with texts, their size for the lineup count.


def names(spark, d):
    return A.read(spark, d, "part").select((F.col("p_partkey") + 1).alias("team_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("lineup_count"))


_NAMES = "WITH names AS (SELECT p_partkey + 1 AS team_id, p_name AS name, p_size::BIGINT AS lineup_count FROM part)"


def _sim(q: str) -> str:
    """s(team_id, similarity): trigram similarity of names to q, in long form."""
    def grams(src):
        return f"(SELECT DISTINCT team_id, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT team_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM {src}) t, range(1, 60) r(i) WHERE i <= length(w) + 1)"
    return f""", ng AS {grams('names')}, qg AS {grams(f"(SELECT 0 AS team_id, '{q}' AS name)")}, qn AS (SELECT count(*) AS n FROM qg),
s AS (SELECT ng.team_id, count(qg.g)::DOUBLE / (count(*) + any_value(n) - count(qg.g)) AS similarity FROM ng CROSS JOIN qn LEFT JOIN qg ON qg.g = ng.g GROUP BY 1)"""


@query(_NAMES + """, p AS (SELECT *, CASE WHEN lower(name) = 'large ring' THEN 0 WHEN team_id::VARCHAR = 'large ring' THEN 1 WHEN regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') = 'largering' THEN 2 WHEN contains(lower(name), 'large ring') THEN 3 END AS priority FROM names)
SELECT team_id, name, priority FROM p WHERE priority IS NOT NULL ORDER BY priority, lineup_count DESC, team_id LIMIT 20""")
def name_search(spark, d):
    return X.name_search(names(spark, d), "large ring")


@query(_NAMES + """, p AS (SELECT *, CASE WHEN lower(name) = '17' THEN 0 WHEN team_id = 17 THEN 1 WHEN regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') = '17' THEN 2 WHEN contains(lower(name), '17') THEN 3 END AS priority FROM names)
SELECT team_id, name, priority FROM p WHERE priority IS NOT NULL ORDER BY priority, lineup_count DESC, team_id LIMIT 20""")
def name_search_by_id(spark, d):
    return X.name_search(names(spark, d), "17")


@query(_NAMES + _sim("smal rnig") + "SELECT team_id, name, round(similarity, 6) AS similarity FROM s JOIN names USING (team_id) WHERE similarity >= 0.3")
def trigram_search(spark, d):
    return X.trigram_search(names(spark, d), "smal rnig").select("team_id", "name", F.round("similarity", 6).alias("similarity"))


@query(_NAMES + ", t AS (SELECT * FROM names ORDER BY lineup_count DESC, team_id LIMIT 200) SELECT team_id, name FROM t WHERE list_contains(regexp_extract_all(lower(name), '[a-z0-9]+'), 'ring') ORDER BY lineup_count DESC, team_id LIMIT 20")
def token_search(spark, d):
    return X.token_search(names(spark, d), "ring").select("team_id", "name")


@query(_NAMES + _sim("smal") + """, h AS (SELECT team_id, name, lineup_count, starts_with(lower(name), 'smal') AS starts, coalesce(similarity, 0) AS similarity FROM names LEFT JOIN s USING (team_id) WHERE starts_with(lower(name), 'smal') OR similarity >= 0.3),
u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY lineup_count DESC, team_id) = 1)
SELECT team_id, name, starts FROM u ORDER BY starts DESC, CASE WHEN starts THEN 0 ELSE -similarity END, lower(name) LIMIT 10""")
def name_suggest(spark, d):
    return X.suggest(names(spark, d), "smal")


def _chain(text: str) -> str:
    """The target search for text by scans: the rows of the first stage that finds any."""
    q = text.strip().lower()
    key = "".join(c for c in q if c.isascii() and c.isalnum())
    flat = "regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')"
    hit = f"list_contains(regexp_extract_all(lower(name), '[a-z0-9]+'), '{key}')" if len(key) <= 4 else f"contains({flat}, '{key}')"
    return "(" + _NAMES + _sim(q) + f""", st AS (
  SELECT *, 0 AS stage, (CASE WHEN lower(name) = '{q}' THEN 0 WHEN team_id::VARCHAR = '{q}' THEN 1 WHEN {flat} = '{key}' THEN 2 ELSE 3 END)::DOUBLE AS o FROM names
    WHERE contains(lower(name), '{q}') OR team_id::VARCHAR = '{q}' OR {flat} = '{key}'
  UNION ALL SELECT names.*, 1, -similarity FROM s JOIN names USING (team_id) WHERE similarity >= 0.3
  UNION ALL SELECT *, 2, NULL FROM (SELECT * FROM names ORDER BY lineup_count DESC, team_id LIMIT 250) WHERE {hit})
SELECT '{text}' AS text, row_number() OVER (ORDER BY o, lineup_count DESC, team_id)::INTEGER AS place, team_id, name, stage FROM st WHERE stage = (SELECT min(stage) FROM st) ORDER BY place LIMIT 25)"""


#: A text that names hold, a number, a text with slips, and one whose letters and digits only are a word.
TEXTS = ("Large ring", "17", "smal rnig", "ri-ng")


@query(" UNION ALL ".join(map(_chain, TEXTS)))
def name_targets(spark, d):
    """The chain of target searches over an index of trigrams, for texts that end in each of its stages."""
    index = I.build(names(spark, d).select(F.col("team_id").alias("id"), "name", F.col("lineup_count").alias("weight")), new_folder(spark))
    found = (index.targets(t).select(F.lit(t).alias("text"), "place", F.col("id").alias("team_id"), "name", "stage") for t in TEXTS)
    return reduce(DataFrame.unionByName, found)


#: The beginning of names, and a name with a slip.
PLAYER_TEXTS = ("Supplier#00000000", "Suplier#000000012")


def _player_chain(text: str) -> str:
    q = text.strip().lower()
    return "(" + lineup_sql(2, 6).replace("WITH appearances", "WITH players AS (" + A.FRAMES["players"] + "), appearances", 1) + f""",
names AS (SELECT player_id AS team_id, trim(display_name) AS name, count(DISTINCT support.team_id) AS teams FROM support JOIN players USING (player_id) WHERE trim(display_name) <> '' AND NOT regexp_full_match(trim(display_name), '[0-9]+') GROUP BY 1, 2)
{_sim(q)}, st AS (SELECT *, 0 AS stage, 0.0::DOUBLE AS o FROM names WHERE starts_with(lower(name), '{q}')
  UNION ALL SELECT names.*, 1, -similarity FROM s JOIN names USING (team_id) WHERE similarity >= 0.3 AND NOT starts_with(lower(name), '{q}'))
SELECT '{text}' AS text, row_number() OVER (ORDER BY stage, o, teams DESC, team_id)::INTEGER AS place, team_id AS player_id, name, teams, stage FROM st ORDER BY place LIMIT 10)"""


@query(" UNION ALL ".join(map(_player_chain, PLAYER_TEXTS)))
def player_suggestions(spark, d):
    """Players whose names begin with a text, and then those with similar names, by their numbers of teams."""
    per = L.player_support(wide_counted(spark, d)).groupBy("player_id").agg(F.countDistinct("team_id").alias("weight"))
    known = L.player_names(A.players(spark, d)).join(per, "player_id").select(F.col("player_id").alias("id"), "name", "weight")
    index = I.build(known, new_folder(spark))
    found = (index.suggestions(t).select(F.lit(t).alias("text"), "place", F.col("id").alias("player_id"), "name", F.col("weight").alias("teams"), "stage") for t in PLAYER_TEXTS)
    return reduce(DataFrame.unionByName, found)


@query(_NAMES + "SELECT team_id, name FROM names QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY lineup_count DESC, team_id) = 1")
def unique_names(spark, d):
    return X.unique_by_name(names(spark, d)).select("team_id", "name")


@query(lineup_sql(2, 6).replace("WITH appearances", "WITH players AS (" + A.FRAMES["players"] + "), appearances", 1) + """SELECT player_id, trim(display_name) AS name, count(DISTINCT team_id) AS teams FROM support JOIN players USING (player_id)
WHERE trim(display_name) <> '' AND NOT regexp_full_match(trim(display_name), '[0-9]+') AND starts_with(lower(trim(display_name)), 'supp') GROUP BY 1, 2 ORDER BY teams DESC, lower(trim(display_name)), player_id LIMIT 10""")
def player_suggest(spark, d):
    return X.player_suggest(L.player_names(A.players(spark, d)), L.player_support(wide_counted(spark, d)), "Supp")


@query(lineup_sql(2, 6) + "SELECT team_id, matches FROM support WHERE player_id = 6 ORDER BY matches DESC, team_id LIMIT 50")
def player_teams(spark, d):
    return X.player_teams(L.player_support(wide_counted(spark, d)), 6)


_T = "(SELECT min(tournament_id) + 3 FROM tournament_teams)"


@query(A.with_frames("tournament_teams") + f"SELECT team_id, name FROM tournament_teams WHERE tournament_id = {_T} AND contains(lower(name), '00') ORDER BY name NULLS LAST, team_id LIMIT 100")
def tournament_teams(spark, d):
    entries = A.tournament_teams(spark, d)
    fourth = entries.agg(F.min("tournament_id") + 3).collect()[0][0]  # one number
    return X.tournament_teams(entries, fourth, "00")


#: Teams of one remote tournament, and the id of the first one; no tournament of the tables has such an id.
REMOTE_TEAMS, FIRST_REMOTE = 200, 900_000


def payload_files(spark, d) -> str:
    """A folder of payload files: every REMOTE_TEAMS customers in a row make a remote tournament, with their nation as second member."""
    key = F.col("c_custkey")
    member = lambda i, name, game: F.struct(i.alias("userId"), name.alias("username"), game.alias("inGameName"))
    team = F.struct(
        (key + 1).alias("id"), F.when(key % 5 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.array(member(key * 2 + 1, F.col("c_mktsegment"), F.lower("c_mktsegment")), member(F.col("c_nationkey") + 0, F.concat(F.lit("n"), F.col("c_nationkey")), F.lit(" "))).alias("members"),
    )
    rows = A.read(spark, d, "customer").select(F.floor(key / REMOTE_TEAMS + FIRST_REMOTE).cast("long").alias("tournament_id"), key, team.alias("team"))
    teams = rows.groupBy("tournament_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "team"))), lambda x: x["team"]).alias("teams"))
    inner = F.to_json(F.struct(F.struct(F.struct("teams").alias("ctx")).alias("tournament")))
    quoted = F.to_json(F.array(inner))  # a JSON text in a list, whose brackets go
    payload = F.concat(F.lit('[{"_1":2},"rosters",{"_3":4},"data",'), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit("]"))
    folder = new_folder(spark)
    teams.select("tournament_id", payload.alias("value")).write.partitionBy("tournament_id").text(folder)
    return folder


_ROSTERS = f"""r AS (SELECT c_custkey // {REMOTE_TEAMS} + {FIRST_REMOTE} AS tournament_id, c_custkey % {REMOTE_TEAMS} AS position, c_custkey + 1 AS team_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS team_name,
  CASE WHEN c_custkey % 5 = 0 THEN '[No team name] ' || c_mktsegment || ' / n' || c_nationkey ELSE c_name END AS display_name, CASE WHEN c_nationkey > 0 AND c_nationkey <> c_custkey * 2 + 1 THEN (c_custkey * 2 + 1) || ',' || c_nationkey ELSE (c_custkey * 2 + 1)::VARCHAR END AS member_user_ids,
  c_mktsegment || ',n' || c_nationkey AS member_names FROM customer)"""


def joined_lists(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"member_user_ids": F.array_join(F.col("member_user_ids").cast("array<string>"), ","), "member_names": F.array_join("member_names", ",")})


@query("WITH " + _ROSTERS + " SELECT * FROM r")
def remote_rosters(spark, d):
    """All payload files, read as a data source."""
    return joined_lists(rosters(spark, payload_files(spark, d))).withColumn("position", F.col("position").cast("long"))


_LISTED = f"""SELECT '{{w}}' AS asked, team_id, team_name, display_name, 0::BIGINT AS lineup_count, NULL::BIGINT AS event_time_ms, member_user_ids, member_names, 'remote' AS source FROM r WHERE tournament_id = {FIRST_REMOTE} AND {{c}}"""


@query(A.with_frames("tournament_teams", "tournaments", "match_rows") + ", " + _ROSTERS + f""", e AS (SELECT e.tournament_id, team_id, e.name, start_time_ms, count(o_orderkey) AS n FROM tournament_teams e JOIN tournaments USING (tournament_id)
  JOIN orders o ON o_custkey + 1 = team_id AND year(o_orderdate) * 12 + month(o_orderdate) = e.tournament_id WHERE e.tournament_id = {_T} AND contains(lower(e.name), '00') GROUP BY 1, 2, 3, 4 ORDER BY n DESC, e.name, team_id LIMIT 50)
SELECT 'dataset' AS asked, team_id, name AS team_name, name AS display_name, n AS lineup_count, start_time_ms AS event_time_ms, '' AS member_user_ids, '' AS member_names, 'dataset' AS source FROM e
UNION ALL """ + _LISTED.format(w="remote", c="position < 150") + " UNION ALL " + _LISTED.format(w="member", c="member_names LIKE '%,n1%'"))
def tournament_teams_or_remote(spark, d):
    """Three look-ups: a tournament of the tables, a remote one, and teams of a remote one by a member's name."""
    entries = A.tournament_teams(spark, d).join(A.tournaments(spark, d).select("tournament_id", F.col("start_time_ms").alias("event_time_ms")), "tournament_id")
    counts = A.read(spark, d, "orders").groupBy((F.col("o_custkey") + 1).alias("team_id"), A.month_id(F.col("o_orderdate")).alias("tournament_id")).agg(F.count(F.lit(1)).alias("lineup_count"))
    entries = entries.join(counts, ["team_id", "tournament_id"])
    fourth = entries.agg(F.min("tournament_id") + 3).collect()[0][0]  # one number
    folder = payload_files(spark, d)
    asked = (("dataset", fourth, "00", 50), ("remote", FIRST_REMOTE, " ", 150), ("member", FIRST_REMOTE, "N1", 700))
    lists = [X.listed_tournament_teams(entries, rosters(spark, folder, t), t, q, n).withColumn("asked", F.lit(name)) for name, t, q, n in asked]
    return joined_lists(reduce(DataFrame.unionByName, lists))


_REMOTE = """WITH t AS (SELECT p_partkey + 1 AS team_id, unnest([p_name, p_brand, p_type]) AS label FROM part),
m AS (SELECT team_id, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS k, regexp_extract_all(lower(label), '[a-z0-9]+') AS tok FROM t)
SELECT DISTINCT team_id FROM m WHERE {}"""


def remote_teams(spark, d):
    """Parts as remote teams: their name, brand and type stand for the team's, the shown and a member's name."""
    p = A.read(spark, d, "part")
    return p.select((F.col("p_partkey") + 1).alias("team_id"), F.col("p_name").alias("team_name"), F.col("p_brand").alias("display_name"), F.array("p_type").alias("member_names"))


@query(_REMOTE.format("contains(k, 'ringlarge') OR (list_contains(tok, 'ring') AND list_contains(tok, 'large'))"))
def remote_team_match(spark, d):
    return X.remote_team_match(remote_teams(spark, d), "Ring  large").select("team_id")


@query(_REMOTE.format("contains(k, 'in')"))
def remote_team_match_short(spark, d):
    return X.remote_team_match(remote_teams(spark, d), "in").select("team_id")


@query("SELECT p_partkey + 1 AS team_id FROM part")
def remote_team_match_blank(spark, d):
    return X.remote_team_match(remote_teams(spark, d), " - ").select("team_id")


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT name, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS alnum_key, trim(regexp_replace(regexp_replace(lower(name || ' (EU)'), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS family_key FROM n")
def name_keys(spark, d):
    n = A.read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return n.select("name", alnum_key(F.col("name")).alias("alnum_key"), family_key(F.concat("name", F.lit(" (EU)"))).alias("family_key"))


@query(_NAMES + _sim("large ring") + "SELECT team_id, round(similarity, 6) AS similarity FROM s")
def trigram_scores(spark, d):
    return names(spark, d).select("team_id", F.round(trigram_similarity(trigrams(F.col("name")), trigrams(F.lit("large ring"))), 6).alias("similarity"))
