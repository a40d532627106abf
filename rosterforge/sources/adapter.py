"""Domain frames over the driver's tables: orders are matches, customers teams, suppliers players.

Ids are shifted by one because ids of zero and less are dropped on ingest. Each frame has the columns of the domain
schema; the DuckDB text of every frame is in FRAMES, for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_ms(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS


def month_id(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("long")


def _times(key: Column, ts: Column) -> list[Column]:
    """Finish and creation time of a match: some missing, some in seconds, most in milliseconds."""
    finished = F.when(key % 3 == 0, F.lit(None)).when(key % 2 == 0, F.floor(day_ms(ts) / 1000)).otherwise(day_ms(ts) + 7_200_000)
    created = F.when(key % 5 == 0, F.lit(None)).otherwise(day_ms(ts))
    return [finished.cast("long").alias("last_game_finished_at_ms"), created.cast("long").alias("created_at_ms")]


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tournament_id, match_id, team_id, player_id: one row for each line of an order."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        month_id(F.col("o_orderdate")).alias("tournament_id"),
        (F.col("o_orderkey") + 1).alias("match_id"),
        (F.col("o_custkey") + 1).alias("team_id"),
        (F.col("l_suppkey") + 1).alias("player_id"),
    )


def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, tournament_id and times of every order."""
    o = read(spark, sf_dir, "orders")
    key, ts = F.col("o_orderkey"), F.col("o_orderdate")
    return o.select((key + 1).alias("match_id"), month_id(ts).alias("tournament_id"), *_times(key, ts))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided matches: an even order against the next one, by another customer."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    a, b = o.where("o_orderkey % 2 = 0").alias("a"), o.alias("b")
    key, ts = F.col("a.o_orderkey"), F.col("a.o_orderdate")
    t1, t2 = F.col("a.o_custkey") + 1, F.col("b.o_custkey") + 1
    winner = F.when(F.col("a.o_orderstatus") == "P", F.lit(None)).when(F.col("a.o_totalprice") >= F.col("b.o_totalprice"), t1).otherwise(t2)
    joined = a.join(b, F.col("b.o_orderkey") == key + 1).where("a.o_custkey <> b.o_custkey")
    return joined.select(
        (key + 1).alias("match_id"), month_id(ts).alias("tournament_id"),
        F.when(key % 7 == 0, F.lit(None)).otherwise(key % 50 + 1).cast("long").alias("round_id"),
        t1.alias("team1_id"), t2.alias("team2_id"), winner.cast("long").alias("winner_team_id"),
        F.floor(F.col("a.o_totalprice") / 50_000).cast("double").alias("team1_score"),
        F.floor(F.col("b.o_totalprice") / 50_000).cast("double").alias("team2_score"),
        *_times(key, ts),
    )


def match_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, tournament_id, team_id, player_id of two-sided matches."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    first = F.col("o_orderkey") - F.col("o_orderkey") % 2
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (first + 1).alias("match_id"), (F.col("o_custkey") + 1).alias("team_id"), (F.col("l_suppkey") + 1).alias("player_id")
    )


def tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tournament a month, starting on its first day."""
    ts = F.col("o_orderdate")
    months = read(spark, sf_dir, "orders").groupBy(month_id(ts).alias("tournament_id")).agg(F.min(day_ms(F.trunc(F.to_date(ts), "month"))).alias("start_time_ms"))
    return months.select("tournament_id", F.concat(F.lit("Cup "), F.col("tournament_id").cast("string")).alias("name"), "start_time_ms")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("team_id"), F.col("c_name").alias("name"))


def tournament_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, tournament_id, name: a team takes part in the months in which it ordered; its name changes with the month's parity."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") + 1).alias("team_id"), month_id(F.col("o_orderdate")).alias("tournament_id")).distinct()
    label = F.when(F.col("tournament_id") % 2 == 0, F.concat("name", F.lit(" (EU)"))).otherwise(F.col("name"))
    return o.join(teams(spark, sf_dir), "team_id").select("team_id", "tournament_id", label.alias("name"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, display_name; a tenth have a name of digits only and another tenth a blank one."""
    key = F.col("s_suppkey")
    name = F.when(key % 10 == 0, (key * 7).cast("string")).when(key % 10 == 1, F.lit("  ")).otherwise(F.col("s_name"))
    return read(spark, sf_dir, "supplier").select((key + 1).alias("player_id"), name.alias("display_name"))


def player_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calculations, the older one with other scores; a quarter of the players have no rank."""
    s = read(spark, sf_dir, "supplier")
    rank = F.when(F.col("s_suppkey") % 4 == 0, F.lit(None)).otherwise(F.floor((10_000 - F.col("s_acctbal")) / 100) + 1).cast("double")
    new = s.select((F.col("s_suppkey") + 1).alias("player_id"), F.col("s_acctbal").alias("score"), rank.alias("player_rank"), F.lit(2000).cast("long").alias("calculated_at_ms"))
    return new.unionByName(new.withColumns({"score": F.col("score") + 1.0, "player_rank": F.col("player_rank") + 5.0, "calculated_at_ms": F.lit(1000).cast("long")}))


def roster_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tournament_id, player_id: players register for the month in which they ship."""
    return read(spark, sf_dir, "lineitem").select(month_id(F.col("l_shipdate")).alias("tournament_id"), (F.col("l_suppkey") + 1).alias("player_id")).distinct()


def match_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, map_number (missing for two thirds), mode, points of both sides, victor: one row for each line of an order."""
    key, line, points = F.col("l_orderkey"), F.col("l_linenumber"), F.floor(F.col("l_quantity")).cast("long")
    victor = F.when(key % 4 == 0, "left").when(key % 4 == 1, "TEAM2").when(key % 4 == 2, "nobody")
    return read(spark, sf_dir, "lineitem").select(
        (key - key % 2 + 1).alias("match_id"), F.when(line % 3 == 1, line).cast("long").alias("map_number"), F.col("l_returnflag").alias("mode"),
        (points % 3).alias("team1_points"), (points % 2).alias("team2_points"), victor.alias("victor"),
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_id 1..50 with number, maps_count and maps_type."""
    return spark.range(1, 51).select(
        F.col("id").alias("round_id"),
        F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("id") % 6 + 1).cast("int").alias("number"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 30 - 2).cast("int").alias("maps_count"),
        F.when(F.col("id") % 2 == 0, F.lit("BEST_OF")).otherwise(F.lit("PLAY_ALL")).alias("maps_type"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, cluster_id, vectors (final 64-d; semantic and identity 32-d each) and lineup metrics of a snapshot."""
    from rosterforge.functions.vectors import l2_normalize

    e = read(spark, sf_dir, "embeddings")
    v, k = F.col("embedding").cast("array<double>"), F.col("vec_id")
    return e.select(
        (k + 1).alias("team_id"), F.col("label").cast("long").alias("cluster_id"), v.alias("final_vector"),
        l2_normalize(F.slice(v, 1, 32)).alias("semantic_vector"), l2_normalize(F.slice(v, 33, 32)).alias("identity_vector"),
        (k % 17 + 1).cast("long").alias("lineup_count"), (k % 5 + 1).cast("long").alias("distinct_lineup_count"),
        ((k % 9 + 1) / 10.0).alias("top_lineup_share"), ((k % 11) / 10.0).alias("lineup_entropy"),
        (F.lit(1_700_000_000_000) + (k % 400) * DAY_MS).cast("long").alias("event_time_ms"),
    )


def family_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, final_vector, lineup_count, players: teams of four share most of the first one's vector and roster, as lineups of one organisation do."""
    from rosterforge.functions.vectors import l2_normalize

    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    k = F.col("vec_id")
    first = e.select(k.alias("first"), F.col("v").alias("shared"))
    own = e.join(first, k - k % 4 == F.col("first")).withColumn("w", (k % 7 + 1) / 10.0)
    vector = l2_normalize(F.zip_with("shared", F.transform("v", lambda x: x * F.col("w")), lambda a, b: a + b))
    kept = lambda i: F.when(i <= 5 - k % 4, (k - k % 4) * 10 + i).otherwise(k * 10 + i + 1_000_000).cast("long")
    players = F.transform(F.sequence(F.lit(1), F.lit(5)), kept)
    return own.select((k + 1).alias("team_id"), vector.alias("final_vector"), (k % 17 + 1).cast("long").alias("lineup_count"), players.alias("players"))


def previous_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot before: some teams moved to their neighbour's vector, some clusters shifted, some teams absent."""
    now = snapshot(spark, sf_dir)
    moved = now.select((F.col("team_id") - 1).alias("at"), F.col("final_vector").alias("other_vector"))
    old = now.join(moved, now.team_id == moved["at"], "left").where("(team_id - 1) % 11 <> 0")
    k = F.col("team_id") - 1
    return old.select(
        "team_id",
        F.when(k % 6 == 0, (F.col("cluster_id") + 1) % 10).otherwise(F.col("cluster_id")).alias("cluster_id"),
        F.when((k % 5 == 0) & F.col("other_vector").isNotNull(), F.col("other_vector")).otherwise(F.col("final_vector")).alias("final_vector"),
        "lineup_count", F.round(F.col("lineup_entropy") * 0.9, 6).alias("lineup_entropy"),
    )


def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).where("(team_id - 1) % 13 <> 0")


def cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, cluster_id, cluster_size of clustered teams (a tenth are noise, cluster -1)."""
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("team_id"), F.when(F.col("vec_id") % 10 == 3, -1).otherwise(F.col("label")).cast("long").alias("cluster_id"))
    sizes = e.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return e.join(F.broadcast(sizes), "cluster_id").select("team_id", "cluster_id", "cluster_size")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh runs: one a tournament month, some failed, some without a finish time."""
    t = tournaments(spark, sf_dir)
    k = F.col("tournament_id")
    return t.select(
        k.alias("run_id"), F.when(k % 5 == 0, "failed").when(k % 7 == 0, "running").otherwise("completed").alias("status"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("start_time_ms") + (k % 3) * 31 * DAY_MS).cast("long").alias("finished_at_ms"),
    )


_MONTH = "(year({t}.o_orderdate) * 12 + month({t}.o_orderdate))::BIGINT"
_DAY = "((({t}.o_orderdate)::DATE - DATE '1970-01-01') * 86400000)::BIGINT"


def _sql_times(t: str) -> str:
    day = _DAY.format(t=t)
    return (
        f"CASE WHEN {t}.o_orderkey % 3 = 0 THEN NULL WHEN {t}.o_orderkey % 2 = 0 THEN {day} // 1000 ELSE {day} + 7200000 END AS last_game_finished_at_ms, "
        f"CASE WHEN {t}.o_orderkey % 5 = 0 THEN NULL ELSE {day} END AS created_at_ms"
    )


#: DuckDB text of each frame.
FRAMES = {
    "appearances": f"SELECT {_MONTH.format(t='o')} AS tournament_id, o_orderkey + 1 AS match_id, o_custkey + 1 AS team_id, l_suppkey + 1 AS player_id FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey",
    "match_rows": f"SELECT o_orderkey + 1 AS match_id, {_MONTH.format(t='o')} AS tournament_id, {_sql_times('o')} FROM orders o",
    "matches": f"""SELECT a.o_orderkey + 1 AS match_id, {_MONTH.format(t='a')} AS tournament_id,
        CASE WHEN a.o_orderkey % 7 = 0 THEN NULL ELSE a.o_orderkey % 50 + 1 END AS round_id,
        a.o_custkey + 1 AS team1_id, b.o_custkey + 1 AS team2_id,
        CASE WHEN a.o_orderstatus = 'P' THEN NULL WHEN a.o_totalprice >= b.o_totalprice THEN a.o_custkey + 1 ELSE b.o_custkey + 1 END AS winner_team_id,
        floor(a.o_totalprice / 50000) AS team1_score, floor(b.o_totalprice / 50000) AS team2_score, {_sql_times('a')}
        FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0 AND a.o_custkey <> b.o_custkey""",
    "match_sides": "SELECT o_orderkey - o_orderkey % 2 + 1 AS match_id, o_custkey + 1 AS team_id, l_suppkey + 1 AS player_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "tournaments": f"SELECT {_MONTH.format(t='o')} AS tournament_id, 'Cup ' || {_MONTH.format(t='o')}::VARCHAR AS name, min((date_trunc('month', o_orderdate)::DATE - DATE '1970-01-01') * 86400000)::BIGINT AS start_time_ms FROM orders o GROUP BY 1, 2",
    "teams": "SELECT c_custkey + 1 AS team_id, c_name AS name FROM customer",
    "tournament_teams": f"SELECT team_id, tournament_id, CASE WHEN tournament_id % 2 = 0 THEN name || ' (EU)' ELSE name END AS name FROM (SELECT DISTINCT o_custkey + 1 AS team_id, {_MONTH.format(t='o')} AS tournament_id FROM orders o) JOIN (SELECT c_custkey + 1 AS team_id, c_name AS name FROM customer) USING (team_id)",
    "players": "SELECT s_suppkey + 1 AS player_id, CASE WHEN s_suppkey % 10 = 0 THEN (s_suppkey * 7)::VARCHAR WHEN s_suppkey % 10 = 1 THEN '  ' ELSE s_name END AS display_name FROM supplier",
    "player_rankings": """SELECT s_suppkey + 1 AS player_id, s_acctbal + x AS score, (CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE floor((10000 - s_acctbal) / 100) + 1 END) + 5 * x AS player_rank, 2000 - 1000 * x AS calculated_at_ms
        FROM supplier, (VALUES (0), (1)) v(x)""",
    "roster_entries": "SELECT DISTINCT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS tournament_id, l_suppkey + 1 AS player_id FROM lineitem",
    "match_games": """SELECT l_orderkey - l_orderkey % 2 + 1 AS match_id, CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber END::BIGINT AS map_number, l_returnflag AS mode, floor(l_quantity)::BIGINT % 3 AS team1_points,
        floor(l_quantity)::BIGINT % 2 AS team2_points, CASE l_orderkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'TEAM2' WHEN 2 THEN 'nobody' END AS victor FROM lineitem""",
    "rounds": "SELECT i AS round_id, CASE WHEN i % 9 = 0 THEN NULL ELSE i % 6 + 1 END AS number, CASE WHEN i % 4 = 0 THEN NULL ELSE i % 30 - 2 END AS maps_count, CASE WHEN i % 2 = 0 THEN 'BEST_OF' ELSE 'PLAY_ALL' END AS maps_type FROM range(1, 51) r(i)",
    "snapshot": """SELECT team_id, cluster_id, v AS final_vector, [x / sn for x in v[1:32]] AS semantic_vector, [x / idn for x in v[33:64]] AS identity_vector,
        (team_id - 1) % 17 + 1 AS lineup_count, (team_id - 1) % 5 + 1 AS distinct_lineup_count, ((team_id - 1) % 9 + 1) / 10.0::DOUBLE AS top_lineup_share, ((team_id - 1) % 11) / 10.0::DOUBLE AS lineup_entropy,
        1700000000000 + ((team_id - 1) % 400) * 86400000 AS event_time_ms
        FROM (SELECT team_id, cluster_id, v, sqrt(list_dot_product(v[1:32], v[1:32])) AS sn, sqrt(list_dot_product(v[33:64], v[33:64])) AS idn
              FROM (SELECT vec_id + 1 AS team_id, label::BIGINT AS cluster_id, embedding::DOUBLE[] AS v FROM embeddings))""",
    "family_snapshot": """SELECT team_id, [x / sqrt(list_dot_product(v, v)) for x in v] AS final_vector, lineup_count, players FROM (
        SELECT o.vec_id + 1 AS team_id, [f.embedding[i]::DOUBLE + o.embedding[i]::DOUBLE * ((o.vec_id % 7 + 1) / 10.0::DOUBLE) for i in range(1, 65)] AS v, (o.vec_id % 17 + 1)::BIGINT AS lineup_count,
          [CASE WHEN i <= 5 - o.vec_id % 4 THEN (o.vec_id - o.vec_id % 4) * 10 + i ELSE o.vec_id * 10 + i + 1000000 END for i in range(1, 6)]::BIGINT[] AS players
        FROM embeddings o JOIN embeddings f ON f.vec_id = o.vec_id - o.vec_id % 4)""",
    "previous_snapshot": """SELECT n.team_id, CASE WHEN (n.team_id - 1) % 6 = 0 THEN (n.cluster_id + 1) % 10 ELSE n.cluster_id END AS cluster_id,
        CASE WHEN (n.team_id - 1) % 5 = 0 AND m.final_vector IS NOT NULL THEN m.final_vector ELSE n.final_vector END AS final_vector, n.lineup_count, round(n.lineup_entropy * 0.9::DOUBLE, 6) AS lineup_entropy
        FROM snapshot n LEFT JOIN snapshot m ON m.team_id = n.team_id + 1 WHERE (n.team_id - 1) % 11 <> 0""",
    "current_snapshot": "SELECT * FROM snapshot WHERE (team_id - 1) % 13 <> 0",
    "cluster_map": "SELECT team_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM (SELECT vec_id + 1 AS team_id, CASE WHEN vec_id % 10 = 3 THEN -1 ELSE label END::BIGINT AS cluster_id FROM embeddings)",
    "runs": "SELECT tournament_id AS run_id, CASE WHEN tournament_id % 5 = 0 THEN 'failed' WHEN tournament_id % 7 = 0 THEN 'running' ELSE 'completed' END AS status, CASE WHEN tournament_id % 6 = 0 THEN NULL ELSE start_time_ms + (tournament_id % 3) * 31 * 86400000 END AS finished_at_ms FROM tournaments",
}
_NEEDS = {"previous_snapshot": ("snapshot",), "current_snapshot": ("snapshot",), "runs": ("tournaments",)}


def with_frames(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` of the frames and what they need."""
    order: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({FRAMES[n]})" for n in order)
