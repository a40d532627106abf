"""Rounds of matches, from whichever table of a catalog tells most about them.

A rounds table that gives the number and kind of a round's maps is expanded to one row a map. Where there is none, the candidate tables
that exist are looked up in the catalog, the columns of each are matched with the roles below, and the table with the most useful roles is
read; its rows are maps already. Only schemas are looked at for the choice, no rows.

Defined cases: no usable table gives no rows; values that are no numbers count as missing; matches with an id of zero or less, or none, are
left out; maps without a number follow the last numbered one of their match, ordered by their other columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType

from rosterforge.operators.matches import MAX_MAPS, running_map_index

#: Tables that may hold the maps of matches, the preferred ones first (fixed values).
CANDIDATES = ("match_rounds", "match_round", "match_maps", "match_round_map", "match_games", "match_map", "match_game")
#: Columns that may play each role, the preferred ones first (fixed values).
ROLES = {
    "round_no": ("round_no", "round_number", "round", "map_no", "map_number", "number", "index"),
    "map_name": ("map_name", "map", "stage_name", "name", "source", "map_label"),
    "maps_count": ("maps_count", "maps", "map_count", "match_maps_count", "match_map_count", "game_count"),
    "map_mode": ("map_mode", "mode", "game_mode", "map_mode_hint", "type"),
    "winner_team": ("winner_team_id", "winner_id", "winner_side_id", "winning_team_id", "winner"),
    "winner_side": ("winner_side", "winner", "result", "victor"),
    "round_id": ("round_id",),
    "tournament_id": ("tournament_id",),
}
#: Pairs of columns that may hold both scores, the preferred ones first (fixed values).
SCORES = (
    ("team1_score", "team2_score"), ("team_1_score", "team_2_score"), ("score1", "score2"), ("score_1", "score_2"), ("team1_points", "team2_points"),
    ("team1_goals", "team2_goals"), ("team_a_score", "team_b_score"), ("a_score", "b_score"), ("left_score", "right_score"),
)
#: Texts that name a winning side (fixed values).
SIDES = {"team_a": ("team_a", "a", "1", "left", "left_team", "team1"), "team_b": ("team_b", "b", "2", "right", "right_team", "team2")}
#: What a rounds table needs (fixed values).
ROUNDS_COLUMNS = ("round_id", "number", "maps_count", "maps_type")

OUTPUT = (
    "match_id", "tournament_id", "round_id", "round_no", "map_index", "maps_count", "map_name", "map_mode", "team_a_score", "team_b_score", "winner_team_id", "winner_side",
)


@dataclass(frozen=True)
class Layout:
    """Role -> column of a table of maps, its pair of scores, and how useful it is (0 to 6)."""

    columns: Mapping[str, str]
    scores: tuple[str, str] | None
    usefulness: int


def layout_of(columns: Iterable[str]) -> Layout | None:
    """The layout of a table with these columns, by their lower-case names; None if it has no match_id or nothing useful."""
    have = {c.lower(): c for c in reversed(list(columns))}
    if "match_id" not in have:
        return None
    found = {role: next((have[n] for n in names if n in have), None) for role, names in ROLES.items()}
    scores = next(((have[a], have[b]) for a, b in SCORES if a in have and b in have), None)
    useful = 2 * bool(found["round_no"]) + bool(found["map_name"] or found["map_mode"]) + 2 * bool(scores) + bool(found["winner_team"] or found["winner_side"])
    named = {"match_id": have["match_id"]} | {role: c for role, c in found.items() if c}
    return Layout(named, scores, useful) if useful else None


def discovered(spark: SparkSession, names: Iterable[str], database: str | None = None) -> dict[str, DataFrame]:
    """The tables or views among names that the catalog knows, in the order of names."""
    full = {name: f"`{database}`.`{name}`" if database else f"`{name}`" for name in names}
    return {name: spark.table(path) for name, path in full.items() if spark.catalog.tableExists(path)}


def most_useful(tables: Mapping[str, DataFrame]) -> tuple[str, Layout] | None:
    """Name and layout of the most useful candidate, the first in order among equals."""
    laid = [(name, layout) for name, table in tables.items() if (layout := layout_of(table.columns))]
    return max(laid, key=lambda c: c[1].usefulness, default=None)


def _plain(column: Column, kind: DataType) -> Column:
    return column if isinstance(kind, NumericType | BooleanType) else column.cast("string")


def whole(table: DataFrame, name: str) -> Column:
    """A column as long, null where it is no whole number."""
    return _plain(table[name], table.schema[name].dataType).try_cast("long")


def real(table: DataFrame, name: str) -> Column:
    """A column as finite double, null otherwise."""
    value = _plain(table[name], table.schema[name].dataType).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def words(table: DataFrame, name: str) -> Column:
    """A column as trimmed text, null if blank."""
    value = F.btrim(table[name].cast("string"), F.lit(" \t\n\r\f\v"))
    return F.when(value != "", value)


def seen_by(matches: DataFrame, team_a: list[int], team_b: list[int]) -> DataFrame:
    """match_id, tournament (0 if unknown), a and b (the teams of both scopes, if any), swapped (team2 is the one of team_a), and round and scores if given."""
    first, second = F.col("team1_id").isin(team_a), F.col("team2_id").isin(team_a)
    both = F.col("team1_id").isNotNull() & F.col("team2_id").isNotNull()
    other = F.when(first, F.col("team2_id")).when(second, F.col("team1_id"))
    extra = [whole(matches, c).alias(f"m_{c}") for c in ("round_id", "winner_team_id") if c in matches.columns]
    extra += [real(matches, c).alias(f"m_{c}") for c in ("team1_score", "team2_score") if c in matches.columns]
    return matches.where("match_id > 0").select(
        "match_id", F.coalesce(whole(matches, "tournament_id"), F.lit(0)).alias("tournament"),
        F.when(both & first, F.col("team1_id")).when(both & second, F.col("team2_id")).alias("a"),
        F.when(both & other.isin(team_b), other).alias("b"), F.coalesce(~(both & first), F.lit(True)).alias("swapped"), *extra,
    )


def _side(text: Column) -> Column:
    lower = F.lower(F.btrim(text))
    return F.when(lower.isin(*SIDES["team_a"]), "team_a").when(lower.isin(*SIDES["team_b"]), "team_b")


def _sided(rows: DataFrame) -> DataFrame:
    """rows with the scores of both scopes and the winning side: by the winner's id, else by what the row says, else by the scores."""
    a, b = (F.when(F.col("swapped"), F.col(y)).otherwise(F.col(x)) for x, y in (("score1", "score2"), ("score2", "score1")))
    named = F.when(F.col("winner_team_id") == F.col("a"), "team_a").when(F.col("winner_team_id") == F.col("b"), "team_b")
    told = F.when(F.col("winner_team_id").isNull(), _side(F.col("told")))
    scored = F.when(F.col("team_a_score") > F.col("team_b_score"), "team_a").when(F.col("team_a_score") < F.col("team_b_score"), "team_b")
    return rows.withColumns({"team_a_score": a, "team_b_score": b}).withColumn("winner_side", F.coalesce(named, told, scored))


def expanded(seen: DataFrame, rounds: DataFrame) -> DataFrame:
    """One row for each map of a match's round, 1 to MAX_MAPS of them, with the match's scores; OUTPUT."""
    count = F.coalesce(whole(rounds, "maps_count"), F.lit(1))
    r = rounds.select(
        whole(rounds, "round_id").alias("m_round_id"), whole(rounds, "round_id").alias("round_id"), whole(rounds, "number").alias("number"),
        F.least(F.greatest(count, F.lit(1)), F.lit(MAX_MAPS)).alias("maps_count"), words(rounds, "maps_type").alias("map_mode"),
    )
    maps = seen.join(r, "m_round_id", "left").withColumn("maps_count", F.coalesce("maps_count", F.lit(1)).cast("long"))
    rows = maps.withColumn("map_index", F.explode(F.sequence(F.lit(1).cast("long"), F.col("maps_count")))).withColumns({
        "tournament_id": F.col("tournament"), "round_no": F.coalesce("number", "map_index"), "map_name": F.lit(None).cast("string"), "told": F.lit(None).cast("string"),
        "score1": F.col("m_team1_score"), "score2": F.col("m_team2_score"), "winner_team_id": F.col("m_winner_team_id"),
    })
    return _sided(rows).select(*OUTPUT)


def from_candidate(seen: DataFrame, table: DataFrame, layout: Layout) -> DataFrame:
    """One row for each row of the table that belongs to a match, read by the layout; OUTPUT."""
    at = layout.columns
    number = lambda role: whole(table, at[role]) if role in at else F.lit(None).cast("long")
    text = lambda role: words(table, at[role]) if role in at else F.lit(None).cast("string")
    score1, score2 = (real(table, c) for c in layout.scores) if layout.scores else (F.lit(None).cast("double"),) * 2
    maps = table.select(
        number("match_id").alias("match_id"), number("tournament_id").alias("row_tournament"), number("round_id").alias("round_id"), number("round_no").alias("round_no"),
        number("maps_count").alias("maps_count"), text("map_name").alias("map_name"), text("map_mode").alias("map_mode"), score1.alias("score1"), score2.alias("score2"),
        number("winner_team").alias("winner_team_id"), (F.lit(None).cast("string") if "winner_team" in at else text("winner_side")).alias("told"),
    )
    # A tournament of zero or none is that of the match.
    own = F.when(F.col("row_tournament") != 0, F.col("row_tournament"))
    rows = maps.join(seen, "match_id").withColumn("tournament_id", F.coalesce(own, "tournament"))
    order = [F.col("round_no").asc_nulls_last(), "round_id", "map_name", "map_mode", "maps_count", "score1", "score2", "winner_team_id", "told"]
    key = ("match_id", "tournament_id")
    placed = rows.withColumns({"position": F.row_number().over(Window.partitionBy(*key).orderBy(*order)), "map_index": F.col("round_no")})
    return _sided(running_map_index(placed, key)).select(*OUTPUT)


def rounds_of(spark: SparkSession, matches: DataFrame, team_a: list[int], team_b: list[int], database: str | None = None) -> DataFrame:
    """OUTPUT of matches as seen from team_a's side: by the catalog's rounds table if it is complete, else by its most useful candidate."""
    seen = seen_by(matches, team_a, team_b)
    rounds = discovered(spark, ["rounds"], database).get("rounds")
    needed = {f"m_{c}" for c in ("round_id", "winner_team_id", "team1_score", "team2_score")}
    if rounds is not None and set(ROUNDS_COLUMNS) <= set(rounds.columns) and needed <= set(seen.columns):
        return expanded(seen, rounds)
    tables = discovered(spark, CANDIDATES, database)
    best = most_useful(tables)
    if best is None:
        types = ["long"] * 6 + ["string"] * 2 + ["double"] * 2 + ["long", "string"]
        return seen.where(F.lit(False)).select(*(F.lit(None).cast(t).alias(c) for c, t in zip(OUTPUT, types, strict=True)))
    return from_candidate(seen, tables[best[0]], best[1])
