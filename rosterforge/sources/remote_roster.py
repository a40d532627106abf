"""Remote tournament rosters from index-encoded JSON files.

The wire format is one array: objects are written as {"_k": v}, where k and v are positions of the key and the value in
the array; lists hold positions; negative positions stand for special values. A file holds one payload; many files make one frame.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Values of negative positions (fixed values of the format).
SPECIAL = {-1: None, -2: True, -3: False, -4: math.nan, -5: None, -6: math.inf, -7: None, -8: -math.inf, -9: -0.0}


class Payload:
    """Resolves positions of an index-encoded array, each once; references may be circular."""

    def __init__(self, items: list):
        self.items, self.seen = items, {}

    def at(self, position: int):
        if position < 0:
            return SPECIAL.get(position)
        if position not in self.seen:
            item = self.items[position] if position < len(self.items) else None
            if isinstance(item, dict):
                self.seen[position] = out = {}
                out.update(self.fields(item))
            elif isinstance(item, list):
                self.seen[position] = out = []
                out.extend(self.at(x) if isinstance(x, int) else x for x in item)
            else:
                self.seen[position] = item
        return self.seen[position]

    def fields(self, item: dict) -> dict:
        out = {}
        for key, value in item.items():
            try:
                name = self.at(int(key.removeprefix("_"))) if key.startswith("_") else None
                position = int(value)
            except (TypeError, ValueError):
                continue
            if name is not None:
                out[str(name)] = self.at(position)
        return out


def decode(text: str | list) -> dict:
    """The object that the first entry of a payload describes; anything malformed gives {}."""
    try:
        items = json.loads(text) if isinstance(text, str) else text
    except ValueError:
        return {}
    if not isinstance(items, list) or not items or not isinstance(items[0], dict):
        return {}
    return Payload(items).fields(items[0])


#: Where the teams of a tournament stand in the data of a route (fixed values of the format).
TEAMS_PATH = ("tournament", "ctx", "teams")
#: Fields of a team that are kept.
TEAM_FIELDS = "id long, name string, members array<struct<userId long, username string, inGameName string>>"


def _below(node, path):
    for step in path:
        node = node.get(step) if isinstance(node, dict) else None
    return node


def _whole(value) -> int | None:
    return int(value) if isinstance(value, (int, float)) and math.isfinite(value) else None


def _text(value) -> str | None:
    return None if value is None else str(value)


def _plain(team: dict) -> dict:
    """The kept fields of a team, without references to anything else."""
    members = [m for m in team.get("members") or () if isinstance(m, dict)]
    return {
        "id": _whole(team.get("id")), "name": _text(team.get("name")),
        "members": [{"userId": _whole(m.get("userId")), "username": _text(m.get("username")), "inGameName": _text(m.get("inGameName"))} for m in members],
    }


def plain_teams(payload: str) -> str:
    """The teams of a payload's first route that has any, as a JSON array of their kept fields."""
    for route in decode(payload).values():
        data = route.get("data") if isinstance(route, dict) else None
        if isinstance(data, str):
            try:
                data = json.loads(data)
            except ValueError:
                continue
        if isinstance(teams := _below(data, TEAMS_PATH), list):
            return json.dumps([_plain(t) for t in teams if isinstance(t, dict)])
    return "[]"


@F.pandas_udf(StringType())
def _plain_teams(payloads: pd.Series) -> pd.Series:
    return payloads.map(plain_teams)


def described(teams: DataFrame) -> DataFrame:
    """teams (id, name, members, others) as team_id, team_name, display_name, member_user_ids, member_names and the others.

    Ids and names of members count once each, names whatever their case; a nameless team is shown by three of its members.
    """
    strip = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\f"))
    title = strip(F.col("name"))
    ids = F.array_distinct(F.filter(F.transform("members", lambda m: m["userId"]), lambda i: i > 0))
    called = F.filter(F.flatten(F.transform("members", lambda m: F.array(strip(m["username"]), strip(m["inGameName"])))), lambda n: n != "")
    lower = F.transform("called", lambda n: F.lower(n))
    once = F.filter("called", lambda n, i: F.array_position("lower", F.lower(n)) == i + 1)
    rest = F.size("member_names") - 3
    shown = F.concat(
        F.lit("[No team name] "), F.array_join(F.slice("member_names", 1, 3), " / "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"))).otherwise("")
    )
    untitled = F.concat_ws(" ", F.lit("Untitled team"), F.col("id").cast("string"))
    display = F.when(title != "", title).when(F.size("member_names") > 0, shown).otherwise(untitled)
    rows = teams.withColumn("called", called).withColumn("lower", lower).withColumn("member_names", once)
    others = [c for c in teams.columns if c not in ("id", "name", "members")]
    return rows.select(*others, F.col("id").alias("team_id"), title.alias("team_name"), display.alias("display_name"), ids.alias("member_user_ids"), "member_names")


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    """One row for each team of the payload files under path, with the file it came from. Only the payload's decoding is Python."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), _plain_teams("value").alias("teams"))
    listed = files.select("file", F.explode(F.from_json("teams", f"array<struct<{TEAM_FIELDS}>>")).alias("t"))
    return described(listed.select("file", "t.*"))
