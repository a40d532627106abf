"""Family scopes: which teams stand for one entity, by the consensus of the search groups of its namesakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.functions.scalars import alnum_key

MAX_ANCHORS = 12


def scope_names(members: DataFrame, names: DataFrame) -> DataFrame:
    """team_id, name that most lineups of a scope's members (team_id, member) carry; a team counts at least once.

    names: team_id, name, lineup_count. Shorter, then alphabetically later names win ties; blank ones don't count.
    """
    known = names.select(F.col("team_id").alias("member"), F.trim("name").alias("name"), F.greatest(F.coalesce("lineup_count", F.lit(0)), F.lit(1)).alias("weight"))
    per = members.join(known.where("name <> ''"), "member").groupBy("team_id", "name").agg(F.sum("weight").alias("weight"))
    best = F.max_by("name", F.struct("weight", -F.length("name"), F.lower("name"), "name"))
    return per.groupBy("team_id").agg(best.alias("name"))


def consensus_scopes(groups: DataFrame, names: DataFrame) -> DataFrame:
    """team_id, member, scope_name: the scope of every team, itself included.

    groups: team_id, member (distinct), the search group that holds a team, itself included. A team's anchors are the members of its group
    whose name has the letters and digits of the group's name (if none has, all members), the 12 smallest ids of them. The scope is what more than
    half of the anchors' groups hold, at least two; if that lacks the team or is the team alone, it is the smallest of the anchors' groups.
    A team alone in its group is its own scope. A scope without a name takes its group's; null if
    that has none.
    """
    sized = groups.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("team_id")))
    alone, several = sized.where("size = 1").select("team_id", "member"), sized.where("size > 1").select("team_id", "member")
    group_names = scope_names(several, names).withColumnRenamed("name", "group_name")
    group_key = group_names.select("team_id", alnum_key(F.col("group_name")).alias("group_key"))
    member_key = names.select(F.col("team_id").alias("member"), alnum_key(F.trim("name")).alias("key"))
    rows = several.join(group_key, "team_id", "left").join(member_key, "member", "left")
    rows = rows.withColumn("namesake", F.coalesce(F.coalesce("key", F.lit("")) == F.col("group_key"), F.lit(False)))
    # Namesakes come first, so the others are anchors only where the first place is not a namesake's.
    by_id = Window.partitionBy("team_id").orderBy(F.desc("namesake"), "member")
    ranked = rows.withColumns({"place": F.row_number().over(by_id), "named": F.first("namesake").over(by_id)})
    anchors = ranked.where((F.col("place") <= MAX_ANCHORS) & (F.col("namesake") == F.col("named")))
    anchors = anchors.select("team_id", F.col("member").alias("anchor"))

    of_anchor = sized.select(F.col("team_id").alias("anchor"), "member", "size")
    held = anchors.join(of_anchor, "anchor")
    votes = held.groupBy("team_id", "member").agg(F.count(F.lit(1)).alias("votes"))
    per_team = anchors.groupBy("team_id").agg(F.count(F.lit(1)).alias("anchors"))
    agreed = votes.join(per_team, "team_id").where(F.col("votes") >= F.greatest(F.lit(2), F.floor(F.col("anchors") / 2) + 1))
    sound = agreed.groupBy("team_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("member") == F.col("team_id")).alias("own")).where("own AND n > 1")
    smallest = held.groupBy("team_id").agg(F.min(F.struct("size", "anchor")).alias("least")).select("team_id", F.col("least.anchor").alias("anchor"))
    by_vote = agreed.join(sound.select("team_id"), "team_id").select("team_id", "member")
    by_size = smallest.join(sound.select("team_id"), "team_id", "left_anti").join(of_anchor, "anchor").select("team_id", "member")
    scopes = alone.unionByName(by_vote).unionByName(by_size)
    named = scopes.join(scope_names(scopes, names), "team_id", "left").join(group_names, "team_id", "left")
    return named.select("team_id", "member", F.coalesce("name", "group_name").alias("scope_name"))
