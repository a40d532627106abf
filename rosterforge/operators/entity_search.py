"""Entity search from end to end: retrieval, consolidation of aliases, rescoring of the groups, order and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.functions.scalars import recency
from rosterforge.functions.vectors import dot, literal
from rosterforge.operators import consolidate as C
from rosterforge.operators import search as S
from rosterforge.operators import vectors as V
from rosterforge.plans.storage import materialize

PARTS = ("embed_score", "player_overlap", "pair_overlap", "lineup_overlap")


def candidate_count(top_n: int, rerank_limit: int) -> int:
    """Teams to consolidate so that top_n groups are left: five times as many or ten more, within the reranked ones."""
    return min(max(top_n, rerank_limit), max(5 * top_n, 10 + top_n))


def rescored(
    found: DataFrame, tops: DataFrame, index: S.Index, profile: S.QueryProfile, recency_weight: float = 0.0, newest_ms: int | None = None
) -> DataFrame:
    """group_id, team_id (the best-ranked member), team_ids, lineup_count, the four scores and rerank_score of the groups of found teams.

    tops: team_id, lineup, distinct_lineup_count, top_lineup_share. Each score of a group is that of its merged rows, raised towards its best member's.
    With a recency_weight (found then has event_time_ms), embedding scores are blended with the age of the teams from newest_ms, a group's being the mean of its members'
    weighted by their lineups.
    """
    rows = materialize(found.join(tops.select("team_id", "lineup", "distinct_lineup_count", "top_lineup_share"), "team_id"))
    member = materialize(C.groups(rows, C.eligible_pairs(rows)))
    weight = F.greatest(F.col("lineup_count"), F.lit(1))
    fresh = F.lit(0.0) if recency_weight <= 0 else recency(F.col("event_time_ms"), F.lit(newest_ms).cast("long"))
    aged = lambda score, age: score if recency_weight <= 0 else (1.0 - recency_weight) * score + recency_weight * age
    joined = rows.join(member, "team_id").withColumn("fresh", fresh)
    centre = V.weighted_centroid(joined, "final_vector", weight, ["group_id"])
    first = F.struct(-F.col("rerank_score"), -F.col("lineup_overlap"), -F.col("embed_score"), -F.col("lineup_count"), "team_id")
    best = joined.withColumn("embed_score", aged(F.col("embed_score"), F.col("fresh"))).groupBy("group_id").agg(
        F.min_by("team_id", first).alias("team_id"), F.sum("lineup_count").alias("lineup_count"), F.array_sort(F.collect_list("team_id")).alias("team_ids"),
        (F.sum(weight * F.col("fresh")) / F.sum(weight)).alias("fresh"), *(F.max(c).alias(c) for c in PARTS),
    )
    as_team = lambda frame: frame.withColumnRenamed("group_id", "team_id")
    variants = C.merged_variants(index.counted, member)
    if "total" in index.counted.columns:  # the index holds some of the lineups only, found has the number of all
        variants = variants.join(joined.groupBy("group_id").agg(F.sum("variant_total").alias("total")), "group_id")
    overlaps = {
        "player_overlap": S.player_overlap(as_team(C.merged_support(index.support, rows, member, ["player_id"])), profile.weights),
        "pair_overlap": S.pair_overlap(as_team(C.merged_support(index.pairs, rows, member, ["lo", "hi"])), profile.pair_weights),
        "lineup_overlap": S.lineup_overlap(as_team(variants), profile.signatures),
    }
    out = best.join(centre, "group_id")
    for name, frame in overlaps.items():
        merged = frame.select(F.col("team_id").alias("group_id"), F.col(name).alias("merged"))
        out = out.join(merged, "group_id", "left").withColumn(name, S.blend_with_best(F.coalesce("merged", F.lit(0.0)), F.col(name))).drop("merged")
    own = aged(dot(F.col("centroid"), literal(profile.vector)), F.col("fresh"))
    out = out.withColumn("embed_score", S.blend_with_best(own, F.col("embed_score"))).drop("fresh")
    return out.withColumn("rerank_score", S.rerank_score(*(F.col(c) for c in PARTS)))


def finish(
    found: DataFrame, tops: DataFrame, index: S.Index, profile: S.QueryProfile, top_n: int, rerank_limit: int, relaxed: bool,
    recency_weight: float = 0.0, newest_ms: int | None = None,
) -> DataFrame:
    """Widening, consolidation, rescoring, order and cut of found teams."""
    wide = found.orderBy(*S.best_first()).limit(candidate_count(top_n, rerank_limit))
    groups = rescored(wide, tops, index, profile, recency_weight, newest_ms)
    order = [F.desc("rerank_score"), F.desc("embed_score"), F.desc("lineup_count"), F.asc("team_id")]
    # One window over at most candidate_count rows.
    placed = groups.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= top_n)
    return placed.withColumn("relaxed", F.lit(relaxed)).select("place", "group_id", "team_id", "team_ids", "relaxed", "lineup_count", "rerank_score", *PARTS).orderBy("place")


def entity_search(
    index: S.Index, tops: DataFrame, profile: S.QueryProfile, top_n: int = 20, min_score: float = 0.0, rerank_limit: int = 200,
    recency_weight: float = 0.0, newest_ms: int | None = None,
) -> DataFrame:
    """place, group_id, team_id, team_ids, relaxed, lineup_count and scores of the top_n groups, in order.

    Where no team reaches min_score, the search is repeated without it, and relaxed is true. An empty profile finds nothing.
    """
    found = S.whole_set_search(index, profile, min_score, rerank_limit)
    relaxed = min_score > 0.0 and found.isEmpty()
    if relaxed:
        found = S.whole_set_search(index, profile, 0.0, rerank_limit)
    return finish(found, tops, index, profile, top_n, rerank_limit, relaxed, recency_weight, newest_ms)
