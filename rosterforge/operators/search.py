"""Entity search: dense retrieval over a player set or target teams, sparse reranking, and its fallbacks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.functions.hashing import slots
from rosterforge.functions.scalars import clamp01, near_match
from rosterforge.functions.vectors import dot, literal

LINEUP_SIZE, MAX_SIGNATURE_PLAYERS = 4, 8


def canonical_ids(values) -> tuple[int, ...]:
    """Positive integer ids of possibly nested values, once each, in the order given."""
    if isinstance(values, (list, tuple, set, range)):
        return tuple(dict.fromkeys(i for v in values for i in canonical_ids(v)))
    try:
        i = int(str(values).strip())
    except ValueError:
        return ()
    return (i,) if i > 0 else ()


@dataclass
class QueryProfile:
    """Vector and sparse weights of a player set."""

    players: tuple[int, ...]
    vector: list[float]
    weights: dict[int, float]
    signatures: tuple[tuple[int, ...], ...] = ()
    pair_weights: dict[tuple[int, int], float] = field(default_factory=dict)


def _unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 0 else v


def player_profile(players, idf: dict[int, float], semantic_dim: int = 64, identity_dim: int = 256, beta: float = 3.0) -> QueryProfile:
    """Profile of a whole player set: hashed vector, idf weights, pair weights, and 4-player signatures for 4 to 8 players."""
    ids = tuple(sorted(canonical_ids(players)))
    semantic, identity = [0.0] * semantic_dim, [0.0] * identity_dim
    for p in ids:
        sb, ss, ib, is_ = slots(p, semantic_dim, identity_dim)
        semantic[sb] += ss
        identity[ib] += is_ * idf.get(p, 1.0)
    vector = _unit([*_unit(semantic), *(beta * x for x in _unit(identity))])
    weights = {p: max(idf.get(p, 1.0), 1e-9) for p in ids}
    signatures = tuple(combinations(ids, LINEUP_SIZE)) if LINEUP_SIZE <= len(ids) <= MAX_SIGNATURE_PLAYERS else ()
    return QueryProfile(ids, vector, weights, signatures, {(a, b): weights[a] * weights[b] for a, b in combinations(ids, 2)})


def _rows(df: DataFrame, schema: str, rows: list) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def player_overlap(support: DataFrame, weights: dict[int, float]) -> DataFrame:
    """team_id, player_overlap: weighted mean of the query players' support; teams without any of them are absent (0)."""
    total = sum(weights.values())
    q = _rows(support, "player_id long, w double", list(weights.items()))
    return support.join(F.broadcast(q), "player_id").groupBy("team_id").agg((F.sum(F.col("w") * F.col("support")) / total).alias("player_overlap"))


def pair_overlap(pairs: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    total = sum(weights.values()) or 1.0
    q = _rows(pairs, "lo long, hi long, w double", [(a, b, w) for (a, b), w in weights.items()])
    return pairs.join(F.broadcast(q), ["lo", "hi"]).groupBy("team_id").agg((F.sum(F.col("w") * F.col("support")) / total).alias("pair_overlap"))


def match_fraction(a: Column, b: Column) -> Column:
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def lineup_overlap(counted: DataFrame, signatures) -> DataFrame:
    """team_id, lineup_overlap: best share of a variant that equals a signature, or share times overlap where it nearly does.

    counted: team_id, lineup, n, and total where it doesn't hold all of a team's lineups.
    """
    q = _rows(counted, "sig array<long>", [(list(s),) for s in signatures])
    if "total" not in counted.columns:
        counted = counted.join(counted.groupBy("team_id").agg(F.sum("n").alias("total")), "team_id")
    share = F.col("n") / F.col("total")
    # A near match shares at least three players, so variants meet signatures over their players, not all with all.
    touching = q.select("sig", F.explode("sig").alias("p"))
    variants = counted.select("team_id", "lineup", "n", "total", F.explode("lineup").alias("p"))
    met = variants.join(F.broadcast(touching), "p").groupBy("team_id", "lineup", "n", "total", "sig").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 3")
    value = F.when(F.col("lineup") == F.col("sig"), share).when(near_match(F.col("lineup"), F.col("sig")), share * match_fraction(F.col("lineup"), F.col("sig")))
    return met.groupBy("team_id").agg(clamp01(F.max(value)).alias("lineup_overlap"))


def lineup_boost(base: Column, overlap: Column, strength: float = 0.35) -> Column:
    b = clamp01(base)
    return F.when(overlap > 0, clamp01(b + strength * overlap * (1.0 - b))).otherwise(b)


def blend_with_best(group: Column, best: Column, strength: float = 0.45) -> Column:
    g, b = clamp01(group), clamp01(best)
    return F.when(b <= g, g).otherwise(clamp01(g + strength * (b - g)))


def rerank_score(embed: Column, player: Column, pair: Column, lineup: Column, weights=(0.70, 0.15, 0.15)) -> Column:
    return lineup_boost(weights[0] * embed + weights[1] * player + weights[2] * pair, lineup)


@dataclass
class Index:
    """Frames of a snapshot: teams (team_id, final_vector, lineup_count), support, pairs and counted lineups."""

    teams: DataFrame
    support: DataFrame
    pairs: DataFrame
    counted: DataFrame


def whole_set_search(index: Index, profile: QueryProfile, min_score: float = 0.0, rerank_limit: int = 200) -> DataFrame:
    """Teams with embed_score, the three overlaps and rerank_score; the best rerank_limit by embed_score, in no order."""
    scored = index.teams.withColumn("embed_score", dot(F.col("final_vector"), literal(profile.vector))).where(F.col("embed_score") >= min_score)
    return reranked(scored.orderBy(F.desc("embed_score"), "team_id").limit(rerank_limit), index, profile)


def reranked(top: DataFrame, index: Index, profile: QueryProfile) -> DataFrame:
    """top (team_id, embed_score and others) with the three overlaps and rerank_score."""
    out = top
    for frame in (player_overlap(index.support, profile.weights), pair_overlap(index.pairs, profile.pair_weights), lineup_overlap(index.counted, profile.signatures)):
        out = out.join(frame, "team_id", "left")
    out = out.fillna(0.0, ["player_overlap", "pair_overlap", "lineup_overlap"])
    score = rerank_score(*(F.col(c) for c in ("embed_score", "player_overlap", "pair_overlap", "lineup_overlap")))
    return out.withColumn("rerank_score", score)


def best_first() -> list[Column]:
    return [F.desc("rerank_score"), F.desc("lineup_overlap"), F.desc("embed_score"), F.desc("lineup_count"), F.asc("team_id")]


def targets_by_players(rosters: DataFrame, players, limit: int = 50) -> DataFrame:
    """team_id, overlap, lineup_count of teams with any of the players; most players first."""
    wanted = _rows(rosters, "player_id long", [(p,) for p in canonical_ids(players)])
    hits = rosters.join(F.broadcast(wanted), "player_id").groupBy("team_id").agg(F.countDistinct("player_id").alias("overlap"), F.max("lineup_count").alias("lineup_count"))
    return hits.orderBy(F.desc("overlap"), F.desc("lineup_count"), "team_id").limit(limit)


def seed_quality(rosters: DataFrame, players) -> DataFrame:
    """team_id, overlap, quality = f1^2 * (1 + recall) of teams within one player of the best overlap and 0.4 of the best quality."""
    ids = canonical_ids(players)
    wanted = _rows(rosters, "player_id long, wanted int", [(p, 1) for p in ids])
    per = rosters.join(F.broadcast(wanted), "player_id", "left").groupBy("team_id").agg(F.count("wanted").alias("overlap"), F.count(F.lit(1)).alias("size")).where("overlap > 0")
    precision, recall = F.col("overlap") / F.col("size"), F.col("overlap") / F.lit(float(len(ids)))
    f1 = 2.0 * precision * recall / (precision + recall)
    per = per.withColumn("quality", f1 * f1 * (1.0 + recall))
    best = per.agg(F.max("overlap").alias("o"), F.max("quality").alias("q"))
    return per.join(F.broadcast(best), (F.col("overlap") >= F.col("o") - 1) & (F.col("quality") >= 0.4 * F.col("q"))).select("team_id", "overlap", "quality")


def subset_projection(rosters: DataFrame, players, size: int = 4, max_subsets: int = 96, per_subset: int = 12) -> DataFrame:
    """team_id, score, hits: over the first max_subsets subsets of the players, the sum of each team's share of the subset it holds,
    relative to the best team of that subset; teams that hold fewer than all but one of a subset don't count.
    """
    from pyspark.sql import Window

    ids = canonical_ids(players)
    subsets = list(combinations(ids, size))[:max_subsets]
    q = _rows(rosters, "subset int, player_id long", [(k, p) for k, s in enumerate(subsets) for p in s])
    hits = rosters.join(F.broadcast(q), "player_id").groupBy("subset", "team_id").agg(F.count(F.lit(1)).alias("held"), F.max("lineup_count").alias("lineup_count"), F.max("roster_size").alias("roster_size"))
    precision, recall = F.col("held") / F.col("roster_size"), F.col("held") / F.lit(float(size))
    f1 = 2.0 * precision * recall / (precision + recall)
    hits = hits.withColumn("q", f1 * f1 * (1.0 + recall))
    per = Window.partitionBy("subset")
    place = F.row_number().over(per.orderBy(F.desc("held"), F.desc("q"), F.desc("lineup_count"), "team_id"))
    kept = hits.withColumn("best", F.max("held").over(per)).withColumn("rn", place).where(f"held >= best - 1 AND rn <= {per_subset}")
    share = F.col("q") / F.max("q").over(per)
    return kept.withColumn("share", share).groupBy("team_id").agg(F.sum("share").alias("score"), F.count(F.lit(1)).alias("hits"))


def evaluate(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """recall_at_1, recall_at_5, mrr of ranked (query, rank, team_id) against expected (query, team_id)."""
    first = expected.join(ranked, ["query", "team_id"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return first.agg(at(1).alias("recall_at_1"), at(5).alias("recall_at_5"), F.avg(F.when(F.col("rank").isNotNull(), 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))
