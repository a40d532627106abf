"""The serving layout of a snapshot, and searches that read little of it.

Beside a snapshot's tables stand the roster, its pairs and its lineups by player, in folders by bucket of the player, and the team rows in
folders by cell: the vectors nearest to one pivot. A search for a set of players reads the buckets of these players only. Its dense retrieval
knows each cell's pivot c and radius r, so no vector of the cell has a dot product with the query q above q.c + |q| r: it reads the
cells with the highest bounds until they hold enough teams, and then those others whose bound reaches the score of the last of these teams. The result is that
of a scan of all teams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterforge.functions.vectors import dot, literal
from rosterforge.operators import entity_search as E
from rosterforge.operators import lineups as L
from rosterforge.operators import search as S
from rosterforge.operators.snapshots import SnapshotStore
from rosterforge.operators.vector_join import MAX_PIVOTS, SLACK, placed, sampled_pivots
from rosterforge.plans.storage import materialize

#: Folders of the tables by player.
BUCKETS = 64
TABLES = ("serving_players", "serving_pairs", "serving_lineups", "serving_teams", "serving_cells")


def bucket_of(player):
    return F.pmod(F.xxhash64(player), F.lit(BUCKETS)).cast("int")


def layout(teams: DataFrame, support: DataFrame, pairs: DataFrame, counted: DataFrame, idf_cap: float = 3.0, pivots: int | None = None) -> dict[str, tuple[DataFrame, str | None]]:
    """The serving tables of a snapshot with the column of their folders. teams: team_id, lineup_count, final_vector and whatever a result shows."""
    by_player = support.join(L.player_idf(support, idf_cap).select("player_id", "idf"), "player_id").withColumn("bucket", bucket_of(F.col("player_id")))
    by_pair = pairs.withColumn("bucket", bucket_of(F.col("lo")))
    total = counted.groupBy("team_id").agg(F.sum("n").alias("total"))
    by_lineup = counted.join(total, "team_id").withColumn("player_id", F.explode("lineup")).withColumn("bucket", bucket_of(F.col("player_id")))
    rows = materialize(teams.join(total.withColumnRenamed("total", "variant_total"), "team_id", "left").fillna(0, ["variant_total"]))
    centres = sampled_pivots(rows, "final_vector", min(MAX_PIVOTS, max(1, pivots or math.isqrt(rows.count()))))
    home = materialize(placed(rows, centres, "final_vector").select("team_id", "cell", "d")) if len(centres) else rows.select("team_id", F.lit(0).alias("cell"), F.lit(0.0).alias("d"))
    sizes = home.groupBy("cell").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("teams"))
    spark = teams.sparkSession
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, pivot array<double>")  # MAX_PIVOTS rows at most
    return {
        "serving_players": (_sorted(by_player, "player_id"), "bucket"), "serving_pairs": (_sorted(by_pair, "lo", "hi"), "bucket"),
        "serving_lineups": (_sorted(by_lineup, "player_id"), "bucket"),
        "serving_teams": (rows.join(home.drop("d"), "team_id").repartition("cell"), "cell"), "serving_cells": (known.join(sizes, "cell"), None),
    }


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    """One file a folder, or some where the folder is large, each in order of the key, so that row groups are skipped, too."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", *keys)


def publish(store: SnapshotStore, run_id: int, tables: dict[str, tuple[DataFrame, str | None]]) -> None:
    for name, (rows, folders) in tables.items():
        store.write(run_id, name, rows, folders)


@dataclass
class Found:
    """Teams with embed_score, and how many of the cells were read."""

    teams: DataFrame
    cells_read: int
    cells: int


class StoredSearch:
    """Searches over the serving tables of one snapshot, by default the newest completed one."""

    def __init__(self, store: SnapshotStore, run_id: int | None = None):
        self.store, self.run_id = store, store.current() if run_id is None else run_id
        self._cells = store.read("serving_cells", self.run_id).collect()  # MAX_PIVOTS rows at most

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name, self.run_id)

    def _of_players(self, name: str, key: str, players: list[int]) -> DataFrame:
        """The rows of the players' buckets; folders of other buckets are not listed among the files to read."""
        folders = [r[0] for r in self.store.spark.createDataFrame([(p,) for p in players], "p long").select(bucket_of(F.col("p"))).distinct().collect()] if players else []
        return self._table(name).where(F.col("bucket").isin(folders) & F.col(key).isin(players))

    def profile(self, players, **dims) -> S.QueryProfile:
        ids = list(S.canonical_ids(players))
        known = self._of_players("serving_players", "player_id", ids).groupBy("player_id").agg(F.max("idf").alias("idf")).collect()  # a row a player
        return S.player_profile(ids, {r.player_id: r.idf for r in known}, **dims)

    def index(self, profile: S.QueryProfile) -> S.Index:
        """What the overlaps with the profile's players need: their rows, their pairs, and each lineup with one of them once."""
        ids = list(profile.players)
        wanted = F.array(*map(F.lit, ids)).cast("array<bigint>") if ids else F.array().cast("array<bigint>")
        lineups = self._of_players("serving_lineups", "player_id", ids).where(F.col("player_id") == F.array_min(F.array_intersect("lineup", wanted)))
        return S.Index(self._table("serving_teams"), self._of_players("serving_players", "player_id", ids), self._of_players("serving_pairs", "lo", ids), lineups.select("team_id", "lineup", "n", "total"))

    def teams_of(self, players) -> DataFrame:
        """team_id, overlap: the teams with any of the players, from the players' buckets."""
        ids = list(S.canonical_ids(players))
        return self._of_players("serving_players", "player_id", ids).groupBy("team_id").agg(F.countDistinct("player_id").alias("overlap"))

    def nearest(self, vector: list[float], k: int, min_score: float = 0.0) -> Found:
        """The k teams with the highest dot products of min_score or more (ties by id), exactly."""
        q = np.array(vector)
        length = float(np.sqrt(q @ q))
        bounds = sorted(((float(q @ np.array(c.pivot)) + length * c.radius + SLACK, c.cell, c.teams) for c in self._cells), reverse=True)
        bounds = [b for b in bounds if b[0] >= min_score]
        scored = self._table("serving_teams").withColumn("embed_score", dot(F.col("final_vector"), literal(vector)))
        first, held = [], 0
        while len(first) < len(bounds) and held < k:
            held += bounds[len(first)][2]
            first.append(bounds[len(first)][1])
        near = scored.where(F.col("cell").isin(first) & (F.col("embed_score") >= min_score))
        last = near.select("embed_score").orderBy(F.desc("embed_score")).limit(k).agg(F.min("embed_score"), F.count(F.lit(1))).first()
        floor = last[0] if last[1] == k else min_score
        cells = first + [cell for bound, cell, _ in bounds[len(first):] if bound >= floor]
        wanted = scored.where(F.col("cell").isin(cells) & (F.col("embed_score") >= floor))
        return Found(wanted.orderBy(F.desc("embed_score"), "team_id").limit(k), len(cells), len(self._cells))

    def whole_set_search(self, profile: S.QueryProfile, min_score: float = 0.0, rerank_limit: int = 200) -> DataFrame:
        """As search.whole_set_search over all teams."""
        return S.reranked(self.nearest(profile.vector, rerank_limit, min_score).teams.drop("cell", "snapshot_id"), self.index(profile), profile)

    def entity_search(self, players, top_n: int = 20, min_score: float = 0.0, rerank_limit: int = 200, recency_weight: float = 0.0, **dims) -> DataFrame:
        """As entity_search.entity_search over all teams, with the players' ids for a profile."""
        profile = self.profile(players, **dims)
        newest = self._table("serving_teams").agg(F.max("event_time_ms")).first()[0] if recency_weight > 0 else None
        tops = lambda rows: rows.select("team_id", F.col("top_lineup").alias("lineup"), "distinct_lineup_count", "top_lineup_share")
        find = lambda floor: materialize(self.whole_set_search(profile, floor, rerank_limit))
        found = find(min_score)
        relaxed = min_score > 0.0 and found.isEmpty()
        if relaxed:
            found = find(0.0)
        return E.finish(found.drop("distinct_lineup_count", "top_lineup_share"), tops(found), self.index(profile), profile, top_n, rerank_limit, relaxed, recency_weight, newest)
