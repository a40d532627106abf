"""The refresh job: lineups to vectors and clusterings, published as one snapshot."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterforge.operators import consolidate as C
from rosterforge.operators import lineups as L
from rosterforge.operators import vectors as V
from rosterforge.operators.snapshots import DEFAULT_IDF_CAP, SnapshotStore
from rosterforge.plans.storage import materialize

TABLES = ("embeddings", "player_support", "pair_support", "lineup_variants", "clusters", "configs")


@dataclass(frozen=True)
class Settings:
    """Parameters of a snapshot, stored with it."""

    semantic_dim: int = 64
    identity_dim: int = 256
    identity_beta: float = 3.0
    identity_idf_cap: float = DEFAULT_IDF_CAP
    strict_threshold: float = 0.94
    explore_threshold: float = 0.90
    family_min_overlap: float = 0.72
    max_cluster_teams: int = 2500


def embeddings(counted: DataFrame, support: DataFrame, settings: Settings) -> DataFrame:
    """One row a team: lineup metrics, top lineup, roster and the three vectors."""
    idf = L.player_idf(support, settings.identity_idf_cap)
    vectors = V.team_vectors(counted, support, idf, settings.semantic_dim, settings.identity_dim, settings.identity_beta)
    top = L.top_lineup(counted).select("team_id", F.col("lineup").alias("top_lineup"))
    return L.team_stats(counted).join(top, "team_id").join(L.roster(support), "team_id").join(vectors, "team_id")


def profiles(rows: DataFrame, settings: Settings) -> DataFrame:
    """profile, team_id, cluster_id, cluster_size: strict and explore by greedy thresholds, family by shared lineups."""
    family = rows.select("team_id", F.col("top_lineup").alias("lineup"), "lineup_count", "distinct_lineup_count", "top_lineup_share")
    found = {
        "strict": C.greedy_clusters(rows, settings.strict_threshold, 3, settings.max_cluster_teams),
        "explore": C.greedy_clusters(rows, settings.explore_threshold, 2, settings.max_cluster_teams),
        "family": C.clusters(family, C.eligible_pairs(family, settings.family_min_overlap)),
    }
    return reduce(DataFrame.unionByName, (f.select(F.lit(p).alias("profile"), "team_id", "cluster_id", "cluster_size") for p, f in found.items()))


def refresh(store: SnapshotStore, counted: DataFrame, at_ms: int, settings: Settings | None = None, keep: int = 10) -> int:
    """Build and publish the next snapshot of a store from lineup variants (team_id, lineup, n); returns its id.

    A failed step marks the run failed and raises; readers see the snapshot once all its tables are written. Snapshots beyond the newest `keep` go.
    """
    settings = settings or Settings()
    run_id = store.start_next(at_ms)
    with store.failing(run_id, at_ms):
        counted = materialize(counted)
        support = materialize(L.player_support(counted))
        rows = materialize(embeddings(counted, support, settings))
        config = store.spark.createDataFrame([asdict(settings)]).select(F.lit(run_id).cast("long").alias("run_id"), "*")
        tables = {
            "embeddings": rows, "player_support": support, "pair_support": L.pair_support(counted), "lineup_variants": counted,
            "clusters": profiles(rows, settings), "configs": config,
        }
    store.publish(run_id, tables, at_ms)
    store.retain(keep, TABLES)
    return run_id
