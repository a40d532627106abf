"""The tables of a snapshot as declared, and rows made to fit them.

A column may be added to a declaration at any time: rows written without it hold nulls, and so do the snapshots written before. Nothing else changes a
declaration, so every snapshot is read with the same columns and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns by table: type, and an exclamation mark where a write must give them.
DECLARED: dict[str, dict[str, str]] = {
    "embeddings": {
        "team_id": "bigint!", "tournament_id": "bigint", "team_name": "string", "event_time_ms": "bigint", "lineup_count": "bigint", "tournament_count": "bigint",
        "unique_player_count": "int", "distinct_lineup_count": "bigint", "top_lineup_share": "double", "lineup_entropy": "double", "effective_lineups": "double",
        "effective_lineups_raw": "double", "semantic_vector": "array<double>", "identity_vector": "array<double>", "final_vector": "array<double>!",
        "top_lineup": "array<bigint>", "top_lineup_summary": "string", "players": "array<bigint>", "match_counts": "array<bigint>",
    },
    "player_support": {"team_id": "bigint!", "player_id": "bigint!", "matches": "bigint", "support": "double!"},
    "pair_support": {"team_id": "bigint!", "lo": "bigint!", "hi": "bigint!", "matches": "bigint", "support": "double!"},
    "lineup_variants": {"team_id": "bigint!", "lineup": "array<bigint>!", "n": "bigint!"},
    "clusters": {"profile": "string!", "team_id": "bigint!", "cluster_id": "bigint!", "cluster_size": "bigint!", "representative_team_name": "string"},
    "configs": {
        "run_id": "bigint!", "semantic_dim": "int", "identity_dim": "int", "identity_beta": "double", "identity_idf_cap": "double", "strict_threshold": "double",
        "explore_threshold": "double", "family_min_overlap": "double", "max_cluster_teams": "int",
    },
}
#: The column by whose values a table lies in folders.
FOLDERS = {"clusters": "profile"}


def schema_of(table: str) -> T.StructType | None:
    """The declared columns, those in folder names last; None for a table that isn't declared."""
    columns = DECLARED.get(table)
    if columns is None:
        return None
    ordered = sorted(columns, key=lambda c: c == FOLDERS.get(table))
    return T.StructType.fromDDL(", ".join(f"{c} {columns[c].rstrip('!')}" for c in ordered))


def conform(rows: DataFrame, table: str) -> DataFrame:
    """rows with exactly the declared columns and types; a missing needed column, an unknown one, or a null in a needed one is an error."""
    columns = DECLARED.get(table)
    if columns is None:
        return rows
    missing = [c for c, kind in columns.items() if kind.endswith("!") and c not in rows.columns]
    unknown = [c for c in rows.columns if c not in columns]
    if missing or unknown:
        raise ValueError(f"{table}: columns missing {missing}, not declared {unknown}")

    def fitted(c: str, kind: str):
        if c not in rows.columns:
            return F.lit(None).cast(kind)
        value = F.col(c).cast(kind.rstrip("!"))
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{table}: {c} is null")).cast(kind.rstrip("!"))).otherwise(value) if kind.endswith("!") else value

    return rows.select(*(fitted(c, kind).alias(c) for c, kind in columns.items()))
