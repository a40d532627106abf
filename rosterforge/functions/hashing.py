"""Player hashes: bucket and sign from an 8-byte BLAKE2b of `id|salt`."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Salts of the four hashes (fixed values).
SALTS = ("sem_idx", "sem_sign", "id_idx", "id_sign")


def player_hash(player_id: int, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{player_id}|{salt}".encode(), digest_size=8).digest(), "little")


def slots(player_id: int, semantic_dim: int = 64, identity_dim: int = 256) -> tuple[int, int, int, int]:
    """Semantic bucket and sign, identity bucket and sign."""
    a, b, c, d = (player_hash(player_id, s) for s in SALTS)
    return a % semantic_dim, 1 - 2 * (b & 1), c % identity_dim, 1 - 2 * (d & 1)


def hashed_players(players: DataFrame, semantic_dim: int = 64, identity_dim: int = 256) -> DataFrame:
    """player_id, sem_bucket, sem_sign, id_bucket, id_sign of the distinct players (each is hashed once)."""

    @F.pandas_udf("sem_bucket int, sem_sign int, id_bucket int, id_sign int")
    def hashes(ids: pd.Series) -> pd.DataFrame:
        rows = [slots(int(i), semantic_dim, identity_dim) for i in ids]
        return pd.DataFrame(rows, columns=["sem_bucket", "sem_sign", "id_bucket", "id_sign"])

    return players.select("player_id").distinct().select("player_id", hashes("player_id").alias("h")).select("player_id", "h.*")
