"""Hashed team vectors, retrieval by dot product, centroids and the projection to two dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.functions.hashing import hashed_players
from rosterforge.functions.scalars import clamp01, recency, stability
from rosterforge.functions.vectors import dot, l2_normalize, literal, norm, scale


def dense(sparse: DataFrame, key: str, dim: int) -> DataFrame:
    """key, vector from rows (key, bucket, x)."""
    cells = F.map_from_entries(F.collect_list(F.struct("bucket", "x")))
    return sparse.groupBy(key).agg(cells.alias("m")).select(
        key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector")
    )


def _unit_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """x of rows (by, bucket, x) over the length of its group; groups of length zero keep zeros."""
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*by)))
    return rows.withColumn("len", length).withColumn("x", F.when(F.col("len") > 0, F.col("x") / F.col("len")).otherwise(0.0)).drop("len")


def semantic_cells(counted: DataFrame, hashes: DataFrame) -> DataFrame:
    """team_id, bucket, x: unit vectors of the lineups, averaged over their occurrences, normalised again."""
    distinct = counted.select("lineup").distinct().select("lineup", F.explode("lineup").alias("player_id"))
    cells = distinct.join(hashes, "player_id").groupBy("lineup", F.col("sem_bucket").alias("bucket")).agg(F.sum("sem_sign").cast("double").alias("x"))
    unit = _unit_cells(cells, ["lineup"])
    summed = counted.join(unit, "lineup").groupBy("team_id", "bucket").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
    return _unit_cells(summed, ["team_id"])


def identity_cells(support: DataFrame, idf: DataFrame, hashes: DataFrame) -> DataFrame:
    """team_id, bucket, x: signed match counts times idf, normalised."""
    weighted = support.join(hashes, "player_id").join(idf.select("player_id", "idf"), "player_id", "left")
    value = F.sum(F.col("id_sign") * F.col("matches") * F.coalesce("idf", F.lit(1.0)))
    return _unit_cells(weighted.groupBy("team_id", F.col("id_bucket").alias("bucket")).agg(value.alias("x")), ["team_id"])


def final_vectors(semantic: DataFrame, identity: DataFrame, beta: float = 3.0) -> DataFrame:
    """team_id, semantic_vector, identity_vector, final_vector = unit(semantic, beta * identity)."""
    both = semantic.withColumnRenamed("vector", "semantic_vector").join(identity.withColumnRenamed("vector", "identity_vector"), "team_id")
    return both.withColumn("final_vector", l2_normalize(F.concat("semantic_vector", scale(F.col("identity_vector"), beta))))


def team_vectors(counted: DataFrame, support: DataFrame, idf: DataFrame, semantic_dim: int = 64, identity_dim: int = 256, beta: float = 3.0) -> DataFrame:
    hashes = hashed_players(support, semantic_dim, identity_dim)
    semantic = dense(semantic_cells(counted, hashes), "team_id", semantic_dim)
    identity = dense(identity_cells(support, idf, hashes), "team_id", identity_dim)
    return final_vectors(semantic, identity, beta)


def weighted_centroid(rows: DataFrame, vector: str, weight: Column, by: list[str]) -> DataFrame:
    """by..., centroid: unit vector of the weighted mean of each group."""
    cells = rows.select(*by, weight.cast("double").alias("w"), F.posexplode(vector).alias("pos", "x"))
    sums = cells.groupBy(*by, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    packed = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return packed.select(*by, l2_normalize(F.transform("c", lambda s: s["x"])).alias("centroid"))


def neighbors(rows: DataFrame, query: list[float], k: int, exclude: list[int] = (), vector: str = "final_vector") -> DataFrame:
    """The k rows with the largest dot product with query; ties by team_id."""
    scored = rows.where(~F.col("team_id").isin(list(exclude))) if exclude else rows
    return scored.withColumn("similarity", dot(F.col(vector), literal(query))).orderBy(F.desc("similarity"), "team_id").limit(k)


def nearest_by_cosine_distance(rows: DataFrame, query: list[float], k: int, vector: str = "final_vector") -> DataFrame:
    q = literal(query)
    length = norm(F.col(vector)) * norm(q)
    distance = 1.0 - F.when(length > 0, dot(F.col(vector), q) / length).otherwise(0.0)
    return rows.withColumn("distance", distance).orderBy("distance", "team_id").limit(k)


def blended_score(semantic: Column, identity: Column, weight: float | Column) -> Column:
    """Score-space blend: weight on the semantic side, the rest on the identity side."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    return w * semantic + (1.0 - w) * identity


def target_profile(targets: DataFrame) -> DataFrame:
    """One row: query_final, query_semantic, query_identity, stability and the two weights of target teams."""
    steady = F.when((F.col("top_lineup_share") <= 0) & (F.col("distinct_lineup_count") <= 0), 0.5).otherwise(
        clamp01(stability(clamp01(F.col("top_lineup_share")), clamp01(F.col("lineup_entropy"))), 0.5))
    rows = targets.withColumn("steady", steady).withColumn(
        "w", F.sqrt(F.greatest(F.col("lineup_count"), F.lit(1)).cast("double")) * (0.75 + 0.25 * F.col("steady"))).withColumn("g", F.lit(0))
    query_stability = rows.groupBy("g").agg((F.sum(F.col("w") * F.col("steady")) / F.sum("w")).alias("query_stability"))
    out = query_stability
    for name in ("final", "semantic", "identity"):
        out = out.join(weighted_centroid(rows, f"{name}_vector", F.col("w"), ["g"]).withColumnRenamed("centroid", f"query_{name}"), "g")
    weight = F.least(F.lit(0.85), F.greatest(F.lit(0.20), 0.15 + 0.70 * F.col("query_stability")))
    return out.withColumn("identity_weight", weight).withColumn("semantic_weight", 1.0 - weight).drop("g")


def adaptive_rank(rows: DataFrame, targets: DataFrame, recency_weight: float = 0.0) -> DataFrame:
    """rows with embed_score against the blend that fits the targets' stability, newest rows favoured by recency_weight."""
    q = target_profile(targets).collect()[0]  # one row
    score = q["semantic_weight"] * dot(F.col("semantic_vector"), literal(q["query_semantic"])) + q["identity_weight"] * dot(F.col("identity_vector"), literal(q["query_identity"]))
    if recency_weight > 0:
        newest = F.lit(rows.agg(F.max("event_time_ms")).collect()[0][0]).cast("long")
        score = (1.0 - recency_weight) * score + recency_weight * recency(F.col("event_time_ms"), newest)
    return rows.withColumn("embed_score", score)


def above_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("embed_score") >= min(1.0, max(0.0, threshold)))


def relaxed_threshold(scored: DataFrame, threshold: float, enough: int = 3, floor: float = 0.5, step: float = 0.2) -> DataFrame:
    """Rows over threshold; if fewer than `enough` and threshold > floor, those over the relaxed one if there are more. Adds relevance_relaxed."""
    low = max(floor, threshold - step) if threshold > floor else threshold
    # One pass at the relaxed threshold; the counts choose. Two numbers reach the driver.
    wide = scored.where(F.col("embed_score") >= low)
    strict, loose = wide.agg(F.count_if(F.col("embed_score") >= threshold), F.count(F.lit(1))).collect()[0]
    relax = strict < enough and threshold > floor and loose > strict
    return (wide if relax else wide.where(F.col("embed_score") >= threshold)).withColumn("relevance_relaxed", F.lit(relax))


def project(rows: DataFrame, max_points: int, vector: str = "final_vector") -> DataFrame:
    """team_id, x, y: first two principal axes of the largest teams, scaled by the largest absolute value; each axis' sign makes its largest loading positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    top = rows.orderBy(F.desc("lineup_count"), "team_id").limit(max(10, max_points))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(top.withColumn("v", array_to_vector(vector)))
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    # Centring after the projection equals centring before it.
    xy = top.select(*[c for c in ("team_id", "cluster_id") if c in top.columns], *((dot(F.col(vector), literal((axes[:, k] * signs[k]).tolist()))).alias(n) for k, n in enumerate("xy")))
    m = xy.agg(F.avg("x"), F.avg("y")).collect()[0]
    centred = xy.withColumns({"x": F.col("x") - m[0], "y": F.col("y") - m[1]})
    s = centred.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).collect()[0][0] or 1.0
    return centred.withColumns({"x": F.col("x") / s, "y": F.col("y") / s})
