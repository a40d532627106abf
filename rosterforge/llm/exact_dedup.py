"""Exact deduplication: 128-bit content hash, smallest id stays, bytes compared inside groups.

Texts are equal when identical after each run of ASCII white space became one space. The hash groups narrow
(id, hash) rows, so no text is shuffled for them. Only texts of groups with two or more members then meet the text
of the row that stays; a large group is salted over as many tasks as its size asks for. Groups in which
bytes differ (a collision of the hash) are regrouped by the texts themselves.

Defined cases: a null text counts as empty; null ids sort behind all others (the smallest non-null id stays; a group of null
ids only has a null keep_id); of rows that repeat the id that stays, one row is kept, and all count in group_size; an
empty table gives an empty result; other columns are ignored, and kept by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.llm.common import ROW, SPACE_RUN, broadcast_if_small, keyed, materialize, surplus, without_rows

#: Members of a group that one task compares before the group is salted.
ROWS_PER_SALT = 512


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def content_hash(norm: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. hash_fn is replaceable for tests."""
    return judge(keyed(docs), id_col, text_col, hash_fn).drop(ROW)


def judge(rows: DataFrame, id_col: str, text_col: str, hash_fn=content_hash) -> DataFrame:
    """exact_dedup of rows that have ROW, with ROW."""
    texts = rows.select(ROW, F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm"))
    hashed = texts.withColumn("h", hash_fn(F.col("norm")))
    narrow = materialize(hashed.select(ROW, "doc_id", "h", F.sha2("norm", 256).alias("text_sha256")))
    groups = materialize(
        narrow.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    differing = _collisions(hashed, groups)
    bad = materialize(differing.groupBy("h").agg(F.count(F.lit(1)).alias("n_differing")).select("h"))
    by_hash = narrow.join(broadcast_if_small(groups), "h", "left")
    if bad.isEmpty():
        return _verdict(by_hash)
    # The texts of colliding hashes are compared as grouping keys; every other row keeps its hash group.
    collided = hashed.join(broadcast_if_small(bad), "h", "left_semi")
    exact = collided.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = collided.join(exact, "norm").withColumn("text_sha256", F.sha2("norm", 256))
    clean = by_hash.join(broadcast_if_small(bad), "h", "left_anti")
    columns = [ROW, "doc_id", "text_sha256", "keep_id", "group_size"]
    return _verdict(clean.select(columns).unionByName(again.select(columns)))


def _collisions(hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of groups whose normalised bytes differ from those of the row that stays."""
    small = broadcast_if_small(groups)
    salts = F.ceil(F.col("group_size") / ROWS_PER_SALT).cast("int")
    members = (
        hashed.join(small, "h")
        .select("h", F.pmod(F.xxhash64(ROW), salts).cast("int").alias("salt"), "norm")
    )
    keepers = (
        hashed.withColumnRenamed("h", "own_h")
        .join(small, (F.col("own_h") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("h", "group_size").agg(F.min("norm").alias("keep_norm"))
        .select("h", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "keep_norm")
    )
    return members.join(keepers, ["h", "salt"]).where("norm <> keep_norm").select("h")


def _verdict(rows: DataFrame) -> DataFrame:
    """Rows of equal texts agree in text_sha256; of those with the smallest id, one is kept."""
    first = F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeated = materialize(surplus(rows.where("group_size > 1").where(first), "text_sha256"))
    out = rows.select(
        ROW,
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        first.alias("kept"),
        "text_sha256",
    )
    if repeated.isEmpty():
        return out
    marked = out.join(broadcast_if_small(repeated.withColumn("again", F.lit(True))), ROW, "left")
    return marked.withColumn("kept", F.col("kept") & F.col("again").isNull()).drop("again")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each text."""
    rows = keyed(docs)
    return without_rows(rows, judge(rows, id_col, text_col).where("NOT kept")).select(*docs.columns)
