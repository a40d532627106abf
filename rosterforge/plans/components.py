"""Connected components by alternating small-star and large-star rounds over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterforge.plans.storage import broadcast_if_small, materialize, new_folder, remove_tree


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has an edge to another node.

    Nodes are longs. Each round hangs every node under its smallest neighbour and then under that one's parent; rounds end when
    the links form stars. Only narrow rows move, and each round is written out, so a lost executor repeats one round. The tables
    of a round go when the next one is done.
    """
    spark = edges.sparkSession
    held = new_folder(spark)
    a, b = F.col(left), F.col(right)
    links = materialize(edges.where(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct(), held)
    while True:
        parents = materialize(links.groupBy("v").agg(F.min("m").alias("p"), F.count(F.lit(1)).alias("n")), held)
        single = parents.where("n > 1").isEmpty()
        nested = links.join(broadcast_if_small(parents.select(F.col("v").alias("m"))), "m", "left_semi")
        if single and nested.isEmpty():
            found = materialize(parents.select(F.col("v").alias("node"), F.col("p").alias("component")).unionByName(
                parents.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
            ))
            remove_tree(spark, held)
            return found
        # Small star: the other smaller neighbours of v hang under the smallest one.
        near = links.join(broadcast_if_small(parents.select("v", "p")), "v")
        hung = near.select(F.explode(F.array(
            F.struct("v", F.col("p").alias("m")),
            F.struct(F.col("m").alias("v"), F.col("p").alias("m")),
        )).alias("e")).select("e.*").where("v <> m").distinct()
        hung = materialize(hung, held)
        # Large star: v hangs under the parent of its parent.
        above = materialize(hung.groupBy("v").agg(F.min("m").alias("pp")), held)
        lifted = hung.join(broadcast_if_small(above.withColumnRenamed("v", "m")), "m", "left")
        done, held = held, new_folder(spark)
        links = materialize(lifted.select("v", F.coalesce("pp", "m").alias("m")).unionByName(
            lifted.where("pp IS NOT NULL").select(F.col("m").alias("v"), F.col("pp").alias("m"))
        ).distinct(), held)
        remove_tree(spark, done)
