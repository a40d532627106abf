"""Declared tables, manifests and profiles of the snapshot store."""

import pytest
from pyspark.sql import functions as F

from rosterforge.operators import snapshots, tables


def rows(spark, value=1.0):
    return spark.createDataFrame([(1, [value]), (2, [value])], "team_id long, final_vector array<double>")


def test_crash_between_tables_leaves_the_old_snapshot_current(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path))
    store.publish(store.start_next(1), {"embeddings": rows(spark)}, 2)
    torn = store.start_next(3)
    store.write(torn, "embeddings", rows(spark, 9.0))  # and then nothing more: the writer is gone
    other = snapshots.SnapshotStore(spark, str(tmp_path))
    assert other.current() == 1 and other.read("embeddings", 1).first().final_vector == [1.0]
    with pytest.raises(LookupError):
        other.read("embeddings", torn)
    other.publish(torn, {"embeddings": rows(spark, 5.0)}, 4)  # a second try does not mix with what lies there
    assert [r.final_vector for r in other.read("embeddings", torn).collect()] == [[5.0], [5.0]]
    assert other.manifest(torn)["embeddings"]["rows"] == 2


def test_two_writers_take_two_ids_and_one_publishes(spark, tmp_path):
    a, b = (snapshots.SnapshotStore(spark, str(tmp_path)) for _ in "ab")
    assert tables.schema_of("no such table") is None
    first = a.start_next(1)
    assert first == 1 and b.start_next(1) == 2
    a.publish(1, {"embeddings": rows(spark)}, 2)
    with pytest.raises(FileExistsError):
        b.publish(1, {"embeddings": rows(spark, 7.0)}, 3)
    assert a.read("embeddings", 1).first().final_vector == [1.0]
    assert snapshots.create_new(spark, f"{tmp_path}/claims/3", "x") and a.start_next(5) == 4


def test_added_column_reads_as_null_in_older_snapshots(spark, tmp_path, monkeypatch):
    store = snapshots.SnapshotStore(spark, str(tmp_path))
    store.publish(store.start_next(1), {"embeddings": rows(spark)}, 2)
    monkeypatch.setitem(tables.DECLARED, "embeddings", tables.DECLARED["embeddings"] | {"region": "string"})
    store.publish(store.start_next(3), {"embeddings": rows(spark).withColumn("region", F.lit("eu"))}, 4)
    assert [r.region for r in store.read("embeddings", 1).collect()] == [None, None]
    assert [r.region for r in store.read("embeddings", 2).collect()] == ["eu", "eu"]


def test_rows_that_do_not_fit_are_refused(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path))
    with pytest.raises(ValueError, match="missing"):
        store.write(1, "embeddings", rows(spark).drop("final_vector"))
    with pytest.raises(ValueError, match="not declared"):
        store.write(1, "embeddings", rows(spark).withColumn("other", F.lit(1)))
    with pytest.raises(Exception, match="team_id is null"):
        store.write(1, "embeddings", rows(spark).withColumn("team_id", F.when(F.col("team_id") > 1, F.col("team_id"))))


def test_a_profile_is_one_folder(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path))
    found = spark.createDataFrame([(p, t, 0, 3) for p in ("strict", "explore", "family") for t in range(3)], "profile string, team_id long, cluster_id long, cluster_size long")
    for at in (1, 3):
        store.publish(store.start_next(at), {"clusters": found.withColumn("cluster_id", F.lit(at))}, at + 1)
    for profile in ("strict", "explore", "family"):
        own = store.clusters(profile)
        assert {(r.cluster_id, r.profile) for r in own.collect()} == {(3, profile)} and own.count() == 3
        plan = own._jdf.queryExecution().toString()
        assert "profile" in plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
        files = {r.f for r in own.select(F.col("_metadata.file_path").alias("f")).collect()}
        assert all(f"profile={profile}/" in f and "snapshot_id=2/" in f for f in files)
    assert {r.cluster_id for r in store.clusters("family", 1).collect()} == {1}
    assert store.clusters("none").isEmpty()


def test_mirror_reads_its_source_once(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    assert snapshots.mirror(spark.range(100).mapInArrow(counted, "id long"), str(tmp_path / "copy")) == 100
    assert counter.value == 100
    assert snapshots.mirror(spark.range(0), str(tmp_path / "none")) == 0
