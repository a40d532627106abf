"""Snapshot lifecycle: write, find the latest, list, retain; and full copies of source tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from rosterforge.operators.tables import FOLDERS, conform, schema_of
from rosterforge.plans.storage import create_new, path_exists, remove_tree

DEFAULT_IDF_CAP = 3.0


def _newest() -> list:
    return [F.col("finished_at_ms").desc_nulls_last(), F.desc("run_id")]


def latest_completed(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'completed'").orderBy(*_newest()).limit(1)


def completed_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.where("status = 'completed'").orderBy(*_newest()).limit(min(50, max(1, limit)))


def expired_runs(runs: DataFrame, keep: int) -> DataFrame:
    """Completed runs beyond the newest `keep`."""
    rank = F.row_number().over(Window.orderBy(*_newest()))
    return runs.where("status = 'completed'").withColumn("place", rank).where(F.col("place") > keep).drop("place")


def config_of(runs: DataFrame, run_id: int) -> DataFrame:
    """run_id, semantic_dim, identity_dim, identity_beta, identity_idf_cap (defaults where absent)."""
    have = set(runs.columns)
    default = {"semantic_dim": 64, "identity_dim": 256, "identity_beta": 3.0, "identity_idf_cap": DEFAULT_IDF_CAP}
    value = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    return runs.where(F.col("run_id") == run_id).select("run_id", *(value(c, d).alias(c) for c, d in default.items()))


class SnapshotStore:
    """Snapshots under a folder: tables by snapshot_id, an append-only log of run states, and a manifest for each published snapshot.

    Every write of a table goes to a folder of its own. The manifest, one file that is created once or not at all, names the folder and the number of rows of
    each table, so a torn or repeated run is never read, and of two writers of one id one fails. The `completed` log row follows it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._written: dict[int, dict[str, dict]] = {}

    def _log(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, "run_id long, status string, at_ms long, teams_indexed long, message string").coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def runs(self) -> DataFrame:
        """run_id, status, started_at_ms, finished_at_ms, teams_indexed, message: the latest state of every run."""
        log = self.spark.read.parquet(f"{self.path}/runs")
        order = F.struct("at_ms", F.when(F.col("status") == "running", 0).otherwise(1))
        last = lambda c: F.max_by(c, order).alias(c)
        return log.groupBy("run_id").agg(
            last("status"), F.min("at_ms").alias("started_at_ms"), F.max(F.when(F.col("status") != "running", F.col("at_ms"))).alias("finished_at_ms"), last("teams_indexed"), last("message"))

    def start(self, run_id: int, at_ms: int) -> int:
        create_new(self.spark, f"{self.path}/claims/{run_id}", str(at_ms))
        self._log([(run_id, "running", at_ms, None, None)])
        return run_id

    def start_next(self, at_ms: int) -> int:
        """Start the run after the latest one; an id that another writer has claimed is left to it."""
        run_id = 1 + ((self.runs().agg(F.max("run_id")).first()[0] or 0) if path_exists(self.spark, f"{self.path}/runs") else 0)
        while not create_new(self.spark, f"{self.path}/claims/{run_id}", str(at_ms)):
            run_id += 1
        return self.start(run_id, at_ms)

    @contextmanager
    def failing(self, run_id: int, at_ms: int) -> Iterator[None]:
        """Mark the run failed where the body raises, and raise again."""
        try:
            yield
        except Exception as error:
            self.mark(run_id, "failed", at_ms, None, str(error)[:500])
            raise

    def mark(self, run_id: int, status: str, at_ms: int, teams_indexed: int | None = None, message: str | None = None) -> None:
        """Log a state; `completed` publishes what this store has written for the run."""
        if status == "completed":
            self._publish_manifest(run_id)
        self._log([(run_id, status, at_ms, teams_indexed, message)])

    def write(self, run_id: int, table: str, rows: DataFrame, folders: str | None = None) -> int:
        """Write a table of a run, as declared if it is; returns its number of rows. folders: the column by whose values its rows lie in folders of their own."""
        folder = f"{table}/snapshot_id={run_id}/write={uuid.uuid4().hex}"
        seen, folders = Observation(), folders or FOLDERS.get(table)
        writer = conform(rows, table).observe(seen, F.count(F.lit(1)).alias("rows")).write
        (writer.partitionBy(folders) if folders else writer).parquet(f"{self.path}/{folder}")
        self._written.setdefault(run_id, {})[table] = {"folder": folder, "rows": seen.get["rows"]}
        return seen.get["rows"]

    def _publish_manifest(self, run_id: int) -> None:
        tables = self._written.pop(run_id, {})
        if not create_new(self.spark, self._manifest_path(run_id), json.dumps({"run_id": run_id, "tables": tables})):
            raise FileExistsError(f"snapshot {run_id} is published already")

    def _manifest_path(self, run_id: int) -> str:
        return f"{self.path}/manifests/{run_id}.json"

    def manifest(self, run_id: int) -> dict[str, dict]:
        """folder and rows of each table of a published snapshot; the writer of one that isn't published sees what it has written."""
        if run_id in self._written:
            return self._written[run_id]
        path = self._manifest_path(run_id)
        if not path_exists(self.spark, path):
            raise LookupError(f"snapshot {run_id} is not published")
        return json.loads(self.spark.read.text(path).first().value)["tables"]

    def publish(self, run_id: int, tables: dict[str, DataFrame], at_ms: int) -> None:
        """Write all tables of a run, then complete it; any error marks it failed and is raised again."""
        with self.failing(run_id, at_ms):
            rows = {name: self.write(run_id, name, frame) for name, frame in tables.items()}
            self._publish_manifest(run_id)
        self._log([(run_id, "completed", at_ms, rows.get("embeddings"), None)])

    def read(self, table: str, run_id: int) -> DataFrame:
        """One snapshot's table, with the declared columns if it is declared."""
        folder, schema = f"{self.path}/{self.manifest(run_id)[table]['folder']}", schema_of(table)
        return (self.spark.read.schema(schema) if schema else self.spark.read).option("basePath", folder).parquet(folder)

    def current(self) -> int:
        """The newest completed run."""
        newest = latest_completed(self.runs()).select("run_id").first()
        if newest is None:
            raise LookupError("no completed snapshot")
        return newest.run_id

    def clusters(self, profile: str, run_id: int | None = None) -> DataFrame:
        """team_id, cluster_id, cluster_size and others of one profile, by default of the newest completed snapshot; one folder is read."""
        return self.read("clusters", self.current() if run_id is None else run_id).where(F.col("profile") == profile)

    def retain(self, keep: int, tables: tuple[str, ...]) -> list[int]:
        """Delete the tables of completed runs beyond the newest keep; returns their ids (a handful a call)."""
        old = [r["run_id"] for r in expired_runs(self.runs(), keep).collect()]
        for run_id in old:
            for name in tables:
                remove_tree(self.spark, f"{self.path}/{name}/snapshot_id={run_id}")
            remove_tree(self.spark, self._manifest_path(run_id))
        if old:
            now = self.runs().agg(F.max("finished_at_ms")).collect()[0][0] or 0
            self._log([(r, "deleted", now + 1, None, None) for r in old])
        return old


def of_dimension(rows: DataFrame, dim: int, vector: str = "final_vector") -> DataFrame:
    """rows, which raise an error when read if a vector has another dimension than dim."""
    wrong = F.raise_error(F.concat(F.lit(f"{vector} should have {dim} values, not "), F.size(vector).cast("string")))
    return rows.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong.cast(rows.schema[vector].dataType)))


def to_json_columns(rows: DataFrame, *columns: str) -> DataFrame:
    """Nested columns as JSON texts, the entries of maps in the order of their keys."""
    def ordered(c):
        if not rows.schema[c].dataType.typeName() == "map":
            return F.to_json(c)
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))

    return rows.withColumns({c: ordered(c) for c in columns})


def from_json_columns(rows: DataFrame, **types: str) -> DataFrame:
    """JSON texts as columns of the given types; a text that isn't of its type gives null."""
    return rows.withColumns({c: F.from_json(c, t) for c, t in types.items()})


def identifier(name: str) -> str:
    """A table's or column's name, trimmed; anything but letters, digits and underscores is an error."""
    name = name.strip()
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"no identifier: {name!r}")
    return name


def mirror(source: DataFrame, path: str) -> int:
    """Copy a table to path in one pass over the source, and compare what was seen on the way with what lies there; returns the number of rows."""
    seen = Observation()
    source.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    wrote, there = seen.get["rows"], source.sparkSession.read.schema(source.schema).parquet(path).count()  # a count is read from the files' ends
    if wrote != there:
        raise RuntimeError(f"saw {wrote} rows, {there} lie in {path}")
    return wrote


def jdbc_source(spark: SparkSession, table: str, url: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options) -> DataFrame:
    """A table (a name, or schema.name) over JDBC, read by ranges of key in parallel where bounds are given."""
    table = ".".join(identifier(part) for part in table.split("."))
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with exactly the wanted columns (name -> type); absent ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()))
