"""Intermediate tables in the shared folder, and joins whose broadcast is decided by a size."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest size in memory, as estimated, that one checked broadcast may have.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row costs in a hash table besides its values.
ROW_BYTES = 32


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Where the session names none, a local session gets a folder of its own, and any other is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rosterforge-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder (or below `folder` there) and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tree(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small ASCII file that doesn't exist yet; False, and nothing written, where it does: of several writers one succeeds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.writeBytes(text)
    out.close()
    return True


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear_intermediates(spark: SparkSession) -> None:
    """Remove all intermediate tables of this session; for the end of a job, when its results are saved."""
    base = shared_dir(spark)
    spark.sparkContext.setCheckpointDir(base.rsplit("/", 1)[0])  # later tables go to a new folder
    remove_tree(spark, base)


def _width(value: Column, kind: T.DataType) -> Column | int:
    """Bytes of a value, as a number where all values of the kind are alike."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        out: Column | int = 8
        for f in kind.fields:
            out = _width(value[f.name], f.dataType) + out
        return out
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(value), F.lit(0)) * 16 + 16
    return 8


def estimated_bytes(df: DataFrame) -> int:
    """Size of df as a hash table, from its rows and the lengths of its texts."""
    row: Column = F.lit(ROW_BYTES).cast("long")
    for f in df.schema.fields:
        row = row + _width(F.col(f"`{f.name}`"), f.dataType)
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind an estimate of the size; beyond the limit a shuffle join is planned instead."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df.hint("merge")
