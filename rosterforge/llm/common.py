"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterforge.plans.storage import broadcast_if_small, materialize, new_folder, remove_tree, shared_dir  # noqa: F401

#: A run of the six ASCII white-space characters, and a word, which is a run of anything else.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch where the job sets no number: the JVM, Arrow and Python each hold a batch of whole texts.
BATCH_ROWS = 1000
#: Column that tells the rows of a table apart, whatever their ids are.
ROW = "__row_key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smaller_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows in this session, unless the job has set their number itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))


def table_rows(docs: DataFrame, by_content: bool = False) -> DataFrame:
    """docs with ROW, the same at every reading: the Parquet file and the place in it.

    docs is a Parquet table as read, whose rows and columns may have been selected; any other frame is keyed() instead. by_content: ROW begins with a
    digest of the row, so that the first of some rows is the same one however the files are named and dealt (columns with maps don't count).
    """
    file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    digest = [F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString())).alias("digest")] if by_content else []
    try:
        return docs.select("*", F.struct(*digest, F.unhex(F.md5(file)).alias("file"), place.alias("place")).alias(ROW))
    except AnalysisException:  # no Parquet table
        return keyed(docs)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW; without it, the rows are numbered and written out, so that the numbers stay."""
    return docs if ROW in docs.columns else materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose ROW is not in gone; only narrow keys move where gone is small enough to broadcast."""
    return docs.join(broadcast_if_small(materialize(gone.select(ROW))), ROW, "left_anti")


def surplus(rows: DataFrame, group: str) -> DataFrame:
    """ROW of the rows that share their group with another row of rows whose ROW is smaller."""
    many = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row")).where("n > 1")
    many = broadcast_if_small(materialize(many.select(group, "first_row")))
    return rows.join(many, group).where(F.col(ROW) != F.col("first_row")).select(ROW)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most: what Python holds of a batch at a time stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # a worker lives on after its task, so it gives back what is free
        libc.malloc_trim(0)


def let(value: Column, body) -> Column:
    """Evaluate value once per row and bind it in body, which the optimizer can't inline again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
