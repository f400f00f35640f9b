"""Intermediate tables in the folder that all executors share.

A table written here cuts the lineage and outlives lost executors. The folder is
``spark.checkpoint.dir``; where a local session names none (tests), one is made and set.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellumark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, under its own schema (empty tables included)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch with texts: ten thousand of them could be gigabytes.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, unless the session bounds it tighter."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory of a Python worker, which lives on after its task, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def turn_to_other_work() -> None:
    """A Python worker that packed or encoded before gives up its token ids."""
    tokens = sys.modules.get("vellumark.llm.tokens")
    if tokens and tokens.encoder.cache_info().currsize:
        tokens.encoder.cache_clear()
        give_back()


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so extra columns can't clash with its own."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def packed(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, row): whole rows as structs beside their id, so that no column of theirs clashes with what is joined."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
