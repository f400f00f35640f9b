"""Token ids in Parquet list columns, ordered by document, for selective reads.

``write_token_ids`` puts a dataset into a folder:

* ``tokens/``: one row a document in ascending ``doc_id`` order: ``doc_id``, ``shard`` (the
  file's place in the order), ``local_start`` (ids before it in its shard), ``n_tokens``, ``ids``
  (list of int, dictionary-encoded). Row groups and pages are of a set size and carry a page
  index, so a reader of a few documents or of the metadata alone skips the rest.
* ``shards/``: one row a shard: ``n_docs``, ``n_tokens``, ``first_token`` (ids in all shards before).

Null texts count as empty; every document ends with ``end_id``, so none is without a token. Rows that
share a ``doc_id`` stay separate documents, next to each other in any order (their ``start`` may change from run to run); texts of any length are encoded whole, in slices; a null ``doc_id`` sorts first. An empty
table gives empty files. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumark.llm.scratch import give_back, id_and_text, new_path
from vellumark.llm.tokens import encoder

TOKENS = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"
SHARDS = "shard int, n_docs long, n_tokens long, first_token long"
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 64 << 20, 256 << 10


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k, ids, at in enc.column(batch.column(1), end):
                n, sizes = len(at) - 1, np.diff(at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype("i4")), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, n), pa.array(np.full(n, shard, "i4")), pa.array(start + at[:-1]), pa.array(sizes), lists], ["doc_id", "shard", "local_start", "n_tokens", "ids"])
                start += int(at[-1])
            give_back()

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the dataset described above into ``path``."""
    spark = docs.sparkSession
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), TOKENS)
        .write.option("compression", "zstd").option("parquet.enable.dictionary", "true").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", 2000).parquet(f"{path}/tokens")
    )
    # A row a shard, however many documents there are.
    sums = spark.read.schema(TOKENS).parquet(f"{path}/tokens").groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).write.parquet(f"{path}/shards")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids``; columns not used are not read."""
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards").select("shard", "first_token")
    rows = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    # shards has one row for each file's task; that bounds what is sent to all.
    return rows.join(F.broadcast(shards), "shard").select("doc_id", (F.col("first_token") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat = lists.values.to_numpy(zero_copy_only=True).view("<u4")
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write, read the files back, and give ``doc_id, start, n_tokens, ids_crc32`` of what they hold."""
    path = path or new_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, tokenizer, end_id)
    return read_token_ids(docs.sparkSession, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
