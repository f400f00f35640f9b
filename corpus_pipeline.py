"""Documents to training sequences in five stages, each on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``, others too if there are any.

In every stage a null text counts as an empty one and stays null if its row stays; empty texts are scored like others and are near copies of each other.
Rows without an id are scored, cut nothing, lose nothing and are packed. Rows that share an id: each is scored; texts that differ are documents of their own for
near-duplicates and repeats, equal ones count once; a leak in one of them takes all of the id. Texts of any length are read whole. Ties go to the smallest id, then the least
hash of the text. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumark.llm.decontam import drop_leaks
from vellumark.llm.packing import pack_documents
from vellumark.llm.paragraphs import drop_repeats
from vellumark.llm.quality import keep_good
from vellumark.llm.queries import tokenizer_path
from vellumark.llm.scratch import table
from vellumark.llm.simhash import keep_one


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on shingles of five words, candidates verified by an exact Jaccard coefficient of 0.8: one document of each group stays."""
    return keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: repeated passages are cut, but for their first occurrence."""
    return drop_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express none of the stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
