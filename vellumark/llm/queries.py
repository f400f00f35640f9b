"""Driver queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumark.llm.rules import SQL as RULES_SQL
from vellumark.llm.trie import SQL as TRIE_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the byte-level tokenizer, where the library is installed."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.simhash import simhash_digest

    return simhash_digest(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.tokenfiles import token_file_digest

    return token_file_digest(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.sharding import shard_by_bytes

    return shard_by_bytes(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.quality import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.embeddings import near_embeddings

    return near_embeddings(_read(spark, sf_dir, "embeddings"))


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.paragraphs import passage_components, repeated_spans

    return passage_components(repeated_spans(_read(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.decontam import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.htmltext import extract_pages

    return extract_pages(_read(spark, sf_dir, "pages"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.trie import prefix_trie, rebuild, turn_arrays

    return prefix_trie(rebuild(turn_arrays(_read(spark, sf_dir, "conversations"))))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.rules import judge

    return judge(_read(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumark.llm.repair import damage, digest, repair

    return digest(repair(*damage(_read(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_licenses": op5_licenses,
    "op6_sharding": op6_sharding,
    "op7_embeddings": op7_embeddings,
    "op8_paragraphs": op8_paragraphs,
    "op9_decontamination": op9_decontamination,
    "op10_html": op10_html,
    "op11_trie": op11_trie,
    "op12_rules": op12_rules,
    "op13_repair": op13_repair,
}

#: The others are no SQL that DuckDB could run in time on whole tables; tests/llm holds each against a brute-force version.
ORACLE: dict[str, str] = {"op11_trie": TRIE_SQL, "op12_rules": RULES_SQL}
