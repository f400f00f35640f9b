"""Export of articles as Markdown files with a manifest, and as a zip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumark.functions import columns as C
from vellumark.plans.checkpoints import cut


def file_name(source: Column, group: Column, groups: Column, kind: str = "md") -> Column:
    base = F.replace(source, F.lit(" "), F.lit("_"))
    return F.when(groups <= 1, F.concat(base, F.lit(f".{kind}"))).otherwise(F.concat(base, F.format_string(f"_part%03d.{kind}", group + 1)))


def manifest(planned: DataFrame) -> DataFrame:
    """``planned`` (source_id, source_name, group_no, ord, title, content_size_bytes, estimated_tokens) to a row a file."""
    files = planned.groupBy("source_id", "source_name", "group_no").agg(F.count(F.lit(1)).alias("article_count"), F.sum("content_size_bytes").alias("size_bytes"), F.sum("estimated_tokens").alias("estimated_tokens"), F.min_by("title", "ord").alias("first_article_title"), F.max_by("title", "ord").alias("last_article_title"))
    n = planned.groupBy("source_id").agg(F.countDistinct("group_no").alias("__n"))
    return files.join(n, "source_id").withColumn("filename", file_name(F.col("source_name"), F.col("group_no"), F.col("__n"))).drop("__n")


def documents(planned: DataFrame, now: str) -> DataFrame:
    """(source_id, group_no, body): header, contents and sections. A file's size is bounded by the split's limit; a plan without a split has a file a source."""
    section = C.article_section(F.col("title"), F.col("source_url"), F.col("last_updated_at"), F.col("extracted_at"), F.col("content_markdown"))
    rows = planned.groupBy("source_id", "source_name", "group_no").agg(F.array_sort(F.collect_list(F.struct("ord", "title", section.alias("section")))).alias("xs"))
    contents = F.array_join(F.transform("xs", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x["title"], F.lit("](#"), C.anchor_slug(x["title"]), F.lit(")"))), "\n")
    head = F.concat(F.lit("# "), "source_name", F.lit("\n\n> Extracted: "), F.date_format(F.lit(now).cast("timestamp"), "yyyy-MM-dd HH:mm 'UTC'"), F.lit("\n> Articles: "), F.size("xs").cast("string"), F.lit("\n\n---\n\n## Table of Contents\n\n"), contents, F.lit("\n\n---\n"))
    body = F.concat(head, F.lit("\n"), F.array_join(F.transform("xs", lambda x: x["section"]), "\n"), F.lit("\n"))
    return rows.select("source_id", "group_no", body.alias("body"))


def write_documents(docs: DataFrame, path: str) -> None:
    """A text file for each source and group, in its folders."""
    docs.select("source_id", "group_no", F.col("body").alias("value")).repartition("source_id", "group_no").write.partitionBy("source_id", "group_no").mode("overwrite").text(path)


def render_chunks(planned: DataFrame, size: int = 50) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source_id", "group_no").orderBy("ord"))
    return planned.withColumn("chunk", F.floor((n - 1) / size))


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, at = _at(spark, path)
    if not fs.rename(at, _at(spark, to)[1]):
        raise OSError(f"{path} can't be moved to {to}")


def names(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, whether it is a folder) of a folder's entries, sorted."""
    fs, at = _at(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at)) if fs.exists(at) else []


class Store:
    """Versioned folders of a table: a rewrite is a new folder, and readers see the last one that is whole."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self._versions()[-1]:06d}")

    def replace(self, df: DataFrame) -> None:
        last = self._versions()
        df.write.parquet(f"{self.path}/v{(last[-1] + 1 if last else 0):06d}")


class Parts:
    """A table in folders by ``key`` (a string column): a write replaces the touched folders only, or adds rows that aren't there yet."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "source_id") -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def read(self) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        columns = self.spark.createDataFrame([], self.schema).columns
        return self.spark.read.schema(self.schema).parquet(self.path).select(*columns)

    def replace_parts(self, df: DataFrame) -> None:
        """``df`` has all rows of the sources that it mentions."""
        df.repartition(self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.path)

    def append_new(self, df: DataFrame, ident: list[str]) -> None:
        """Rows whose ``ident`` the touched sources don't have; what is added is settled before it is written."""
        known = self.read().join(F.broadcast(df.select(self.key).distinct()), self.key, "left_semi")
        cut(df.dropDuplicates(ident).join(known.select(*ident), ident, "left_anti")).repartition(self.key).write.mode("append").partitionBy(self.key).parquet(self.path)
