"""Topic search over an inverted index of lexemes, and version diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellumark.functions.stem import counts, counts_of, lexemes
from vellumark.plans.checkpoints import cut
from vellumark.sources import sinks

INDEX = "source_id string, id string, term string, tf int, n_terms int"


def build_index(articles: DataFrame) -> DataFrame:
    """(source_id, id, term, tf, n_terms) of title and body. Write it partitioned by term to look terms up without a scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                terms, total = counts(f"{r.title or ''} {r.content_markdown or ''}")
                rows += [(r.source_id, r.id, t, n, total) for t, n in terms.items()]
            yield pd.DataFrame(rows, columns=["source_id", "id", "term", "tf", "n_terms"])

    return articles.select("source_id", "id", "title", "content_markdown").mapInPandas(run, INDEX)


def index_of(articles: DataFrame, q: str) -> DataFrame:
    """The index's rows of the query's terms only, for a search without a stored index."""
    wanted = sorted(set(lexemes(q)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                terms, total = counts_of(f"{r.title or ''} {r.content_markdown or ''}", wanted)
                rows += [(r.source_id, r.id, t, n, total) for t, n in terms.items()]
            yield pd.DataFrame(rows, columns=["source_id", "id", "term", "tf", "n_terms"])

    return articles.select("source_id", "id", "title", "content_markdown").mapInPandas(run, INDEX)


def topic_search(index: DataFrame, q: str, source_id: str | None = None) -> DataFrame:
    """Articles that hold all terms of the query; rank: the mean of 1 + ln(tf), by the root of the length."""
    terms = sorted(set(lexemes(q)))
    hits = index.where(F.col("term").isin(terms)) if terms else index.where(F.lit(False))
    if source_id is not None:
        hits = hits.where(F.col("source_id") == source_id)
    weight = (1 + F.log(F.col("tf"))) / F.sqrt(F.col("n_terms"))
    return hits.groupBy("source_id", "id").agg(F.count(F.lit(1)).alias("n"), (F.sum(weight) / max(1, len(terms))).alias("rank")).where(F.col("n") == len(terms)).select("source_id", "id", "rank")


#: Folders of a stored index; a term has one of them.
BUCKETS = 64


class StoredIndex:
    """An index table in folders by term bucket, kept up article by article.

    ``postings`` (bucket, term, source_id, id, tf, n_terms, stamp) only grow; ``live`` (source_id, id, stamp) says which stamp of an article counts. An update stems the articles whose content
    hash has changed and adds their postings; what they had before is passed over by searches and goes with ``compact``. A search reads its terms' buckets only, and of ``live`` the rows of
    what it found.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, table: str) -> list[str]:
        return [n for n, _ in sinks.names(self.spark, f"{self.path}/{table}")]

    def _live(self) -> DataFrame:
        """The newest whole list."""
        schema = "source_id string, id string, stamp string"
        known = [n for n in self._names("live") if sinks.exists(self.spark, f"{self.path}/live/{n}/_SUCCESS")]
        return self.spark.read.schema(schema).parquet(f"{self.path}/live/{max(known)}") if known else self.spark.createDataFrame([], schema)

    def _put_live(self, df: DataFrame) -> None:
        n = len(self._names("live"))
        df.write.parquet(f"{self.path}/live/v{n:09d}")

    def postings(self) -> DataFrame:
        schema = "term string, source_id string, id string, tf int, n_terms int, stamp string, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings") if sinks.exists(self.spark, f"{self.path}/postings") else self.spark.createDataFrame([], schema)

    def _add(self, df: DataFrame, path: str) -> None:
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        df.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(path)

    def update(self, articles: DataFrame) -> int:
        """Brings the index to ``articles`` (source_id, id, title, content_markdown), all there are; how many were stemmed."""
        stamped = articles.withColumn("stamp", F.sha2(F.concat_ws("\u0001", F.coalesce("title", F.lit("")), F.coalesce("content_markdown", F.lit(""))), 256))
        live = self._live()
        new = stamped.join(live.select("source_id", "id", "stamp"), ["source_id", "id", "stamp"], "left_anti")
        changed = cut(new.select("source_id", "id", "title", "content_markdown", "stamp"))
        n = changed.count()
        if n:
            # Postings first: until the list is written, nobody counts them. A run that crashed between may leave equal ones, which count once.
            self._add(build_index(changed).join(changed.select("source_id", "id", "stamp"), ["source_id", "id"]), f"{self.path}/postings")
        if n or live.count() != stamped.count():
            self._put_live(stamped.select("source_id", "id", "stamp"))
        return n

    def hits(self, q: str, source_id: str | None = None) -> DataFrame:
        """Live postings of the query's terms, from their buckets."""
        terms = sorted(set(lexemes(q)))
        if not terms:
            return self.postings().where(F.lit(False))
        wanted = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(x)), F.lit(BUCKETS)).cast("int").alias(f"b{k}") for k, x in enumerate(terms)]).first()
        found = self.postings().where(F.col("bucket").isin(sorted(set(wanted))) & F.col("term").isin(terms))
        if source_id is not None:
            found = found.where(F.col("source_id") == source_id)
        return found.dropDuplicates(["source_id", "id", "term", "stamp"]).join(self._live(), ["source_id", "id", "stamp"], "left_semi")

    def search(self, q: str, source_id: str | None = None) -> DataFrame:
        """As ``topic_search``, with ``rank``."""
        return topic_search(self.hits(q, source_id), q, source_id)

    def compact(self) -> None:
        """Rewrites the postings with the live ones only; not beside an update."""
        fresh = f"{self.path}/compacted"
        sinks.remove(self.spark, fresh)
        kept = self.postings().drop("bucket").distinct().join(self._live(), ["source_id", "id", "stamp"], "left_semi")
        self._add(kept.select("term", "source_id", "id", "tf", "n_terms", "stamp"), fresh)
        sinks.remove(self.spark, f"{self.path}/postings")
        sinks.move(self.spark, fresh, f"{self.path}/postings")


def unified(old: str | None, new: str | None, a: str, b: str) -> str:
    return "".join(difflib.unified_diff((old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True), fromfile=a, tofile=b))


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([unified(*x) for x in zip(old, new, a, b, strict=True)], dtype="object")


def version_diffs(versions: DataFrame, articles: DataFrame, against: str = "next") -> DataFrame:
    """``current``: each version against the live body. ``next``: its stored diff, else against the next newer version or the live body."""
    live = articles.select(F.col("id").alias("article_id"), F.col("content_markdown").alias("__live"))
    w = Window.partitionBy("article_id").orderBy("extracted_at", "id")
    v = versions.withColumns({"__next": F.lead("content_markdown").over(w), "__next_id": F.lead("id").over(w)}).join(live, "article_id")
    own = F.concat(F.lit("version:"), "id")
    if against == "current":
        return v.select("id", "article_id", F.lit(True).alias("computed"), unified_diff("content_markdown", "__live", own, F.lit("current")).alias("diff"))
    stored = F.coalesce(F.length("diff_text") > 0, F.lit(False))
    to, label = F.coalesce("__next", "__live"), F.when(F.col("__next_id").isNull(), "current").otherwise(F.concat(F.lit("version:"), "__next_id"))
    # Texts are compared only where there is no stored diff.
    old, new = F.when(~stored, F.col("content_markdown")), F.when(~stored, to)
    return v.select("id", "article_id", (~stored).alias("computed"), F.when(stored, F.col("diff_text")).otherwise(unified_diff(old, new, own, label)).alias("diff"))
