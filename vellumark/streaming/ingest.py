"""Structured Streaming forms of push ingestion, resumable merging, ticks and heartbeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.operators import merge
from vellumark.plans.checkpoints import cut
from vellumark.sources.sinks import Parts

EVENT = "type string, id string, ts timestamp, source_id string, run_id string, data array<struct<url:string,title:string,markdown:string,change_status:string>>"


def webhook_pages(events: DataFrame, toc: DataFrame) -> DataFrame:
    """``batch_scrape.page`` events with their first page and its TOC entry; pages without one stay, unlinked."""
    page = events.where((F.col("type") == "batch_scrape.page") & (F.size("data") > 0)).select("id", "ts", "source_id", "run_id", F.col("data")[0].alias("p"))
    page = page.select("id", "ts", "source_id", "run_id", F.col("p.url").alias("url"), F.col("p.title").alias("page_title"), F.col("p.markdown").alias("markdown"), F.col("p.change_status").alias("change_status"))
    entry = toc.where("url is not null").groupBy("source_id", "url").agg(F.min(F.struct("sort_order", F.col("id").alias("toc_entry_id"), F.col("title").alias("toc_title"))).alias("t"))
    out = page.join(entry, ["source_id", "url"], "left")
    return out.select("id", "ts", "run_id", "source_id", "url", F.lit(None).cast("string").alias("topic_key"), "markdown", F.coalesce("t.toc_title", "page_title", "url").alias("title"), F.col("t.toc_entry_id").alias("toc_entry_id"), F.coalesce("t.sort_order", F.lit(0)).alias("sort_order"), "change_status")


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Replayed events within the delay count once."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def read_events(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).json(path)


def merge_stream(pages: DataFrame, store: Parts, versions: Parts, checkpoint: str, now: Callable[[], str]):
    """A query that merges each micro-batch into the store, which is partitioned by source: only touched sources are rewritten.

    A batch that runs again, after a crash between the two writes too, finds its versions there and leaves them out, and its pages unchanged.
    """

    def batch(df: DataFrame, _: int) -> None:
        at, articles = now(), store.read()
        touched = cut(articles.join(F.broadcast(df.select("source_id").distinct()), "source_id", "left_semi"))
        decided = merge.decide(df, touched).persist()
        versions.append_new(merge.new_versions(decided, at).join(decided.select("article_id", "source_id").distinct(), "article_id"), ["id"])
        store.replace_parts(merge.merged_articles(touched, decided, at).select(*articles.columns))
        decided.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run still has to fetch."""
    return wanted.where("url is not null and url != ''").join(done.select("url"), "url", "left_anti")


def ticks(spark: SparkSession, seconds: int, action: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls ``action`` at each tick."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def heartbeats(beats: DataFrame, timeout_ms: int = 300_000, late: str = "1 hour") -> DataFrame:
    """(run_id, ts) beats to runs as they go stale: one row when none came for the timeout, in event time.

    Beats may come ``late``, in any order; one that is later still is dropped by the watermark. So a run shows up as stale once event time is past its last
    beat by the timeout and the lateness.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "last_ms": [last], "status": ["stale"]})
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            last = max(last, int(b["ms"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))

    rows = beats.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("run_id").applyInPandasWithState(track, "run_id string, last_ms long, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
