"""Driver queries of the fetching sources: answers of an API and of a site, recorded from the given tables with statuses that pass, are fetched again."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.plans.checkpoints import new_folder
from vellumark.queries.registry import query
from vellumark.sources import fetch, media
from vellumark.streaming.scheduler import REAPED, reaped

URL, SIZE = "https://api.example.com/events?page={page}", 100
ITEM = "event_id long, event_type string, value double"


def recorded_api(events: DataFrame) -> str:
    """A folder of exchanges: each page's items, behind a 429 for every third and a 503 for every fifth page."""
    page = (F.floor(F.col("event_id") / SIZE) + 1).cast("int")
    item = F.struct("event_id", "event_type", "value")
    bodies = events.groupBy(page.alias("page")).agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(item)).alias("results")).alias("data"))).alias("body"))
    busy = F.filter(F.array(F.when(F.col("page") % 3 == 0, 429), F.when(F.col("page") % 5 == 0, 503)), lambda s: s.isNotNull())
    answers = bodies.select("page", "body", F.posexplode(F.concat(busy, F.array(F.lit(200)))).alias("attempt", "status"))
    url = F.concat(F.lit(URL.split("{", 1)[0]), F.col("page").cast("string"))
    path = new_folder(events.sparkSession, "recorded")
    fetch.record(answers.select(url.alias("url"), "attempt", "status", F.when(F.col("status") == 200, F.col("body")).alias("body")), path)
    return path


def _options(path: str) -> dict[str, str]:
    return {"url": URL, "items": "data.results", "size": str(SIZE), "recorded": path, "pause": "0", "chunk": "5", "most": "1000000"}


def _pages(t):
    events = t("events")
    return fetch.api_items(events.sparkSession, ITEM, **_options(recorded_api(events)))


def _stream(t):
    """Two runs of one stream: the API has the first seventh of the events at first, then all; the second run goes on where the first ended, inside a page."""
    events = t("events")
    spark = events.sparkSession
    seventh = events.agg(F.max("event_id")).first()[0] // 7
    out, checkpoint = new_folder(spark, "fetched"), new_folder(spark, "progress")
    for known in (events.where(F.col("event_id") <= seventh), events):
        items = fetch.api_item_stream(spark, ITEM, **_options(recorded_api(known)))
        items.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


_ITEMS = f"SELECT CAST(floor(event_id / {SIZE}) + 1 AS INT) AS page, CAST(event_id % {SIZE} AS INT) AS pos, event_id, event_type, value FROM {{events}}"
query("api_pages", _ITEMS)(_pages)
query("api_pages_stream", _ITEMS)(_stream)


def _site(t):
    """Pages of a site, asked for twice. A page's number, as a fragment, is part of its recorded address: pages that share a URL have bodies of their own."""
    pages = t("pages").withColumn("url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))
    busy = F.when(F.col("page_id") % 4 == 0, F.array(F.lit(503), F.lit(429))).otherwise(F.array().cast("array<int>"))
    last = F.when(F.col("page_id") % 11 == 0, 404).otherwise(200)
    answers = pages.select("url", "html", F.posexplode(F.concat(busy, F.array(last))).alias("attempt", "status"))
    path = new_folder(pages.sparkSession, "site")
    fetch.record(answers.select("url", "attempt", "status", F.when(F.col("status") < 400, F.col("html")).alias("body")), path)
    return fetch.raw_pages(pages.unionAll(pages), 8, recorded=path, pause="0").withColumn("url", F.regexp_replace("url", "#[0-9]+$", ""))


query("raw_pages", "SELECT url, CASE WHEN page_id % 11 <> 0 THEN html END AS body, CAST(NULL AS VARCHAR) AS error FROM {pages}")(_site)


# Files beside the tables.
def _media(t):
    """Texts as images of 40 articles, stored twice as if a run had been repeated; then the folders of what is there, empty files included."""
    docs = t("documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "image/jpeg").when(F.col("doc_id") % 3 == 1, "image/svg+xml")
    images = docs.select(F.concat(F.lit("a"), (F.col("doc_id") % 40).cast("string")).alias("article_id"), F.concat(F.lit("https://cdn.example.com/"), F.col("doc_id").cast("string")).alias("original_url"), kind.alias("content_type"), F.encode("text", "utf-8").alias("content"))
    path = new_folder(docs.sparkSession, "media")
    for _ in range(2):
        media.store_images(images, path).write.format("noop").mode("overwrite").save()
    return media.list_folders(docs.sparkSession, path, empty=True).select("name", "files", "size")


query("media_dir_scan", "SELECT 'a' || (doc_id % 40) AS name, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS size FROM {documents} WHERE text IS NOT NULL GROUP BY 1")(_media)


def _bundle(t):
    """Documents in a zip made by tasks, and what its own directory says of each."""
    docs = t("documents").where("text is not null")
    path = f"{new_folder(docs.sparkSession, 'bundle')}.zip"
    media.zip_bundle(docs.select(F.col("doc_id").alias("number"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.encode("text", "utf-8").alias("content")), path)
    fs, at = media.filesystem(path)
    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        rows = [(x.filename, x.file_size, x.CRC) for x in z.infolist()]
    return docs.sparkSession.createDataFrame(rows, "name string, size long, crc long")


query("export_zip", "SELECT 'docs/' || doc_id || '.md' AS name, strlen(text) AS size FROM {documents} WHERE text IS NOT NULL")(lambda t: _bundle(t).select("name", "size"))


# Streams of events.
LATE = "2002-01-01 00:00:00"


def _reaped(t):
    """Running runs' claims as events, then one event long after; the stream's timers reap what the batch rule would."""
    runs = t("runs")
    spark = runs.sparkSession
    events, out, checkpoint = (new_folder(spark, name) for name in ("events", "reaped", "progress"))
    claims = runs.where("status = 'running' and heartbeat_at is not null").select(F.col("id").alias("run_id"), F.lit("claimed").alias("kind"), F.col("heartbeat_at").cast("timestamp").alias("ts"), "attempts")
    late = spark.range(1).select(F.lit("tick").alias("run_id"), F.lit("beat").alias("kind"), F.lit(LATE).cast("timestamp").alias("ts"), F.lit(0).alias("attempts"))
    for rows in (claims.coalesce(1), late):
        rows.write.mode("append").parquet(events)
        stream = spark.readStream.schema(claims.schema).parquet(events)
        reaped(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(REAPED).parquet(out)


query("reap_stale_stream", f"SELECT id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN attempts >= 3 THEN 'worker lost' END AS error_message FROM {{runs}} WHERE status = 'running' AND heartbeat_at < TIMESTAMP '{LATE}' - INTERVAL 300 SECOND")(lambda t: _reaped(t).select("id", "status", "error_message"))
