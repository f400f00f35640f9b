"""What client actions do to the store's tables: each function gives the rows to add or the whole new table.

``now`` is a time as text. Ids of new rows are hashes of what they name, so an action that runs again makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.functions import columns as C
from vellumark.operators import catalog, jobs, merge
from vellumark.operators.catalog import moment


def _ident(*parts: Column | str) -> Column:
    return F.left(F.sha2(F.concat_ws("\u0001", *parts), 256), F.lit(32))


# Runs.
def new_runs(wanted: DataFrame, runs: DataFrame, now: str, trigger: str = "manual") -> DataFrame:
    """Pending runs for the sources (``source_id``, ``job_run_id``?) that have no pending or running one, each once."""
    start = jobs.enqueue_coalesce(wanted, runs)
    if "job_run_id" in wanted.columns:
        start = start.join(wanted.groupBy("source_id").agg(F.min("job_run_id").alias("job_run_id")), "source_id")
    else:
        start = start.withColumn("job_run_id", F.lit(None).cast("string"))
    return start.select(_ident("source_id", F.lit(trigger), F.lit(now)).alias("id"), "source_id", "job_run_id", F.lit("pending").alias("status"), F.lit(trigger).alias("triggered_by"), F.lit(0).alias("attempts"), moment(now).alias("started_at"))


def claim(queue: DataFrame, now: str, order: str = "created_at", column: str = "heartbeat_at") -> DataFrame:
    """The queue with its oldest pending row running, one attempt more and a fresh heartbeat. Writers are single, so nothing is locked."""
    first = jobs.claim_oldest(queue, order).select(F.col("id").alias("__claimed"))
    out = queue.join(F.broadcast(first), F.col("id") == F.col("__claimed"), "left")  # one row
    mine = F.col("__claimed").isNotNull()
    new = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, column: moment(now)}
    return out.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns])


def blocked_runs(runs: DataFrame, message: str) -> DataFrame:
    """Completed runs that stored nothing and met blocked pages have failed."""
    stored = F.col("n_new") + F.col("n_updated") + F.col("n_unchanged") + F.col("n_resumed")
    return runs.withColumn("status", F.when((F.col("status") == "completed") & (stored == 0) & F.coalesce(F.col("error_message") == message, F.lit(False)), "failed").otherwise(F.col("status")))


def tick(all_jobs: DataFrame, job_runs: DataFrame, runs: DataFrame, sources: DataFrame, now: str) -> dict[str, DataFrame]:
    """One turn of the scheduler: stale runs go back or fail, job runs follow their runs, due jobs start, and their next time is set.

    Gives ``runs`` (new states of stale ones), ``job_runs`` (new states), ``starts`` (runs of due jobs), ``new_job_runs`` (of due jobs that have sources; completed where all are busy) and ``jobs``
    (next times; the last time of those that have sources).
    """
    due = catalog.due_jobs(all_jobs, now)
    starts = due.select(F.col("id").alias("job_id")).join(sources.select("job_id", F.col("id").alias("source_id")), "job_id")
    starts = starts.withColumn("job_run_id", _ident("job_id", F.lit(now)))
    reaped = jobs.reap_stale(runs, now)
    # What has just gone back to the queue or failed counts as such.
    settled = runs.join(reaped.select("id", F.col("status").alias("__s")), "id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")
    after = C.next_run(F.col("frequency"), F.col("time_of_day"), F.col("day_of_week"), F.col("day_of_month"), F.col("timezone"), F.lit(now).cast("timestamp"))
    begun = new_runs(starts, settled, now, "scheduled").join(starts.select("source_id", "job_id"), "source_id").select("id", "source_id", "job_id", "job_run_id", "status", "triggered_by")
    ran = starts.select(F.col("job_id").alias("id")).distinct().withColumn("__ran", F.lit(True))
    last = F.col("last_run_at") if "last_run_at" in due.columns else F.lit(None).cast("timestamp_ntz")
    return {
        "runs": reaped,
        "job_runs": jobs.job_run_rollup(job_runs, settled),
        "starts": begun,
        "new_job_runs": started_job_runs(starts, begun, now, "scheduled"),
        "jobs": due.join(ran, "id", "left").select("id", after.alias("next_run_at"), F.when(F.col("__ran"), moment(now)).otherwise(last).alias("last_run_at")),
    }


def started_job_runs(assigned: DataFrame, begun: DataFrame, now: str, trigger: str) -> DataFrame:
    """Job runs of ``assigned`` (job_run_id, job_id, source_id): pending with the number of runs ``begun``, completed at once where every source was busy."""
    own = assigned.select(F.col("job_run_id").alias("id"), "job_id").distinct()
    n = begun.groupBy(F.col("job_run_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("sources_total"))
    out = own.join(n, "id", "left").withColumn("sources_total", F.coalesce("sources_total", F.lit(0)))
    idle = F.col("sources_total") == 0
    return out.select("id", "job_id", F.lit(trigger).alias("triggered_by"), F.when(idle, "completed").otherwise("pending").alias("status"), "sources_total", moment(now).alias("created_at"), F.when(idle, moment(now)).alias("completed_at"))


# Jobs and sources.
def assign(sources: DataFrame, job_id: str | None, ids: DataFrame) -> DataFrame:
    """The sources with those of ``ids`` (column id) in the job, or in none."""
    chosen = ids.select("id").distinct().withColumn("__in", F.lit(True))
    return sources.join(chosen, "id", "left").withColumn("job_id", F.when(F.col("__in"), F.lit(job_id)).otherwise(F.col("job_id"))).select(*sources.columns)


def imported_rows(planned: DataFrame, vendors: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """New rows of a planned import (``readers.plan_import``): ``vendors`` and ``products`` of all rows without an error, as first written, and ``sources`` of the created ones."""
    good = planned.where("result != 'error'").withColumns({"v": F.lower("vendor"), "p": F.lower("product")})
    old_v = vendors.groupBy(F.lower("name").alias("v")).agg(F.min("id").alias("vendor_id"))
    seen_v = good.groupBy("v").agg(F.min_by("vendor", "row_no").alias("name")).join(old_v, "v", "left").withColumn("new", F.col("vendor_id").isNull()).withColumn("vendor_id", F.coalesce("vendor_id", _ident(F.lit("vendor"), "v")))
    old_p = products.groupBy("vendor_id", F.lower("name").alias("p")).agg(F.min("id").alias("product_id"))
    seen_p = good.groupBy("v", "p").agg(F.min_by("product", "row_no").alias("name")).join(seen_v.select("v", "vendor_id"), "v")
    seen_p = seen_p.join(old_p, ["vendor_id", "p"], "left").withColumn("new", F.col("product_id").isNull()).withColumn("product_id", F.coalesce("product_id", _ident(F.lit("product"), "vendor_id", "p")))
    made = good.where("result = 'created'").join(seen_p.select("v", "p", "product_id"), ["v", "p"])
    return {
        "vendors": seen_v.where("new").select(F.col("vendor_id").alias("id"), "name"),
        "products": seen_p.where("new").select(F.col("product_id").alias("id"), "vendor_id", "name"),
        "sources": made.select(_ident(F.lit("source"), "product_id", "base_url").alias("id"), "product_id", F.col("source_name").alias("name"), "base_url", F.lit("pending").alias("status")),
    }


# Versions of products.
def versioned(sources: DataFrame, products: DataFrame, articles: DataFrame, product_id: str, version: str) -> dict[str, DataFrame]:
    """A product's version set: ``products`` and ``sources`` with templates as whole tables, and ``articles`` (id, topic_key) of the sources that have one."""
    if not version.strip():
        raise ValueError("blank version")
    hit = F.col("id") == product_id
    new_products = products.withColumn("version", F.when(hit, F.lit(version)).otherwise(F.col("version")))
    templated = merge.enable_versioning(sources.where(F.col("product_id") == product_id), new_products)
    out = sources.drop("url_template").join(templated.select("id", "url_template"), "id", "left")
    mine = articles.join(templated.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return {"products": new_products, "sources": out, "articles": merge.rekey(mine, templated).select("id", "topic_key")}


def bumped(sources: DataFrame, products: DataFrame, runs: DataFrame, product_id: str, version: str, now: str) -> dict[str, DataFrame]:
    """A product at another version: its row, its templated sources' URLs, and runs of those that aren't active. Raises ``ValueError`` for a blank or the same version, or without a template."""
    if "url_template" not in sources.columns:
        raise ValueError("no templates")
    same = products.where((F.col("id") == product_id) & F.col("version").eqNullSafe(F.lit(version)))
    templated = sources.where((F.col("product_id") == product_id) & F.col("url_template").isNotNull())
    if not version.strip() or same.take(1) or not templated.take(1):
        raise ValueError("nothing to bump")
    hit = F.col("id") == product_id
    return {
        "products": products.withColumns({"previous_version": F.when(hit, F.col("version")), "version": F.when(hit, F.lit(version)).otherwise(F.col("version"))}),
        "sources": templated.select("id", C.resolve_template(F.col("url_template"), F.lit(version)).alias("base_url")),
        "runs": new_runs(templated.select(F.col("id").alias("source_id")), runs, now),
    }


# Captures and tables of contents.
def fast_path(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, source_id): pending runs whose PDF is the one of the last completed run and whose source has active articles; those get ``extracted_at`` only."""
    from vellumark.operators.history import latest_completed_run

    last = latest_completed_run(runs, with_pdf=True).select("source_id", "pdf_hash")
    active = articles.where("removed_at is null").select("source_id").distinct()
    return runs.where("status in ('pending', 'running')").join(last, ["source_id", "pdf_hash"], "left_semi").join(active, "source_id", "left_semi").select("id", "source_id")


def bump_extracted(articles: DataFrame, fast: DataFrame, now: str) -> DataFrame:
    hit = fast.select("source_id").distinct().withColumn("__hit", F.lit(True))
    return articles.join(hit, "source_id", "left").withColumn("extracted_at", F.when(F.col("__hit") & F.col("removed_at").isNull(), moment(now)).otherwise(F.col("extracted_at"))).select(*articles.columns)


def rebuild_toc(toc: DataFrame, new: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the sources of ``new`` replaced, and the articles, whose links to entries that went are null."""
    touched = new.select("source_id").distinct()
    kept = toc.join(touched, "source_id", "left_anti").select(*toc.columns)
    gone = toc.join(touched, "source_id", "left_semi").select("id").join(new.select("id"), "id", "left_anti")
    return kept.unionByName(new.select(*toc.columns)), catalog.set_null(gone, articles, "toc_entry_id")


def in_order(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a requested list (id, ord), each as often as it is asked for; sort by ``ord``."""
    return wanted.select("id", "ord").join(rows, "id")


def segment_images(segments: DataFrame, images: DataFrame) -> DataFrame:
    """Images (doc_id, filename) of the segments (doc_id, seg, body) whose body names them; a document's file names are one small list."""
    names = images.groupBy("doc_id").agg(F.sort_array(F.collect_set("filename")).alias("names"))
    found = segments.join(names, "doc_id").withColumn("filename", F.explode(F.filter("names", lambda n: F.contains(F.col("body"), n))))
    return found.select("doc_id", "seg", "filename")


# Progress of a run that can be resumed.
def progress_done(progress: DataFrame, run_source: str, urls: DataFrame) -> DataFrame:
    """The progress table (source_id, kind, value) with the URLs of a finished chunk added, each once."""
    new = urls.select(F.lit(run_source).alias("source_id"), F.lit("content_done").alias("kind"), F.col("url").alias("value"))
    return progress.unionByName(new).distinct()


def progress_after(progress: DataFrame, runs: DataFrame) -> DataFrame:
    """Cleared where a source's run has completed or was cancelled; kept on a pause or a failure."""
    over = runs.where("status in ('completed', 'cancelled')").select("source_id").distinct()
    return progress.join(over, "source_id", "left_anti")


# Exports.
def new_export(export_jobs: DataFrame, source_id: str, request: str, now: str) -> DataFrame:
    """The table with a pending export of a source."""
    row = export_jobs.sparkSession.range(1).select(_ident(F.lit("export"), F.lit(source_id), F.lit(request), F.lit(now)).alias("id"), F.lit(source_id).alias("source_id"), F.lit("pending").alias("status"), F.lit(request).alias("request"), F.lit(0).alias("attempts"), moment(now).alias("created_at"))
    return export_jobs.unionByName(row, allowMissingColumns=True)


def cancel_export(export_jobs: DataFrame, ident: str) -> DataFrame:
    """A pending export is cancelled; others, running ones too, stay as they are."""
    return export_jobs.withColumn("status", F.when((F.col("id") == ident) & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")))


def export_format(request: Column) -> Column:
    return F.coalesce(F.get_json_object(request, "$.format"), F.lit("markdown"))


def export_queue(export_jobs: DataFrame, sources: DataFrame, products: DataFrame, vendors: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Export jobs, newest first, with the names of what they export; 1 to 500 of them."""
    rows = catalog.runs_enriched(export_jobs, sources, products, vendors)
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.orderBy(*catalog.newest("created_at")).limit(max(1, min(limit, 500))).withColumn("format", export_format(F.col("request")))


def listed_exports(export_jobs: DataFrame, sources: DataFrame, folders: DataFrame | None, days: int, limit: int = 20) -> DataFrame:
    """The newest finished exports with their files' number and size, format, and end; those whose folder (``folders``: export_id) is gone are passed over."""
    named = export_jobs.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    out = catalog.completed_exports(named, folders, days, limit)
    number = lambda k: F.coalesce(F.get_json_object("result", f"$.{k}").cast("long"), F.lit(0).cast("long")).alias(k)
    return out.select("export_id", "source_id", "source_name", export_format(F.col("request")).alias("format"), "created_at", "expires_at", number("file_count"), number("total_size_bytes"))


def delete_export(export_jobs: DataFrame, export_id: str) -> DataFrame:
    return export_jobs.where(~F.col("export_id").eqNullSafe(F.lit(export_id)))
