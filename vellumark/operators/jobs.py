"""Jobs, queues and retention as DataFrame logic. Writers are single; every function gives the new rows or decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.operators.catalog import moment, stale

MAX_ATTEMPTS = 3


def job_run_rollup(job_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """New status and counts of job runs from their children; those without children are left out."""
    is_ = lambda s: F.count_if(F.col("child") == s)
    kids = runs.where("job_run_id is not null").select(F.col("job_run_id").alias("id"), F.col("status").alias("child"))
    c = kids.groupBy("id").agg(F.count(F.lit(1)).alias("n"), is_("completed").alias("done"), is_("failed").alias("failed"), is_("cancelled").alias("cancelled"), is_("pending").alias("pending"))
    over = F.col("done") + F.col("failed") + F.col("cancelled") == F.col("n")
    status = (
        F.when(~over, F.when(F.col("pending") < F.col("n"), "running").otherwise(F.col("status")))
        .when(F.col("done") == F.col("n"), "completed").when(F.col("failed") == F.col("n"), "failed").when(F.col("cancelled") == F.col("n"), "cancelled").otherwise("partial")
    )
    return job_runs.join(c, "id").select("id", "job_id", status.alias("status"), F.when(over, F.col("done")).alias("sources_done"), F.when(over, F.col("failed")).alias("sources_failed"))


def run_progress(runs: DataFrame) -> DataFrame:
    processed = F.col("n_new") + F.col("n_updated") + F.col("n_unchanged") + F.col("n_resumed")
    percent = F.when(F.col("n_total") > 0, F.least(F.lit(100), F.floor(100.0 * processed / F.col("n_total") + 0.5)).cast("long"))
    return runs.select("id", processed.alias("processed"), percent.alias("percent"))


def failure_rate_guard(attempted: Column, failed: Column, least: int = 10, rate: float = 0.3) -> Column:
    """Whether a run must abort."""
    return (attempted >= least) & (failed / F.when(attempted > 0, attempted) > rate)


def reap_stale(runs: DataFrame, now: str, seconds: int = 300, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Stale runs: back to pending, or failed when their attempts are used up."""
    spent = F.col("attempts") >= attempts
    return stale(runs, now, seconds).select("id", "source_id", F.when(spent, "failed").otherwise("pending").alias("status"), F.when(spent, "worker lost").alias("error_message"), F.when(spent, F.col("heartbeat_at")).alias("heartbeat_at"))


def claim_oldest(queue: DataFrame, order: str = "created_at") -> DataFrame:
    return queue.where(F.col("status") == "pending").orderBy(F.col(order).asc_nulls_last(), "id").limit(1)


def enqueue_coalesce(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources (``source_id``) to start: each once, none that has a pending or running run."""
    active = runs.where(F.col("status").isin("pending", "running")).select("source_id")
    return wanted.select("source_id").distinct().join(active, "source_id", "left_anti")


def fan_out(jobs: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Each job with how many sources it has, how many runs it starts, and the state of its run (null: none assigned)."""
    own = sources.where("job_id is not null").select("job_id", F.col("id").alias("source_id"))
    start = enqueue_coalesce(own, runs).withColumn("starts", F.lit(1))
    n = own.join(start, "source_id", "left").groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("assigned"), F.count("starts").alias("started"))
    return jobs.select("id").join(n, "id", "left").select("id", F.coalesce("assigned", F.lit(0)).alias("assigned"), F.coalesce("started", F.lit(0)).alias("started"), F.when(F.col("assigned") > 0, F.when(F.col("started") > 0, "pending").otherwise("completed")).alias("status"))


def duplicate_active(runs: DataFrame) -> DataFrame:
    """Sources that break the rule of one pending or running run."""
    return runs.where(F.col("status").isin("pending", "running")).groupBy("source_id").agg(F.count(F.lit(1)).alias("active")).where("active > 1")


def run_control(status: Column, action: str) -> Column:
    """(status, control, http) that an action leads to."""
    ok = lambda s, c: F.struct(F.lit(s).alias("status") if isinstance(s, str) else s.alias("status"), F.lit(c).cast("string").alias("control"), F.lit(200).alias("http"))
    no = F.struct(status.alias("status"), F.lit(None).cast("string").alias("control"), F.lit(409).alias("http"))
    if action == "cancel":
        return F.when(status.isin("pending", "paused"), ok("cancelled", None)).when(status == "running", ok(status, "cancel")).otherwise(no)
    if action == "pause":
        return F.when(status == "running", ok(status, "pause")).when(status == "pending", ok("paused", None)).otherwise(no)
    if action == "resume":
        return F.when(status == "paused", ok("pending", None)).otherwise(no)
    raise ValueError(action)


def retention_evict(exports: DataFrame, cap: float) -> DataFrame:
    """Oldest first until the rest fits: a row goes if the sizes from it to the newest exceed the cap.

    Sums by day come first, so only the days' few rows are in one window.
    """
    rows = exports.withColumn("__day", F.to_date("created_at"))
    days = rows.groupBy("__day").agg(F.sum("size").alias("s"))
    later = Window.orderBy("__day").rowsBetween(1, Window.unboundedFollowing)
    days = days.select("__day", F.coalesce(F.sum("s").over(later), F.lit(0.0)).alias("__after"))
    inside = Window.partitionBy("__day").orderBy("created_at", "id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("__rest", F.sum("size").over(inside)).join(days, "__day").where(F.col("__rest") + F.col("__after") > cap).drop("__day", "__rest", "__after")


def orphans(listing: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Folders (``key``) that no row knows."""
    return listing.join(known.select(key), key, "left_anti")


def image_filter(images: DataFrame) -> DataFrame:
    """http(s) images that aren't furniture, each once for an article."""
    keep = images.where(F.col("original_url").rlike("(?i)^https?://") & ~F.col("original_url").rlike(r"(?i)/_SystemImages/|/Skins/|/transparent\.gif"))
    first = Window.partitionBy("article_id", "original_url").orderBy("sort_order", "id")
    return keep.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def orphan_folders(folders: DataFrame, known: DataFrame, before: str | None = None) -> DataFrame:
    """Folders (name, modified) that are named by a UUID no row of ``known`` (name) has, last changed before a time if one is given: what garbage collection may remove."""
    old = folders.where(F.lower("name").rlike(UUID))
    if before is not None:
        old = old.where(F.col("modified") < F.lit(before).cast("timestamp_ntz"))
    return old.join(known.select(F.lower("name").alias("__n")).distinct(), F.lower("name") == F.col("__n"), "left_anti")
