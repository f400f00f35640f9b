"""Filters, lookups and enriched lists of the store.

Sort orders spell out where nulls go (ascending: last, descending: first) and end in the id, so that pages are stable.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(when: str | datetime) -> Column:
    return F.lit(str(when)).cast("timestamp_ntz")


def up(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def newest(*columns: str) -> list[Column]:
    return [*[F.col(c).desc_nulls_first() for c in columns], F.col("id").asc_nulls_last()]


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 50, most: int = 200) -> DataFrame:
    """One page of a sorted list; ``skip`` is at least 0, ``limit`` from 1 to ``most``."""
    return df.orderBy(*order).offset(max(0, skip)).limit(min(max(1, limit), most))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def list_articles(articles: DataFrame, source_id: str | None = None, toc_entry_id: str | None = None, q: str | None = None, include_removed: bool = True) -> DataFrame:
    """``q`` is a case-insensitive pattern in which % and _ are wildcards."""
    out = articles
    if source_id is not None:
        out = out.where(F.col("source_id") == source_id)
    if toc_entry_id is not None:
        out = out.where(F.col("toc_entry_id") == toc_entry_id)
    if q is not None:
        out = out.where(F.col("title").ilike(f"%{q}%"))
    return out if include_removed else out.where(F.col("removed_at").isNull())


def list_products(products: DataFrame, vendor_id: str | None = None) -> DataFrame:
    return products if vendor_id is None else products.where(F.col("vendor_id") == vendor_id)


def list_realms(realms: DataFrame) -> DataFrame:
    """All sign-in realms by name."""
    return realms.orderBy("name", "id")


def list_sources(sources: DataFrame, products: DataFrame, product_id: str | None = None, vendor_id: str | None = None) -> DataFrame:
    out = sources if product_id is None else sources.where(F.col("product_id") == product_id)
    if vendor_id is None:
        return out
    return out.join(products.where(F.col("vendor_id") == vendor_id).select(F.col("id").alias("product_id")), "product_id", "left_semi").select(*sources.columns)


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows with these key values; raises ``LookupError`` where the caller asks for one and there is none."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def one(df: DataFrame):
    row = df.limit(1).collect()
    if not row:
        raise LookupError("not found")
    return row[0]


def filtered(df: DataFrame, source_id: str | None = None, status: str | None = None) -> DataFrame:
    """Runs or export jobs."""
    if source_id is not None:
        df = df.where(F.col("source_id") == source_id)
    return df if status is None else df.where(F.col("status") == status)


ACTIVE = ("pending", "running", "paused")
TERMINAL_EXPORT = ("completed", "failed", "cancelled")


def active_run_guard(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources that have a run pending, running or paused."""
    return sources.join(runs.where(F.col("status").isin(*ACTIVE)).select(F.col("source_id").alias("id")), "id", "left_semi")


def due_jobs(jobs: DataFrame, now: str) -> DataFrame:
    return jobs.where(F.col("enabled") & (F.col("next_run_at") <= moment(now)))


def stale(runs: DataFrame, now: str, seconds: int = 300) -> DataFrame:
    """Running without a heartbeat since ``seconds`` before ``now``; without any at all too."""
    old = moment(now) - F.expr(f"INTERVAL {int(seconds)} SECOND")
    return runs.where((F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < old)))


def expired_exports(exports: DataFrame, now: str, days: int) -> DataFrame:
    cutoff = moment(now) - F.expr(f"INTERVAL {int(days)} DAY")
    return exports.where((F.col("created_at") < cutoff) & F.col("status").isin(*TERMINAL_EXPORT))


def completed_exports(exports: DataFrame, directories: DataFrame | None, days: int, limit: int = 20) -> DataFrame:
    """The newest finished exports whose folder is there (``directories``: export_id), with when they expire."""
    out = exports.where((F.col("status") == "completed") & F.col("export_id").isNotNull())
    expires = F.col("created_at") + F.expr(f"INTERVAL {int(days)} DAY") if days > 0 else F.lit(None).cast("timestamp_ntz")
    out = out.orderBy(*newest("created_at")).limit(limit).withColumn("expires_at", expires)
    return out if directories is None else out.join(directories, "export_id", "left_semi")


def source_hierarchy(sources: DataFrame, products: DataFrame, vendors: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Sources with product and vendor (inner), and their job if any. The planner broadcasts the small sides."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product"), F.col("version").alias("product_version"), "vendor_id")
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor"))
    out = sources.join(p, "product_id").join(v, "vendor_id")
    return out if jobs is None else out.join(jobs.select(F.col("id").alias("job_id"), F.col("name").alias("job")), "job_id", "left")


def runs_enriched(runs: DataFrame, sources: DataFrame, products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Runs, or export jobs, with the names of source, product and vendor."""
    s = source_hierarchy(sources, products, vendors).select(F.col("id").alias("source_id"), F.col("name").alias("source"), "product", "vendor")
    return runs.join(s, "source_id")


def job_sources(jobs: DataFrame, sources: DataFrame, products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Each job with its sources in order of name, and their number; one join for all jobs."""
    s = source_hierarchy(sources, products, vendors).where(F.col("job_id").isNotNull())
    nested = s.groupBy("job_id").agg(F.count(F.lit(1)).alias("source_count"), F.array_sort(F.collect_list(F.struct("name", "id", "product", "vendor"))).alias("sources"))
    return jobs.join(nested, jobs["id"] == nested["job_id"], "left").select("id", "name", F.coalesce("source_count", F.lit(0)).alias("source_count"), F.coalesce("sources", F.array().cast("array<struct<name:string,id:string,product:string,vendor:string>>")).alias("sources"))


def json_default(column: str, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(F.col(column), path), F.lit(default))


def missing_ids(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids asked for that aren't there (a bulk assignment fails if there is one)."""
    return wanted.select("id").distinct().join(df.select("id"), "id", "left_anti")


def cascade(parents_gone: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children that stay when their parents (``id``) are deleted."""
    return children.join(parents_gone.select(F.col("id").alias(key)), key, "left_anti").select(*children.columns)


def set_null(parents_gone: DataFrame, children: DataFrame, key: str) -> DataFrame:
    gone = parents_gone.select(F.col("id").alias("__gone")).distinct()
    return children.join(gone, F.col(key) == F.col("__gone"), "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*children.columns)
