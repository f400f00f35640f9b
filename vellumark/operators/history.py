"""Joins over runs and versions: latest rows, as-of matches, relinking, the changelog and the browse tree's states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumark.operators.catalog import moment


def latest_run_per_source(runs: DataFrame) -> DataFrame:
    """One run a source: pending ones last, then the newest start, then the id; ``min_by`` keeps a row a source on the map side."""
    newest = F.coalesce(-F.unix_micros(F.col("started_at").cast("timestamp")), F.lit(-(2**63)))
    key = F.struct((F.col("status") == "pending").alias("p"), newest.alias("t"), "id")
    return runs.groupBy("source_id").agg(F.min_by(F.struct(*[c for c in runs.columns if c != "source_id"]), key).alias("r")).select("source_id", "r.*").select(*runs.columns)


def latest_completed_run(runs: DataFrame, with_pdf: bool = False) -> DataFrame:
    """``max_by`` keeps a row a source on the map side; no window sorts all runs."""
    done = runs.where(F.col("status") == "completed")
    if with_pdf:
        done = done.where(F.col("pdf_hash").isNotNull())
    key = F.struct("started_at", "id")
    return done.groupBy("source_id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "source_id"]), key).alias("r")).select("source_id", "r.*")


def baseline_run(articles: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each source the earliest run that created an article, its time, and how many it created."""
    created = articles.where(F.col("created_run_id").isNotNull()).groupBy("source_id", "created_run_id").agg(F.count(F.lit(1)).alias("n"))
    r = runs.select(F.col("id").alias("created_run_id"), "started_at", "completed_at", "version")
    first = created.join(r, "created_run_id").groupBy("source_id").agg(F.min_by(F.struct("created_run_id", "n", F.coalesce("completed_at", "started_at").alias("at"), "version"), F.struct("started_at", "created_run_id")).alias("b"))
    return first.select("source_id", F.col("b.created_run_id").alias("run_id"), F.col("b.n").alias("n"), F.col("b.at").alias("at"), F.col("b.version").alias("version"))


def changelog(articles: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Events of all sources at once: initial, added, changed, removed; newest first is the caller's sort."""
    base = baseline_run(articles, runs)
    b = base.select("source_id", F.col("run_id").alias("__base"))
    names = ["source_id", "article_id", "event", "at", "run_id", "has_diff", "title"]
    added = articles.where("created_run_id is not null").join(b, "source_id").where("created_run_id != __base").select("source_id", F.col("id").alias("article_id"), F.lit("added").alias("event"), F.col("created_at").alias("at"), F.col("created_run_id").alias("run_id"), F.lit(False).alias("has_diff"), "title")
    of = articles.select(F.col("id").alias("article_id"), "source_id", "title")
    changed = versions.join(of, "article_id").select("source_id", "article_id", F.lit("changed").alias("event"), F.col("extracted_at").alias("at"), F.col("extraction_run_id").alias("run_id"), F.col("diff_text").isNotNull().alias("has_diff"), "title")
    removed = articles.where("removed_at is not null").select("source_id", F.col("id").alias("article_id"), F.lit("removed").alias("event"), F.col("removed_at").alias("at"), F.col("removal_run_id").alias("run_id"), F.lit(False).alias("has_diff"), "title")
    initial = base.where("n > 0").select("source_id", F.lit(None).cast("string").alias("article_id"), F.lit("initial").alias("event"), "at", "run_id", F.lit(False).alias("has_diff"), F.concat(F.lit("Initial extraction — "), "n", F.lit(" articles added")).alias("title"))
    events = added.select(*names).unionByName(changed.select(*names)).unionByName(removed.select(*names)).unionByName(initial.select(*names))
    return events.join(runs.select(F.col("id").alias("run_id"), "version"), "run_id", "left")


def version_counts(versions: DataFrame, articles: DataFrame) -> DataFrame:
    return versions.join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").groupBy("source_id", "article_id").agg(F.count(F.lit(1)).alias("version_count"))


def browse_status(articles: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Linked articles as new, updated or unchanged since their source's latest completed run; the unlinked as removed."""
    last = latest_completed_run(runs).select("source_id", F.col("id").alias("last_run"), F.col("started_at").alias("last_start"))
    per = versions.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("version_count"))
    # Versions of the latest runs only: one row for an article at most.
    fresh = versions.join(last.select(F.col("last_run").alias("extraction_run_id")), "extraction_run_id", "left_semi").select(F.col("article_id").alias("id"), F.col("extraction_run_id").alias("last_run")).distinct().withColumn("updated", F.lit(True))
    out = articles.join(last, "source_id", "left").join(per, "id", "left").join(fresh, ["id", "last_run"], "left")
    status = (
        F.when(F.col("toc_entry_id").isNull(), "removed")
        .when(F.col("created_at") >= F.col("last_start"), "new")
        .when(F.col("updated"), "updated")
        .otherwise("unchanged")
    )
    return out.select("id", "source_id", "toc_entry_id", status.alias("status"), F.coalesce("version_count", F.lit(0)).alias("version_count"))


def next_version(versions: DataFrame) -> DataFrame:
    """Each version with the one that follows at a strictly later time. Equal times share their successor."""
    times = versions.groupBy("article_id", "extracted_at").agg(F.min("id").alias("first_id"))
    after = Window.partitionBy("article_id").orderBy("extracted_at")
    step = times.select("article_id", "extracted_at", F.lead("first_id").over(after).alias("next_id"))
    return versions.join(step, ["article_id", "extracted_at"], "left").select("id", "article_id", "extracted_at", "next_id")


def run_as_of(articles: DataFrame, runs: DataFrame) -> DataFrame:
    """For each article the latest run of its source with ``started_at <= created_at``: one sort of both, no range join.

    An article older than all runs gets the earliest run of its source that created one.
    """
    a = articles.select("source_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("run"))
    r = runs.select("source_id", F.col("started_at").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), F.col("id").alias("run"))
    order = Window.partitionBy("source_id").orderBy("at", "kind", "run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(r).withColumn("run_id", F.last("run", ignorenulls=True).over(order)).where("kind = 1")
    first = baseline_run(articles, runs).select("source_id", F.col("run_id").alias("__first"))
    return found.join(first, "source_id", "left").select("id", "source_id", F.coalesce("run_id", "__first").alias("run_id"))


def relink(articles: DataFrame, toc: DataFrame) -> DataFrame:
    """Article to the TOC entry of its source with its URL (lowest order, then id), or null."""
    best = toc.where("url is not null").groupBy("source_id", F.col("url").alias("source_url")).agg(F.min_by("id", F.struct("sort_order", "id")).alias("linked"))
    return articles.join(best, ["source_id", "source_url"], "left")


def reconcile_removals(articles: DataFrame, toc: DataFrame, run_id: str, now: str) -> DataFrame:
    """After relinking: stamp what lost its link (the first time only) and clear what came back."""
    out = relink(articles, toc)
    gone, back = F.col("linked").isNull() & F.col("removed_at").isNull(), F.col("linked").isNotNull()
    removed_at = F.when(back, F.lit(None).cast("timestamp_ntz")).when(gone, moment(now)).otherwise(F.col("removed_at"))
    by = F.when(back, F.lit(None).cast("string")).when(gone, F.lit(run_id)).otherwise(F.col("removal_run_id"))
    return out.withColumns({"removed_at": removed_at, "removal_run_id": by, "toc_entry_id": F.col("linked")}).drop("linked").select(*articles.columns)


def toc_article_map(toc: DataFrame, articles: DataFrame) -> DataFrame:
    """TOC entry to its article: the newest, then the greatest id, where several share it."""
    best = articles.where("toc_entry_id is not null").groupBy(F.col("toc_entry_id").alias("id")).agg(F.max_by("id", F.struct("created_at", "id")).alias("article_id"))
    return toc.join(best, "id", "left")


def dashboard_rows(sources: DataFrame, products: DataFrame, vendors: DataFrame, articles: DataFrame, runs: DataFrame, now: str, stale_days: int = 30) -> DataFrame:
    """Every source with its article count, latest run and freshness."""
    from vellumark.operators.catalog import source_hierarchy

    active = articles.where("removed_at is null").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("article_count"))
    last = latest_run_per_source(runs).select(F.col("source_id").alias("id"), F.col("status").alias("last_run_status"), F.col("n_new").alias("last_run_new"), F.col("n_updated").alias("last_run_updated"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_extracted_at").cast("timestamp"))
    out = source_hierarchy(sources, products, vendors).join(active, "id", "left").join(last, "id", "left")
    return out.select(
        "id", "vendor", "product", "name", "status", "last_extracted_at", F.coalesce("article_count", F.lit(0)).alias("article_count"), "last_run_status",
        F.coalesce("last_run_new", F.lit(0)).alias("last_run_new"), F.coalesce("last_run_updated", F.lit(0)).alias("last_run_updated"), age.alias("age_seconds"),
        F.coalesce(F.col("last_extracted_at") < moment(now) - F.expr(f"INTERVAL {int(stale_days)} DAY"), F.lit(False)).alias("is_stale"),
    )


def dashboard_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("last_extracted_at").isNull()).alias("never"), F.count_if("is_stale").alias("stale"), F.count_if(F.col("status") == "failed").alias("failing"), F.count_if(F.col("status") == "extracting").alias("running"))


def health_rank(rows: DataFrame) -> DataFrame:
    rank = F.when(F.col("last_extracted_at").isNull(), 0).when(F.col("status") == "failed", 1).when(F.col("age_seconds") > 30 * 86400, 2).otherwise(3)
    return rows.withColumn("health_rank", rank)
