"""Queries of client actions: the rows or tables that they lead to."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumark.operators import actions as A
from vellumark.operators import merge as M
from vellumark.plans.domain import NOW
from vellumark.queries.registry import query
from vellumark.sources import batch as B
from vellumark.sources import readers as R

_ACTIVE = "SELECT source_id FROM {runs} WHERE status IN ('pending', 'running')"


# Runs.
query("trigger_runs", f"SELECT DISTINCT id AS source_id, 'pending' AS status, 'manual' AS triggered_by FROM {{sources}} WHERE id NOT IN ({_ACTIVE})")(lambda t: A.new_runs(t("sources").select(F.col("id").alias("source_id")), t("runs"), NOW).select("source_id", "status", "triggered_by"))
query("claim_queue", "WITH first AS (SELECT id FROM {runs} WHERE status = 'pending' ORDER BY started_at, id LIMIT 1) SELECT r.id, CASE WHEN f.id IS NULL THEN status ELSE 'running' END AS status, CAST(attempts + CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS INT) AS attempts FROM {runs} r LEFT JOIN first f ON r.id = f.id")(lambda t: A.claim(t("runs"), NOW, "started_at").select("id", "status", "attempts"))
_MESSAGE = "CASE WHEN triggered_by = 'manual' THEN 'blocked by the site' WHEN attempts > 2 THEN 'other' END"
query("blocked_run_fail", f"SELECT id, CASE WHEN status = 'completed' AND n_new + n_updated + n_unchanged + n_resumed = 0 AND {_MESSAGE} = 'blocked by the site' THEN 'failed' ELSE status END AS status FROM {{runs}}")(lambda t: A.blocked_runs(t("runs").withColumn("error_message", F.expr(_MESSAGE)), "blocked by the site").select("id", "status"))
_SETTLED = f"SELECT *, CASE WHEN status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND) THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS settled FROM {{runs}}"
query("scheduler_tick_starts", f"SELECT s.id AS source_id, s.job_id FROM {{sources}} s JOIN {{jobs}} j ON s.job_id = j.id WHERE j.enabled AND j.next_run_at <= TIMESTAMP '{NOW}' AND s.id NOT IN (SELECT source_id FROM ({_SETTLED}) x WHERE settled IN ('pending', 'running'))")(lambda t: _tick(t)["starts"].select("source_id", "job_id"))
query("scheduler_tick_job_runs", f"SELECT b.id, CASE WHEN c.over < c.n THEN CASE WHEN c.pending < c.n THEN 'running' ELSE b.status END WHEN c.done = c.n THEN 'completed' WHEN c.failed = c.n THEN 'failed' WHEN c.cancelled = c.n THEN 'cancelled' ELSE 'partial' END AS status FROM {{job_runs}} b JOIN (SELECT job_run_id, count(*) AS n, count(*) FILTER (WHERE settled IN ('completed', 'failed', 'cancelled')) AS over, count(*) FILTER (WHERE settled = 'completed') AS done, count(*) FILTER (WHERE settled = 'failed') AS failed, count(*) FILTER (WHERE settled = 'cancelled') AS cancelled, count(*) FILTER (WHERE settled = 'pending') AS pending FROM ({_SETTLED}) x WHERE job_run_id IS NOT NULL GROUP BY 1) c ON b.id = c.job_run_id")(lambda t: _tick(t)["job_runs"].select("id", "status"))


def _tick(t):
    return A.tick(t("jobs"), t("job_runs"), t("runs"), t("sources"), NOW)


_DUE = f"FROM {{jobs}} j JOIN {{sources}} s ON s.job_id = j.id WHERE j.enabled AND j.next_run_at <= TIMESTAMP '{NOW}'"
_FREE = f"count(*) FILTER (WHERE s.id NOT IN (SELECT source_id FROM ({_SETTLED}) x WHERE settled IN ('pending', 'running')))"
query("scheduler_tick_new_job_runs", f"SELECT job_id, CAST(n AS INT) AS sources_total, CASE WHEN n > 0 THEN 'pending' ELSE 'completed' END AS status, CASE WHEN n = 0 THEN TIMESTAMP '{NOW}' END AS completed_at FROM (SELECT j.id AS job_id, {_FREE} AS n {_DUE} GROUP BY j.id) q")(lambda t: _tick(t)["new_job_runs"].select("job_id", "sources_total", "status", "completed_at"))
query("scheduler_tick_busy_jobs", f"SELECT DISTINCT j.id AS job_id, 0 AS sources_total, 'completed' AS status {_DUE} AND s.id IN (SELECT source_id FROM {{runs}} WHERE status = 'pending')")(lambda t: _busy(t))
query("scheduler_tick_last_runs", f"SELECT id, CASE WHEN id IN (SELECT job_id FROM {{sources}} WHERE job_id IS NOT NULL) THEN TIMESTAMP '{NOW}' END AS last_run_at FROM {{jobs}} WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}'")(lambda t: _tick(t)["jobs"].select("id", "last_run_at"))


def _busy(t):
    """A tick when jobs have only sources with a pending run: their runs are completed at once."""
    busy = t("sources").join(t("runs").where("status = 'pending'").select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    return A.tick(t("jobs"), t("job_runs"), t("runs"), busy, NOW)["new_job_runs"].select("job_id", "sources_total", "status")


# Jobs, imports and versions.
query("assign_job", "SELECT id, CASE WHEN id IN ('s1', 's2', 's7') THEN 'j4' ELSE job_id END AS job_id FROM {sources}")(lambda t: A.assign(t("sources"), "j4", t("sources").where("id in ('s1', 's2', 's7')").select("id")).select("id", "job_id"))
_ROWS = "SELECT s.n, s.name AS source_name, CASE WHEN s.n % 7 = 0 THEN 'new ' || lower(v.name) ELSE lower(v.name) END AS vendor, upper(p.name) AS product, CASE WHEN s.n % 2 = 0 THEN s.base_url WHEN s.n % 5 = 0 THEN '' ELSE s.base_url || '/new' END AS base_url FROM {sources} s JOIN {products} p ON s.product_id = p.id JOIN {vendors} v ON p.vendor_id = v.id"


def _import(t):
    rows = t("sources").join(t("products").select(F.col("id").alias("product_id"), F.upper("name").alias("product"), "vendor_id"), "product_id").join(t("vendors").select(F.col("id").alias("vendor_id"), F.lower("name").alias("vendor")), "vendor_id")
    rows = rows.select(F.expr("CASE WHEN n % 7 = 0 THEN 'new ' || vendor ELSE vendor END").alias("vendor"), "product", F.col("name").alias("source_name"), F.expr("CASE WHEN n % 2 = 0 THEN base_url WHEN n % 5 = 0 THEN '' ELSE base_url || '/new' END").alias("base_url"), (F.col("n") + 2).cast("int").alias("row_no"))
    return A.imported_rows(R.plan_import(rows, t("sources"), t("products"), t("vendors")), t("vendors"), t("products"))


query("import_new_vendors", f"SELECT DISTINCT vendor AS name FROM ({_ROWS}) x WHERE base_url <> '' AND n % 7 = 0")(lambda t: _import(t)["vendors"].select("name"))
query("import_new_products", f"SELECT product AS name, count(DISTINCT vendor) AS n FROM ({_ROWS}) x WHERE base_url <> '' AND n % 7 = 0 GROUP BY product")(lambda t: _import(t)["products"].groupBy("name").agg(F.count(F.lit(1)).alias("n")))
query("import_new_sources", f"SELECT source_name AS name, base_url, 'pending' AS status FROM ({_ROWS}) x WHERE base_url <> '' AND (n % 7 = 0 OR n % 2 <> 0)")(lambda t: _import(t)["sources"].select("name", "base_url", "status"))

_HOLE = "chr(123) || 'version' || chr(125)"
_FOUR = "product_id = 'p4' AND contains(base_url, '4.0')"
query("enable_versioning_sources", f"SELECT id, CASE WHEN {_FOUR} THEN left(base_url, instr(base_url, '4.0') - 1) || {_HOLE} || substr(base_url, instr(base_url, '4.0') + 3) END AS url_template FROM {{sources}}")(lambda t: A.versioned(t("sources"), t("products"), t("articles"), "p4", "4.0")["sources"].select("id", "url_template"))
query("bump_version_sources", f"SELECT id, left(base_url, instr(base_url, '4.0') - 1) || '5.1' || substr(base_url, instr(base_url, '4.0') + 3) AS base_url FROM {{sources}} WHERE {_FOUR}")(lambda t: _bump(t)["sources"])
query("bump_version_products", "SELECT id, CASE WHEN id = 'p4' THEN '5.1' ELSE version END AS version, CASE WHEN id = 'p4' THEN '4.0' END AS previous_version FROM {products}")(lambda t: _bump(t)["products"].select("id", "version", "previous_version"))
query("bump_version_runs", f"SELECT id AS source_id FROM {{sources}} WHERE {_FOUR} AND id NOT IN ({_ACTIVE})")(lambda t: _bump(t)["runs"].select("source_id"))


def _bump(t):
    on = A.versioned(t("sources"), t("products").withColumn("previous_version", F.lit(None).cast("string")), t("articles"), "p4", "4.0")
    return A.bumped(on["sources"], on["products"], t("runs"), "p4", "5.1", NOW)


query("rekey_articles", f"SELECT a.id, CASE WHEN instr(a.source_url, s.version) > 0 THEN left(a.source_url, instr(a.source_url, s.version) - 1) || {_HOLE} || substr(a.source_url, instr(a.source_url, s.version) + length(s.version)) ELSE a.source_url END AS topic_key FROM (SELECT id, source_id, source_url || '/' || (n % 7 + 1) || '.' || (n % 3) AS source_url FROM {{articles}}) a LEFT JOIN (SELECT s.id, p.version FROM {{sources}} s JOIN {{products}} p ON s.product_id = p.id WHERE contains(s.base_url, p.version)) s ON a.source_id = s.id")(lambda t: M.rekey(t("articles").select("id", "source_id", F.expr("source_url || '/' || (n % 7 + 1) || '.' || (n % 3)").alias("source_url")), M.enable_versioning(t("sources"), t("products"))).select("id", "topic_key"))

# Captures and tables of contents.
_LAST_PDF = "SELECT source_id, pdf_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS k FROM {runs} WHERE status = 'completed' AND pdf_hash IS NOT NULL) q WHERE k = 1"
_AGAIN = "CASE WHEN status = 'completed' THEN 'pending' ELSE status END"
query("pdf_fast_path", f"SELECT r.id, r.source_id FROM {{runs}} r JOIN ({_LAST_PDF}) l ON r.source_id = l.source_id AND r.pdf_hash = l.pdf_hash WHERE r.status IN ('pending', 'running') AND r.source_id IN (SELECT source_id FROM {{articles}} WHERE removed_at IS NULL)".replace("FROM {runs} r", "FROM (SELECT * FROM {runs} UNION ALL SELECT * REPLACE ('again' || id AS id, 'pending' AS status) FROM {runs} WHERE status = 'completed') r"))(lambda t: A.fast_path(_again(t), t("articles")))
query("pdf_fast_path_articles", f"SELECT id, CASE WHEN removed_at IS NULL AND source_id IN (SELECT source_id FROM ({_LAST_PDF}) l) THEN TIMESTAMP '{NOW}' ELSE extracted_at END AS extracted_at FROM {{articles}}")(lambda t: A.bump_extracted(t("articles"), A.fast_path(_again(t), t("articles")), NOW).select("id", "extracted_at"))


def _again(t):
    """Runs, and a pending one for each completed one, with the same PDF."""
    more = t("runs").where("status = 'completed'").withColumns({"id": F.concat(F.lit("again"), "id"), "status": F.lit("pending")})
    return t("runs").unionByName(more)


_TWO = "source_id IN ('s1', 's2')"
query("toc_rebuild", f"SELECT id, source_id FROM {{toc}} WHERE source_id NOT IN ('s1', 's2') UNION ALL SELECT 'new' || id, source_id FROM {{toc}} WHERE {_TWO} AND level < 2 UNION ALL SELECT id, source_id FROM {{toc}} WHERE {_TWO} AND level = 2")(lambda t: _rebuilt(t)[0].select("id", "source_id"))
query("toc_rebuild_articles", f"SELECT id, CASE WHEN toc_entry_id IN (SELECT id FROM {{toc}} WHERE {_TWO} AND level <> 2) THEN NULL ELSE toc_entry_id END AS toc_entry_id FROM {{articles}}")(lambda t: _rebuilt(t)[1].select("id", "toc_entry_id"))


def _rebuilt(t):
    new = t("toc").where(f"{_TWO} and level <= 2").withColumn("id", F.when(F.col("level") < 2, F.concat(F.lit("new"), "id")).otherwise(F.col("id")))
    return A.rebuild_toc(t("toc"), new, t("articles"))


query("chunk_reorder", "SELECT a.id, a.title, CAST(100000000 - a.n AS BIGINT) AS ord FROM {articles} a")(lambda t: A.in_order(t("articles").select("id", "title"), t("articles").select("id", (F.lit(100_000_000) - F.col("n")).cast("long").alias("ord"))))
query("segment_images", "SELECT DISTINCT d.doc_id, CAST(0 AS INT) AS seg, i.f AS filename FROM {documents} d JOIN (SELECT doc_id, left(text, 4) AS f FROM {documents} UNION ALL SELECT doc_id, 'zz~' AS f FROM {documents}) i ON d.doc_id = i.doc_id WHERE contains(d.text, i.f)")(lambda t: A.segment_images(t("documents").select("doc_id", F.lit(0).alias("seg"), F.col("text").alias("body")), t("documents").select("doc_id", F.left("text", F.lit(4)).alias("filename")).unionAll(t("documents").select("doc_id", F.lit("zz~").alias("filename")))))
query("progress_after", "SELECT id AS source_id, base_url AS value FROM {sources} WHERE id NOT IN (SELECT source_id FROM {runs} WHERE status IN ('completed', 'cancelled'))")(lambda t: A.progress_after(t("sources").select(F.col("id").alias("source_id"), F.lit("content_done").alias("kind"), F.col("base_url").alias("value")), t("runs")).select("source_id", "value"))


class _Fixture:
    """A crawler that loses pages whose URL ends in 7 and gives empty ones for 3, forty at a time."""

    def submit(self, urls: list[str]) -> list[str]:
        return [u for u in urls if u[-1] != "7"]

    def poll(self, job: list[str], skip: int) -> tuple[list[dict], bool]:
        return [{"url": u, "markdown": "" if u[-1] == "3" else f"# {u}"} for u in job[skip : skip + 40]], skip + 40 >= len(job)

    def scrape(self, url: str) -> dict:
        return {"url": url, "markdown": f"# {url}"}


query("batch_scrape", "SELECT DISTINCT source_id, source_url AS url, '# ' || source_url AS markdown, CASE WHEN right(source_url, 1) IN ('3', '7') THEN 2 ELSE 1 END AS tries FROM {articles}")(lambda t: B.scrape(t("articles").select("source_id", F.col("source_url").alias("url")), _Fixture()))

# Exports.
query("export_create", "SELECT id, status, attempts FROM {export_jobs} UNION ALL SELECT 'made', 'pending', 0")(lambda t: A.new_export(t("export_jobs"), "s3", "{}", NOW).select(F.when(F.length("id") == 32, "made").otherwise(F.col("id")).alias("id"), "status", "attempts"))
_NEXT_EXPORT = "(SELECT min(id) FROM {{export_jobs}} WHERE status = 'pending')"
query("export_cancel", f"SELECT id, CASE WHEN id = {_NEXT_EXPORT} THEN 'cancelled' ELSE status END AS status FROM {{export_jobs}}".replace("{{", "{").replace("}}", "}"))(lambda t: _cancelled(t))
query("export_queue", "SELECT e.id, e.status, s.name AS source, p.name AS product, v.name AS vendor, coalesce(json_extract_string(e.request, '$.format'), 'markdown') AS format FROM {export_jobs} e JOIN {sources} s ON e.source_id = s.id JOIN {products} p ON s.product_id = p.id JOIN {vendors} v ON p.vendor_id = v.id WHERE e.status = 'failed' ORDER BY e.created_at DESC, e.id LIMIT 100")(
    lambda t: A.export_queue(t("export_jobs"), t("sources"), t("products"), t("vendors"), "failed").select("id", "status", "source", "product", "vendor", "format")
)
query("export_list", "SELECT export_id, e.source_id, s.name AS source_name, coalesce(json_extract_string(request, '$.format'), 'markdown') AS format, created_at, created_at + INTERVAL 7 DAY AS expires_at, coalesce(CAST(json_extract_string(result, '$.file_count') AS BIGINT), 0) AS file_count, coalesce(CAST(json_extract_string(result, '$.total_size_bytes') AS BIGINT), 0) AS total_size_bytes FROM {export_jobs} e JOIN {sources} s ON e.source_id = s.id WHERE e.status = 'completed' AND export_id IS NOT NULL ORDER BY created_at DESC, e.id LIMIT 20")(
    lambda t: A.listed_exports(t("export_jobs"), t("sources"), None, 7)
)
query("export_delete", "SELECT id FROM {export_jobs} WHERE export_id IS NULL OR export_id <> (SELECT max(export_id) FROM {export_jobs})")(lambda t: A.delete_export(t("export_jobs"), t("export_jobs").agg(F.max("export_id")).first()[0]).select("id"))


def _cancelled(t):
    """A cancel of a pending export and one of a running export, which has no effect."""
    jobs = t("export_jobs")
    for status in ("pending", "running"):
        ident = t("export_jobs").where(F.col("status") == status).agg(F.min("id")).first()[0]
        jobs = A.cancel_export(jobs, ident)
    return jobs.select("id", "status")


_UUID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"
query("orphan_exports", f"SELECT {_UUID} AS name FROM (SELECT md5(export_id) AS h, CAST(substr(id, 2) AS BIGINT) AS n, created_at AS modified FROM {{export_jobs}} WHERE export_id IS NOT NULL) f WHERE n % 5 <> 0 AND n % 3 <> 0 AND modified < TIMESTAMP '1996-01-01 00:00:00'")(lambda t: _orphans(t))


def _orphans(t):
    """Folders of exports by UUIDs, every fifth named otherwise; every third has its row still."""
    from vellumark.operators.jobs import orphan_folders

    n, h = F.substring("id", 2, 20).cast("long"), F.md5("export_id")
    parts = [F.substring(h, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    folders = t("export_jobs").where("export_id is not null").select(F.when(n % 5 == 0, F.concat(F.lit("tmp-"), n.cast("string"))).otherwise(F.concat_ws("-", *parts)).alias("name"), F.col("created_at").alias("modified"), n.alias("n"))
    return orphan_folders(folders.select("name", "modified"), folders.where("n % 3 = 0").select("name"), "1996-01-01 00:00:00").select("name")
