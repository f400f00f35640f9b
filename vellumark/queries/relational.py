"""Lists, joins, aggregations, windows and domain queries over the store's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumark.operators import catalog as K
from vellumark.operators import history as H
from vellumark.operators import jobs as J
from vellumark.operators import toc as TC
from vellumark.plans.domain import NOW
from vellumark.queries.registry import query

ASOF = "2024-01-20 00:00:00"

# Scans, filters and lists.
query("scan_table", "SELECT * FROM {runs}")(lambda t: t("runs"))
query("scan_projected", "SELECT id, title, estimated_tokens, content_size_bytes, sort_order, toc_entry_id FROM {articles}")(lambda t: t("articles").select("id", "title", "estimated_tokens", "content_size_bytes", "sort_order", "toc_entry_id"))
query("list_articles", "SELECT id, title, source_id FROM {articles} WHERE lower(title) LIKE '%th_r%' ORDER BY sort_order NULLS LAST, id LIMIT 50 OFFSET 5")(lambda t: K.page(K.list_articles(t("articles"), q="th_r"), K.up("sort_order", "id"), 5, 50).select("id", "title", "source_id"))
query("list_articles_total", "SELECT count(*) AS total FROM {articles} WHERE source_id = 's3'")(lambda t: K.total(K.list_articles(t("articles"), source_id="s3")))
query("list_vendors", "SELECT id, name, website FROM {vendors} ORDER BY name, id LIMIT 20")(lambda t: K.page(t("vendors"), K.up("name", "id"), 0, 20))
query("list_products", "SELECT id, vendor_id, name, version FROM {products} WHERE vendor_id = 'v18'")(lambda t: K.list_products(t("products"), "v18").select("id", "vendor_id", "name", "version"))
query("list_jobs", "SELECT id, name, enabled, frequency FROM {jobs}")(lambda t: t("jobs").orderBy(*K.up("name", "id")).select("id", "name", "enabled", "frequency"))
query("list_sources", "SELECT id, name, product_id FROM {sources} WHERE product_id IN (SELECT id FROM {products} WHERE vendor_id = 'v18')")(lambda t: K.list_sources(t("sources"), t("products"), vendor_id="v18").select("id", "name", "product_id"))
query("point_lookup", "SELECT id, source_id, status FROM {runs} WHERE id = 'r7'")(lambda t: K.lookup(t("runs"), id="r7").select("id", "source_id", "status"))
query("point_lookup_two_keys", "SELECT id, article_id FROM {versions} WHERE id = 'x7' AND article_id = 'a7'")(lambda t: K.lookup(t("versions"), id="x7", article_id="a7").select("id", "article_id"))
query("runs_filtered", "SELECT id, source_id, started_at FROM {runs} WHERE status = 'failed' ORDER BY started_at DESC NULLS FIRST, id LIMIT 500")(lambda t: K.page(K.filtered(t("runs"), status="failed"), K.newest("started_at"), 0, 500, 500).select("id", "source_id", "started_at"))
query("export_jobs_filtered", "SELECT id, source_id, created_at FROM {export_jobs} WHERE status = 'completed' ORDER BY created_at DESC NULLS FIRST, id LIMIT 500")(lambda t: K.page(K.filtered(t("export_jobs"), status="completed"), K.newest("created_at"), 0, 500, 500).select("id", "source_id", "created_at"))
query("active_run_guard", "SELECT id FROM {sources} WHERE id IN (SELECT source_id FROM {runs} WHERE status IN ('pending', 'running', 'paused'))")(lambda t: K.active_run_guard(t("sources"), t("runs")).select("id"))
query("due_jobs", f"SELECT id, name FROM {{jobs}} WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}'")(lambda t: K.due_jobs(t("jobs"), NOW).select("id", "name"))
query("stale_runs", f"SELECT id, attempts FROM {{runs}} WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND)")(lambda t: K.stale(t("runs"), NOW).select("id", "attempts"))
query("expired_exports", f"SELECT id, status FROM {{export_jobs}} WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND status IN ('completed', 'failed', 'cancelled')")(lambda t: K.expired_exports(t("export_jobs"), NOW, 90).select("id", "status"))
query("list_realms", "SELECT id, name, login_url FROM {auth_realms} ORDER BY name, id")(lambda t: K.list_realms(t("auth_realms")))
query("completed_exports", "SELECT id, export_id, created_at, created_at + INTERVAL 7 DAY AS expires_at FROM {export_jobs} WHERE status = 'completed' AND export_id IS NOT NULL ORDER BY created_at DESC, id LIMIT 20")(lambda t: K.completed_exports(t("export_jobs"), None, 7).select("id", "export_id", "created_at", "expires_at"))
query("not_null_projections", "SELECT id, diff_text IS NOT NULL AS has_diff, coalesce(strlen(content_markdown), 0) AS size_bytes FROM {versions}")(lambda t: t("versions").select("id", F.col("diff_text").isNotNull().alias("has_diff"), F.coalesce(F.octet_length("content_markdown"), F.lit(0)).alias("size_bytes")))
query("json_defaults", "SELECT id, coalesce(json_extract_string(request, '$.format'), 'markdown') AS format, coalesce(CAST(json_extract_string(result, '$.file_count') AS BIGINT), 0) AS file_count FROM {export_jobs}")(lambda t: t("export_jobs").select("id", K.json_default("request", "$.format", "markdown").alias("format"), K.json_default("result", "$.file_count", "0").cast("long").alias("file_count")))
query("image_filter", "SELECT id, article_id, original_url FROM (SELECT *, row_number() OVER (PARTITION BY article_id, original_url ORDER BY sort_order, id) AS k FROM {images} WHERE regexp_matches(original_url, '^https?://', 'i') AND NOT regexp_matches(original_url, '/_SystemImages/|/Skins/|/transparent\\.gif', 'i')) x WHERE k = 1")(lambda t: J.image_filter(t("images")).select("id", "article_id", "original_url"))
query("scrapable_filter", "SELECT id, url FROM {toc} WHERE url IS NOT NULL AND url <> ''")(lambda t: t("toc").where("url is not null and url != ''").select("id", "url"))
query("pending_set", "SELECT t.id, t.url FROM {toc} t WHERE t.url IS NOT NULL AND t.url <> '' AND NOT EXISTS (SELECT 1 FROM {articles} a WHERE a.source_url = t.url AND a.removed_at IS NULL)")(lambda t: _pending(t))


def _pending(t):
    from vellumark.streaming.ingest import pending

    return pending(t("toc"), t("articles").where("removed_at is null").select(F.col("source_url").alias("url"))).select("id", "url")


# Joins.
query("source_hierarchy", "SELECT s.id, s.name, p.name AS product, v.name AS vendor, j.name AS job FROM {sources} s JOIN {products} p ON s.product_id = p.id JOIN {vendors} v ON p.vendor_id = v.id LEFT JOIN {jobs} j ON s.job_id = j.id")(lambda t: K.source_hierarchy(t("sources"), t("products"), t("vendors"), t("jobs")).select("id", "name", "product", "vendor", "job"))
query("runs_enriched", "SELECT r.id, r.status, r.started_at, s.name AS source, p.name AS product, v.name AS vendor FROM {runs} r JOIN {sources} s ON r.source_id = s.id JOIN {products} p ON s.product_id = p.id JOIN {vendors} v ON p.vendor_id = v.id")(lambda t: K.runs_enriched(t("runs"), t("sources"), t("products"), t("vendors")).select("id", "status", "started_at", "source", "product", "vendor"))
query("export_jobs_enriched", "SELECT e.id, e.status, e.created_at, s.name AS source, p.name AS product, v.name AS vendor FROM {export_jobs} e JOIN {sources} s ON e.source_id = s.id JOIN {products} p ON s.product_id = p.id JOIN {vendors} v ON p.vendor_id = v.id")(lambda t: K.runs_enriched(t("export_jobs"), t("sources"), t("products"), t("vendors")).select("id", "status", "created_at", "source", "product", "vendor"))
query("job_sources", "SELECT j.id, j.name, count(s.id) AS source_count, coalesce(string_agg(s.name, ',' ORDER BY s.name, s.id), '') AS source_names FROM {jobs} j LEFT JOIN (SELECT s.* FROM {sources} s JOIN {products} p ON s.product_id = p.id JOIN {vendors} v ON p.vendor_id = v.id) s ON s.job_id = j.id GROUP BY j.id, j.name")(lambda t: K.job_sources(t("jobs"), t("sources"), t("products"), t("vendors")).select("id", "name", "source_count", F.array_join("sources.name", ",").alias("source_names")))
query("job_runs_recent", "SELECT b.id, j.name, b.status FROM {job_runs} b JOIN {jobs} j ON b.job_id = j.id ORDER BY b.created_at DESC, b.id LIMIT 30")(lambda t: t("job_runs").join(t("jobs").select(F.col("id").alias("job_id"), "name"), "job_id").orderBy(*K.newest("created_at")).limit(30).select("id", "name", "status"))
query("version_run_outer", "SELECT x.id, x.article_id, r.version FROM {versions} x LEFT JOIN {runs} r ON x.extraction_run_id = r.id")(lambda t: t("versions").join(t("runs").select(F.col("id").alias("extraction_run_id"), "version"), "extraction_run_id", "left").select("id", "article_id", "version"))
query("version_count_join", "SELECT a.source_id, x.article_id, count(*) AS version_count FROM {versions} x JOIN {articles} a ON x.article_id = a.id GROUP BY 1, 2")(lambda t: H.version_counts(t("versions"), t("articles")))
_BASE = "SELECT source_id, run_id, n, x.\"at\" FROM (SELECT c.source_id, c.created_run_id AS run_id, c.n, coalesce(r.completed_at, r.started_at) AS \"at\", row_number() OVER (PARTITION BY c.source_id ORDER BY r.started_at, c.created_run_id) AS k FROM (SELECT source_id, created_run_id, count(*) AS n FROM {articles} WHERE created_run_id IS NOT NULL GROUP BY 1, 2) c JOIN {runs} r ON c.created_run_id = r.id) x WHERE k = 1"
query("baseline_join", _BASE)(lambda t: H.baseline_run(t("articles"), t("runs")).select("source_id", "run_id", "n", "at"))
query("vendor_in_subquery", "SELECT s.id FROM {sources} s JOIN {products} p ON s.product_id = p.id WHERE p.vendor_id = 'v18'")(lambda t: K.list_sources(t("sources"), t("products"), vendor_id="v18").select("id"))
query("relink_scalar_subquery", "SELECT a.id, x.linked FROM {articles} a LEFT JOIN (SELECT source_id, url, id AS linked FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY sort_order, id) AS k FROM {toc} WHERE url IS NOT NULL) q WHERE k = 1) x ON a.source_id = x.source_id AND a.source_url = x.url")(lambda t: H.relink(t("articles"), t("toc")).select("id", "linked"))
query("asof_next_version", "SELECT x.id, x.article_id, x.extracted_at, (SELECT min(y.id) FROM {versions} y WHERE y.article_id = x.article_id AND y.extracted_at = m.t) AS next_id FROM {versions} x LEFT JOIN (SELECT a.id, min(b.extracted_at) AS t FROM {versions} a JOIN {versions} b ON a.article_id = b.article_id AND b.extracted_at > a.extracted_at GROUP BY a.id) m ON x.id = m.id")(lambda t: H.next_version(t("versions")))
query("asof_run_backfill", f"SELECT a.id, a.source_id, coalesce(x.run_id, b.run_id) AS run_id FROM {{articles}} a LEFT JOIN (SELECT id, run_id FROM (SELECT a.id, r.id AS run_id, row_number() OVER (PARTITION BY a.id ORDER BY r.started_at DESC, r.id DESC) AS k FROM {{articles}} a JOIN {{runs}} r ON a.source_id = r.source_id AND r.started_at <= a.created_at - INTERVAL 9400 DAY) q WHERE k = 1) x ON a.id = x.id LEFT JOIN ({_BASE}) b ON a.source_id = b.source_id")(lambda t: H.run_as_of(t("articles").withColumn("created_at", F.expr("created_at - INTERVAL 9400 DAY")), t("runs")))
query("toc_article_map", "SELECT t.id, x.article_id FROM {toc} t LEFT JOIN (SELECT toc_entry_id, id AS article_id FROM (SELECT *, row_number() OVER (PARTITION BY toc_entry_id ORDER BY created_at DESC, id DESC) AS k FROM {articles} WHERE toc_entry_id IS NOT NULL) q WHERE k = 1) x ON t.id = x.toc_entry_id")(lambda t: H.toc_article_map(t("toc"), t("articles")).select("id", "article_id"))
query("url_to_entry", "SELECT a.id, t.id AS toc_id FROM {articles} a JOIN {toc} t ON a.source_url = t.url")(lambda t: t("articles").join(t("toc").select(F.col("id").alias("toc_id"), F.col("url").alias("source_url")), "source_url").select("id", "toc_id"))
query("url_to_entry_unmatched", "SELECT id FROM {articles} WHERE source_url NOT IN (SELECT url FROM {toc} WHERE url IS NOT NULL)")(lambda t: t("articles").join(t("toc").select(F.col("url").alias("source_url")), "source_url", "left_anti").select("id"))
query("orphan_media", "SELECT DISTINCT article_id FROM {images} WHERE article_id NOT IN (SELECT id FROM {articles} WHERE removed_at IS NULL)")(lambda t: J.orphans(t("images").select("article_id").distinct(), t("articles").where("removed_at is null").select(F.col("id").alias("article_id")), "article_id"))
query("bulk_assign_check", "SELECT id FROM (VALUES ('s1'), ('s2'), ('nope')) w(id) WHERE id NOT IN (SELECT id FROM {sources})")(lambda t: K.missing_ids(t("sources"), t("sources").sparkSession.createDataFrame([("s1",), ("s2",), ("nope",), ("s1",)], "id string")))
query("cascade_delete", "SELECT id, product_id FROM {sources} WHERE product_id NOT IN (SELECT id FROM {products} WHERE vendor_id = 'v18')")(lambda t: K.cascade(t("products").where("vendor_id = 'v18'"), t("sources"), "product_id").select("id", "product_id"))
query("cascade_set_null", "SELECT id, CASE WHEN job_id = 'j1' THEN NULL ELSE job_id END AS job_id FROM {sources}")(lambda t: K.set_null(t("jobs").where("id = 'j1'"), t("sources"), "job_id").select("id", "job_id"))
query("match_key_join", "SELECT coalesce(a.id, 'none') AS article, coalesce(x.id, 'none') AS entry FROM {articles} a FULL OUTER JOIN {toc} x ON a.source_id = x.source_id AND a.source_url = x.url")(lambda t: t("articles").alias("a").join(t("toc").alias("x"), (F.col("a.source_id") == F.col("x.source_id")) & (F.col("a.source_url") == F.col("x.url")), "full_outer").select(F.coalesce("a.id", F.lit("none")).alias("article"), F.coalesce("x.id", F.lit("none")).alias("entry")))
query("eager_loads", "SELECT a.id, count(i.id) AS images, coalesce(string_agg(i.id, ',' ORDER BY i.sort_order, i.id), '') AS image_ids FROM {articles} a LEFT JOIN {images} i ON i.article_id = a.id GROUP BY a.id")(lambda t: t("articles").select("id").join(t("images").groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("images"), F.array_sort(F.collect_list(F.struct("sort_order", F.col("id").alias("image")))).alias("xs")), "id", "left").select("id", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce(F.array_join("xs.image", ","), F.lit("")).alias("image_ids")))

# Aggregations.
query("active_articles_per_source", "SELECT source_id, count(*) AS n FROM {articles} WHERE removed_at IS NULL GROUP BY source_id")(lambda t: t("articles").where("removed_at is null").groupBy("source_id").agg(F.count(F.lit(1)).alias("n")))
_LATEST = "SELECT source_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN status = 'pending' THEN 1 ELSE 0 END, started_at DESC, id) AS k FROM {runs}) x WHERE k = 1"
query("latest_run_per_source", _LATEST)(lambda t: H.latest_run_per_source(t("runs")).select("source_id", "id", "status"))
query("latest_completed_run", "SELECT source_id, id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS k FROM {runs} WHERE status = 'completed') x WHERE k = 1")(lambda t: H.latest_completed_run(t("runs")).select("source_id", "id", "started_at"))
query("latest_pdf_run", "SELECT source_id, id, pdf_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS k FROM {runs} WHERE status = 'completed' AND pdf_hash IS NOT NULL) x WHERE k = 1")(lambda t: H.latest_completed_run(t("runs"), with_pdf=True).select("source_id", "id", "pdf_hash"))
query("distinct_updated", "SELECT DISTINCT article_id FROM {versions} WHERE extraction_run_id = 'r301'")(lambda t: t("versions").where("extraction_run_id = 'r301'").select("article_id").distinct())
query("job_run_rollup", "SELECT b.id, b.job_id, CASE WHEN c.done + c.failed + c.cancelled < c.n THEN CASE WHEN c.pending < c.n THEN 'running' ELSE b.status END WHEN c.done = c.n THEN 'completed' WHEN c.failed = c.n THEN 'failed' WHEN c.cancelled = c.n THEN 'cancelled' ELSE 'partial' END AS status, CASE WHEN c.done + c.failed + c.cancelled = c.n THEN c.done END AS sources_done, CASE WHEN c.done + c.failed + c.cancelled = c.n THEN c.failed END AS sources_failed FROM {job_runs} b JOIN (SELECT job_run_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled, count(*) FILTER (WHERE status = 'pending') AS pending FROM {runs} WHERE job_run_id IS NOT NULL GROUP BY 1) c ON b.id = c.job_run_id")(lambda t: J.job_run_rollup(t("job_runs"), t("runs")))
query("run_progress", "SELECT id, n_new + n_updated + n_unchanged + n_resumed AS processed, CASE WHEN n_total > 0 THEN least(100, CAST(floor(100.0 * (n_new + n_updated + n_unchanged + n_resumed) / n_total + 0.5) AS BIGINT)) END AS percent FROM {runs}")(lambda t: J.run_progress(t("runs")))
query("run_counters", "SELECT status, sum(n_new) AS n_new, sum(n_updated) AS n_updated, sum(n_unchanged) AS n_unchanged FROM {runs} GROUP BY status")(lambda t: t("runs").groupBy("status").agg(*[F.sum(c).alias(c) for c in ("n_new", "n_updated", "n_unchanged")]))
query("failure_rate_guard", "SELECT source_id, count(*) AS attempted, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) >= 10 AND count(*) FILTER (WHERE status = 'failed') / count(*) > 0.3 AS abort FROM {runs} GROUP BY source_id")(lambda t: t("runs").groupBy("source_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status") == "failed").alias("failed")).withColumn("abort", J.failure_rate_guard(F.col("attempted"), F.col("failed"))))
_DASH = f"SELECT s.id, s.status, s.last_extracted_at, coalesce(a.n, 0) AS article_count, l.status AS last_run_status, coalesce(l.n_new, 0) AS last_run_new, coalesce(s.last_extracted_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY, false) AS is_stale, date_diff('second', s.last_extracted_at, TIMESTAMP '{NOW}') AS age_seconds FROM {{sources}} s JOIN {{products}} p ON s.product_id = p.id JOIN {{vendors}} v ON p.vendor_id = v.id LEFT JOIN (SELECT source_id, count(*) AS n FROM {{articles}} WHERE removed_at IS NULL GROUP BY 1) a ON a.source_id = s.id LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN status = 'pending' THEN 1 ELSE 0 END, started_at DESC, id) AS k FROM {{runs}}) q WHERE k = 1) l ON l.source_id = s.id"
query("dashboard", _DASH)(lambda t: _dash(t).select("id", "status", "last_extracted_at", "article_count", "last_run_status", "last_run_new", "is_stale", "age_seconds"))
query("dashboard_summary", f"WITH d AS ({_DASH}) SELECT count(*) AS total, count(*) FILTER (WHERE last_extracted_at IS NULL) AS never, count(*) FILTER (WHERE is_stale) AS stale, count(*) FILTER (WHERE status = 'failed') AS failing, count(*) FILTER (WHERE status = 'extracting') AS running FROM d")(lambda t: H.dashboard_summary(_dash(t)))
query("health_rank", f"WITH d AS ({_DASH}) SELECT id, CASE WHEN last_extracted_at IS NULL THEN 0 WHEN status = 'failed' THEN 1 WHEN age_seconds > 30 * 86400 THEN 2 ELSE 3 END AS health_rank FROM d")(lambda t: H.health_rank(_dash(t)).select("id", "health_rank"))


def _dash(t):
    return H.dashboard_rows(t("sources"), t("products"), t("vendors"), t("articles"), t("runs"), NOW)


# Windows.
query("claim_oldest", "SELECT id, source_id FROM {runs} WHERE status = 'pending' ORDER BY started_at, id LIMIT 1")(lambda t: J.claim_oldest(t("runs"), "started_at").select("id", "source_id"))
query("retention_evict", "SELECT id FROM (SELECT id, sum(size) OVER (ORDER BY created_at, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {export_jobs}) x WHERE rest > 20000000")(lambda t: J.retention_evict(t("export_jobs"), 20_000_000).select("id"))
query("toc_dedupe", "SELECT id, row_number() OVER (PARTITION BY source_id ORDER BY n) - 1 AS sort_order FROM (SELECT *, row_number() OVER (PARTITION BY source_id, coalesce(url, id) ORDER BY n) AS k FROM {toc}) x WHERE k = 1")(lambda t: TC.dedupe(t("toc").drop("sort_order"), order="n").select("id", "sort_order"))
query("chapter_islands", "SELECT id, sum(CASE WHEN k > 1 AND before IS DISTINCT FROM toc_level THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT id, source_id, n, n % 3 AS toc_level, lag(n % 3) OVER (PARTITION BY source_id ORDER BY n) AS before, row_number() OVER (PARTITION BY source_id ORDER BY n) AS k FROM {articles}) x")(lambda t: TC.islands(t("articles").withColumn("toc_level", F.col("n") % 3), "toc_level", "source_id", ["n"]).select("id", "island"))
query("render_chunks", "SELECT id, CAST(floor((row_number() OVER (PARTITION BY source_id ORDER BY n) - 1) / 7) AS BIGINT) AS chunk FROM {articles}")(lambda t: t("articles").withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("source_id").orderBy("n")) - 1) / 7)).select("id", "chunk"))
query("key_dedupe_suffix", "SELECT id, CASE WHEN k > 1 THEN source_url || '-' || k ELSE source_url END AS source_url FROM (SELECT id, source_url, row_number() OVER (PARTITION BY source_id, source_url ORDER BY id) AS k FROM (SELECT id, source_id, 'https://d/' || (n % 3) AS source_url FROM {articles}) y) x")(lambda t: TC.suffix_duplicates(t("articles").withColumn("source_url", F.concat(F.lit("https://d/"), (F.col("n") % 3).cast("string"))), "source_url", "source_id", "id").select("id", "source_url"))
query("version_boundary", "SELECT id, coalesce(lag(version) OVER (PARTITION BY source_id ORDER BY started_at DESC, id) <> version, false) AS boundary FROM {runs}")(lambda t: TC.version_boundary(t("runs"), "source_id", [F.col("started_at").desc(), "id"]).select("id", "boundary"))
query("changelog_by_day", "SELECT CAST(extracted_at AS DATE) AS day, count(*) AS events, max(extracted_at) AS newest FROM {versions} GROUP BY 1")(lambda t: t("versions").groupBy(F.to_date("extracted_at").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.max("extracted_at").alias("newest")))
query("segment_page_range", "SELECT id, sort_order AS start_page, CASE WHEN nxt IS NULL THEN 99 ELSE greatest(sort_order, nxt - 1) END AS end_page FROM (SELECT id, sort_order, lead(sort_order) OVER (PARTITION BY source_id ORDER BY sort_order, id) AS nxt FROM {toc}) x")(lambda t: t("toc").withColumn("nxt", F.lead("sort_order").over(Window.partitionBy("source_id").orderBy("sort_order", "id"))).select("id", F.col("sort_order").alias("start_page"), F.when(F.col("nxt").isNull(), 99).otherwise(F.greatest("sort_order", F.col("nxt") - 1)).alias("end_page")))
query("page_ownership", "SELECT r.id, max(c) = 1 AS alone FROM (SELECT id, source_id, started_at, n_new FROM {runs}) r JOIN (SELECT source_id, n_new, count(*) AS c FROM {runs} GROUP BY 1, 2) o ON r.source_id = o.source_id AND r.n_new = o.n_new GROUP BY r.id")(lambda t: t("runs").withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("source_id", "n_new"))).select("id", (F.col("c") == 1).alias("alone")))
query("vlm_budget", "WITH RECURSIVE o AS (SELECT source_id, id, n_new AS c, row_number() OVER (PARTITION BY source_id ORDER BY id) AS k FROM {runs}), w AS (SELECT source_id, id, k, c <= 60 AS taken, CASE WHEN c <= 60 THEN 60 - c ELSE 60 END AS rest FROM o WHERE k = 1 UNION ALL SELECT o.source_id, o.id, o.k, o.c <= w.rest, CASE WHEN o.c <= w.rest THEN w.rest - o.c ELSE w.rest END FROM w JOIN o ON o.source_id = w.source_id AND o.k = w.k + 1) SELECT source_id, id, taken FROM w")(lambda t: TC.budget_take(t("runs"), "source_id", "id", "n_new", 60))
query("greedy_split_count", "SELECT id, CAST(floor((row_number() OVER (PARTITION BY source_id ORDER BY n) - 1) / 10) AS INT) AS group_no FROM {articles}")(lambda t: TC.greedy_split(t("articles").select("id", "source_id", "n", "content_size_bytes", "estimated_tokens"), "articles", 10, order="n").select("id", "group_no"))
query("greedy_split_size", "WITH RECURSIVE o AS (SELECT id, source_id, content_size_bytes AS m, row_number() OVER (PARTITION BY source_id ORDER BY n) AS k FROM {articles}), w AS (SELECT id, source_id, k, 0 AS group_no, CAST(m AS DOUBLE) AS filled FROM o WHERE k = 1 UNION ALL SELECT o.id, o.source_id, o.k, CASE WHEN w.filled + o.m > 6000 THEN w.group_no + 1 ELSE w.group_no END, CASE WHEN w.filled + o.m > 6000 THEN o.m ELSE w.filled + o.m END FROM w JOIN o ON o.source_id = w.source_id AND o.k = w.k + 1) SELECT id, group_no FROM w")(lambda t: TC.greedy_split(t("articles").select("id", "source_id", "n", "content_size_bytes", "estimated_tokens"), "size", 6000, order="n").select("id", "group_no"))
# A chapter that fits joins the open file; one that alone exceeds the limit is split by itself and closes its last file; any other starts one.
_FITS = "(NOT w.split AND w.filled + o.t <= 900)"
_CHAPTERS = f"WITH RECURSIVE a AS (SELECT id, source_id, CAST(estimated_tokens AS DOUBLE) AS m, floor(n / 150) % 3 AS c, row_number() OVER (PARTITION BY source_id ORDER BY n) AS k FROM {{articles}}), b AS (SELECT *, CASE WHEN k = 1 OR c <> lag(c) OVER (PARTITION BY source_id ORDER BY k) THEN 1 ELSE 0 END AS f FROM a), r AS (SELECT *, sum(f) OVER (PARTITION BY source_id ORDER BY k) AS run FROM b), o AS (SELECT *, sum(m) OVER (PARTITION BY source_id, run) AS t FROM r), w AS (SELECT source_id, id, k, 0 AS g, t > 900 AS split, CASE WHEN t > 900 THEN m ELSE t END AS filled FROM o WHERE k = 1 UNION ALL SELECT o.source_id, o.id, o.k, w.g + CASE WHEN o.f = 1 THEN CASE WHEN {_FITS} THEN 0 ELSE 1 END WHEN w.split AND w.filled + o.m > 900 THEN 1 ELSE 0 END, CASE WHEN o.f = 1 THEN o.t > 900 AND NOT {_FITS} ELSE w.split END, CASE WHEN o.f = 1 THEN CASE WHEN {_FITS} THEN w.filled + o.t WHEN o.t > 900 THEN o.m ELSE o.t END WHEN w.split THEN CASE WHEN w.filled + o.m > 900 THEN o.m ELSE w.filled + o.m END ELSE w.filled END FROM w JOIN o ON o.source_id = w.source_id AND o.k = w.k + 1) SELECT id, g AS group_no FROM w"
query("greedy_split_chapters", _CHAPTERS)(lambda t: TC.greedy_split(t("articles").select("id", "source_id", "n", "content_size_bytes", "estimated_tokens", (F.floor(F.col("n") / 150) % 3).cast("string").alias("chapter")), "tokens", 900, chapter="chapter", order="n").select("id", "group_no"))
query("toc_resolve_parents", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n) - 1 AS pos, (n * 7) % 4 AS lv FROM (SELECT *, floor(n / 50) AS q FROM {toc}) y), x AS (SELECT a.id, max(b.pos) AS p FROM o a JOIN o b ON a.source_id = b.source_id AND b.pos < a.pos AND b.lv < a.lv GROUP BY a.id) SELECT o.id, CASE WHEN u.lv = o.lv - 1 THEN u.pos END AS parent_pos FROM o LEFT JOIN x ON o.id = x.id LEFT JOIN o u ON u.source_id = o.source_id AND u.pos = x.p".replace("(n * 7) % 4", "(q * 7 + q % 3) % 4"))(lambda t: TC.resolve_parents(t("toc").select("source_id", "id", "n", "url", F.expr("cast((floor(n / 50) * 7 + floor(n / 50) % 3) % 4 as int)").alias("level"), F.lit(None).cast("string").alias("parent_url")), order="n").select("id", "parent_pos"))

# Trees.
_UP = "WITH RECURSIVE up AS (SELECT id, id AS ancestor, parent_id AS nxt, 0 AS distance FROM {toc} UNION ALL SELECT up.id, t.id, t.parent_id, up.distance + 1 FROM up JOIN {toc} t ON up.nxt = t.id)"
query("toc_ancestors", _UP + " SELECT id, ancestor, distance FROM up")(lambda t: TC.ancestors(t("toc")))
query("toc_root", _UP + " SELECT id, ancestor AS root FROM up WHERE nxt IS NULL OR nxt NOT IN (SELECT id FROM {toc})")(lambda t: TC.roots(t("toc")))
query("toc_descendants", _UP + " SELECT DISTINCT id FROM up WHERE ancestor IN ('t1', 't23')")(lambda t: TC.descendants(t("toc"), t("toc").where("id in ('t1', 't23')").select("id")))
query("toc_tree", "SELECT t.id, CASE WHEN p.id IS NULL THEN NULL ELSE t.parent_id END AS parent, t.level FROM {toc} t LEFT JOIN {toc} p ON t.parent_id = p.id")(lambda t: t("toc").join(t("toc").select(F.col("id").alias("parent")), F.col("parent_id") == F.col("parent"), "left").select("id", "parent", "level"))
query("filter_tree", _UP + ", hits AS (SELECT id FROM {toc} WHERE contains(lower(title), 'ing')), kept AS (SELECT DISTINCT ancestor AS id FROM up WHERE id IN (SELECT id FROM hits)) SELECT k.id, EXISTS (SELECT 1 FROM {toc} c WHERE c.parent_id = k.id AND c.id IN (SELECT id FROM kept)) AS expanded FROM kept k")(lambda t: TC.filter_tree(t("toc"), "ING"))
query("flatten_visible", _UP + " SELECT id FROM {toc} WHERE id NOT IN (SELECT id FROM up WHERE distance > 0 AND ancestor IN ('t1', 't12'))")(lambda t: TC.visible(t("toc"), t("toc").where("id in ('t1', 't12')").select("id")).select("id"))
query("article_detail", _UP + " SELECT a.id, s.name AS source, p.name AS product, v.name AS vendor, par.title AS parent_chapter, top.title AS top_level_chapter FROM {articles} a JOIN {sources} s ON a.source_id = s.id JOIN {products} p ON s.product_id = p.id JOIN {vendors} v ON p.vendor_id = v.id LEFT JOIN {toc} e ON a.toc_entry_id = e.id LEFT JOIN {toc} par ON e.parent_id = par.id LEFT JOIN (SELECT id, ancestor FROM up WHERE nxt IS NULL) r ON r.id = e.id LEFT JOIN {toc} top ON top.id = r.ancestor")(lambda t: _detail(t))


def _detail(t):
    toc = t("toc")
    own = toc.select(F.col("id").alias("toc_entry_id"), "parent_id")
    parent = toc.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_chapter"))
    top = TC.roots(toc).select(F.col("id").alias("toc_entry_id"), "root").join(toc.select(F.col("id").alias("root"), F.col("title").alias("top_level_chapter")), "root")
    out = K.runs_enriched(t("articles").select("id", "source_id", "toc_entry_id"), t("sources"), t("products"), t("vendors"))
    return out.join(own, "toc_entry_id", "left").join(parent, "parent_id", "left").join(top, "toc_entry_id", "left").select("id", "source", "product", "vendor", "parent_chapter", "top_level_chapter")


# The domain queries.
_EVENTS = f"base AS ({_BASE}), ev AS (SELECT a.source_id, a.id AS article_id, 'added' AS event, a.created_at AS \"at\", a.created_run_id AS run_id, false AS has_diff FROM {{articles}} a JOIN base b ON a.source_id = b.source_id WHERE a.created_run_id IS NOT NULL AND a.created_run_id <> b.run_id UNION ALL SELECT a.source_id, x.article_id, 'changed', x.extracted_at, x.extraction_run_id, x.diff_text IS NOT NULL FROM {{versions}} x JOIN {{articles}} a ON x.article_id = a.id UNION ALL SELECT source_id, id, 'removed', removed_at, removal_run_id, false FROM {{articles}} WHERE removed_at IS NOT NULL UNION ALL SELECT source_id, NULL, 'initial', base.\"at\", run_id, false FROM base)"
query("changelog", f"WITH {_EVENTS} SELECT ev.*, r.version FROM ev LEFT JOIN {{runs}} r ON ev.run_id = r.id")(lambda t: H.changelog(t("articles"), t("versions"), t("runs")).select("source_id", "article_id", "event", "at", "run_id", "has_diff", "version"))
query("changelog_page", f"WITH {_EVENTS} SELECT event, ev.\"at\", run_id, article_id FROM ev WHERE source_id = 's5' ORDER BY ev.\"at\" DESC, article_id LIMIT 50")(lambda t: H.changelog(t("articles").where("source_id = 's5'"), t("versions"), t("runs")).select("event", "at", "run_id", "article_id").orderBy(F.desc("at"), "article_id").limit(50))
query("events_count", f"WITH {_EVENTS} SELECT source_id, count(*) AS total FROM ev GROUP BY source_id")(lambda t: H.changelog(t("articles"), t("versions"), t("runs")).groupBy("source_id").agg(F.count(F.lit(1)).alias("total")))
query("browse", "SELECT a.id, a.source_id, CASE WHEN a.toc_entry_id IS NULL THEN 'removed' WHEN a.created_at >= l.started_at THEN 'new' WHEN EXISTS (SELECT 1 FROM {versions} x WHERE x.article_id = a.id AND x.extraction_run_id = l.id) THEN 'updated' ELSE 'unchanged' END AS status, (SELECT count(*) FROM {versions} x WHERE x.article_id = a.id) AS version_count FROM {articles} a LEFT JOIN (SELECT source_id, id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS k FROM {runs} WHERE status = 'completed') q WHERE k = 1) l ON a.source_id = l.source_id")(lambda t: H.browse_status(t("articles"), t("versions"), t("runs")).select("id", "source_id", "status", "version_count"))
query("reconcile_removals", f"SELECT a.id, x.linked AS toc_entry_id, CASE WHEN x.linked IS NOT NULL THEN NULL WHEN a.removed_at IS NULL THEN TIMESTAMP '{ASOF}' ELSE a.removed_at END AS removed_at, CASE WHEN x.linked IS NOT NULL THEN NULL WHEN a.removed_at IS NULL THEN 'r1' ELSE a.removal_run_id END AS removal_run_id FROM {{articles}} a LEFT JOIN (SELECT source_id, url, id AS linked FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY sort_order, id) AS k FROM {{toc}} WHERE url IS NOT NULL) q WHERE k = 1) x ON a.source_id = x.source_id AND a.source_url = x.url")(lambda t: H.reconcile_removals(t("articles"), t("toc"), "r1", ASOF).select("id", "toc_entry_id", "removed_at", "removal_run_id"))

# Queues.
query("reap_stale", f"SELECT id, source_id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN attempts >= 3 THEN 'worker lost' END AS error_message FROM {{runs}} WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND)")(lambda t: J.reap_stale(t("runs"), NOW).select("id", "source_id", "status", "error_message"))
query("enqueue_coalesce", "SELECT DISTINCT id AS source_id FROM {sources} WHERE id NOT IN (SELECT source_id FROM {runs} WHERE status IN ('pending', 'running'))")(lambda t: J.enqueue_coalesce(t("sources").select(F.col("id").alias("source_id")), t("runs")))
query("fan_out_job", "SELECT j.id, coalesce(a.assigned, 0) AS assigned, coalesce(a.started, 0) AS started, CASE WHEN a.assigned > 0 THEN CASE WHEN a.started > 0 THEN 'pending' ELSE 'completed' END END AS status FROM {jobs} j LEFT JOIN (SELECT job_id, count(*) AS assigned, count(*) FILTER (WHERE id NOT IN (SELECT source_id FROM {runs} WHERE status IN ('pending', 'running'))) AS started FROM {sources} WHERE job_id IS NOT NULL GROUP BY job_id) a ON a.job_id = j.id")(lambda t: J.fan_out(t("jobs"), t("sources"), t("runs")))
query("active_unique_violations", "SELECT source_id, count(*) AS active FROM {runs} WHERE status IN ('pending', 'running') GROUP BY source_id HAVING count(*) > 1")(lambda t: J.duplicate_active(t("runs")))
query("run_state_machine", "SELECT id, CASE WHEN status = 'running' THEN status WHEN status = 'pending' THEN 'paused' ELSE status END AS next_status, CASE WHEN status = 'running' THEN 'pause' END AS control, CASE WHEN status IN ('running', 'pending') THEN 200 ELSE 409 END AS http FROM {runs}")(lambda t: t("runs").withColumn("c", J.run_control(F.col("status"), "pause")).select("id", F.col("c.status").alias("next_status"), "c.control", "c.http"))
