"""Text, merge, search, export, import and profile queries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vellumark.functions import bodies as B
from vellumark.functions import columns as C
from vellumark.functions import pdf as P
from vellumark.functions.dom import html_to_markdown, scope_content, strip_selectors
from vellumark.functions.sanitize import sanitize
from vellumark.operators import merge as M
from vellumark.operators import profiles as PR
from vellumark.operators import search as S
from vellumark.operators import toc as TC
from vellumark.plans.checkpoints import new_folder
from vellumark.plans.domain import NOW
from vellumark.queries.registry import query
from vellumark.sources import readers as R
from vellumark.sources import sinks as X
from vellumark.sources.commits import Tables, merge_run

V = "'2.' || (doc_id % 3)"
URL = f"'https://docs.example.com/v/' || {V} || '/' || source || '/' || {V} || '-' || doc_id"
TEMPLATE = "'https://docs.example.com/v/{{version}}/'"


def _docs(t, *columns):
    return t("documents").select("doc_id", *columns)


# Scalar functions.
query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM {documents}")(lambda t: _docs(t, C.content_hash("text").alias("hash")))
query("estimated_tokens", "SELECT doc_id, length(text) // 4 AS tokens, strlen(text) AS bytes FROM {documents}")(lambda t: _docs(t, C.estimated_tokens("text").alias("tokens"), C.size_bytes("text").cast("long").alias("bytes")))
query("resolve_template", "SELECT doc_id, 'https://d/2.' || (doc_id % 3) || '/' || source || '/2.' || (doc_id % 3) AS url FROM {documents}")(lambda t: _docs(t, C.resolve_template(F.concat(F.lit("https://d/{version}/"), "source", F.lit("/{version}")), F.concat(F.lit("2."), (F.col("doc_id") % 3).cast("string"))).alias("url")))
query("derive_topic_key", f"SELECT doc_id, 'https://docs.example.com/v/' || chr(123) || 'version' || chr(125) || '/' || source || '/' || {V} || '-' || doc_id AS topic_key FROM {{documents}}")(lambda t: _docs(t, C.derive_topic_key(F.expr(URL), F.lit("https://docs.example.com/v/{version}/"), F.expr(V)).alias("topic_key")))
query("detect_version_token", f"SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'https://docs.example.com/v/' || chr(123) || 'version' || chr(125) || '/' || source || '/' || {V} || '-' || doc_id WHEN contains('/' || source || '-' || doc_id, '2.1') THEN '' END AS template FROM {{documents}}")(lambda t: _docs(t, C.detect_version_token(F.expr(URL), F.lit("2.1")).alias("template")))
query("pdf_topic_key", "SELECT doc_id, trim(regexp_replace(lower(lang || ' ' || source), '[^a-z0-9]+', '-', 'g'), '-') || '/' || 'part-' || doc_id AS topic_key FROM {documents}")(lambda t: _docs(t, C.pdf_topic_key(F.array(F.concat_ws(" ", "lang", "source"), F.lit(" -- "), F.concat(F.lit("Part: "), F.col("doc_id").cast("string")))).alias("topic_key")))
query("anchor_slug", "SELECT doc_id, trim(regexp_replace(replace(regexp_replace(lower(trim(substr(text, 1, 60))), '[^\\p{L}\\p{N} _-]', '', 'g'), ' ', '-'), '-{2,}', '-', 'g'), '-') AS slug FROM {documents}".replace("{L}", "L").replace("\\p{N}", "\\pN").replace("{2,}", "+"))(lambda t: _docs(t, C.anchor_slug(F.substring("text", 1, 60)).alias("slug")))
_PLATFORM = "CASE lang WHEN 'en' THEN 'lazy_tree' WHEN 'de' THEN 'mkdocs' ELSE 'grouped_nav_' || lang END"
query("humanise_label", "SELECT doc_id, CASE lang WHEN 'en' THEN 'Lazy Tree Nav' WHEN 'de' THEN 'MkDocs' ELSE 'Grouped Nav ' || upper(substr(lang, 1, 1)) || substr(lang, 2) END AS label FROM {documents}")(lambda t: _docs(t, C.humanise_label(F.expr(_PLATFORM)).alias("label")))
query("strip_zero_width", "SELECT doc_id, text AS clean FROM {documents}")(lambda t: _docs(t, C.strip_zero_width(F.concat(F.lit("​"), "text", F.lit("﻿"))).alias("clean")))
query("log_append", "SELECT doc_id, right(coalesce(text, '') || 'end', 200000) AS log FROM {documents}")(lambda t: _docs(t, C.log_append(F.col("text"), F.lit("end")).alias("log")))
query("error_truncation", "SELECT doc_id, left(text, 4096) AS error FROM {documents}")(lambda t: _docs(t, F.left("text", F.lit(C.ERROR_CHARS)).alias("error")))
query("highlight", "SELECT doc_id, instr(lower(text), 'the') AS at FROM {documents}")(lambda t: _docs(t, F.locate("the", F.lower("text")).alias("at")))
_BLOCK = "CASE WHEN doc_id % 5 = 0 THEN 'Access Denied. Reference #18.2' WHEN doc_id % 5 = 1 THEN 'Just a moment, enable JavaScript' WHEN doc_id % 5 = 2 THEN text || ' access denied permission' ELSE text END"
query("is_block_page", f"SELECT doc_id, length(trim(body, E' \\t\\n\\r')) <= 800 AND ((contains(lower(body), 'access denied') OR contains(lower(body), 'request unsuccessful')) AND (contains(lower(body), 'denied')) OR (contains(lower(body), 'just a moment') AND contains(lower(body), 'javascript'))) AS blocked FROM (SELECT doc_id, {_BLOCK} AS body FROM {{documents}}) x")(lambda t: _docs(t, C.is_block_page(F.expr(_BLOCK)).alias("blocked")))
query("is_auth_wall", "SELECT doc_id, (doc_id % 4 = 0) OR (doc_id % 4 = 1) AS wall FROM {documents}")(lambda t: _docs(t, C.is_auth_wall(F.col("text"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'https://login.example.com/x' WHEN 1 THEN 'https://id.example.com/saml/x' ELSE 'https://docs.example.com/login' END")).alias("wall")))
query("diff_line_class", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'meta' WHEN 1 THEN 'hunk' WHEN 2 THEN 'add' WHEN 3 THEN 'del' ELSE 'context' END AS class FROM {documents}")(lambda t: _docs(t, C.diff_line_class(F.expr("CASE doc_id % 5 WHEN 0 THEN '+++ b' WHEN 1 THEN '@@ -1 +1 @@' WHEN 2 THEN '+x' WHEN 3 THEN '-y' ELSE ' z' END")).alias("class")))
query("fmt_age", "SELECT doc_id, CASE WHEN n >= 86400 THEN (n // 86400) || 'd ago' WHEN n >= 3600 THEN (n // 3600) || 'h ago' ELSE (n // 60) || 'm ago' END AS age FROM (SELECT doc_id, doc_id * 977 AS n FROM {documents}) x")(lambda t: _docs(t, C.fmt_age(F.col("doc_id") * 977).alias("age")))
query("fmt_duration", "SELECT doc_id, CASE WHEN n >= 3600 THEN (n // 3600) || 'h ' || (n // 60 % 60) || 'm ' || (n % 60) || 's' WHEN n >= 60 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE n || 's' END AS duration FROM (SELECT doc_id, doc_id * 37 AS n FROM {documents}) x")(lambda t: _docs(t, C.fmt_duration(F.col("doc_id") * 37).alias("duration")))
query("build_cron", "SELECT id, CASE frequency WHEN 'hourly' THEN '15 * * * *' WHEN 'daily' THEN '30 2 * * *' WHEN 'weekly' THEN '30 2 * * 4' ELSE '30 2 ' || coalesce(day_of_month, 1) || ' * *' END AS cron FROM {jobs}")(lambda t: t("jobs").select("id", C.build_cron(F.col("frequency"), F.col("time_of_day"), F.col("day_of_week"), F.col("day_of_month")).alias("cron")))
query("compute_next_run", "SELECT id, CASE id WHEN 'j0' THEN '1998-08-02 00:15:00' WHEN 'j1' THEN '1998-08-02 06:30:00' WHEN 'j2' THEN '1998-08-06 02:30:00' WHEN 'j3' THEN '1998-09-01 02:30:00' ELSE '1998-08-15 02:30:00' END AS next_run FROM {jobs}")(lambda t: t("jobs").select("id", C.next_run(F.col("frequency"), F.col("time_of_day"), F.col("day_of_week"), F.col("day_of_month"), F.col("timezone"), F.lit(NOW).cast("timestamp")).cast("string").alias("next_run")))
query("generic_level", "SELECT id, CASE WHEN url IS NULL THEN 0 ELSE 2 END AS level FROM {toc}")(lambda t: t("toc").select("id", C.url_level(F.col("url"), F.lit("https://docs.example.com/index.html")).alias("level")))
_FOLDER = "SELECT source_id, id, CASE WHEN floor(n / 50) % 5 = 0 THEN regexp_replace(url, '/[^/]*$', CASE WHEN floor(n / 250) % 2 = 0 THEN '/' ELSE '' END) ELSE url END AS url FROM {toc} WHERE url IS NOT NULL"
_FOLDERS = f"WITH u AS (SELECT *, regexp_replace(regexp_replace(url, '/$', ''), '[^/]*$', '') AS up FROM ({_FOLDER}) x)"
query("generic_parents", f"{_FOLDERS} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM u v WHERE v.source_id = u.source_id AND v.url = u.up) THEN up WHEN EXISTS (SELECT 1 FROM u v WHERE v.source_id = u.source_id AND v.url = regexp_replace(u.up, '/$', '')) THEN regexp_replace(up, '/$', '') END AS parent_url FROM u")(lambda t: TC.generic_parents(t("toc").where("url is not null").select("source_id", "id", F.expr("CASE WHEN floor(n / 50) % 5 = 0 THEN regexp_replace(url, '/[^/]*$', CASE WHEN floor(n / 250) % 2 = 0 THEN '/' ELSE '' END) ELSE url END").alias("url"))).select("id", "parent_url"))
query("image_ref_rewrite", "SELECT doc_id, 'see ![x](/m/' || doc_id || '.png) and ![y](/m/b.png)' AS md FROM {documents}")(lambda t: _docs(t, C.rewrite_images(F.concat(F.lit("see ![x](https://h/i/"), F.col("doc_id").cast("string"), F.lit(".png) and ![y](../b.png)")), F.array(F.struct(F.concat(F.lit("https://h/i/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("full"), F.lit("i/x.png").alias("raw"), F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("served")), F.struct(F.lit("https://h/b.png").alias("full"), F.lit("../b.png").alias("raw"), F.lit("/m/b.png").alias("served")))).alias("md")))
query("substring_filter", "SELECT doc_id FROM {documents} WHERE contains(lower(text), 'tion')")(lambda t: _docs(t, "text").where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id"))


# Documents and pages.
@F.pandas_udf(StringType())
def _markdown(html: pd.Series) -> pd.Series:
    return html.map(html_to_markdown, na_action="ignore")


@F.pandas_udf(StringType())
def _scoped(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([scope_content(h, u or "", ["article", "main"], [".ad", "nav"]) for h, u in zip(html, url, strict=True)], dtype="object")


@F.pandas_udf(StringType())
def _stripped(html: pd.Series) -> pd.Series:
    return html.map(lambda h: strip_selectors(h, ["nav", ".ad", "footer", "script", "style"]), na_action="ignore")


query("sanitize_markdown")(lambda t: _docs(t, sanitize("text").alias("clean")))
query("html_to_markdown")(lambda t: t("pages").select("page_id", _markdown("html").alias("markdown")))
query("scope_content_html")(lambda t: t("pages").select("page_id", _scoped("html", "url").alias("scoped")))
query("strip_selectors")(lambda t: t("pages").select("page_id", _stripped("html").alias("rest")))
query("profile_detect", "SELECT page_id, CASE WHEN regexp_matches(url, '/hc/[a-zA-Z][a-zA-Z](-[a-zA-Z]+)?(/|$)') THEN 'zendesk' WHEN contains(lower(html), 'zendesk') THEN 'zendesk' ELSE 'generic' END AS profile FROM {pages}")(lambda t: t("pages").select("page_id", PR.detect(F.col("html"), F.col("url")).alias("profile")))
query("profile_toc_build")(lambda t: _toc_build(t))
query("unified_diff")(lambda t: S.version_diffs(t("versions"), t("articles"), "next").select("id", "computed", "diff"))
query("version_diff_current")(lambda t: S.version_diffs(t("versions"), t("articles"), "current").select("id", "computed", F.length("diff").alias("n")))


def _toc_build(t):
    pages = t("pages").where("url is not null").select(F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("source_id"), "url", F.col("html").alias("body"))
    return PR.build_toc(pages.select("source_id", F.lit("bar").alias("profile"), F.col("url").alias("root_url")), pages, {"bar": PR.derived({"strategy": "sidebar", "nav_selector": "nav"})})


_SEGMENT = StructType([StructField("title", StringType()), StructField("level", LongType()), StructField("path", ArrayType(StringType())), StructField("flags", ArrayType(StringType()))])


@F.pandas_udf(ArrayType(_SEGMENT))
def _segments(md: pd.Series) -> pd.Series:
    return md.map(lambda m: [{"title": s.title, "level": s.level, "path": s.path, "flags": P.segment_flags(s.body, False, m)} for s in P.split(m or "")])


query("pdf_split")(lambda t: t("pages").select("page_id", F.inline(_segments(_markdown("html")))))
query("segment_score")(lambda t: t("pages").select("page_id", F.inline(_segments(_markdown("html")))).select("page_id", "title", F.array_join("flags", ",").alias("flags")))

# Search.
def _whole_titles(t):
    """Articles whose titles, the first 24 characters of their texts, don't end inside a word: half a word is a lexeme that the text doesn't hold."""
    cut_up = F.substring("content_markdown", 25, 1).rlike(r"[\p{L}\p{N}]")
    return t("articles").withColumn("title", F.when(cut_up, F.regexp_replace("title", r"[\p{L}\p{N}]+$", "")).otherwise(F.col("title")))


query("topic_search", "SELECT 's' || (doc_id % 50 + 1) AS source_id, 'a' || doc_id AS id FROM {documents} d JOIN {events} e ON d.doc_id = e.event_id WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN])thst($|[^\\pL\\pN])')")(lambda t: S.topic_search(S.index_of(_whole_titles(t), "The thst"), "The thst").select("source_id", "id"))
def _stored_search(t):
    """An index of two thirds of the articles with older texts for some, brought up to all articles; then a search."""
    articles = _whole_titles(t)
    index = S.StoredIndex(articles.sparkSession, new_folder(articles.sparkSession, "index"))
    index.update(articles.where("n % 3 > 0").withColumn("content_markdown", F.when(F.col("n") % 4 == 0, F.concat(F.lit("thst "), "content_markdown")).otherwise(F.col("content_markdown"))))
    index.update(articles)
    return index.search("The thst").select("source_id", "id")


query("topic_search_stored", "SELECT 's' || (doc_id % 50 + 1) AS source_id, 'a' || doc_id AS id FROM {documents} d JOIN {events} e ON d.doc_id = e.event_id WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN])thst($|[^\\pL\\pN])')")(_stored_search)
query("search_index")(lambda t: S.build_index(t("articles")))


# The merge.
# A page has a heading with its number, so it isn't blank where the document is, and a change in it that no cleaning of the text's end takes away.
_PAGE = "concat('# ', doc_id, '\\n\\n', coalesce(text, ''))"


def _scraped(t):
    return t("documents").select(
        F.lit("r1").alias("run_id"), F.expr("'s' || (doc_id % 50 + 1)").alias("source_id"), F.expr("'https://docs.example.com/' || source || '/' || doc_id").alias("url"), F.lit(None).cast("string").alias("topic_key"),
        F.expr("CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Access denied' WHEN 2 THEN concat('# ', doc_id, ' more\\n\\n', coalesce(text, '')) ELSE " + _PAGE + " END").alias("markdown"), F.left("text", F.lit(24)).alias("title"), F.expr("'t' || doc_id").alias("toc_entry_id"),
        F.col("doc_id").cast("int").alias("sort_order"), F.expr("CASE doc_id % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'changed' END").alias("change_status"), "doc_id",
    )


def _store(t):
    """What an earlier run stored: two thirds of the documents."""
    return t("documents").where("doc_id % 3 != 0").select(
        F.expr("'a' || doc_id").alias("id"), F.expr("'s' || (doc_id % 50 + 1)").alias("source_id"), F.lit("r0").alias("created_run_id"), F.expr("'t' || doc_id").alias("toc_entry_id"), F.left("text", F.lit(24)).alias("title"),
        F.expr("'https://docs.example.com/' || source || '/' || doc_id").alias("source_url"), F.expr("'https://docs.example.com/' || source || '/' || doc_id").alias("topic_key"), sanitize(F.expr(_PAGE)).alias("content_markdown"), C.content_hash(sanitize(F.expr(_PAGE))).alias("content_hash"),
        C.estimated_tokens(F.expr(_PAGE)).alias("estimated_tokens"), C.size_bytes(F.expr(_PAGE)).alias("content_size_bytes"), F.col("doc_id").cast("int").alias("sort_order"), F.lit("1998-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("1998-01-01").cast("timestamp_ntz").alias("extracted_at"),
    )


_OUTCOME = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'empty' WHEN doc_id % 7 = 1 THEN 'blocked' WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN 'unchanged' WHEN doc_id % 3 <> 0 AND doc_id % 5 > 1 AND doc_id % 7 <> 2 THEN 'unchanged' WHEN doc_id % 3 <> 0 THEN 'updated' ELSE 'new' END AS outcome FROM {documents}"
query("article_upsert", _OUTCOME)(lambda t: M.decide(_scraped(t), _store(t)).select("doc_id", "outcome"))
query("merge_counters", f"SELECT 'r1' AS run_id, count(*) FILTER (WHERE outcome = 'new') AS n_new, count(*) FILTER (WHERE outcome = 'updated') AS n_updated, count(*) FILTER (WHERE outcome = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE outcome = 'empty') AS n_empty, count(*) FILTER (WHERE outcome = 'blocked') AS n_blocked FROM ({_OUTCOME}) x")(lambda t: M.counters(M.decide(_scraped(t), _store(t))))
query("snapshot_on_change", f"SELECT 'a' || doc_id AS article_id, 'r1' AS extraction_run_id FROM ({_OUTCOME}) x WHERE outcome = 'updated'")(lambda t: M.new_versions(M.decide(_scraped(t), _store(t)), NOW).select("article_id", "extraction_run_id"))
query("merged_articles", f"SELECT 'https://docs.example.com/' || d.source || '/' || d.doc_id AS source_url, CASE WHEN o.outcome = 'new' THEN 'r1' ELSE 'r0' END AS created_run_id, o.outcome IN ('new', 'updated', 'unchanged') AS met FROM {{documents}} d JOIN ({_OUTCOME}) o ON d.doc_id = o.doc_id WHERE d.doc_id % 3 <> 0 OR o.outcome = 'new'")(lambda t: M.merged_articles(_store(t), M.decide(_scraped(t), _store(t)), NOW).select("source_url", "created_run_id", (F.col("extracted_at") == F.lit(NOW).cast("timestamp_ntz")).alias("met")))


def _committed(t):
    """The merge as one commit, of two chunks, the second of which is sent twice; then what its tables say together."""
    scraped, store = _scraped(t), _store(t)
    tables = Tables(store.sparkSession, new_folder(store.sparkSession, "store"))
    tables.commit(lambda at, new: new.replace("articles", store))
    for chunk in (0, 1, 1):
        merge_run(tables, "r1", scraped.where(F.col("doc_id") % 2 == chunk), NOW, f"chunk {chunk}")
    at = tables.snapshot()
    held = [at.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name in ("articles", "versions", "progress")]
    outcomes = ["new", "updated", "unchanged", "empty", "blocked"]
    sums = at.read("counters").agg(*[F.sum(f"n_{o}").alias(o) for o in outcomes]).unpivot([], outcomes, "what", "n")
    return reduce(DataFrame.unionByName, [*held, sums])


query("commit_merge", f"SELECT outcome AS what, count(*) AS n FROM ({_OUTCOME}) x GROUP BY 1 UNION ALL SELECT 'articles', count(*) FILTER (WHERE doc_id % 3 <> 0 OR outcome = 'new') FROM ({_OUTCOME}) y UNION ALL SELECT 'versions', count(*) FILTER (WHERE outcome = 'updated') FROM ({_OUTCOME}) z UNION ALL SELECT 'progress', count(*) FROM ({_OUTCOME}) p")(_committed)
query("resanitize")(lambda t: M.resanitize(t("articles")).select("id", "content_hash", "estimated_tokens"))
query("enable_versioning", "SELECT s.id, p.version FROM {sources} s JOIN {products} p ON s.product_id = p.id WHERE contains(s.base_url, p.version)")(lambda t: M.enable_versioning(t("sources"), t("products")).select("id", "version"))
query("bump_version", "SELECT s.id, p.version AS previous_version, '9.9' AS version, left(s.base_url, instr(s.base_url, p.version) - 1) || '9.9' || substr(s.base_url, instr(s.base_url, p.version) + length(p.version)) AS base_url FROM {sources} s JOIN {products} p ON s.product_id = p.id WHERE contains(s.base_url, p.version)")(lambda t: M.bump_version(M.enable_versioning(t("sources"), t("products")), t("products"), "9.9").select("id", "previous_version", "version", "base_url"))


# Export.
def _planned(t):
    a = t("articles").select("id", "source_id", F.col("n").alias("ord"), "title", "source_url", "content_markdown", "content_size_bytes", "estimated_tokens", "extracted_at", F.lit(None).cast("timestamp_ntz").alias("last_updated_at"))
    return TC.greedy_split(a, "articles", 10).withColumn("source_name", F.concat(F.lit("Source "), "source_id"))


query("export_manifest", "SELECT source_id, group_no, count(*) AS article_count, sum(content_size_bytes) AS size_bytes, min_by(title, n) AS first_article_title, max_by(title, n) AS last_article_title, CASE WHEN max(groups) = 1 THEN 'Source_' || source_id || '.md' ELSE 'Source_' || source_id || '_part' || lpad('' || (group_no + 1), 3, '0') || '.md' END AS filename FROM (SELECT *, max(group_no) OVER (PARTITION BY source_id) + 1 AS groups FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY source_id ORDER BY n) - 1) / 10) AS INT) AS group_no FROM {articles}) y) x GROUP BY source_id, group_no")(lambda t: X.manifest(_planned(t)).select("source_id", "group_no", "article_count", "size_bytes", "first_article_title", "last_article_title", "filename"))
query("export_markdown")(lambda t: X.documents(_planned(t), NOW))
query("group_stats", "SELECT source_id, count(*) AS n, sum(estimated_tokens) AS tokens, sum(content_size_bytes) AS bytes FROM {articles} GROUP BY source_id")(lambda t: t("articles").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("estimated_tokens").alias("tokens"), F.sum("content_size_bytes").alias("bytes")))


# Import.
def _import_rows(t):
    rows = t("sources").join(t("products").select(F.col("id").alias("product_id"), F.upper("name").alias("product"), "vendor_id"), "product_id").join(t("vendors").select(F.col("id").alias("vendor_id"), F.lower("name").alias("vendor")), "vendor_id")
    return rows.select("vendor", "product", F.col("name").alias("source_name"), F.expr("CASE WHEN n % 2 = 0 THEN base_url WHEN n % 5 = 0 THEN '' ELSE base_url || '/new' END").alias("base_url"), (F.col("n") + 2).cast("int").alias("row_no"))


query("csv_import", "SELECT CAST(n + 2 AS INT) AS row_no, CASE WHEN n % 2 = 0 THEN 'skipped' WHEN n % 5 = 0 THEN 'error' ELSE 'created' END AS result FROM {sources} WHERE product_id IN (SELECT id FROM {products})")(lambda t: R.plan_import(_import_rows(t), t("sources"), t("products"), t("vendors")).select("row_no", "result"))
query("import_totals", "SELECT result, count(*) AS n FROM (SELECT CASE WHEN n % 2 = 0 THEN 'skipped' WHEN n % 5 = 0 THEN 'error' ELSE 'created' END AS result FROM {sources} WHERE product_id IN (SELECT id FROM {products})) x GROUP BY result")(lambda t: R.plan_import(_import_rows(t), t("sources"), t("products"), t("vendors")).groupBy("result").agg(F.count(F.lit(1)).alias("n")))
query("dir_size", "SELECT article_id, sum(file_size_bytes) AS bytes FROM {images} GROUP BY article_id")(lambda t: t("images").groupBy("article_id").agg(F.sum("file_size_bytes").alias("bytes")))


# Platform bodies, dates and schedules.

query("sphinx_body")(lambda t: t("pages").select("page_id", B.text_udf(B.sphinx_body, str)(F.replace("html", F.lit("<article>"), F.lit("<article role=main>")), "url").alias("body")))
query("flare_body")(lambda t: t("pages").select("page_id", B.text_udf(B.flare_body, str)(F.replace("html", F.lit("<article>"), F.lit("<article data-mc-content-body>")), "url").alias("body")))
query("normalise_next_steps")(lambda t: t("pages").select("page_id", B.text_udf(B.normalise_next_steps)("html").alias("body")))
query("json_body_unwrap", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' || user_id END AS body FROM {events}")(lambda t: t("events").select("event_id", B.json_body_column(F.expr("CASE WHEN event_id % 2 = 0 THEN to_json(named_struct('article', named_struct('body', event_type))) ELSE to_json(named_struct('topic_html', string(user_id))) END")).alias("body")))
query("last_updated", "SELECT event_id, ts AS last_updated FROM {events}")(lambda t: t("events").select("event_id", B.last_updated_column(F.concat(F.lit("<p><time class=x datetime='"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("'>"))).cast("timestamp_ntz").alias("last_updated")))
query("schedule_validation", "SELECT event_id, CASE WHEN event_id % 30 > 23 THEN 'time_of_day' ELSE '' END || CASE WHEN event_id % 9 > 6 THEN CASE WHEN event_id % 30 > 23 THEN ',' ELSE '' END || 'day_of_week' ELSE '' END AS errors FROM {events}")(lambda t: t("events").select("event_id", F.array_join(B.schedule_errors(F.lit("weekly"), F.format_string("%02d:30", F.col("event_id") % 30), F.col("event_id") % 9, F.lit(1)), ",").alias("errors")))
query("url_map", "SELECT DISTINCT url FROM {pages}")(lambda t: R.sitemap_urls(t("pages").select(F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url></urlset>")).alias("body"))).distinct())
query("json_api_paginate", "SELECT CAST(event_id % 10 AS BIGINT) AS page_no, event_id AS id FROM {events}")(lambda t: R.pages_of_api(t("events").groupBy((F.col("event_id") % 10).alias("page_no")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("event_id").alias("id"))).alias("results"))).alias("body")), "results array<struct<id:bigint>>", "results").select("page_no", "id"))
query("webhook_ingest", "SELECT a.id, CASE WHEN x.id IS NULL THEN NULL ELSE x.id END AS toc_entry_id FROM {articles} a LEFT JOIN (SELECT source_id, url, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY sort_order, id) AS k FROM {toc} WHERE url IS NOT NULL) q WHERE k = 1) x ON a.source_id = x.source_id AND a.source_url = x.url")(lambda t: _webhook(t))
query("data_uri_images")(lambda t: t("pages").select("page_id", B.text_udf(lambda h: P.data_images(h)[0])(F.concat(F.lit("![a](data:image/png;base64,aGk=)"), "html")).alias("markdown")))
query("resume_checkpoint", "SELECT a.id FROM {articles} a WHERE a.n % 4 <> 0")(lambda t: _resume(t))


def _webhook(t):
    from vellumark.streaming.ingest import webhook_pages

    data = F.array(F.struct(F.col("source_url").alias("url"), "title", F.col("content_markdown").alias("markdown"), F.lit(None).cast("string").alias("change_status")))
    events = t("articles").select("id", F.col("created_at").alias("ts"), "source_id", F.lit("r1").alias("run_id"), F.lit("batch_scrape.page").alias("type"), data.alias("data"))
    return webhook_pages(events, t("toc")).select("id", "toc_entry_id")


def _resume(t):
    from vellumark.streaming.ingest import pending

    wanted = t("articles").select("id", "n", F.col("source_url").alias("url"))
    return pending(wanted, wanted.where("n % 4 = 0")).select("id")


# References of pages: those in their HTML, and others of each kind.
_REFS = "list_concat(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1), ['../up.png', './here', '?q=1', '#top', '//cdn.example.com/i/../x.png', 'a/./b/../c', 'https://other.example.com/x'])"
query(
    "resolve_urls",
    f"WITH r AS (SELECT page_id, regexp_extract(url, '^(https?:)//', 1) AS scheme, regexp_extract(url, '^https?://[^/?#]*', 0) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS q, unnest({_REFS}) AS ref FROM {{pages}}), d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM r) "
    "SELECT page_id, ref, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN ref = '//cdn.example.com/i/../x.png' THEN scheme || '//cdn.example.com/x.png' WHEN ref LIKE '/%' THEN host || ref WHEN ref = '../up.png' THEN host || CASE WHEN folder IN ('', '/') THEN '/' ELSE regexp_replace(folder, '[^/]*/$', '') END || 'up.png' "
    "WHEN ref = './here' THEN host || folder || 'here' WHEN ref = 'a/./b/../c' THEN host || folder || 'a/c' WHEN ref LIKE '?%' THEN host || path || ref WHEN ref = '' OR ref LIKE '#%' THEN host || path || q || ref ELSE host || folder || ref END AS resolved FROM d",
)(lambda t: _resolved(t))


def _resolved(t):
    more = F.array(*[F.lit(x) for x in ("../up.png", "./here", "?q=1", "#top", "//cdn.example.com/i/../x.png", "a/./b/../c", "https://other.example.com/x")])
    refs = t("pages").select("page_id", "url", F.explode(F.concat(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), 1), more)).alias("ref"))
    return refs.select("page_id", "ref", C.resolve_url(F.col("url"), F.col("ref")).alias("resolved"))
