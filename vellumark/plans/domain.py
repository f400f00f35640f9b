"""The corpus store's tables, derived from the star-schema test tables by SQL that Spark and DuckDB both read.

``{name}`` stands for a table: a Parquet file of the data folder, or another table of ``TABLES``. In production the
same names are the store's own tables; every operator takes DataFrames and doesn't care where they come from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "1998-08-02 00:00:00"

TABLES = {
    "vendors": "SELECT 'v' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'https://' || lower(n_name) || '.example.com' END AS website FROM {nation}",
    "auth_realms": "SELECT 'm' || r_regionkey AS id, r_name AS name, 'https://login.' || lower(replace(r_name, ' ', '-')) || '.example.com' AS login_url FROM {region}",
    "products": "SELECT 'p' || s_suppkey AS id, 'v' || s_nationkey AS vendor_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '' || (s_suppkey % 7 + 1) || '.' || (s_suppkey % 3) END AS version FROM {supplier}",
    "jobs": "SELECT 'j' || r_regionkey AS id, r_name AS name, r_regionkey <> 3 AS enabled, CASE r_regionkey WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE 'monthly' END AS frequency, CASE WHEN r_regionkey = 0 THEN '00:15' ELSE '02:30' END AS time_of_day, CASE WHEN r_regionkey = 2 THEN 4 END AS day_of_week, CASE WHEN r_regionkey = 4 THEN 15 END AS day_of_month, CASE WHEN r_regionkey = 1 THEN 'America/New_York' ELSE 'UTC' END AS timezone, CASE r_regionkey WHEN 4 THEN NULL WHEN 2 THEN TIMESTAMP '1999-01-01 00:00:00' ELSE TIMESTAMP '1998-08-01 12:00:00' END AS next_run_at FROM {region}",
    "job_runs": "SELECT 'b' || s_suppkey AS id, 'j' || (s_suppkey % 5) AS job_id, CASE s_suppkey % 4 WHEN 0 THEN 'pending' ELSE 'running' END AS status, 1 + s_suppkey % 9 AS sources_total, TIMESTAMP '1998-01-01 00:00:00' AS created_at FROM {supplier}",
    "runs": "SELECT 'r' || o_orderkey AS id, 's' || o_custkey AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'b' || (o_orderkey % 100) END AS job_run_id, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'cancelled' ELSE 'completed' END WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END ELSE CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'paused' END END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 'manual' ELSE 'scheduled' END AS triggered_by, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 3 HOUR END AS completed_at, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL 20 MINUTE END AS heartbeat_at, CAST(o_orderkey % 5 AS INT) AS attempts, CAST(o_orderkey % 40 AS INT) AS n_new, CAST(o_orderkey % 17 AS INT) AS n_updated, CAST(o_orderkey % 90 AS INT) AS n_unchanged, CAST(o_orderkey % 4 AS INT) AS n_resumed, CAST(o_orderkey % 120 AS INT) AS n_total, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '' || (o_orderkey % 5 + 1) || '.0' END AS version, CASE WHEN o_orderkey % 8 = 0 THEN 'h' || (o_orderkey % 30) END AS pdf_hash FROM {orders}",
    "sources": "SELECT 's' || c_custkey AS id, c_custkey AS n, 'p' || (c_custkey % 10 + 1) AS product_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'j' || (c_custkey % 5) END AS job_id, c_name AS name, 'https://' || lower(c_mktsegment) || '.example.com/docs/' || (c_custkey % 7 + 1) || '.' || (c_custkey % 3) || '/' || c_custkey AS base_url, CASE WHEN c_custkey % 9 = 0 THEN 'pdf' ELSE 'web' END AS source_type, CASE WHEN c_custkey % 10 = 3 THEN 'failed' WHEN c_custkey % 10 = 5 THEN 'extracting' WHEN c_custkey % 10 = 7 THEN 'pending' ELSE 'completed' END AS status, last_extracted_at FROM {customer} LEFT JOIN (SELECT source_id, max(completed_at) AS last_extracted_at FROM {runs} WHERE status = 'completed' GROUP BY source_id) x ON 's' || c_custkey = x.source_id",
    "export_jobs": "SELECT 'e' || o_orderkey AS id, 's' || o_custkey AS source_id, CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'cancelled' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN '{\"split_by\": \"size\"}' ELSE '{\"format\": \"pdf\"}' END AS request, CASE WHEN o_orderkey % 6 > 3 THEN '{\"file_count\": ' || (o_orderkey % 8) || ', \"total_size_bytes\": ' || o_orderkey || '}' END AS result, CASE WHEN o_orderkey % 6 = 4 THEN 'x' || o_orderkey END AS export_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL 5 MINUTE END AS heartbeat_at, CAST(o_orderkey % 4 AS INT) AS attempts, o_totalprice AS size FROM {orders}",
    "articles": "SELECT 'a' || d.doc_id AS id, d.doc_id AS n, 's' || (d.doc_id % 50 + 1) AS source_id, CASE WHEN d.doc_id % 20 = 0 THEN NULL ELSE 'r' || (d.doc_id % 5 * 100 + 1) END AS created_run_id, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE 't' || d.doc_id END AS toc_entry_id, substr(d.text, 1, 24) AS title, 'https://docs.example.com/' || d.source || '/' || d.doc_id AS source_url, d.text AS content_markdown, e.ts AS created_at, e.ts + INTERVAL 1 DAY AS extracted_at, CASE WHEN d.doc_id % 13 = 0 THEN e.ts + INTERVAL 2 DAY END AS removed_at, CASE WHEN d.doc_id % 13 = 0 THEN 'r' || (d.doc_id % 7 * 100 + 1) END AS removal_run_id, CAST(d.doc_id % 37 AS INT) AS sort_order, CAST(d.n_chars % 900 AS INT) AS estimated_tokens, d.n_chars AS content_size_bytes FROM {documents} d JOIN {events} e ON d.doc_id = e.event_id",
    "versions": "SELECT 'x' || event_id AS id, 'a' || (event_id % 200) AS article_id, 'r' || (event_id % 9 * 100 + 1) AS extraction_run_id, CASE WHEN event_type = 'click' THEN NULL ELSE props END AS diff_text, props AS content_markdown, ts AS extracted_at FROM {events}",
    "toc": "SELECT 't' || doc_id AS id, doc_id AS n, 's' || (doc_id % 50 + 1) AS source_id, CASE WHEN doc_id < 10 THEN NULL ELSE 't' || CAST(floor(doc_id / 10) AS BIGINT) END AS parent_id, substr(text, 1, 24) AS title, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'https://docs.example.com/' || source || '/' || (doc_id % 400) END AS url, CAST(CASE WHEN doc_id < 10 THEN 0 WHEN doc_id < 100 THEN 1 WHEN doc_id < 1000 THEN 2 ELSE 3 END AS INT) AS level, CAST(doc_id % 41 AS INT) AS sort_order FROM {documents}",
    "images": "SELECT 'i' || l_orderkey || '_' || l_linenumber AS id, 'a' || (l_orderkey % 200) AS article_id, CASE l_linenumber % 5 WHEN 0 THEN 'data:x' WHEN 1 THEN 'https://cdn.example.com/_SystemImages/' || l_partkey WHEN 2 THEN 'http://cdn.example.com/transparent.gif' ELSE 'https://cdn.example.com/img/' || (l_partkey % 50) END AS original_url, CAST(l_linenumber AS INT) AS sort_order, CAST(l_quantity AS BIGINT) AS file_size_bytes FROM {lineitem}",
}

_NAME = re.compile(r"\{(\w+)\}")


def names(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def frame(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table of the store, lazily, or a raw one of the folder. ``known`` saves reading a file's schema twice."""
    known = {} if known is None else known
    if name not in known:
        known[name] = _frame(spark, sf_dir, name, known)
    return known[name]


def _frame(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame]) -> DataFrame:
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    # Braces that aren't names are JSON.
    sql = re.sub(r"\{(?!\w+\})", "{{", sql)
    sql = re.sub(r"(?<!\w)\}", "}}", sql) if "{{" in sql else sql
    return spark.sql(sql, **{t: frame(spark, sf_dir, t, known) for t in names(TABLES[name])})


def oracle(sql: str) -> str:
    """SQL over ``{name}`` tables as one statement over the raw tables."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in TABLES and name not in needed:
            for t in names(TABLES[name]):
                add(t)
            needed.append(name)

    for t in names(sql):
        add(t)
    plain = lambda s: _NAME.sub(r"\1", s)
    head = ", ".join(f"{t} AS ({plain(TABLES[t])})" for t in needed)
    body = plain(sql).strip()
    if body.upper().startswith("WITH "):
        recursive = body[5:].upper().startswith("RECURSIVE ")
        rest = body[15:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{head + ', ' if head else ''}{rest}"
    return f"WITH {head} {body}" if head else body
