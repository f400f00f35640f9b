"""The incremental merge of scraped pages into the article store.

One left join on (source, key) and one window over each key's pages decide every page's outcome, as if pages were merged in turn; new articles,
superseded versions, images and run counters are projections of the decisions. Ids are hashes of what they name, so a batch that
runs again makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.functions import columns as C
from vellumark.functions.sanitize import sanitize
from vellumark.operators.catalog import moment


def _ident(*parts: str) -> Column:
    return F.left(F.sha2(F.concat_ws("\u0001", *parts), 256), F.lit(32))


def decide(scraped: DataFrame, articles: DataFrame) -> DataFrame:
    """``scraped`` (run_id, source_id, url, topic_key?, markdown, title, toc_entry_id, sort_order, change_status?) with ``outcome``.

    Blank and blocked pages are counted and change nothing. The others of a key come in turn (``ts`` if there is one, then sort order and URL): said to be
    the same and stored: unchanged; equal hash (no verdict, or new): unchanged; stored otherwise: updated; else new. What is stored is what the store
    had until a page of the same key writes; ``old_markdown`` and ``old_hash`` are what a page supersedes, ``turn`` its place.
    """
    blank = F.coalesce(F.regexp_replace("markdown", r"(?U)\s", "") == "", F.lit(True))
    new = scraped.withColumns({"key": F.coalesce("topic_key", "url"), "clean": sanitize("markdown")})
    new = new.withColumns({"bad": F.when(blank, "empty").when(C.is_block_page(F.col("markdown")), "blocked"), "hash": C.content_hash("clean"), "said": F.coalesce("change_status", F.lit("new"))})
    old = articles.select("source_id", F.coalesce("topic_key", "source_url").alias("key"), F.col("id").alias("stored_id"), F.col("content_hash").alias("stored_hash"), F.col("content_markdown").alias("stored_markdown"))
    # Bad pages take no turn.
    turns = Window.partitionBy("source_id", "key", F.col("bad").isNull()).orderBy(*[c for c in ("ts", "sort_order", "url", "hash") if c in new.columns])
    out = new.join(old, ["source_id", "key"], "left").withColumn("turn", F.row_number().over(turns))
    exists = F.col("stored_id").isNotNull() | (F.col("turn") > 1)
    out = out.withColumn("writes", ~(exists & (F.col("said") == "same")))
    before = turns.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("writes"), F.struct("clean", "hash")), ignorenulls=True).over(before)
    out = out.withColumn("last", last).withColumns({"old_markdown": F.coalesce("last.clean", "stored_markdown"), "old_hash": F.coalesce("last.hash", "stored_hash")})
    equal = (F.col("said") == "new") & F.coalesce(F.col("old_hash") == F.col("hash"), F.lit(False))
    outcome = F.coalesce("bad", F.when(exists & ((F.col("said") == "same") | equal), "unchanged").when(exists, "updated").otherwise("new"))
    return out.withColumns({"outcome": outcome, "article_id": F.coalesce("stored_id", _ident("source_id", "key"))}).drop("bad", "said", "writes", "last", "stored_id", "stored_hash", "stored_markdown")


def counters(decided: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o).alias(f"n_{o}")
    return decided.groupBy("run_id").agg(*[n(o) for o in ("new", "updated", "unchanged", "empty", "blocked")])


def new_versions(decided: DataFrame, now: str) -> DataFrame:
    """The bodies that updated pages supersede, with the crawler's diff where the pages carry one."""
    d = decided.where("outcome = 'updated'")
    diff = F.col("diff_text") if "diff_text" in decided.columns else F.lit(None).cast("string")
    turn = F.col("turn").cast("string")
    return d.withColumn("t", turn).select(_ident("article_id", "run_id", "old_hash", "t").alias("id"), "article_id", F.col("run_id").alias("extraction_run_id"), F.col("old_markdown").alias("content_markdown"), F.col("old_hash").alias("content_hash"), diff.alias("diff_text"), moment(now).alias("extracted_at"))


def article_images(decided: DataFrame) -> DataFrame:
    """Images of the pages (column ``html``) that wrote an article last: http(s) ones that aren't furniture, each once; they replace the article's rows."""
    from vellumark.operators.jobs import image_filter

    wrote = decided.where("outcome in ('new', 'updated')").groupBy("article_id").agg(F.max_by(F.struct("url", "html"), "turn").alias("p"))
    tags = wrote.select("article_id", "p.url", F.posexplode(F.regexp_extract_all("p.html", F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))).alias("sort_order", "tag"))
    attribute = lambda a: F.regexp_extract("tag", rf"(?is)\s{a}\s*=\s*[\"']?([^\"'\s>]*)", 1)
    alt = F.concat(*[F.regexp_extract("tag", rf"(?is)\salt\s*=\s*{q}([^{q}]*){q}", 1) for q in "\"'"])
    rows = tags.withColumn("src", attribute("src")).where("src != ''").select("article_id", C.resolve_url(F.col("url"), F.col("src")).alias("original_url"), alt.alias("alt_text"), "sort_order")
    return image_filter(rows.withColumn("id", _ident("article_id", "original_url"))).select("id", "article_id", "original_url", "alt_text", "sort_order")


def merged_articles(articles: DataFrame, decided: DataFrame, now: str) -> DataFrame:
    """The store after the run: rows not met stay; met ones get the links of their last page, and the content of the last that wrote."""
    wrote = F.col("outcome").isin("new", "updated")
    per = decided.where("outcome in ('new', 'updated', 'unchanged')").groupBy(F.col("article_id").alias("__id")).agg(
        F.max_by(F.struct("source_id", "url", "key", "title", "toc_entry_id", "sort_order"), "turn").alias("m"),
        F.max_by(F.struct("clean", "hash"), F.when(wrote, F.col("turn"))).alias("w"),
        F.max(F.when(F.col("outcome") == "new", F.col("run_id"))).alias("__created"),
    )
    out = articles.join(per, F.col("id") == F.col("__id"), "full_outer")
    met, content, fresh = F.col("__id").isNotNull(), F.col("w").isNotNull(), F.col("__created").isNotNull()
    take = lambda cond, new, old: F.when(cond, new).otherwise(F.col(old)).alias(old)
    return out.select(
        F.coalesce("id", "__id").alias("id"), F.coalesce("source_id", "m.source_id").alias("source_id"), take(fresh, F.col("__created"), "created_run_id"), take(met, F.col("m.toc_entry_id"), "toc_entry_id"),
        take(met, F.col("m.title"), "title"), take(met, F.col("m.url"), "source_url"), take(met, F.col("m.key"), "topic_key"), take(content, F.col("w.clean"), "content_markdown"), take(content, F.col("w.hash"), "content_hash"),
        take(content, C.estimated_tokens("w.clean"), "estimated_tokens"), take(content, C.size_bytes("w.clean"), "content_size_bytes"), take(met, F.col("m.sort_order"), "sort_order"),
        take(fresh, moment(now), "created_at"), take(met, moment(now), "extracted_at"),
    )


def resanitize(articles: DataFrame) -> DataFrame:
    """Articles whose body cleaning changes, with old and new body and measures; a second time there are none."""
    out = articles.withColumn("clean", sanitize("content_markdown")).where("clean != content_markdown")
    return out.select("id", "source_id", F.col("content_markdown").alias("old_markdown"), F.col("clean").alias("content_markdown"), C.content_hash("clean").alias("content_hash"), C.estimated_tokens("clean").alias("estimated_tokens"), C.size_bytes("clean").alias("content_size_bytes"))


def enable_versioning(sources: DataFrame, products: DataFrame) -> DataFrame:
    """Sources whose URL holds their product's version, with the template."""
    v = products.select(F.col("id").alias("product_id"), F.col("version").alias("__v"))
    return sources.join(v, "product_id").withColumn("url_template", C.detect_version_token(F.col("base_url"), F.col("__v"))).where("url_template is not null").select("id", "product_id", "url_template", F.col("__v").alias("version"))


def bump_version(templated: DataFrame, products: DataFrame, version: str) -> DataFrame:
    """Templated sources of products that have another version, at the new one."""
    if not version.strip():
        raise ValueError("blank version")
    v = products.where(~F.col("version").eqNullSafe(F.lit(version))).select(F.col("id").alias("product_id"), F.col("version").alias("previous_version"))
    return templated.drop("version").join(v, "product_id").select("id", "product_id", "previous_version", F.lit(version).alias("version"), C.resolve_template(F.col("url_template"), F.lit(version)).alias("base_url"))


def rekey(articles: DataFrame, templated: DataFrame) -> DataFrame:
    """Version-free keys of all articles; those of other sources keep their URL."""
    t = templated.select(F.col("id").alias("source_id"), "url_template", "version")
    return articles.join(t, "source_id", "left").withColumn("topic_key", C.derive_topic_key(F.col("source_url"), F.col("url_template"), F.col("version"))).drop("url_template", "version")
