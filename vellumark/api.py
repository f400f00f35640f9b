"""The engine's calls, one for each thing a client asks for, over a folder of versioned tables.

Writes give a whole new table (``Store``); reads are lazy DataFrames. ``patch`` leaves out what is None; names in
``clear`` are set to null. Deleting cascades along ``CHILDREN``; links in ``LINKS`` become null.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions import columns
from vellumark.operators import actions, catalog, history, jobs, merge, profiles, search
from vellumark.operators import toc as trees
from vellumark.sources import readers, sinks
from vellumark.sources.media import media_files as images_of
from vellumark.sources.media import zip_bundle

CHILDREN = {"vendors": [("products", "vendor_id")], "products": [("sources", "product_id")], "sources": [("runs", "source_id"), ("toc", "source_id"), ("articles", "source_id"), ("export_jobs", "source_id")], "articles": [("versions", "article_id"), ("images", "article_id")], "jobs": [("job_runs", "job_id")]}
LINKS = {"jobs": [("sources", "job_id")], "runs": [("articles", "created_run_id"), ("versions", "extraction_run_id")], "toc": [("articles", "toc_entry_id")]}


class Conflict(RuntimeError):
    """The state doesn't allow it."""


class Engine:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def store(self, table: str) -> sinks.Store:
        return sinks.Store(self.spark, f"{self.path}/{table}")

    def table(self, name: str) -> DataFrame:
        return self.store(name).read()

    # Rows.
    def create(self, table: str, unique: tuple[str, ...] = (), **values: object) -> str:
        rows = self.table(table)
        for c in unique:
            if rows.where(F.col(c) == F.lit(values[c])).take(1):
                raise Conflict(f"{c} is taken")
        ident = hashlib.sha256("\u0001".join([table, *[f"{k}={v}" for k, v in sorted(values.items())]]).encode()).hexdigest()[:32]
        if rows.where(F.col("id") == ident).take(1):
            raise Conflict("exists")
        new = self.spark.createDataFrame([tuple({"id": ident, **values}.get(c) for c in rows.columns)], rows.schema)
        self.store(table).replace(rows.unionByName(new))
        return ident

    def get(self, table: str, ident: str):
        return catalog.one(catalog.lookup(self.table(table), id=ident))

    def patch(self, table: str, ident: str, clear: tuple[str, ...] = (), **values: object) -> None:
        self.get(table, ident)
        rows = self.table(table)
        new = {k: v for k, v in values.items() if v is not None} | dict.fromkeys(clear)
        hit = F.col("id") == ident
        self.store(table).replace(rows.select(*[F.when(hit, F.lit(new[c]).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns]))

    def delete(self, table: str, ident: str) -> None:
        self.get(table, ident)
        self._delete(table, self.table(table).where(F.col("id") == ident).select("id"))

    def _delete(self, table: str, gone: DataFrame) -> None:
        for child, key in CHILDREN.get(table, []):
            rows = self.table(child)
            if "id" in rows.columns:
                self._delete(child, rows.join(gone.select(F.col("id").alias(key)), key, "left_semi").select("id"))
        for other, key in LINKS.get(table, []):
            self.store(other).replace(catalog.set_null(gone, self.table(other), key))
        rows = self.table(table)
        self.store(table).replace(rows.join(gone, "id", "left_anti").select(*rows.columns))

    # Reads.
    def articles(self, skip: int = 0, limit: int = 50, **filters: object) -> tuple[DataFrame, DataFrame]:
        rows = catalog.list_articles(self.table("articles"), **filters)
        return catalog.page(rows, catalog.up("sort_order", "id"), skip, limit), catalog.total(rows)

    def sources(self, skip: int = 0, limit: int = 50, **filters: object) -> tuple[DataFrame, DataFrame]:
        rows = catalog.list_sources(self.table("sources"), self.table("products"), **filters)
        return catalog.page(rows, catalog.up("name", "id"), skip, limit), catalog.total(rows)

    def runs(self, limit: int = 50, **filters: object) -> DataFrame:
        rows = catalog.runs_enriched(catalog.filtered(self.table("runs"), **filters), self.table("sources"), self.table("products"), self.table("vendors"))
        return catalog.page(rows, catalog.newest("started_at"), 0, limit, 500)

    def changelog(self, source_id: str, skip: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        rows = history.changelog(self.table("articles").where(F.col("source_id") == source_id), self.table("versions"), self.table("runs"))
        return catalog.page(rows, [F.col("at").desc_nulls_first(), F.col("article_id").asc_nulls_last()], skip, limit), catalog.total(rows)

    def browse(self, source_id: str) -> DataFrame:
        return history.browse_status(self.table("articles").where(F.col("source_id") == source_id), self.table("versions"), self.table("runs"))

    def dashboard(self, now: str, stale_days: int = 30) -> tuple[DataFrame, DataFrame]:
        rows = history.dashboard_rows(*[self.table(t) for t in ("sources", "products", "vendors", "articles", "runs")], now, stale_days)
        return history.health_rank(rows), history.dashboard_summary(rows)

    def version_diff(self, article_id: str, against: str = "next") -> DataFrame:
        return search.version_diffs(self.table("versions").where(F.col("article_id") == article_id), self.table("articles"), against)

    def topic(self, source_id: str, q: str) -> DataFrame:
        return search.topic_search(search.index_of(self.table("articles").where(F.col("source_id") == source_id), q), q)

    def toc(self, source_id: str) -> DataFrame:
        return self.table("toc").where(F.col("source_id") == source_id).orderBy(*catalog.up("sort_order", "id"))

    def profile_options(self) -> list[tuple[str, str]]:
        """(name, label) of the platforms that can be chosen, after ``auto``."""
        names = [p.name for p in profiles.PROFILES]
        labels = self.spark.createDataFrame([(n,) for n in names], "name string").select("name", columns.humanise_label(F.col("name")).alias("label")).collect()
        return [("auto", "Auto-detect"), *((r["name"], r["label"]) for r in labels)]

    def _add(self, table: str, rows: DataFrame) -> int:
        """Append rows, whatever columns of the table they lack; how many."""
        have = self.table(table)
        kept = [c for c in rows.columns if c in have.columns]
        new = rows.select(*[F.col(c).cast(have.schema[c].dataType).alias(c) for c in kept]).join(have.select("id"), "id", "left_anti").persist()
        n = new.count()
        if n:
            self.store(table).replace(have.unionByName(new, allowMissingColumns=True))
        new.unpersist()
        return n

    def _put(self, table: str, rows: DataFrame, new: tuple[str, ...] = ()) -> None:
        """Replace the columns of ``rows`` in the rows of its ids; columns that the table lacks are left out, but for ``new`` ones."""
        have = self.table(table)
        for c in new:
            if c not in have.columns:
                have = have.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
        names = [c for c in rows.columns if c in have.columns and c != "id"]
        fresh = rows.select("id", F.lit(True).alias("__hit"), *[F.col(c).cast(have.schema[c].dataType).alias(f"__{c}") for c in names])
        out = have.join(fresh, "id", "left")
        self.store(table).replace(out.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in have.columns]))

    # Runs and jobs.
    def trigger(self, source_ids: list[str], now: str, trigger: str = "manual") -> int:
        """Start runs of the sources that have none; how many."""
        wanted = self.spark.createDataFrame([(s,) for s in source_ids], "source_id string")
        if missing := catalog.missing_ids(self.table("sources"), wanted.withColumnRenamed("source_id", "id")).take(1):
            raise LookupError(missing[0]["id"])
        return self._add("runs", actions.new_runs(wanted, self.table("runs"), now, trigger))

    def assign(self, job_id: str | None, source_ids: list[str]) -> None:
        ids = self.spark.createDataFrame([(s,) for s in source_ids], "id string")
        if job_id is not None:
            self.get("jobs", job_id)
        if missing := catalog.missing_ids(self.table("sources"), ids).take(1):
            raise LookupError(missing[0]["id"])
        self.store("sources").replace(actions.assign(self.table("sources"), job_id, ids))

    def run_job(self, job_id: str, now: str) -> int:
        """Start the runs of a job's free sources under a new job run; how many. A job without sources gets none."""
        self.get("jobs", job_id)
        own = self.table("sources").where(F.col("job_id") == job_id).select("job_id", F.col("id").alias("source_id")).withColumn("job_run_id", F.left(F.sha2(F.lit(f"{job_id} {now}"), 256), F.lit(32)))
        runs = actions.new_runs(own, self.table("runs"), now, "manual").persist()
        made = actions.started_job_runs(own, runs, now, "manual").persist()
        made.count()
        n = self._add("runs", runs)
        if self._add("job_runs", made):
            self._put("jobs", self.spark.createDataFrame([(job_id,)], "id string").withColumn("last_run_at", catalog.moment(now)), ("last_run_at",))
        made.unpersist()
        runs.unpersist()
        return n

    def tick(self, now: str) -> None:
        """One turn of the scheduler over the stored tables."""
        out = actions.tick(*[self.table(t) for t in ("jobs", "job_runs", "runs", "sources")], now)
        held = {k: df.persist() for k, df in out.items()}
        for df in held.values():
            df.count()  # all are of one state
        self._put("runs", held["runs"].select("id", "status"))
        self._put("job_runs", held["job_runs"].select("id", "status"))
        self._add("runs", held["starts"].withColumn("started_at", catalog.moment(now)).withColumn("attempts", F.lit(0)))
        self._add("job_runs", held["new_job_runs"])
        self._put("jobs", held["jobs"].select("id", "next_run_at", "last_run_at"), ("last_run_at",))
        for df in held.values():
            df.unpersist()

    # Versions of products.
    def enable_versioning(self, product_id: str, version: str) -> None:
        self.get("products", product_id)
        if not version.strip():
            raise Conflict("blank version")
        out = actions.versioned(self.table("sources"), self.table("products"), self.table("articles"), product_id, version)
        for t in ("articles", "sources", "products"):
            self._whole(t, out[t])

    def bump_version(self, product_id: str, version: str, now: str) -> int:
        """The product's templated sources at another version, and runs of those that are free; how many."""
        try:
            out = actions.bumped(self.table("sources"), self.table("products"), self.table("runs"), product_id, version, now)
        except ValueError as e:
            raise Conflict(str(e)) from e
        n = self._add("runs", out["runs"])
        self._put("sources", out["sources"])
        self._whole("products", out["products"])
        return n

    def _whole(self, table: str, rows: DataFrame) -> None:
        """A whole table with new columns, or a few columns of some rows."""
        if set(self.table(table).columns) <= set(rows.columns):
            self.store(table).replace(rows)
        else:
            self._put(table, rows)

    def control(self, run_id: str, action: str) -> None:
        run = self.table("runs").where(F.col("id") == run_id).select("*", jobs.run_control(F.col("status"), action).alias("__c"))
        row = catalog.one(run)
        if row["__c"]["http"] != 200:
            raise Conflict(f"{action} of a {row['status']} run")
        self.patch("runs", run_id, status=row["__c"]["status"])

    def resanitize(self, source_id: str, now: str) -> int:
        """Clean the stored articles of a source; the bodies they had become versions, with what the cleaning changed."""
        if self.table("runs").where((F.col("source_id") == source_id) & F.col("status").isin(*catalog.ACTIVE)).take(1):
            raise Conflict("a run is active")
        articles, versions = self.table("articles"), self.table("versions")
        new = merge.resanitize(articles.where(F.col("source_id") == source_id)).persist()
        old = new.select(F.left(F.sha2(F.concat_ws("\u0001", "id", F.lit(now)), 256), F.lit(32)).alias("id"), F.col("id").alias("article_id"), F.col("old_markdown").alias("content_markdown"), columns.content_hash("old_markdown").alias("content_hash"), search.unified_diff("old_markdown", "content_markdown", F.lit("pre-sanitize"), F.lit("sanitized")).alias("diff_text"), catalog.moment(now).alias("extracted_at"))
        self.store("versions").replace(versions.unionByName(old, allowMissingColumns=True).select(*versions.columns))
        fresh = new.select("id", *[F.col(c).alias(f"__{c}") for c in ("content_markdown", "content_hash", "estimated_tokens", "content_size_bytes") if c in articles.columns])
        out = articles.join(fresh, "id", "left")
        self.store("articles").replace(out.select(*[F.coalesce(F.col(f"__{c}").cast(articles.schema[c].dataType), F.col(c)).alias(c) if f"__{c}" in fresh.columns else F.col(c) for c in articles.columns]))
        n = new.count()
        new.unpersist()
        return n

    # Import and export.
    def import_csv(self, path: str, only_plan: bool = False) -> DataFrame:
        """The outcome of each row; what is created is stored unless only the plan is asked for."""
        plan = readers.plan_import(readers.read_import_csv(self.spark, path), self.table("sources"), self.table("products"), self.table("vendors")).persist()
        if not only_plan:
            new = {k: df.persist() for k, df in actions.imported_rows(plan, self.table("vendors"), self.table("products")).items()}
            for t in ("vendors", "products", "sources"):
                new[t].count()
            for t in ("vendors", "products", "sources"):
                self._add(t, new[t])
                new[t].unpersist()
        return plan

    def export(self, source_id: str, request: str, now: str) -> str:
        """Queue an export; its id."""
        self.get("sources", source_id)
        before = self.table("export_jobs")
        after = actions.new_export(before, source_id, request, now)
        ident = after.join(before.select("id"), "id", "left_anti").first()["id"]
        self._add("export_jobs", after.where(F.col("id") == ident))
        return ident

    def run_export(self, ident: str, folder: str, now: str, media: str | None = None) -> str:
        """Write a queued export's files and zip into ``folder`` by its request's split, with the articles' images from ``media``; the zip's path."""
        job = self.get("export_jobs", ident)
        if job["status"] != "pending":
            raise Conflict(f"the export is {job['status']}")
        request = json.loads(job["request"] or "{}")
        plan = self.export_plan(job["source_id"], request.get("split_by"), request.get("limit"), request.get("topic"), chapters=bool(request.get("chapters")))
        names = self.table("sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
        plan = plan.join(names, "source_id")
        plan = plan.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("last_updated_at",) if c not in plan.columns})
        files = sinks.manifest(plan)
        docs = sinks.documents(plan, now)
        sinks.write_documents(docs, f"{folder}/{ident}")
        path = f"{folder}/{ident}.zip"
        entries = docs.join(files.select("source_id", "group_no", "filename"), ["source_id", "group_no"]).select(F.col("group_no").alias("number"), F.col("filename").alias("name"), F.encode("body", "utf-8").alias("content"))
        if media:
            # Behind the texts, in any order.
            images = images_of(self.spark, media, plan).withColumn("number", F.lit((1 << 31) - 1))
            entries = entries.unionByName(images)
        zip_bundle(entries, path)
        total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b")).first()
        self.patch("export_jobs", ident, status="completed", export_id=ident, result=json.dumps({"file_count": total["n"], "total_size_bytes": total["b"]}))
        return path

    def cancel_export(self, ident: str) -> None:
        """Only a queued export can be cancelled; one that runs ends on its own."""
        if (status := self.get("export_jobs", ident)["status"]) != "pending":
            raise Conflict(f"the export is {status}")
        self.patch("export_jobs", ident, status="cancelled")

    def export_jobs(self, status: str | None = None, limit: int = 100) -> DataFrame:
        return actions.export_queue(*[self.table(t) for t in ("export_jobs", "sources", "products", "vendors")], status, limit)

    def exports(self, folder: str, days: int = 7) -> DataFrame:
        """Finished exports whose files are in ``folder``."""
        names = [(n,) for n, is_folder in sinks.names(self.spark, folder) if is_folder]
        return actions.listed_exports(self.table("export_jobs"), self.table("sources"), self.spark.createDataFrame(names, "export_id string"), days)

    def realms(self) -> DataFrame:
        return catalog.list_realms(self.table("auth_realms"))

    def download(self, folder: str, export_id: str, file: str | None = None) -> str:
        """The path of an export's zip, or of one of its files; ``LookupError`` where there is none, ``PermissionError`` for a name that leads out of the export."""
        if any(part in ("", ".", "..") for name in (export_id, file or "x") for part in name.replace("\\", "/").split("/")):
            raise PermissionError(file or export_id)
        path = f"{folder}/{export_id}/{file}" if file else f"{folder}/{export_id}.zip"
        if not sinks.exists(self.spark, path):
            raise LookupError(path)
        return path

    def delete_export(self, folder: str, export_id: str) -> None:
        """The export's files and row go; ``LookupError`` if there is neither."""
        if "/" in export_id or export_id in ("", ".", ".."):
            raise PermissionError(export_id)
        paths = [p for p in (f"{folder}/{export_id}", f"{folder}/{export_id}.zip") if sinks.exists(self.spark, p)]
        jobs = self.table("export_jobs")
        if not paths and not jobs.where(F.col("export_id") == export_id).take(1):
            raise LookupError(export_id)
        for p in paths:
            sinks.remove(self.spark, p)
        self.store("export_jobs").replace(actions.delete_export(jobs, export_id))

    def export_plan(self, source_id: str, split_by: str | None = None, limit: float | None = None, topic: str | None = None, toc_ids: list[str] | None = None, chapters: bool = False) -> DataFrame:
        """Articles with their order and file; by topic, by chapters, or all."""
        rows = self.table("articles").where(F.col("source_id") == source_id)
        if topic:
            rows = rows.join(self.topic(source_id, topic).select("id", "rank"), "id").withColumn("__k", F.struct(-F.col("rank"), "sort_order", "id"))
        else:
            rows = rows.withColumn("__k", F.struct("sort_order", "id"))
        if toc_ids:
            wanted = trees.descendants(self.table("toc"), self.spark.createDataFrame([(t,) for t in toc_ids], "id string")).select(F.col("id").alias("toc_entry_id"))
            rows = rows.join(wanted, "toc_entry_id", "left_semi")
        # One source's articles, numbered in their order.
        ordered = rows.withColumn("ord", F.row_number().over(_by("source_id", "__k"))).drop("__k")
        if chapters and split_by:
            ordered = ordered.join(trees.roots(self.table("toc")).select(F.col("id").alias("toc_entry_id"), F.col("root").alias("chapter")), "toc_entry_id", "left")
        return trees.greedy_split(ordered, split_by, limit, "chapter" if chapters and split_by else None)


def _by(partition: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(order)
