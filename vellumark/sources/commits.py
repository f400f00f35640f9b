"""Commits over several tables: a numbered log of manifests, each naming the folders that hold every table at that moment.

A writer reads a version, writes new folders beside the old ones, and then claims the next number by renaming its manifest into place, which fails if somebody else has it. So a crash
between any two writes leaves the version before; what was written is garbage that ``vacuum`` removes. A writer that loses the race runs again on the version that won. A table is a list of
folders: ``append`` adds one, ``replace`` starts anew, so adding rows doesn't rewrite a table.

Renaming without overwriting is what HDFS and local disks offer; a store that can't do it needs one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from vellumark.sources import sinks


class Lost(Exception):
    """Another writer has claimed the version."""


class Snapshot:
    """The tables at one version."""

    def __init__(self, tables: Tables, version: int, manifest: dict) -> None:
        self.tables, self.version, self.manifest = tables, version, manifest

    def __contains__(self, name: str) -> bool:
        return name in self.manifest

    def read(self, name: str) -> DataFrame:
        entry = self.manifest[name]
        reader = self.tables.spark.read.schema(entry["schema"])
        return reader.parquet(*[f"{self.tables.path}/{f}" for f in entry["folders"]])


class Change:
    """What a commit writes. Nothing of it is seen before the commit."""

    def __init__(self, base: Snapshot) -> None:
        self.base, self.manifest = base, dict(base.manifest)

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.base.tables.path}/{folder}")
        return folder

    def replace(self, name: str, df: DataFrame) -> None:
        self.manifest[name] = {"schema": df.schema.simpleString()[7:-1] if not df.columns else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "folders": [self._write(name, df)]}

    def append(self, name: str, df: DataFrame) -> None:
        """Rows of the table's own columns; a table that isn't there is made."""
        if name not in self.manifest:
            self.replace(name, df)
            return
        entry = self.manifest[name]
        have = self.base.tables.spark.createDataFrame([], entry["schema"])
        rows = have.unionByName(df, allowMissingColumns=True).select(*have.columns)
        self.manifest[name] = {"schema": entry["schema"], "folders": [*entry["folders"], self._write(name, rows)]}


class Tables:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in sinks.names(self.spark, f"{self.path}/_log") if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self, version: int | None = None) -> Snapshot:
        known = self.versions()
        version = version if version is not None else known[-1] if known else 0
        if not version:
            return Snapshot(self, 0, {})
        fs, at = sinks._at(self.spark, f"{self.path}/_log/{version:012d}.json")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self, version, json.loads(text))

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def _claim(self, version: int, manifest: dict) -> None:
        sc = self.spark.sparkContext
        jvm = sc._jvm
        fs, temporary = sinks._at(self.spark, f"{self.path}/_log/.{version:012d}-{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri() if temporary.toUri().getScheme() else fs.getUri(), sc._jsc.hadoopConfiguration())
        options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temporary, target, options)
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Lost(version) from e
            raise

    def commit(self, change: Callable[[Snapshot, Change], None], retries: int = 10) -> int:
        """``change(snapshot, writer)`` reads the one and writes to the other; the new version's number. It runs again on what won if another writer was faster."""
        for _ in range(retries):
            base = self.snapshot()
            work = Change(base)
            change(base, work)
            if work.manifest == base.manifest:
                return base.version
            try:
                self._claim(base.version + 1, work.manifest)
                return base.version + 1
            except Lost:
                continue
        raise Lost(f"no version could be claimed in {retries} attempts")

    def vacuum(self, keep: int = 10) -> list[str]:
        """Removes folders that none of the last ``keep`` versions names, and older manifests; not beside a writer at work."""
        known = self.versions()
        used = {f for v in known[-keep:] for e in self.snapshot(v).manifest.values() for f in e["folders"]}
        gone = []
        for table, is_folder in sinks.names(self.spark, self.path):
            if is_folder and table != "_log":
                gone += [f for name, _ in sinks.names(self.spark, f"{self.path}/{table}") if (f := f"{table}/{name}") not in used]
        for f in gone:
            sinks.remove(self.spark, f"{self.path}/{f}")
        for v in known[:-keep]:
            sinks.remove(self.spark, f"{self.path}/_log/{v:012d}.json")
        return gone


def merge_run(tables: Tables, run_id: str, pages: DataFrame, now: str, chunk: str | None = None) -> int:
    """Merges pages of a run into ``articles``, with ``versions``, ``counters`` and the run's ``progress`` in the same commit.

    ``chunk`` names what was fetched: one that the progress has already is left out, so a run that is killed and resumed adds nothing twice. The articles of sources that the pages
    don't touch keep their folder's rows; the table is rewritten, versions and progress only grow.
    """
    from pyspark.sql import functions as F

    from vellumark.operators import merge
    from vellumark.plans.checkpoints import cut

    def change(at: Snapshot, new: Change) -> None:
        if chunk is not None and "progress" in at and at.read("progress").where((F.col("run_id") == run_id) & (F.col("chunk") == chunk)).take(1):
            return
        articles = at.read("articles")
        decided = cut(merge.decide(pages, articles))
        new.append("versions", merge.new_versions(decided, now))
        new.append("counters", merge.counters(decided))
        new.replace("articles", merge.merged_articles(articles, decided, now).select(*articles.columns))
        if chunk is not None:
            done = decided.select(F.lit(run_id).alias("run_id"), F.lit(chunk).alias("chunk"), "source_id", "url").distinct()
            new.append("progress", done)

    return tables.commit(change)


def settle_progress(tables: Tables, runs: DataFrame) -> int:
    """Progress of runs (id, status) that completed or were cancelled goes; that of paused and failed ones stays. The table is one folder again."""
    from pyspark.sql import functions as F

    over = runs.where(F.col("status").isin("completed", "cancelled")).select(F.col("id").alias("run_id"))

    def change(at: Snapshot, new: Change) -> None:
        if "progress" in at:
            new.replace("progress", at.read("progress").join(over, "run_id", "left_anti"))

    return tables.commit(change)


def pending(tables: Tables, run_id: str, wanted: DataFrame) -> DataFrame:
    """What a resumed run still has to fetch, of ``wanted`` (source_id, url)."""
    from pyspark.sql import functions as F

    at = tables.snapshot()
    if "progress" not in at:
        return wanted
    done = at.read("progress").where(F.col("run_id") == run_id).select("source_id", "url").distinct()
    return wanted.join(done, ["source_id", "url"], "left_anti")
