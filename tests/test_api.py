import pytest
from pyspark.sql import functions as F

from vellumark.api import Conflict, Engine
from vellumark.functions import bodies as B
from vellumark.operators.catalog import moment
from vellumark.plans.domain import NOW, TABLES, frame


@pytest.fixture(scope="module")
def engine(spark, sf, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    for t in TABLES:
        rows = frame(spark, sf, t)
        e.store(t).replace(rows.withColumn("next_run_at", F.col("next_run_at").cast("timestamp_ntz")) if t == "jobs" else rows)
    return e


def test_rows(engine):
    ident = engine.create("vendors", unique=("name",), name="Acme", website="w")
    with pytest.raises(Conflict):
        engine.create("vendors", unique=("name",), name="Acme")
    engine.patch("vendors", ident, name=None, website="x")
    assert engine.get("vendors", ident).name == "Acme" and engine.get("vendors", ident).website == "x"
    engine.patch("vendors", ident, clear=("website",))
    assert engine.get("vendors", ident).website is None
    product = engine.create("products", vendor_id=ident, name="P")
    engine.delete("vendors", ident)
    with pytest.raises(LookupError):
        engine.get("products", product)


def test_reads(engine):
    rows, total = engine.articles(0, 10, source_id="s3")
    assert rows.count() <= 10 and total.first().total >= rows.count()
    assert engine.runs(5, status="failed").count() == 5
    events, n = engine.changelog("s3")
    assert n.first().total >= events.count() > 0
    assert {r.status for r in engine.browse("s3").collect()} <= {"new", "updated", "unchanged", "removed"}
    ranked, summary = engine.dashboard(NOW)
    assert ranked.count() == summary.first().total
    assert engine.version_diff("a3").count() > 0


def test_control_and_resanitize(engine):
    run = engine.table("runs").where("status = 'paused'").first()
    with pytest.raises(Conflict):
        engine.resanitize(run.source_id, NOW)
    engine.control(run.id, "resume")
    assert engine.get("runs", run.id).status == "pending"
    with pytest.raises(Conflict):
        engine.control(run.id, "resume")
    free = "s3"
    runs = engine.table("runs")
    engine.store("runs").replace(runs.withColumn("status", F.when(F.col("source_id") == free, "completed").otherwise(F.col("status"))))
    before = engine.table("versions").count()
    n = engine.resanitize(free, NOW)
    assert n > 0 and engine.table("versions").count() == before + n and engine.resanitize(free, NOW) == 0
    assert engine.table("versions").where("diff_text like '--- pre-sanitize%+++ sanitized%'").count() == n


def test_export_plan(engine):
    plan = engine.export_plan("s3", "articles", 2)
    assert plan.groupBy("group_no").count().agg(F.max("count")).first()[0] <= 2
    assert engine.export_plan("s3", "tokens", 500, chapters=True).count() == plan.count()
    assert engine.export_plan("s3", topic="zzzz").count() == 0


def test_runs_and_jobs(engine):
    active = {r.source_id for r in engine.table("runs").where("status in ('pending', 'running')").collect()}
    free = sorted({r.id for r in engine.table("sources").collect()} - active)[:2]
    assert engine.trigger([*free, *sorted(active)[:1]], NOW) == 2 and engine.trigger(free, NOW) == 0
    with pytest.raises(LookupError):
        engine.trigger(["nowhere"], NOW)
    job = engine.create("jobs", name="Nightly", enabled=True, frequency="daily", time_of_day="02:30", timezone="UTC")
    engine.assign(job, free)
    assert {r.job_id for r in engine.table("sources").where(F.col("id").isin(free)).collect()} == {job}
    with pytest.raises(LookupError):
        engine.assign(job, ["nowhere"])
    assert engine.run_job(job, NOW) == 0
    runs = engine.table("runs")
    engine.store("runs").replace(runs.withColumn("status", F.when(F.col("source_id").isin(free), "completed").otherwise(F.col("status"))))
    assert engine.run_job(job, "1998-08-03 00:00:00") == 2 and engine.table("job_runs").where(F.col("job_id") == job).count() == 2
    totals = [(r.status, r.sources_total) for r in engine.table("job_runs").where(F.col("job_id") == job).orderBy("created_at").collect()]
    assert totals == [("completed", 0), ("pending", 2)] and str(engine.get("jobs", job).last_run_at) == "1998-08-03 00:00:00"
    engine.tick("1998-08-03 00:00:00")
    assert engine.table("jobs").where("last_run_at is not null").count() > 1
    assert engine.table("runs").where("status = 'running' and heartbeat_at is null").count() == 0
    assert engine.table("jobs").where("enabled and next_run_at <= timestamp_ntz '1998-08-03 00:00:00'").count() == 0
    assert engine.toc("s3").count() > 0 and ("mkdocs", "MkDocs") in engine.profile_options() and len(engine.profile_options()) == 29


def test_import_and_versions(engine, tmp_path):
    f = tmp_path / "i.csv"
    f.write_text("vendor,product,source_name,base_url\nNewco,Tool,One,https://n/7.7/1\nNEWCO,tool,Two,https://n/7.7/2\nNewco,Tool,Two again,https://n/7.7/2\n,Tool,Bad,https://n/3\n")
    assert [r.result for r in engine.import_csv(str(f)).orderBy("row_no").collect()] == ["created", "created", "skipped", "error"]
    vendor = engine.table("vendors").where("name = 'Newco'").collect()
    product = engine.table("products").where("name = 'Tool'").collect()
    assert len(vendor) == len(product) == 1 and product[0].vendor_id == vendor[0].id
    assert engine.table("sources").where(F.col("product_id") == product[0].id).count() == 2
    assert {r.result for r in engine.import_csv(str(f)).collect()} == {"skipped", "error"} and engine.table("sources").where(F.col("product_id") == product[0].id).count() == 2
    engine.store("products").replace(engine.table("products").withColumn("previous_version", F.lit(None).cast("string")))
    with pytest.raises(Conflict):
        engine.bump_version(product[0].id, "8.0", NOW)
    engine.enable_versioning(product[0].id, "7.7")
    assert {r.url_template for r in engine.table("sources").where(F.col("product_id") == product[0].id).collect()} == {"https://n/{version}/1", "https://n/{version}/2"}
    for version in ("7.7", " "):
        with pytest.raises(Conflict):
            engine.bump_version(product[0].id, version, NOW)
    assert engine.bump_version(product[0].id, "8.0", NOW) == 2
    now = engine.get("products", product[0].id)
    assert (now.version, now.previous_version) == ("8.0", "7.7") and {r.base_url for r in engine.table("sources").where(F.col("product_id") == now.id).collect()} == {"https://n/8.0/1", "https://n/8.0/2"}


def test_exports(engine, tmp_path):
    import zipfile

    ident = engine.export("s4", '{"split_by": "articles", "limit": 2}', "2030-01-01 00:00:00")
    path = engine.run_export(ident, str(tmp_path), NOW)
    row = engine.get("export_jobs", ident)
    assert row.status == "completed" and row.export_id == ident and f'"file_count": {len(zipfile.ZipFile(path).namelist())}' in row.result
    for again in (engine.run_export, lambda i, *_: engine.cancel_export(i)):
        with pytest.raises(Conflict):
            again(ident, str(tmp_path), NOW)
    folder = str(tmp_path)
    assert ident in {r.export_id for r in engine.exports(folder).collect()} and engine.exports(str(tmp_path / "none")).count() == 0
    queue = engine.export_jobs("completed", 500)
    assert {r.format for r in queue.where(F.col("id") == ident).collect()} == {"markdown"} and engine.export_jobs(limit=0).count() == 1
    assert engine.download(folder, ident) == path
    for name in ("../x", "a/../../x", "..", "x\\..\\y", ""):
        with pytest.raises(PermissionError):
            engine.download(folder, ident, name or "..")
    with pytest.raises(LookupError):
        engine.download(folder, ident, "missing.md")
    engine.delete_export(folder, ident)
    assert not (tmp_path / ident).exists() and not (tmp_path / f"{ident}.zip").exists()
    for call in (lambda: engine.get("export_jobs", ident), lambda: engine.delete_export(folder, ident), lambda: engine.download(folder, ident)):
        with pytest.raises(LookupError):
            call()
    running = engine.table("export_jobs").where("status = 'running'").first().id
    with pytest.raises(Conflict):
        engine.cancel_export(running)
    other = engine.export("s4", "{}", NOW)
    engine.cancel_export(other)
    assert engine.get("export_jobs", other).status == "cancelled"
    engine.delete("export_jobs", other)
    with pytest.raises(LookupError):
        engine.get("export_jobs", other)


def test_raw_get_and_batches():
    from vellumark.sources import batch

    answers, waits = iter([(503, ""), OSError("reset"), (200, "body")]), []

    def get(url):
        a = next(answers)
        if isinstance(a, OSError):
            raise a
        return a

    assert batch.raw_get(get, "u", waits.append) == "body" and waits == [4.0, 8.0] and batch.raw_get(lambda u: (404, "x"), "u", waits.append) is None
    with pytest.raises(OSError, match="429"):
        batch.raw_get(lambda u: (429, ""), "u", waits.append)
    assert waits[2:] == [4.0, 8.0, 16.0, 32.0, 64.0]
    pages = {None: ([{"id": 1}], "b"), "b": ([{"id": 2}], "c"), "c": ([{"id": 3}], "b")}
    assert [r["id"] for r in batch.cursor_pages(pages.get)] == [1, 2, 3] and [r["id"] for r in batch.cursor_pages(pages.get, 2)] == [1, 2]


def test_bodies(spark):
    assert B.js_unescape(r"aA\n\'b") == "aA\n'b"
    assert str(B.last_updated("<time datetime='2024-01-02T03:04:05Z'>")) == "2024-01-02 03:04:05" and B.last_updated("<time datetime=''>") is None and B.last_updated("<time datetime='soon'>") is None
    assert B.normalise_next_steps("<div><h2>A</h2><p>x</p><h2>Next steps</h2><ul><li>y</ul></div>") == "<div><h2>A</h2><p>x</p></div>"
    assert B.normalise_next_steps("<h2>Next steps</h2><h2>B</h2>") == "<h2>Next steps</h2><h2>B</h2>"
    assert B.sphinx_body("<div role=main><p>a</p><blockquote> </blockquote><p>Go back to x</p></div>", "http://h/") == '<div role="main"><p>a</p></div>'
    assert B.flare_body("<div data-mc-content-body><p>a</p><a class=GoToTop>t</a><img src=i></div>", "http://h/d/") == '<p>a</p><img src="http://h/d/i">'
    assert B.json_body('{"article": {"body": "x"}}') == "x" and B.json_body('{"topic_html": "y"}') == "y" and B.json_body("[") is None
    bad = spark.range(1).select(B.schedule_errors(F.lit("daily"), F.lit("24:00"), F.lit(7), F.lit(28)).alias("e")).first().e
    assert bad == ["time_of_day", "day_of_week"]
    assert spark.range(1).select((moment("2024-01-01") == F.lit("2024-01-01").cast("timestamp_ntz")).alias("x")).first().x
