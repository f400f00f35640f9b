import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumark.operators import merge, profiles
from vellumark.operators import toc as TC
from vellumark.operators.jobs import run_control
from vellumark.operators.search import StoredIndex, build_index, index_of, topic_search, unified, version_diffs
from vellumark.sources import readers, sinks
from vellumark.sources.media import zip_bundle
from vellumark.streaming import ingest


PAGES = "run_id string, source_id string, url string, topic_key string, markdown string, title string, toc_entry_id string, sort_order int, change_status string"
STORE = "id string, source_id string, created_run_id string, toc_entry_id string, title string, source_url string, topic_key string, content_markdown string, content_hash string, estimated_tokens long, content_size_bytes int, sort_order int, created_at timestamp_ntz, extracted_at timestamp_ntz"
VERSIONS = "id string, article_id string, extraction_run_id string, content_markdown string, content_hash string, diff_text string, extracted_at timestamp_ntz, source_id string"


def page(url, text, status=None, run="r1", order=0):
    return (run, "s", url, None, text, url, "t", order, status)


def test_merge_runs(spark):
    empty = spark.createDataFrame([], STORE)
    first = spark.createDataFrame([page("a", "# A\n"), page("b", "# B\n"), page("c", ""), page("d", "Access denied"), page("e", "# E\n", "same")], PAGES)
    d1 = merge.decide(first, empty)
    assert {r.url: r.outcome for r in d1.collect()} == {"a": "new", "b": "new", "c": "empty", "d": "blocked", "e": "new"}
    store = spark.createDataFrame(merge.merged_articles(empty, d1, "2024-01-01").collect(), STORE)
    second = spark.createDataFrame([page("a", "# A\n", None, "r2"), page("b", "# B2\n", None, "r2"), page("e", "# E\n", "changed", "r2"), page("f", "# F\n", None, "r2"), page("f", "# F again\n", None, "r2", 1)], PAGES)
    d2 = merge.decide(second, store)
    # Two pages of a key are merged in turn: the second supersedes the first.
    assert sorted((r.url, r.turn, r.outcome) for r in d2.collect()) == [("a", 1, "unchanged"), ("b", 1, "updated"), ("e", 1, "updated"), ("f", 1, "new"), ("f", 2, "updated")]
    c = merge.counters(d2).first()
    assert (c.n_new, c.n_updated, c.n_unchanged) == (1, 3, 1)
    assert sorted(r.content_markdown for r in merge.new_versions(d2, "2024-01-02").collect()) == ["# B\n", "# E\n", "# F\n"]
    after = {r.source_url: r for r in merge.merged_articles(store, d2, "2024-01-02").collect()}
    assert after["b"].content_markdown == "# B2\n" and after["b"].created_run_id == "r1" and after["f"].created_run_id == "r2"
    assert after["f"].content_markdown == "# F again\n"
    assert str(after["a"].created_at) == "2024-01-01 00:00:00" and str(after["a"].extracted_at) == "2024-01-02 00:00:00"


def test_pages_of_a_key_in_turn(spark):
    """Blank and blocked pages before and between don't hide good ones; a verdict of no change counts once there is something to be the same as."""
    k = lambda text, order, status=None: page("k", text, status, "r2", order)
    stored = merge.merged_articles(spark.createDataFrame([], STORE), merge.decide(spark.createDataFrame([page("k", "# old\n")], PAGES), spark.createDataFrame([], STORE)), "2024-01-01")
    stored = spark.createDataFrame(stored.collect(), STORE)
    cases = [
        ([k("", 0), k("# new\n", 1)], ["empty", "updated"], "# new\n", ["# old\n"]),
        ([k("Access denied", 0), k("# old\n", 1), k("", 2)], ["blocked", "unchanged", "empty"], "# old\n", []),
        ([k("# b\n", 0), k("# b\n", 1), k("# c\n", 2), k("# x\n", 3, "same")], ["updated", "unchanged", "updated", "unchanged"], "# c\n", ["# b\n", "# old\n"]),
        ([k("# b\n", 0), k("# old\n", 1)], ["updated", "updated"], "# old\n", ["# b\n", "# old\n"]),
    ]
    for pages, outcomes, body, versions in cases:
        d = merge.decide(spark.createDataFrame(pages, PAGES), stored)
        assert [r.outcome for r in d.orderBy("sort_order").collect()] == outcomes
        assert [r.content_markdown for r in merge.merged_articles(stored, d, "2024-01-02").collect()] == [body]
        made = merge.new_versions(d, "2024-01-02").collect()
        assert sorted(r.content_markdown for r in made) == versions and len({r.id for r in made}) == len(made)
    first = merge.decide(spark.createDataFrame([k("# a\n", 0, "same"), k("# b\n", 1, "same")], PAGES), spark.createDataFrame([], STORE))
    assert [r.outcome for r in first.orderBy("turn").collect()] == ["new", "unchanged"]


def test_images_of_merged_pages(spark):
    html = "<p><IMG src='a.png' alt='A b'><img src=a.png><img src='data:x'><img src='/Skins/x.png'><img alt=\"q\" src=\"https://c/d.png\"></p>"
    d = merge.decide(spark.createDataFrame([(*page("http://h/p/", "# x\n"), html, "@@ diff")], PAGES + ", html string, diff_text string"), spark.createDataFrame([], STORE))
    assert [(r.original_url, r.alt_text, r.sort_order) for r in merge.article_images(d).orderBy("sort_order").collect()] == [("http://h/p/a.png", "A b", 0), ("https://c/d.png", "q", 4)]
    assert merge.new_versions(d, "2024-01-01").columns[5] == "diff_text"


def chain(spark, n, more=()):
    return spark.createDataFrame([(f"t{k}", f"t{k - 1}" if k else None, f"title {k}") for k in range(n)] + list(more), "id string, parent_id string, title string")


def test_trees_of_any_depth(spark):
    toc = chain(spark, 40)
    assert {r.root for r in TC.roots(toc).collect()} == {"t0"}
    up = TC.ancestors(toc)
    assert up.count() == 40 * 41 // 2 and up.agg(F.max("distance")).first()[0] == 39
    assert TC.descendants(toc, toc.where("id = 't3'").select("id")).count() == 37
    assert TC.filter_tree(toc, "title 39").where("expanded").count() == 39 and TC.visible(toc, toc.where("id = 't5'").select("id")).count() == 6


def test_trees_with_cycles_and_strays(spark):
    more = [("a", "c", "x"), ("b", "a", "x"), ("c", "b", "x"), ("d", "c", "x"), ("e", "gone", "x"), ("f", "f", "x")]
    toc = chain(spark, 3, more)
    assert {r.id: r.root for r in TC.roots(toc).collect()} == {"t0": "t0", "t1": "t0", "t2": "t0", "a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}
    assert {(r.ancestor, r.distance) for r in TC.ancestors(toc).where("id = 'd'").collect()} == {("d", 0), ("c", 1), ("b", 2), ("a", 3)}
    empty = toc.where("false")
    assert TC.roots(empty).collect() == [] and TC.ancestors(empty).collect() == []


def test_run_control(spark):
    for status, action, want in [("pending", "cancel", ("cancelled", None, 200)), ("running", "cancel", ("running", "cancel", 200)), ("completed", "cancel", ("completed", None, 409)), ("running", "pause", ("running", "pause", 200)), ("paused", "resume", ("pending", None, 200)), ("failed", "resume", ("failed", None, 409))]:
        r = spark.range(1).select(run_control(F.lit(status), action).alias("c")).select("c.*").first()
        assert (r.status, r.control, r.http) == want


def test_search(spark):
    rows = [("s", "1", "Install", "run pip install now"), ("s", "2", "pip", "nothing"), ("s", "3", "Backups", "how to backup a backup"), ("s", "4", "x", "one backup among many other words that go on and on"), ("s", "5", "Guide", "installing with pip")]
    articles = spark.createDataFrame(rows, "source_id string, id string, title string, content_markdown string")
    index = build_index(articles)
    ids = lambda q: [r.id for r in topic_search(index, q).orderBy(F.desc("rank")).collect()]
    for q in ("pip install", "backups", "the", "zzz"):
        assert sorted(topic_search(index_of(articles, q), q).collect()) == sorted(topic_search(index, q).collect())
    assert set(ids("pip install")) == {"1", "5"} and ids("backups") == ["3", "4"] and ids("the") == [] and ids("zzz") == []


def test_version_diffs(spark):
    v = spark.createDataFrame([("v0", "a", "one\n", None, 0), ("v1", "a", "two\n", "stored", 1)], "id string, article_id string, content_markdown string, diff_text string, extracted_at int")
    a = spark.createDataFrame([("a", "three\n")], "id string, content_markdown string")
    nxt = {r.id: r for r in version_diffs(v, a).collect()}
    assert nxt["v1"].diff == "stored" and not nxt["v1"].computed and nxt["v0"].diff == unified("one\n", "two\n", "version:v0", "version:v1")
    now = {r.id: r for r in version_diffs(v, a, "current").collect()}
    assert now["v1"].diff == "--- version:v1\n+++ current\n@@ -1 +1 @@\n-two\n+three\n"
    assert unified("x", "x", "a", "b") == ""


def test_profiles(spark):
    pages = [("theme-doc-sidebar-menu theme-doc-sidebar-item-x", "https://h/"), ("<p>zendesk</p>", "https://h/"), ("", "https://h/hc/en-us/a"), ("nothing", "https://h/"), ("MadCap sidenav", "https://h/"), ('MadCap <iframe id="topic"', "https://h/"), ("", "https://www.ibm.com/docs/en/x"), (None, None), ('x data-bi-name name="ms.t"', "https://h"), ("slds- articleView", "https://h")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "k int, html string, url string")
    got = [r.p for r in df.select("k", profiles.detect(F.col("html"), F.col("url")).alias("p")).orderBy("k").collect()]
    assert got == ["docusaurus", "zendesk", "zendesk", "generic", "flare_html5", "flare_webhelp", "dita_api", "generic", "docfx", "salesforce"]
    assert len(profiles.PROFILES) == 28
    src = spark.createDataFrame([("s1", "docusaurus", "http://h/d/"), ("s2", "json_toc", "http://j/d/"), ("s3", "release_notes", "http://k/")], "source_id string, profile string, root_url string")
    cap = spark.createDataFrame([("s1", "http://h/d/", "<div class=theme-doc-sidebar-menu><ul><li><a href=a>A</a></ul></div>"), ("s2", "http://j/d/toc-contents.json", json.dumps({"contents": [{"title": "T", "href": "t.html"}]})), ("s3", "http://k/", "<div class=releasenotes id=n1><h2>​Note</h2></div>")], "source_id string, url string, body string")
    toc = {r.source_id: r for r in profiles.build_toc(src, cap).collect()}
    assert (toc["s1"].url, toc["s2"].url, toc["s3"].title, toc["s3"].content_selector) == ("http://h/d/a", "http://j/d/t.html", "Note", "#n1")


def test_csv_import(spark, tmp_path):
    f = tmp_path / "i.csv"
    f.write_text(' Vendor ,Product,source_name,BASE_URL\nAcme,"A, B",S1,https://x/1\nacme,"a, b",S2, https://x/1 \nAcme,,S3,https://x/3\nOld,P,S4,https://x/4\n')
    rows = readers.read_import_csv(spark, str(f))
    out = readers.plan_import(rows, spark.createDataFrame([("s", "p", "https://x/4")], "id string, product_id string, base_url string"), spark.createDataFrame([("p", "p", "v")], "id string, name string, vendor_id string"), spark.createDataFrame([("v", "OLD")], "id string, name string"))
    assert {r.row_no: r.result for r in out.collect()} == {2: "created", 3: "skipped", 4: "error", 5: "skipped"}
    assert {r.key: r.vendor for r in readers.first_casing(rows, "vendor").collect()} == {"acme": "Acme", "old": "Old"}
    f.write_text("vendor,product\na,b\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_import_csv(spark, str(f))


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF x")
    (tmp_path / "b.pdf").write_bytes(b"")
    assert readers.load(spark, "pdf", path=str(tmp_path)).count() == 1
    with pytest.raises(LookupError):
        readers.load(spark, "nope")
    bodies = spark.createDataFrame([(1, '{"results": [{"id": 1}, {"id": 2}]}'), (2, '{"results": [{"id": 3}]}')], "page_no int, body string")
    assert [r.id for r in readers.pages_of_api(bodies, "results array<struct<id:int>>", "results").orderBy("page_no", "pos").collect()] == [1, 2, 3]
    assert readers.sitemap_urls(spark.createDataFrame([('<urlset xmlns="x"><url><loc> http://a/ </loc></url></urlset>',)], "body string")).first().url == "http://a/"


def test_export(spark, tmp_path):
    rows = [("s", "Src Name", g, k, f"T {k}", f"http://h/{k}", "body", 4, 1) for k, g in enumerate([0, 0, 1])]
    planned = spark.createDataFrame(rows, "source_id string, source_name string, group_no int, ord int, title string, source_url string, content_markdown string, content_size_bytes int, estimated_tokens int").withColumns({"last_updated_at": F.lit(None).cast("timestamp_ntz"), "extracted_at": F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")})
    man = {r.group_no: r for r in sinks.manifest(planned).collect()}
    assert man[0].filename == "Src_Name_part001.md" and man[0].article_count == 2 and man[1].first_article_title == "T 2"
    docs = sinks.documents(planned, "2024-01-03 00:00:00")
    body = {r.group_no: r.body for r in docs.collect()}[0]
    assert body.startswith("# Src Name\n\n> Extracted: 2024-01-03 00:00 UTC\n> Articles: 2\n\n---\n\n## Table of Contents\n\n1. [T 0](#t-0)\n2. [T 1](#t-1)\n\n---\n\n## T 0\n\n**Source:** [http://h/0](http://h/0)\n**Extracted:** 2024-01-02 03:04 UTC\n\nbody\n\n---\n")
    sinks.write_documents(docs, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() > 5
    named = docs.join(sinks.manifest(planned).select("source_id", "group_no", "filename"), ["source_id", "group_no"])
    zip_bundle(named.select(F.col("group_no").alias("number"), F.col("filename").alias("name"), F.encode("body", "utf-8").alias("content")), str(tmp_path / "x.zip"))
    assert zipfile.ZipFile(tmp_path / "x.zip").namelist() == ["Src_Name_part001.md", "Src_Name_part002.md"]


def test_webhook_stream_merges_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    event = lambda n, url, text, kind="batch_scrape.page": {"type": kind, "id": n, "ts": "2024-01-01T00:00:00Z", "source_id": "s", "run_id": "r", "data": [{"url": url, "title": url, "markdown": text}]}
    (inbox / "1.json").write_text("\n".join(json.dumps(e) for e in [event("1", "u1", "# one\n"), event("1", "u1", "# one\n"), event("2", "u2", "# two\n"), event("3", "u3", "x", "batch_scrape.completed")]))
    store, versions = sinks.Parts(spark, str(tmp_path / "a"), STORE), sinks.Parts(spark, str(tmp_path / "v"), VERSIONS)
    other = spark.createDataFrame([("x", "other", *[None] * 12)], STORE)
    store.replace_parts(other)
    untouched = [(p.name, p.stat().st_mtime_ns) for p in (tmp_path / "a" / "source_id=other").iterdir()]
    toc = spark.createDataFrame([("t1", "s", "u1", "One", 5)], "id string, source_id string, url string, title string, sort_order int")

    def go():
        pages = ingest.webhook_pages(ingest.once(ingest.read_events(spark, str(inbox))), toc).drop("id")
        ingest.merge_stream(pages, store, versions, str(tmp_path / "cp"), lambda: "2024-01-01").awaitTermination()

    mine = lambda: store.read().where("source_id = 's'").collect()
    go()
    assert {(r.source_url, r.title, r.toc_entry_id) for r in mine()} == {("u1", "One", "t1"), ("u2", "u2", None)}
    (inbox / "2.json").write_text("\n".join(json.dumps(e) for e in [event("4", "u1", "# one\n"), event("5", "u2", "# changed\n")]))
    # A crash between the two writes: the versions are there, the store isn't, and the batch runs again.
    replace, store.replace_parts = store.replace_parts, lambda df: 1 / 0
    with pytest.raises(Exception, match="division"):
        go()
    store.replace_parts = replace
    assert [r.content_markdown for r in versions.read().collect()] == ["# two\n"] and "# changed\n" not in {r.content_markdown for r in mine()}
    go()
    assert {r.content_markdown for r in mine()} == {"# one\n", "# changed\n"}
    assert [r.content_markdown for r in versions.read().collect()] == ["# two\n"]
    assert untouched == [(p.name, p.stat().st_mtime_ns) for p in (tmp_path / "a" / "source_id=other").iterdir()]


def test_heartbeats_time_out(spark, tmp_path):
    """Files in any order of reading: beats within the lateness all count."""
    for k, order in enumerate(((1, 2, 3), (2, 1, 3))):
        inbox = tmp_path / f"hb{k}"
        inbox.mkdir()
        rows = {1: [("r1", "00:00:00"), ("r2", "00:00:00")], 2: [("r2", "00:30:00")], 3: [("r2", "02:30:00"), ("r3", "02:30:00")], 4: [("r2", "02:30:01")]}
        for n, f in enumerate((*order, 4)):
            (inbox / f"{f}.json").write_text("\n".join(json.dumps({"run_id": a, "ts": f"2024-01-01T{b}Z"}) for a, b in rows[f]))
            os.utime(inbox / f"{f}.json", (1_700_000_000 + 10 * n,) * 2)
        beats = spark.readStream.schema("run_id string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(inbox))
        q = ingest.heartbeats(beats).writeStream.format("memory").queryName(f"hb{k}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp{k}")).start()
        q.awaitTermination()
        assert [(r.run_id, r.last_ms) for r in spark.sql(f"SELECT * FROM hb{k}").collect()] == [("r1", 1_704_067_200_000)]


def test_stored_index(spark, tmp_path):
    """Kept up by content, read by bucket: the same answers and ranks as an index of all texts, from the terms' folders only."""
    schema = "source_id string, id string, title string, content_markdown string"
    old = [("s", "1", "Pip", "install with pip"), ("s", "2", "Backups", "backup and restore a backup"), ("s", "3", "Old", "install nothing"), ("q", "4", None, None)]
    new = [old[0], ("s", "2", "Backups", "restore"), ("t", "5", "More", "pip install pip installs"), old[3]]
    index = StoredIndex(spark, str(tmp_path / "index"))
    assert index.search("pip").count() == 0
    assert index.update(spark.createDataFrame(old, schema)) == 4 and index.update(spark.createDataFrame(old, schema)) == 0
    assert [r.id for r in index.search("backups").collect()] == ["2"]
    articles = spark.createDataFrame(new, schema)
    assert index.update(articles) == 2
    for q in ("backup", "restore", "pip install", "install", "the", "nothing"):
        for source in (None, "s"):
            got = sorted((r.source_id, r.id, round(r["rank"], 9)) for r in index.search(q, source).collect())
            assert got == sorted((r.source_id, r.id, round(r["rank"], 9)) for r in topic_search(build_index(articles), q, source).collect()), q
    plan = index.hits("pip")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket#") or "PartitionFilters: [isnotnull(bucket" in plan
    read = index.postings().where(F.col("bucket").isin([r.bucket for r in index.hits("pip").select("bucket").distinct().collect()]))
    assert 0 < read.count() < index.postings().count()
    before = index.postings().count()
    index.compact()
    assert index.postings().count() < before and sorted(r.id for r in index.search("pip install").collect()) == ["1", "5"]
    assert index.update(spark.createDataFrame(new[:1], schema)) == 0 and [r.id for r in index.search("install").collect()] == ["1"]
