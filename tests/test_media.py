"""Stored images, listings and bundles."""

import zipfile

import pytest
from pyspark.sql import functions as F

from vellumark.operators.jobs import orphan_folders
from vellumark.sources import media, sinks

SCHEMA = "article_id string, original_url string, content_type string, content binary"


def test_images_are_stored_once_under_retries(spark, tmp_path):
    path = str(tmp_path / "media")
    rows = [("a", "u1", "image/jpeg", b"1"), ("a", "u1", "image/jpeg", b"1"), ("a", "u2", "image/svg+xml; charset=utf-8", b"22"), ("b", "u1", None, b"333"), ("b", "u3", "image/webp", None), ("c", "u", "image/gif", b"")]
    images = spark.createDataFrame(rows, SCHEMA)
    first = {(r.article_id, r.original_url): (r.filename, r.file_size_bytes) for r in media.store_images(images, path).collect()}
    assert first == {(r.article_id, r.original_url): (r.filename, r.file_size_bytes) for r in media.store_images(images, path).collect()}
    assert [first[k][0][12:] for k in (("a", "u1"), ("a", "u2"), ("b", "u1"), ("c", "u"))] == [".jpg", ".svg", ".png", ".gif"] and all(len(f.split(".")[0]) == 12 for f, _ in first.values())
    files = {(r.folder, r.name): r.size for r in media.list_files(spark, path).collect()}
    assert files == {(a, f): n for (a, _), (f, n) in first.items() if n}
    assert [n for n, _ in sinks.names(spark, f"{path}/c") if not n.startswith(".")] == [first["c", "u"][0]]
    assert {(r.name, r.files, r["size"]) for r in media.list_folders(spark, path).collect()} == {("a", 2, 3), ("b", 1, 3)}
    plan = media.list_files(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan
    assert media.list_folders(spark, str(tmp_path / "none")).count() == 0


def test_orphan_folders(spark):
    known, other = "0f8fad5b-d9cb-469f-a165-70867728950e", "7c9e6679-7425-40de-944b-e07fc1f90ae7"
    rows = [(known, "2024-01-01"), (other, "2024-01-01"), (other.replace("7c", "8c"), "2024-03-01"), ("tmp", "2024-01-01"), (other.upper().replace("7C", "9C"), "2024-01-01")]
    folders = spark.createDataFrame(rows, "name string, modified string").withColumn("modified", F.col("modified").cast("timestamp_ntz"))
    keep = spark.createDataFrame([(known.upper(),)], "name string")
    assert {r.name for r in orphan_folders(folders, keep, "2024-02-01").collect()} == {other, other.upper().replace("7C", "9C")}
    assert orphan_folders(folders, keep).count() == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_bundles_are_whole(spark, tmp_path, parts):
    path = str(tmp_path / "b.zip")
    want = [(f"ordner/ñ {k}.md", (f"text {k} " * (k % 50)).encode()) for k in range(300)]
    df = spark.createDataFrame([(k, n, c) for k, (n, c) in enumerate(want)], "number int, name string, content binary").repartition(parts)
    assert media.zip_bundle(df, path) == 300
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and [(x, z.read(x)) for x in z.namelist()] == want
    assert sinks.names(spark, str(tmp_path)) == [("b.zip", False)] or [n for n, _ in sinks.names(spark, str(tmp_path)) if not n.startswith(".")] == ["b.zip"]
    assert media.zip_bundle(df.limit(0), str(tmp_path / "e.zip")) == 0 and zipfile.ZipFile(tmp_path / "e.zip").namelist() == []


def test_large_directories(tmp_path, monkeypatch):
    """Offsets and numbers over 32 and 16 bits go into 64-bit records."""
    n = 70_000
    entries = [{"part": "p", "number": k, "name": f"{k}", "crc": 0, "packed": 2, "plain": 0, "at": 0} for k in range(n)]
    data = media._directory(entries, {"p": 5 << 30}, 5 << 30)
    assert data[-22:-18] == b"PK\x05\x06" and data[-12:-10] == b"\xff\xff"
    end64 = data.rindex(b"PK\x06\x06")
    assert int.from_bytes(data[end64 + 24 : end64 + 32], "little") == n and int.from_bytes(data[end64 + 48 : end64 + 56], "little") == 5 << 30


def test_media_files_of_a_bundle(spark, tmp_path):
    path = str(tmp_path / "media")
    media.store_images(spark.createDataFrame([("a", "u", "image/png", b"1"), ("b", "u", "image/png", b"2")], SCHEMA), path).collect()
    rows = media.media_files(spark, path, spark.createDataFrame([("a",)], "id string")).collect()
    assert len(rows) == 1 and rows[0].name.startswith("images/a/") and bytes(rows[0].content) == b"1"
    assert media.media_files(spark, str(tmp_path / "none"), spark.createDataFrame([("a",)], "id string")).count() == 0
