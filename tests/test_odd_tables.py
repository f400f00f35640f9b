"""Queries on tables that the given small ones don't hold: shared URLs, cut words, empty texts, many files."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import plain
from vellumark.functions.stem import counts, counts_of
from vellumark.queries import ORACLE, QUERIES
from vellumark.sources import fetch, media, sinks

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def held(spark, tmp_path, name, **tables):
    """The query's rows, which are its SQL's."""
    con = duckdb.connect()
    for table, df in tables.items():
        path = f"{tmp_path}/{table}.parquet"
        if not (tmp_path / f"{table}.parquet").exists():
            df.write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    out = con.execute(ORACLE[name])
    names = [d[0] for d in out.description]
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in out.fetchall()), key=str), name
    return got


def documents(spark, texts):
    return spark.createDataFrame([(k, x, "en", f"src{k % 3}", len(x)) for k, x in enumerate(texts)], DOCUMENT)


def events(spark, n):
    return spark.sql(f"select id as event_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts, id % 7 as user_id, 'click' as event_type, id / 2 as value, '{{}}' as props from range({n})")


def test_pages_that_share_a_url_have_their_own_bodies(spark, tmp_path):
    rows = [(k, f"https://x/{k // 2}", f"<p>{k}</p>") for k in range(24)]
    assert len(held(spark, tmp_path, "raw_pages", pages=spark.createDataFrame(rows, "page_id long, url string, html string"))) == 24


@pytest.mark.parametrize("name", ["topic_search", "topic_search_stored"])
def test_titles_cut_inside_a_word_are_not_found_by_its_half(spark, tmp_path, name):
    """The title is the first 24 characters; a word that ends there counts, half a word doesn't, and neither does half a word with an ending that stems to it."""
    texts = ["Ndesen is ersttiou, thstering", "Ndesen is ersttiou, thst", "Ndesen is ersttiou, thst.", "Ndesen is erstiou, thstshat", "Thst ndesen is ersttiou, thstering", "Ndesen is ersttiou, Thst9", "Ndesen is ersttiou, ünd. Und thst."]
    assert [x for _, x in held(spark, tmp_path, name, documents=documents(spark, texts), events=events(spark, 9))] == ["a1", "a2", "a4", "a6"]


@pytest.mark.parametrize("name", ["article_upsert", "merge_counters", "snapshot_on_change", "merged_articles", "commit_merge"])
def test_documents_without_text_are_pages_of_their_own(spark, tmp_path, name):
    """Empty and blank documents, missing texts, and texts whose end is page furniture meet each outcome."""
    df = documents(spark, ["", " \n\t", "Text.", "Text.\n\nCopyright (c) 2019 Example", "# Title\n\nText."] * 43)
    held(spark, tmp_path, name, documents=df.selectExpr("doc_id", "if(doc_id % 13 = 4, null, text) as text", "lang", "source", "n_chars"))


def test_a_thousand_files_of_a_source_have_names_of_their_own(spark):
    names = [r.f for r in spark.range(1100).select(sinks.file_name(F.lit("Source s1"), F.col("id").cast("int"), F.lit(1100)).alias("f")).collect()]
    assert len(set(names)) == 1100 and {"Source_s1_part100.md", "Source_s1_part1000.md"} <= set(names)


def test_folders_with_empty_files(spark, tmp_path):
    got = held(spark, tmp_path, "media_dir_scan", documents=documents(spark, ["", "a", "ñ"] + [""] * 38 + ["bc"]))
    assert ("a1", 2, 3) in got and ("a7", 1, 0) in got and len(got) == 40


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """The driver keeps no list of files: none of Spark's file sources, which do, is in the plan."""
    for name, n in (("a/1.png", 1), ("a/b/c/2.png", 2), ("a/.part", 4), ("a/_x/3.png", 8), ("d/0.png", 0), ("e/f/0.png", 0), ("here.png", 16), (".g/4.png", 32)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * n)
    rows = lambda df: sorted((r.name, r.files, r["size"]) for r in df.collect())
    assert rows(media.list_folders(spark, str(tmp_path))) == [("a", 2, 3)]
    every = media.list_folders(spark, f"file:{tmp_path}", empty=True)
    assert rows(every) == [("a", 2, 3), ("d", 1, 0), ("e", 1, 0)]
    assert "binaryFile" not in every._jdf.queryExecution().executedPlan().toString()


def test_large_recordings_are_read_in_small_parts(spark, tmp_path, monkeypatch):
    """More exchanges, more buckets; pages in turn share few of them, whatever their number."""
    monkeypatch.setattr(fetch, "FULL", 1)
    url = "https://x/items?page={}"
    rows = spark.range(1, 1001).select(F.concat(F.lit(url.format("")), "id").alias("url"), F.lit(0).alias("attempt"), F.lit(200).alias("status"), F.col("id").cast("string").alias("body"))
    fetch.record(rows, str(tmp_path / "rec"))
    transport = fetch.RecordedTransport({"recorded": str(tmp_path / "rec")})
    assert [transport.get(url.format(k)) for k in range(500, 600)] == [(200, str(k)) for k in range(500, 600)]
    assert transport.digits == 3 and len(transport.buckets) == 1
    assert all(transport.get(url.format(k)) == (200, str(k)) for k in range(1, 1001)) and transport.get(url.format(1001)) == (404, "") and transport.get("x")[0] == 404


@pytest.mark.parametrize("a, b", [(0, 36_000_000), (1_234_567, 36_000_001), (5, 123), (0, 512_101)])
def test_ranges_of_pages_stay_few(a, b):
    ranges = fetch._Pages({"url": "https://x/{page}", "size": "100", "chunk": "5"}).ranges(a, b)
    assert ranges[0].a == a and ranges[-1].b == b and all(x.b == y.a and x.b % 100 == 0 for x, y in zip(ranges, ranges[1:], strict=False))
    assert len(ranges) <= 1025 and (len(ranges) > 500 or b < 500_000)


def test_two_letters_that_are_left_stay():
    """Words are looked up by their first two letters, which stemming keeps."""
    text = "ays aying eyed oys ay days"
    terms, total = counts(text)
    assert counts_of(text, sorted(terms)) == (terms, total) and terms == {"ay": 3, "ey": 1, "oy": 1, "dai": 1}
    assert counts_of(text, ["ay"])[0] == {"ay": 3}
