"""Fetching sources over recorded exchanges, held to DuckDB over the same files."""

import json

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vellumark.sources import fetch

URL = "https://api.example.com/items?start={start}"


def recorded(spark, tmp_path, n, size=10, busy=True, name="rec"):
    """Items 0 to n-1 by pages of ``size``; a 429 and a 503 before every third page."""
    rows = []
    for page in range(-(-n // size)):
        url = URL.replace("{start}", str(page * size))
        statuses = ([429, 503] if busy and page % 3 == 0 else []) + [200]
        items = [{"id": k, "name": f"ñ {k}"} for k in range(page * size, min(n, (page + 1) * size))]
        rows += [(url, k, s, json.dumps({"results": items}) if s == 200 else None) for k, s in enumerate(statuses)]
    path = str(tmp_path / f"{name}-{n}")
    fetch.record(spark.createDataFrame(rows, "url string, attempt int, status int, body string"), path)
    return {"url": URL, "size": str(size), "recorded": path, "pause": "0", "chunk": "3"}


SCHEMA = "id long, name string"


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 100, 237])
def test_all_items_in_ranges_of_pages(spark, tmp_path, n):
    if n == 0:
        options = {"url": URL, "size": "10", "recorded": str(tmp_path), "pause": "0"}
        assert fetch.api_items(spark, SCHEMA, **options).count() == 0
        return
    options = recorded(spark, tmp_path, n)
    df = fetch.api_items(spark, SCHEMA, **options)
    got = sorted(map(tuple, df.select("page", "pos", "id", "name").collect()))
    sql = f"select unnest(from_json(body, '{{\"results\": [{{\"id\": \"BIGINT\", \"name\": \"VARCHAR\"}}]}}').results, recursive := true) from read_json('{options['recorded']}/*/*.json', columns = {{url: 'VARCHAR', attempt: 'INT', status: 'INT', body: 'VARCHAR'}}) where status = 200"
    assert sorted((x[2], x[3]) for x in got) == sorted(duckdb.sql(sql).fetchall())
    assert [x[:2] for x in got] == [(k // 10 + 1, k % 10) for k in range(n)]
    assert df.rdd.getNumPartitions() == max(1, -(-n // 30))


def test_the_last_page_is_found_with_few_gets(spark, tmp_path):
    options = recorded(spark, tmp_path, 1000, busy=False)
    pages = fetch._Pages(options)
    calls = []
    pages.get = lambda url, get=pages.get: calls.append(url) or get(url)
    assert pages.count() == 1000 and len(calls) <= 20
    calls.clear()
    assert pages.count(995) == 1000 and len(calls) <= 3


def test_statuses_that_stay_fail_the_read(spark, tmp_path):
    rows = [(URL.replace("{start}", "0"), 0, 503, None)]
    path = str(tmp_path / "down")
    fetch.record(spark.createDataFrame(rows, "url string, attempt int, status int, body string"), path)
    with pytest.raises(PySparkException, match="503"):
        fetch.api_items(spark, SCHEMA, url=URL, recorded=path, pause="0").count()
    out = fetch.raw_pages(spark.createDataFrame([(rows[0][0],), ("https://x/none",), (None,), ("",)], "url string"), 2, recorded=path, pause="0").collect()
    assert {(r.url, r.body, r.error) for r in out} == {(rows[0][0], None, "status 503"), ("https://x/none", None, None)}


def stream(spark, tmp_path, options, checkpoint="ck"):
    q = fetch.api_item_stream(spark, SCHEMA, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    """Restarts while the last page fills up, with nothing new, and after a crash that lost the sink's last commit: each item once."""
    for n in (25, 25, 27, 104):
        out = stream(spark, tmp_path, recorded(spark, tmp_path, n, name=f"r{n}") if not (tmp_path / f"r{n}-{n}").exists() else {"url": URL, "size": "10", "recorded": str(tmp_path / f"r{n}-{n}"), "pause": "0", "chunk": "3"})
        assert sorted(r.id for r in out.collect()) == list(range(n))
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    more = recorded(spark, tmp_path, 120, name="more")
    assert sorted(r.id for r in stream(spark, tmp_path, more).collect()) == list(range(104))  # the lost batch, again
    assert sorted(r.id for r in stream(spark, tmp_path, more).collect()) == list(range(120))


class Failing:
    """A transport whose first GET in a task breaks off."""

    def __init__(self, options):
        self.inner, self.broken = fetch.RecordedTransport(options), False

    def get(self, url):
        if not self.broken:
            self.broken = True
            raise ConnectionResetError("reset")
        return self.inner.get(url)


def test_own_transports_and_transport_errors(spark, tmp_path):
    options = recorded(spark, tmp_path, 45) | {"transport": "tests.test_fetch:Failing"}
    assert fetch.api_items(spark, SCHEMA, **options).agg(F.sum("id")).first()[0] == sum(range(45))
