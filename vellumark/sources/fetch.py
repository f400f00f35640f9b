"""Fetching as Spark sources: verbatim GETs of a table of addresses, and paged APIs in batch and as streams.

A transport answers ``get(url)`` with (status, body). It is made inside tasks from its options: ``HttpTransport`` for http addresses, ``RecordedTransport`` for a folder of
recorded exchanges, or any class named ``module:Name``.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vellumark.sources.batch import PAUSE, raw_get
from vellumark.sources.media import filesystem

AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36"
#: Hexadecimal digits of a recorded folder's bucket, at least; exchanges of a bucket, at most on average; the name of the file that says how many digits there are.
BUCKET, FULL, DIGITS = 2, 256, "_digits"
#: Addresses that differ in so many last characters only share a bucket, so a task that reads pages in turn reads few.
TAIL = 2
#: Partitions of a paged API, at most; more pages make them longer.
PARTITIONS = 1024


class HttpTransport:
    """Follows redirects; statuses are answers, not errors."""

    def __init__(self, options: dict[str, str]) -> None:
        self.timeout = float(options.get("timeout", 30))

    def get(self, url: str) -> tuple[int, str]:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")


class RecordedTransport:
    """Answers from what ``record`` wrote: the n-th GET of an address gets its n-th exchange, later ones the last; 404 for an unknown one."""

    def __init__(self, options: dict[str, str]) -> None:
        self.fs, self.path = filesystem(options["recorded"])
        self.digits = 0
        self.buckets: dict[str, dict[str, list[tuple[int, str]]]] = {}
        self.calls: dict[str, int] = {}

    def _bucket(self, name: str) -> dict[str, list[tuple[int, str]]]:
        if name not in self.buckets:
            rows: list[dict] = []
            for f in self.fs.get_file_info(pafs.FileSelector(f"{self.path}/bucket={name}", allow_not_found=True)):
                if f.base_name.startswith("part-"):
                    with self.fs.open_input_stream(f.path) as lines:
                        rows += [json.loads(x) for x in lines.read().decode().splitlines()]
            answers: dict[str, list[tuple[int, str]]] = {}
            for x in sorted(rows, key=lambda x: x["attempt"]):
                answers.setdefault(x["url"], []).append((x["status"], x.get("body") or ""))
            self.buckets[name] = answers
        return self.buckets[name]

    def get(self, url: str) -> tuple[int, str]:
        if not self.digits:
            told = f"{self.path}/{DIGITS}"
            if self.fs.get_file_info(told).type == pafs.FileType.File:
                with self.fs.open_input_stream(told) as f:
                    self.digits = int(f.read())
            else:
                self.digits = BUCKET
        answers = self._bucket(hashlib.md5(url[:-TAIL].encode()).hexdigest()[: self.digits]).get(url)
        if not answers:
            return 404, ""
        n = self.calls[url] = self.calls.get(url, -1) + 1
        return answers[min(n, len(answers) - 1)]


def record(exchanges: DataFrame, path: str) -> None:
    """Writes ``url, attempt, status, body`` as the folder that ``RecordedTransport`` reads, with more buckets for more exchanges."""
    digits, n = BUCKET, exchanges.count()
    while n > FULL * 16**digits:
        digits += 1
    head = F.left("url", F.greatest(F.length("url") - TAIL, F.lit(0)))
    rows = exchanges.select("url", F.col("attempt").cast("int"), F.col("status").cast("int"), "body", F.left(F.md5(head), F.lit(digits)).alias("bucket"))
    rows.repartition("bucket").write.partitionBy("bucket").json(path)
    fs, at = filesystem(path)
    with fs.open_output_stream(f"{at}/{DIGITS}") as f:
        f.write(str(digits).encode())


def transport(options: dict[str, str]):
    name = options.get("transport")
    if name:
        module, _, attribute = name.partition(":")
        return getattr(importlib.import_module(module), attribute)(options)
    return RecordedTransport(options) if "recorded" in options else HttpTransport(options)


def _get(options: dict[str, str], known: list) -> Callable[[str], str | None]:
    """Body by address, with retries; the transport is made on first use, in the task."""

    def get(url: str) -> str | None:
        if not known:
            known.append(transport(options))
        pause = float(options.get("pause", PAUSE))
        return raw_get(known[0].get, url, pause=pause)

    return get


def raw_pages(urls: DataFrame, parallel: int, **options: str) -> DataFrame:
    """``url, body, error`` of each different address (column ``url``): the body as it came, null for a status that stays bad; ``error`` where retries ran out.

    ``parallel`` tasks fetch, one GET at a time each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _get(options, [])
        for batch in batches:
            urls, bodies, errors = batch.column(0).to_pylist(), [], []
            for url in urls:
                body = error = None
                try:
                    body = get(url)
                except OSError as e:
                    error = str(e)
                bodies.append(body)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (urls, bodies, errors)], ["url", "body", "error"])

    return urls.select("url").where("url is not null and url != ''").distinct().repartition(parallel, "url").mapInArrow(run, "url string, body string, error string")


class _Pages:
    """Pages of an API: ``url`` holds ``{page}`` or ``{start}``, answers hold their items in the array ``items`` (a path of names), a page has ``size`` of them but for the last."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.size = int(self.options.get("size", 100))
        self.first = int(self.options.get("first", 1))
        self.most = int(self.options.get("most", 5000))
        self.chunk = int(self.options.get("chunk", 20))
        self.names = [n for n in self.options.get("items", "results").split(".") if n]
        self.get = partial(_fetch, self.options, [])

    def items(self, page: int) -> list:
        """Items of the page (from 0); none behind the last."""
        if page >= self.most:
            return []
        url = self.options["url"].replace("{page}", str(page + self.first)).replace("{start}", str(page * self.size))
        body = self.get(url)
        out = json.loads(body) if body else {}
        for n in self.names:
            out = (out or {}).get(n)
        return out or []

    def count(self, known: int = 0) -> int:
        """Number of items, at least ``known``: the last page is found in log2 of the pages by doubling steps, then halving."""
        low = known // self.size  # all pages before it are full
        here = len(self.items(low))
        if here < self.size:
            return max(known, low * self.size + here)
        step, full = 1, low
        while len(self.items(full + step)) == self.size:
            full, step = full + step, step * 2
        high = full + step  # not full
        while high - full > 1:
            mid = (full + high) // 2
            if len(self.items(mid)) == self.size:
                full = mid
            else:
                high = mid
        return high * self.size + len(self.items(high))

    def ranges(self, a: int, b: int) -> list[PageRange]:
        """Items from a to b (not included), cut at pages; a range has ``chunk`` of them, or more where there would be over ``PARTITIONS``."""
        pages = -(-b // self.size) - a // self.size
        step = self.size * self.chunk * max(1, -(-pages // (self.chunk * PARTITIONS)))
        cuts = [a, *range((a // step + 1) * step, b, step), b]
        return [PageRange(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]

    def read(self, part: PageRange) -> Iterator[pa.RecordBatch]:
        for page in range(part.a // self.size, -(-part.b // self.size)):
            at = page * self.size
            rows = [(page + self.first, k, json.dumps(x, ensure_ascii=False)) for k, x in enumerate(self.items(page)) if part.a <= at + k < part.b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)], ["page", "pos", "item"])


def _fetch(options: dict[str, str], known: list, url: str) -> str | None:
    return _get(options, known)(url)


class PageRange(InputPartition):
    def __init__(self, a: int, b: int) -> None:
        self.a, self.b = a, b


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[PageRange]:
        pages = _Pages(self.options)
        return pages.ranges(0, pages.count()) or [PageRange(0, 0)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        yield from _Pages(self.options).read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets count items, so a last page that fills up later is read on from where it ended."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.known = dict(options), 0

    def initialOffset(self) -> dict:
        return {"items": 0}

    def latestOffset(self) -> dict:
        self.known = _Pages(self.options).count(self.known)
        return {"items": self.known}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        self.known = max(self.known, end["items"])
        return _Pages(self.options).ranges(start["items"], end["items"])

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        yield from _Pages(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class ApiPages(DataSource):
    """``format("api_pages")``: ``page, pos, item`` (JSON) of a paged API. A partition is a range of pages; planning finds the last page with a logarithmic number of GETs.

    Options: ``url`` with ``{page}`` or ``{start}``, ``items``, ``size``, ``first`` (number of the first page), ``most`` (pages), ``chunk`` (pages of a partition, at least), ``pause`` (seconds
    before the first retry), and the transport's.
    """

    @classmethod
    def name(cls) -> str:
        return "api_pages"

    def schema(self) -> str:
        return "page int, pos int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ApiPages)


def api_items(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    """Items of a paged API as columns, with ``page`` and ``pos``."""
    register(spark)
    raw = spark.read.format("api_pages").options(**options).load()
    return raw.select("page", "pos", F.from_json("item", schema).alias("x")).select("page", "pos", "x.*")


def api_item_stream(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    register(spark)
    raw = spark.readStream.format("api_pages").options(**options).load()
    return raw.select("page", "pos", F.from_json("item", schema).alias("x")).select("page", "pos", "x.*")
