"""Fetching through a connector: batches with a cursor, retries of what came back empty or not at all, and verbatim GETs.

The connector is an object that tasks get a copy of. ``submit(urls)`` gives a job, ``poll(job, skip)`` the pages from that place on and whether it
is over, ``scrape(url)`` one page; a page is a dict with ``url`` and ``markdown``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: URLs of a batch; statuses that are tried again, how often, and the first pause in seconds.
BATCH = 100
AGAIN, RETRIES, PAUSE = (429, 502, 503, 504), 5, 4.0
#: Seconds without a page after which a batch counts as over.
PATIENCE = 600.0


def raw_get(get: Callable[[str], tuple[int, str]], url: str, sleep: Callable[[float], None] = time.sleep, pause: float = PAUSE) -> str | None:
    """The body of ``get(url)`` (status, body); transport errors and passing statuses are tried again after pauses that double. None for other statuses."""
    trouble = None
    for attempt in range(RETRIES + 1):
        if attempt:
            sleep(pause)
            pause *= 2
        try:
            status, body = get(url)
        except OSError as e:
            trouble = e
            continue
        if status not in AGAIN:
            return body if 200 <= status < 300 else None
        trouble = OSError(f"status {status}")
    raise trouble


def fetch_batch(connector, urls: list[str], patience: float = PATIENCE, clock: Callable[[], float] = time.monotonic) -> list[dict]:
    """Pages of one batch: polled from a cursor until it is over or nothing has come for ``patience`` seconds; then empty pages and URLs that got none are tried alone, once."""
    job, pages, over, last = connector.submit(urls), [], False, clock()
    while not over and clock() - last < patience:
        more, over = connector.poll(job, len(pages))
        pages += more
        if more:
            last = clock()
        elif not over:
            time.sleep(getattr(connector, "pause", 2.0))
    got: dict[str, dict] = {}
    for p in pages:
        if p["url"] not in got or not (got[p["url"]].get("markdown") or "").strip():
            got[p["url"]] = p
    for url in urls:
        if not (got.get(url, {}).get("markdown") or "").strip():
            got[url] = connector.scrape(url) or got.get(url) or {"url": url, "markdown": ""}
    return [{"url": u, "markdown": got[u].get("markdown") or "", "tries": 1 + (got[u] not in pages)} for u in dict.fromkeys(urls)]


def scrape(wanted: DataFrame, connector, batch: int = BATCH) -> DataFrame:
    """``source_id, url, markdown, tries`` of the wanted (source_id, url), a batch of one source at a time; tasks fetch their batches."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("url")) - 1
    numbered = wanted.select("source_id", "url").distinct().withColumn("batch", F.floor(place / batch))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pages = fetch_batch(connector, group["url"].tolist())
        return pd.DataFrame({"source_id": group["source_id"].iloc[0], **{k: [p[k] for p in pages] for k in ("url", "markdown", "tries")}})

    return numbered.groupBy("source_id", "batch").applyInPandas(run, "source_id string, url string, markdown string, tries int")


def cursor_pages(fetch: Callable[[str | None], tuple[list[dict], str | None]], most: int | None = None) -> Iterator[dict]:
    """Rows of a paged API by its cursor, up to ``most`` pages if given; a cursor that comes again ends it."""
    cursor, seen, n = None, set(), 0
    while most is None or n < most:
        rows, cursor = fetch(cursor)
        yield from rows
        n += 1
        if not cursor or cursor in seen:
            return
        seen.add(cursor)
