"""Platform-specific bodies, dates and schedules that documents need beside generic scoping."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellumark.functions.dom import Element, first, parse, scope_content, select

# Headings of trailing link lists, and what each platform leaves in its bodies.
NEXT_HEADINGS = ["next steps", "next step", "related content", "related links"]
NEXT_IDS = ["next-steps", "next-step"]
FLARE_OUT = [".GoToTop", ".feedback-button", ".nocontent"]

_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_TIME = re.compile(r"<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)[\"']", re.I)


def js_unescape(text: str) -> str:
    """Escapes of JavaScript strings: unicode, newline, tab and return; any other character stands for itself."""
    plain = {"n": "\n", "t": "\t", "r": "\r"}
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else plain.get(m[1], m[1]), text)


def last_updated(html: str | None) -> datetime | None:
    """Of the first ``<time datetime>``, in UTC; null if it isn't a date."""
    m = _TIME.search(html or "")
    try:
        at = datetime.fromisoformat(m[1].strip().replace("Z", "+00:00")) if m else None
    except ValueError:
        return None
    return at.astimezone(UTC).replace(tzinfo=None) if at and at.tzinfo else at


def normalise_next_steps(html: str | None) -> str | None:
    """Without a trailing section of links, if it is the last h2 or h3."""
    root = parse(html)
    heads = [e for e in root.walk() if e.tag in ("h2", "h3")]
    if not heads or not (heads[-1].attrs.get("id") in NEXT_IDS or " ".join(heads[-1].text().split()).lower() in NEXT_HEADINGS):
        return html
    head, box = heads[-1], heads[-1].parent
    at = next(k for k, c in enumerate(box.children) if c is head)
    box.children = box.children[:at]
    return root.html()


def sphinx_body(html: str | None, url: str) -> str | None:
    """The main part without links to a PDF, empty quotes and "Go back to" lines."""
    scoped = scope_content(html, url, ["[role=main]"])
    if scoped is None:
        return None
    root = parse(scoped)
    for e in list(root.walk()):
        text = " ".join(e.text().split())
        admonition = "admonition" in e.classes and any(a.attrs.get("href", "").lower().endswith(".pdf") for a in select(e, "a"))
        if admonition or (e.tag == "blockquote" and not text) or (e.tag == "p" and text.startswith("Go back to")):
            e.remove()
    return root.html().strip() or None


def flare_body(html: str | None, url: str) -> str | None:
    root = parse(html)
    body: Element | None = first(root, "[data-mc-content-body]") or first(root, "#mc-main-content")
    if body is None:
        return None
    for s in FLARE_OUT:
        for e in select(body, s):
            e.remove()
    for e in body.walk():
        if e.tag == "img" and e.attrs.get("src"):
            e.attrs["src"] = urljoin(url, e.attrs["src"])
    return body.html().strip() or None


def json_body(text: str | None) -> str | None:
    """The body in an article's JSON: ``article.body`` or ``topic_html``."""
    try:
        data = json.loads(text or "null")
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    article = data.get("article")
    return (article.get("body") if isinstance(article, dict) else None) or data.get("topic_html")


def json_body_column(text: Column) -> Column:
    return F.coalesce(F.get_json_object(text, "$.article.body"), F.get_json_object(text, "$.topic_html"))


def text_udf(f, *more: type):
    """A one- or two-column text function as a pandas UDF."""
    if more:
        return F.pandas_udf(_two(f), StringType())
    return F.pandas_udf(_one(f), StringType())


def _one(f):
    def run(a: pd.Series) -> pd.Series:
        return a.map(f, na_action="ignore")

    return run


def _two(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y or "") for x, y in zip(a, b, strict=True)], dtype="object")

    return run


def last_updated_column(html: Column) -> Column:
    """The same as a column: zone-less dates count as UTC."""
    return F.try_to_timestamp(F.regexp_extract(html, r"(?i)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)[\"']", 1))


def schedule_errors(frequency: Column, time_of_day: Column, day_of_week: Column, day_of_month: Column) -> Column:
    """What is wrong with a schedule, as an array: Sunday is day 0, months have 28 days."""
    errors = F.array(
        F.when(~F.coalesce(frequency.isin("hourly", "daily", "weekly", "monthly"), F.lit(False)), "frequency"),
        F.when(~F.coalesce(time_of_day.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(True)), "time_of_day"),
        F.when(~F.coalesce(day_of_week.between(0, 6), F.lit(True)), "day_of_week"),
        F.when(~F.coalesce(day_of_month.between(1, 28), F.lit(True)), "day_of_month"),
    )
    return F.array_compact(errors)
