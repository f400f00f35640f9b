"""Scalar functions as column expressions, so that they stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "{version}"
#: Length that errors and logs are cut to.
ERROR_CHARS, LOG_CHARS = 4096, 200_000

# What bot walls and login walls say.
STRONG_BLOCK_MARKERS = ["edgesuite.net", "cf-browser-verification", "/cdn-cgi/challenge-platform", "attention required! | cloudflare", "incapsula incident id", "request unsuccessful. incapsula", "pardon our interruption"]
SHORT_BLOCK_MARKERS = ["you don't have permission to access", "access denied", "request unsuccessful"]
LOGIN_HOST_MARKERS = ["login", "signin", "sign-in", "b2clogin.com", "onepassport", "auth0.com", "okta.com", "accounts.google.com"]
LOGIN_URL_MARKERS = ["oauth2", "/authorize", "/saml"]
AUTH_WALL_MARKERS = ["requires authentication", "please sign in to continue", "you must be logged in to view", "session has expired"]
SHORT_PAGE = 800


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text: Column | str) -> Column:
    return F.sha2(F.encode(_c(text), "utf-8"), 256)


def estimated_tokens(text: Column | str) -> Column:
    return F.floor(F.length(_c(text)) / 4)


def size_bytes(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(_c(text)), F.lit(0))


def resolve_template(template: Column, version: Column) -> Column:
    return F.replace(template, F.lit(PLACEHOLDER), version)


def replace_first(text: Column, what: Column, by: Column) -> Column:
    where = F.call_function("instr", text, what)
    return F.when((where > 0) & (F.length(what) > 0), F.concat(F.substr(text, F.lit(1), where - 1), by, F.substr(text, where + F.length(what)))).otherwise(text)


def derive_topic_key(url: Column, template: Column, version: Column) -> Column:
    """The URL with its version token made ``{version}``: at the template's place, else the first occurrence."""
    hole = F.call_function("instr", template, F.lit(PLACEHOLDER))
    prefix = F.substr(template, F.lit(1), hole - 1)
    at_place = F.startswith(url, prefix) & (F.substr(url, F.length(prefix) + 1, F.length(version)) == version)
    swapped = F.concat(prefix, F.lit(PLACEHOLDER), F.substr(url, F.length(prefix) + F.length(version) + 1))
    usable = template.isNotNull() & version.isNotNull() & (F.length(version) > 0) & (hole > 0) & url.isNotNull() & (F.length(url) > 0)
    return F.when(~F.coalesce(usable, F.lit(False)), url).when(at_place, swapped).otherwise(replace_first(url, version, F.lit(PLACEHOLDER)))


def detect_version_token(url: Column, version: Column) -> Column:
    """A template of the URL, or null if the version isn't in it."""
    return F.when((F.length(version) > 0) & F.contains(url, version), replace_first(url, version, F.lit(PLACEHOLDER)))


def pdf_topic_key(path: Column) -> Column:
    slug = lambda p: F.regexp_replace(F.regexp_replace(F.lower(p), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    joined = F.array_join(F.filter(F.transform(path, slug), lambda p: p != ""), "/")
    return F.when(joined == "", "document").otherwise(joined)


def anchor_slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N} _-]", "")
    return F.regexp_replace(F.regexp_replace(F.replace(kept, F.lit(" "), F.lit("-")), "-{2,}", "-"), "^-+|-+$", "")


# Labels that the rule would not give.
LABELS = {"lazy_tree": "Lazy Tree Nav", "mkdocs": "MkDocs", "gitbook": "GitBook", "flare_webhelp": "Flare WebHelp", "flare_html5": "Flare HTML5", "warmup_listgroup": "Warm-up + List Group", "generic": "Generic (sitemap)", "llm": "LLM fallback"}


def humanise_label(name: Column) -> Column:
    own = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(own, name), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, "​﻿", "")


def log_append(log: Column, chunk: Column) -> Column:
    return F.right(F.concat(F.coalesce(log, F.lit("")), chunk), F.lit(LOG_CHARS))


def _any(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def _short(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) <= SHORT_PAGE


def is_block_page(text: Column) -> Column:
    low = F.lower(text)
    denied = _any(low, SHORT_BLOCK_MARKERS) & (low.rlike(r"reference\s*#\s*\d") | F.contains(low, F.lit("permission")) | F.contains(low, F.lit("denied")))
    script = F.contains(low, F.lit("just a moment")) & F.contains(low, F.lit("javascript"))
    return F.coalesce(_any(low, STRONG_BLOCK_MARKERS) | (_short(text) & (denied | script)), F.lit(False))


def is_auth_wall(text: Column, url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    said = _short(text) & _any(F.lower(text), AUTH_WALL_MARKERS)
    return _any(host, LOGIN_HOST_MARKERS) | _any(low, LOGIN_URL_MARKERS) | F.coalesce(said, F.lit(False))


def diff_line_class(line: Column) -> Column:
    return F.when(line.rlike(r"^(\+\+\+|---)"), "meta").when(F.startswith(line, F.lit("@@")), "hunk").when(F.startswith(line, F.lit("+")), "add").when(F.startswith(line, F.lit("-")), "del").otherwise("context")


def fmt_age(seconds: Column) -> Column:
    day, hour = F.floor(seconds / 86400), F.floor(seconds / 3600)
    return F.when(seconds.isNull(), "never").when(day > 0, F.concat(day, F.lit("d ago"))).when(hour > 0, F.concat(hour, F.lit("h ago"))).otherwise(F.concat(F.floor(seconds / 60), F.lit("m ago")))


def fmt_duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60
    return F.when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m "), s, F.lit("s"))).when(m > 0, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def build_cron(frequency: Column, time_of_day: Column, day_of_week: Column, day_of_month: Column) -> Column:
    hour, minute = F.split(time_of_day, ":")[0].cast("int"), F.split(time_of_day, ":")[1].cast("int")
    return (
        F.when(frequency == "hourly", F.concat(minute, F.lit(" * * * *")))
        .when(frequency == "daily", F.concat_ws(" ", minute, hour, F.lit("* * *")))
        .when(frequency == "weekly", F.concat_ws(" ", minute, hour, F.lit("* *"), F.coalesce(day_of_week, F.lit(0))))
        .when(frequency == "monthly", F.concat_ws(" ", minute, hour, F.coalesce(day_of_month, F.lit(1)), F.lit("* *")))
    )


def next_run(frequency: Column, time_of_day: Column, day_of_week: Column, day_of_month: Column, timezone: Column, after: Column) -> Column:
    """First fire time strictly after ``after`` (UTC), kept in the job's zone: candidates of the next days, then the least that is later."""
    hour, minute = F.split(time_of_day, ":")[0].cast("int"), F.split(time_of_day, ":")[1].cast("int")
    here = F.from_utc_timestamp(after, timezone)
    today, clock = F.to_date(here), hour * 60 + minute
    utc = lambda day, mins: F.to_utc_timestamp(F.timestamp_add("MINUTE", mins, day.cast("timestamp")), timezone)
    days = F.sequence(F.date_sub(today, 1), F.date_add(today, 63))
    fits = lambda d: F.when(frequency == "weekly", F.dayofweek(d) - 1 == F.coalesce(day_of_week, F.lit(0))).when(frequency == "monthly", F.dayofmonth(d) == F.coalesce(day_of_month, F.lit(1))).otherwise(True)
    by_day = F.transform(F.filter(days, fits), lambda d: utc(d, clock))
    hours = F.transform(F.sequence(F.lit(-1), F.lit(3)), lambda h: F.timestamp_add("MINUTE", minute, F.timestamp_add("HOUR", h, F.date_trunc("hour", after))))
    return F.array_min(F.filter(F.when(frequency == "hourly", hours).otherwise(by_day), lambda t: t > after))


def rewrite_images(markdown: Column, images: Column) -> Column:
    """``images``: array of (full, raw, served); full URLs first, then raw ones that are relative."""
    relative = lambda i: F.startswith(i["raw"], F.lit("/")) | F.startswith(i["raw"], F.lit("./")) | F.startswith(i["raw"], F.lit("../"))
    step = lambda md, i: F.when(relative(i), F.replace(F.replace(md, i["full"], i["served"]), i["raw"], i["served"])).otherwise(F.replace(md, i["full"], i["served"]))
    return F.aggregate(images, markdown, step)


def url_level(url: Column, root: Column) -> Column:
    """Path segments below the root's folder, at least 0."""
    path = lambda u: F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    n = lambda p: F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    folder = F.regexp_replace(path(root), "[^/]*$", "")
    return F.greatest(F.lit(0), n(path(url)) - n(folder))


def article_section(title: Column, url: Column, last_updated: Column, extracted: Column, markdown: Column) -> Column:
    when = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm 'UTC'")
    updated = F.when(last_updated.isNotNull(), F.concat(F.lit("**Last Updated:** "), when(last_updated), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("## "), title, F.lit("\n\n**Source:** ["), url, F.lit("]("), url, F.lit(")\n"), updated, F.lit("**Extracted:** "), when(extracted), F.lit("\n\n"), markdown, F.lit("\n\n---\n"))


def without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments; other paths as they are."""
    step = lambda out, s: F.when(s == ".", out).when(s == "..", F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(s)))
    kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    ends = F.when(F.regexp_extract(path, "/(\\.{1,2})$", 1) != "", F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.startswith(path, F.lit("/")), F.array_join(ends, "/")).otherwise(path)


def resolve_url(base: Column, ref: Column) -> Column:
    """A reference against a base address, by RFC 3986, section 5.2. A null base or reference counts as empty."""
    base, ref = F.coalesce(base, F.lit("")), F.coalesce(ref, F.lit(""))
    # Parts by the RFC's own pattern; the parts that may be missing keep their marks.
    pattern = "(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\\?[^#]*)?(#.*)?$"
    scheme, authority, path, query, fragment = (F.regexp_extract(ref, pattern, k) for k in range(1, 6))
    b_scheme, b_authority, b_path, b_query = (F.regexp_extract(base, pattern, k) for k in range(1, 5))
    merged = F.when((b_authority != "") & (b_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(b_path, "(?s)^(.*/)?", 1), path))
    whole = F.concat(scheme, authority, without_dots(path), query, fragment)
    other_host = F.concat(b_scheme, authority, without_dots(path), query, fragment)
    here = F.concat(b_scheme, b_authority, b_path, F.when(query != "", query).otherwise(b_query), fragment)
    other_path = F.concat(b_scheme, b_authority, without_dots(F.when(F.startswith(path, F.lit("/")), path).otherwise(merged)), query, fragment)
    return F.when(scheme != "", whole).when(authority != "", other_host).when(path == "", here).otherwise(other_path)
