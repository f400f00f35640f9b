"""The extraction profiles: which documentation platform a page is of, its table of contents and its content scope.

Detection is one CASE expression. Builders are functions of captured pages and run in ``mapInPandas``/``applyInPandas``;
what a platform would fetch comes from the captured table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.functions import tocparse as T
from vellumark.functions.dom import parse, select

Build = Callable[[str, T.Fetch], list[T.Entry]]


@dataclass
class Profile:
    name: str
    #: Conditions that must all hold; each is a list of which one must: strings are looked for in the page, "host:x", "host$:x" (its end), "path:x" and "url~x" (pattern) in the URL; "low:x" in the lower-cased page, "-x" must be absent.
    marks: list[list[str]]
    engine: str = "raw_http"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    build: Build = lambda url, fetch: []
    auto: bool = True


def _bar(selector: str) -> Build:
    return lambda url, fetch: T.sidebar(fetch(url), url, selector)


def _flare(selector: str) -> Build:
    """The data files of a help system, or else the tree in the page, whose links may stand behind a ``#``."""

    def build(url: str, fetch: T.Fetch) -> list[T.Entry]:
        found = T.help_system(fetch, url)
        if not found:
            found = T.sidebar(fetch(url), url, selector)
            plain = {e.url: urljoin(urljoin(url, "."), e.url.split("#", 1)[1].split("?", 1)[0]) if e.url and "#" in e.url else e.url for e in found}
            for e in found:
                e.url, e.parent_url = plain[e.url], plain.get(e.parent_url, e.parent_url)
        return found

    return build


def _json(name: str, children: str, titles: tuple[str, ...], items: str | None, strip_query: bool) -> Build:
    return lambda url, fetch: T.json_tree(T.json_text(fetch(urljoin(url, name))), urljoin(url, name), children, titles, "href", items, {urlparse(url).netloc}, strip_query)


def _nodes(selector: str, level: str, base: int = 0) -> Build:
    """Tree items with their level in an attribute or class, by a level stack."""

    def build(url: str, fetch: T.Fetch) -> list[T.Entry]:
        nodes = []
        for e in select(parse(fetch(url)), selector):
            link = e if e.tag == "a" else next((x for x in e.walk() if x.tag == "a"), None)
            raw = e.attrs.get(level) or "".join(c.rsplit("_", 1)[-1] for c in e.classes if c.startswith(level)) or str(base)
            nodes.append((T._title(link if link is not None else e), link.attrs.get("href") if link is not None else None, max(0, int(raw) - base) if raw.isdigit() else 0))
        return T.stacked(nodes, url)

    return build


def _crawl(seed: str, child: str, most: int | None) -> Build:
    def build(url: str, fetch: T.Fetch) -> list[T.Entry]:
        def links(at: str, selector: str) -> list[tuple[str, str]]:
            found = [(T._title(e), urljoin(at, e.attrs["href"]).split("#")[0]) for e in select(parse(fetch(at)), selector) if e.attrs.get("href")]
            return [(t, u) for t, u in dict((u, (t, u)) for t, u in found).values() if urlparse(u).netloc == urlparse(url).netloc]

        return T.crawl_tree(links(url, seed), lambda u: links(u, child), most)

    return build


def _hub(*steps: tuple[str, str | None]) -> Build:
    return lambda url, fetch: T.tiers(fetch, url, list(steps))


def _generic(url: str, fetch: T.Fetch) -> list[T.Entry]:
    return T.by_path(T.sitemap(fetch(urljoin(url, "/sitemap.xml"))), url)


def _accordion(url: str, fetch: T.Fetch) -> list[T.Entry]:
    out, seen = [], set()
    scope = urlparse(url).path.rsplit("/", 1)[0]
    for part in select(parse(fetch(url)), ".category-section"):
        head = next((e for e in part.walk() if e.tag in ("h2", "h3", "h4", "button")), None)
        out.append(T.Entry(T._title(head) if head is not None else "", None, 0, False))
        for a in (e for e in part.walk() if e.tag == "a" and e.attrs.get("href")):
            to = urljoin(url, a.attrs["href"]).split("#")[0]
            if to not in seen and urlparse(to).path.startswith(scope):
                seen.add(to)
                out.append(T.Entry(T._title(a), to, 1, True))
    return out


MADCAP = ["MadCap", "data-mc-", " mc-"]

# Platforms in the order in which they are tried, with their marks and selectors.
PROFILES = [
    Profile("lazy_tree", [["host$:documentation.commvault.com", "cv-nav-slug", 'id="nav"&nav-group']], include=["#doc"], exclude=[".breadcrumbs"], build=_nodes("#nav a", "data-level")),
    Profile("collapsible_sidebar", [["host$:docs.cohesity.com", 'data-slot="sidebar-inner"&data-slot="collapsible-trigger"']], "rendered", ["article"], [], _bar("div[data-slot='sidebar-inner']")),
    Profile("docusaurus", [["theme-doc-sidebar-menu"], ["theme-doc-sidebar-item-"]], include=[".theme-doc-markdown"], build=_bar(".theme-doc-sidebar-menu")),
    Profile("mkdocs", [["md-nav__list"], ["md-content"]], include=["article.md-content__inner"], exclude=[".md-feedback", ".md-source-file", ".md-content__button"], build=_bar(".md-nav--primary .md-nav__list")),
    Profile("gitbook", [["data-gb-table-of-contents"]], "rendered", build=_crawl("[data-gb-table-of-contents] a", "[data-gb-table-of-contents] li li a", None)),
    Profile("flare_webhelp", [MADCAP, ['<iframe id="topic"']], include=["[role=main]"], exclude=[".GoToTop", ".feedback-button", ".nocontent"], build=_flare("ul.tree")),
    Profile("flare_html5", [MADCAP, ["sidenav"], ['-<iframe id="topic"']], include=["[role=main]"], exclude=[".GoToTop", ".feedback-button", ".nocontent"], build=_flare(".sidenav")),
    Profile("intercom", [["collection-link"]], "rendered", build=_hub(("a.collection-link", "h2"), ("a[data-testid='article-link']", "span"))),
    Profile("freshdesk", [["cdn.freshdesk.com"]], "rendered", exclude=[".article-votes", ".vote-options", ".related-articles"], build=_hub(("a[href*='/support/solutions/']", None), ("a[href*='/support/solutions/folders/']", None), ("a[href*='/support/solutions/articles/']", None))),
    Profile("confluence", [["low:com-atlassian-confluence", "low:/wiki/spaces/"]], include=[".wiki-content"], build=lambda url, fetch: T.wiki_space(fetch, url)),
    Profile("salesforce", [["slds-"], ["articleView"]], "browser", [".slds-text-longform"], build=_nodes("[role=treeitem]", "aria-level", 1)),
    Profile("warmup_listgroup", [["host$:dell.com"], ["path:/support/manuals/"]], "browser", ["#divTopicContent"], build=_bar("#toc-main-parent-ul")),
    Profile("category_accordion", [["host:keepit.com"], ["category-section", "category-sidebar"]], include=["article.article", ".m.embed"], build=_accordion),
    Profile("release_notes", [["host:keepit.com"], ["path:product-updates"]], "browser", [".releasenotes"], build=lambda url, fetch: T.anchored(fetch(url), url, ".releasenotes[id]", ("h2", "h3"))),
    Profile("devsite", [["devsite-book-nav", "devsite-nav-list"]], include=[".devsite-article-body"], exclude=[".devsite-article-meta", ".devsite-floating-action-buttons"], build=_bar('ul.devsite-nav-list[menu="_book"]')),
    Profile("json_toc", [["awsdocs-", "toc-contents.json"]], include=["#main-col-body"], exclude=["#awsdocs-page-tools", ".awsdocs-page-tools", ".feedback"], build=_json("toc-contents.json", "contents", ("title",), "contents", False)),
    Profile("docfx", [['low:content="docfx', 'low:data-bi-name&low:name="ms.', "low:data-bi-name&low:learn.microsoft"]], include=[".content"], exclude=[".page-metadata", ".feedback-verbatim", ".ms-feedback"], build=_json("toc.json", "children", ("toc_title", "name"), "items", True)),
    Profile("zoomin", [["zDocsWebClient", "zoominsoftware"]], build=_json("toc.json", "childEntries", ("title",), None, False)),
    Profile("zendesk", [["url~/hc/[a-zA-Z]{2}(-[a-zA-Z]{2,4})?(/|$)", "low:/api/v2/help_center/", "low:zendesk"]], build=lambda url, fetch: T.help_center(fetch, url)),
    Profile("help_tree", [["help-tree-node", "js-sidebar", "SYNO_WEB"]], "rendered", ["#kb_help_body"], [".feedBackForm", ".section-selector-container"], _nodes("[class*='tree_layer_']", "tree_layer_", 1)),
    Profile("helpjuice", [["data-helpjuice-"]], include=["article.article"], build=_json("toc.json", "children", ("name", "title"), None, False)),
    Profile("dita_api", [["host$:ibm.com&path:/docs/", "low:ibmdocs"]], include=["article"], exclude=[".familylinks", ".parentlink", ".breadcrumb"], build=_json("toc.json", "topics", ("label", "title"), "topics", False)),
    Profile("sphinx", [["wy-nav-side", "wy-menu-vertical", "sphinx_rtd_theme"]], include=["[role=main]"], build=_crawl("li.toctree-l1 > a", ".toctree-wrapper a", 50_000)),
    Profile("grouped_nav", [["documentation-container"], ['class="navigation"']], include=[".documentation-container"], exclude=["#TableOfContents"], build=lambda url, fetch: T.grouped(fetch(url), url, "nav.navigation", "h3", r"(/docs/[^/?#]+)")),
    Profile("warmup_book", [["host$:docs.redhat.com"], ["path:/documentation/"]], "browser", ["article"], ["nav.pagination", ".copy-link-tooltip"], _bar("#main-content")),
    Profile("prerendered_toc", [["js-page-toc"], ["js-page-article"]], include=["article.js-page-article"], exclude=[".mini-toc__container", "footer"], build=_bar(".page-toc .page-toc__search-links")),
    Profile("generic", [], "rendered", build=_generic, auto=False),
    Profile("llm", [], "rendered", auto=False),
]
BY_NAME = {p.name: p for p in PROFILES}


def derived(spec: dict) -> Profile:
    """A profile from a stored selector spec: strategy sidebar, hubspoke or sitemap."""
    kind = spec.get("strategy", "sitemap")
    if kind == "sidebar":
        build = _bar(spec.get("nav_selector") or "nav")
    elif kind == "hubspoke":
        build = _hub((spec.get("category_link_selector") or "a", None), (spec.get("article_link_selector") or "a", None))
    else:
        build = _generic
    return Profile("llm", [], "rendered", [spec["content_selector"]] if spec.get("content_selector") else [], build=build, auto=False)


def _mark(html: Column, url: Column, mark: str) -> Column:
    if "&" in mark:
        out = F.lit(True)
        for m in mark.split("&"):
            out = out & _mark(html, url, m)
        return out
    host = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    kind, _, what = mark.partition(":")
    if kind == "host":
        return F.contains(host, F.lit(what))
    if kind == "host$":
        return F.endswith(host, F.lit(what))
    if kind == "path":
        return F.contains(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(what))
    if kind == "low":
        return F.contains(F.lower(html), F.lit(what))
    if mark.startswith("url~"):
        return url.rlike(mark[4:])
    if mark.startswith("-"):
        return ~F.contains(html, F.lit(mark[1:]))
    return F.contains(html, F.lit(mark))


def detect(html: Column, url: Column, override: Column | None = None) -> Column:
    """Name of the first profile whose marks are there; ``generic`` if none is; a stored override wins."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    out = None
    for p in PROFILES:
        if p.auto:
            all_ = F.lit(True)
            for alternatives in p.marks:
                any_ = F.lit(False)
                for m in alternatives:
                    any_ = any_ | _mark(html, url, m)
                all_ = all_ & any_
            out = F.when(all_, p.name) if out is None else out.when(all_, p.name)
    found = out.otherwise("generic")
    return found if override is None else F.coalesce(F.when(~override.isin("", "auto"), override), found)


TOC_RAW = "source_id string, pos int, title string, url string, level int, is_article boolean, parent_url string, content_selector string, content_url string"


def build_toc(sources: DataFrame, captures: DataFrame, more: dict[str, Profile] | None = None) -> DataFrame:
    """``sources`` (source_id, profile, root_url) with their ``captures`` (source_id, url, body) to entries in order, a source to a task.

    ``more``: profiles beside the registered ones, such as derived ones.
    """
    known = BY_NAME | (more or {})

    def run(key: tuple, src: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        bodies = dict(zip(pages["url"], pages["body"], strict=True))
        for s in src.itertuples():
            for n, e in enumerate(known[s.profile].build(s.root_url, bodies.get)):
                rows.append((s.source_id, n, e.title, e.url, e.level, e.is_article, e.parent_url, e.content_selector, e.content_url))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TOC_RAW.split(", ")])

    return sources.groupBy("source_id").cogroup(captures.groupBy("source_id")).applyInPandas(run, TOC_RAW)
