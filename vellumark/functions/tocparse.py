"""Readers of tables of contents from captured HTML and JSON. Each gives entries in order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import urldefrag, urljoin, urlparse

from vellumark.functions.bodies import js_unescape
from vellumark.functions.dom import Element, first, parse, select

Fetch = Callable[[str], str | None]


@dataclass
class Entry:
    title: str
    url: str | None
    level: int
    is_article: bool
    parent_url: str | None = None
    content_selector: str | None = None
    content_url: str | None = None


def _title(e: Element, selector: str | None = None) -> str:
    part = first(e, selector) if selector else None
    return "".join(s.strip() for s in [(part or e).text("\0")] for s in s.split("\0"))


def _events(top: Element) -> Iterable[tuple[bool, Element]]:
    """(begins, element) as the elements inside ``top`` begin and end."""
    todo: list[tuple[bool, Element]] = [(True, e) for e in reversed(top.elements())]
    while todo:
        begins, e = todo.pop()
        yield begins, e
        if begins:
            todo.append((False, e))
            todo += [(True, c) for c in reversed(e.elements())]


def sidebar(html: str | None, root_url: str, nav: str) -> list[Entry]:
    """Nested lists under ``nav``, in one pass over its tags.

    An open item is on a stack with its entry, which its first link makes; a list that begins inside turns the entry into a section. Items
    without a link before their list stay without an entry, so they add no level.
    """
    found = first(parse(html), nav)
    lists = [] if found is None else [found, *found.walk()]
    out: list[Entry] = []
    items: list[list] = []  # of each open item: its entry, and whether its list has begun
    for begins, e in _events(next((x for x in lists if x.tag == "ul"), Element("ul", {}, None))):
        if e.tag == "li":
            if begins:
                items.append([None, False])
            else:
                items.pop()
        elif begins and items and e.tag == "ul":
            items[-1][1] = True
            if items[-1][0]:
                items[-1][0].is_article = False
        elif begins and items and e.tag == "a" and e.attrs.get("href") and items[-1] == [None, False]:
            above = [i[0] for i in items if i[0]]
            items[-1][0] = Entry(_title(e), urljoin(root_url, e.attrs["href"]), len(above), True, above[-1].url if above else None)
            out.append(items[-1][0])
    return out


def tiers(fetch: Fetch, root_url: str, steps: list[tuple[str, str | None]]) -> list[Entry]:
    """Pages that lead to pages: ``steps`` has, from the root's page on, what is a link of that tier and where its title stands.

    Links are followed as they come, each URL once; those of the last tier are articles.
    """

    def links(url: str, tier: int) -> Iterable[tuple[str, str]]:
        chosen, title = steps[tier]
        return iter([(_title(e, title), urljoin(url, e.attrs["href"])) for e in select(parse(fetch(url)), chosen) if e.attrs.get("href")])

    out: list[Entry] = []
    pages: list[tuple[str | None, Iterable]] = [(None, links(root_url, 0))]
    met: set[str] = set()
    while pages:
        above, rest = pages[-1]
        title, url = next(rest, (None, None))
        if url is None:
            pages.pop()
        elif url not in met:
            met.add(url)
            tier = len(pages) - 1
            out.append(Entry(title, url, tier, tier + 1 == len(steps), above))
            if tier + 1 < len(steps):
                pages.append((url, links(url, tier + 1)))
    return out


def json_tree(data: object, base: str, children: str, titles: tuple[str, ...], href: str, items: str | None = None, hosts: set[str] | None = None, strip_query: bool = False) -> list[Entry]:
    """A nested JSON list; links off the hosts, or not http(s), make entries without a URL."""
    out: list[Entry] = []

    def url_of(value: object) -> str | None:
        if not isinstance(value, str) or not value:
            return None
        url = urljoin(base, value)
        p = urlparse(url)
        if p.scheme not in ("http", "https") or (hosts is not None and p.netloc not in hosts):
            return None
        return urldefrag(url.split("?", 1)[0] if strip_query else url)[0]

    def down(nodes: object, level: int, parent: str | None) -> None:
        for node in nodes if isinstance(nodes, list) else []:
            if isinstance(node, dict):
                url, kids = url_of(node.get(href)), node.get(children) or []
                title = next((node[t].strip() for t in titles if isinstance(node.get(t), str) and node[t].strip()), url or "")
                if title or kids:
                    out.append(Entry(title, url, level, bool(url) and not kids, parent))
                    down(kids, level + 1, url)

    down(data.get(items, []) if items and isinstance(data, dict) else data, 0, None)
    return out


def json_text(text: str | None) -> object:
    try:
        return json.loads(text or "null")
    except ValueError:
        return None


_JS = re.compile(r"""\s*(?:(?P<mark>[{}\[\]:,])|'(?P<one>(?:[^'\\]|\\.)*)'|"(?P<two>(?:[^"\\]|\\.)*)"|(?P<bare>[\w$.+-]+))""", re.S)


def js_object(text: str | None) -> dict:
    """The first object literal of a script: bare or quoted keys, strings of either quote, numbers, lists. Empty if there is none, or it doesn't end."""
    made: list = []
    key, at, text = None, (text or "").find("{"), text or ""
    while at >= 0 and (m := _JS.match(text, at)):
        at = m.end()
        mark, bare = m["mark"], m["bare"]
        if mark and mark in "}]":
            if len(made) == 1:
                return made[0]
            made.pop()
        elif mark == ",":
            key = None
        elif mark != ":":
            new = {"{": dict, "[": list}[mark]() if mark else int(bare) if bare and bare.isdigit() else bare if bare else js_unescape(m["one"] if m["one"] is not None else m["two"])
            if made and isinstance(made[-1], dict):
                if key is None:
                    key = str(new)
                    continue
                made[-1][key], key = new, None
            elif made:
                made[-1].append(new)
            if mark:
                made.append(new)
    return {}


def help_system(fetch: Fetch, root_url: str) -> list[Entry]:
    """The table of contents in a help system's data files: a system file names the tree, whose nodes point to entries of numbered files.

    The system's folder is what stands before ``/Content/``, the page's folder, or the one above. A node without an entry adds no level; an entry whose
    link is only underscores is a section without a page.
    """
    before = re.match(r"(?i)(.*?/)content/", root_url)
    homes = [h for h in (before and before[1], urljoin(root_url, "./"), urljoin(root_url, "../")) if h]
    home = next((h for h in homes if fetch(urljoin(h, "Data/HelpSystem.xml"))), None)
    named = re.search(r'\bToc="([^"]+)"', fetch(urljoin(home, "Data/HelpSystem.xml")) or "") if home else None
    if not named:
        return []
    where = urljoin(home, named[1])
    system = js_object(fetch(where))
    known: dict[tuple[int, int], tuple[str, str]] = {}
    for file in range(int(system.get("numchunks", 1))) if "prefix" in system else ():
        for href, entry in js_object(fetch(urljoin(where, f"{system['prefix']}{file}.js"))).items():
            titles = entry.get("t") or [""]
            known |= {(file, i): (href, titles[n] if n < len(titles) else titles[0]) for n, i in enumerate(entry.get("i", []))}
    out: list[Entry] = []
    todo = [(node, 0, None) for node in reversed((system.get("tree") or {}).get("n", []))]
    while todo:
        node, level, above = todo.pop()
        kids, found = node.get("n") or [], known.get((node.get("c", 0), node.get("i")))
        if found:
            href, title = found
            url = urljoin(home, href.lstrip("/")) if href.strip("_") else None
            out.append(Entry(title, url, level, bool(url) and not kids, above))
            level, above = level + 1, url
        todo += [(k, level, above) for k in reversed(kids)]
    return out


def stacked(nodes: list[tuple[str, str | None, int]], root_url: str) -> list[Entry]:
    """(title, href, level) in order: the parent is the nearest earlier node of a lower level."""
    out: list[Entry] = []
    above: list[Entry] = []
    for k, (title, href, level) in enumerate(nodes):
        while above and above[-1].level >= level:
            above.pop()
        url = urljoin(root_url, href) if href else None
        section = k + 1 < len(nodes) and nodes[k + 1][2] > level
        e = Entry(title, url, level, bool(url) and not section, next((a.url for a in reversed(above) if a.url), None))
        out.append(e)
        above.append(e)
    return out


def sitemap(xml: str | None) -> list[str]:
    return re.findall(r"<loc>\s*([^<\s]+)\s*</loc>", xml or "")


def by_path(urls: list[str], root_url: str) -> list[Entry]:
    """Levels from the URLs' paths, inside the root's host and folder; the parent is the path's folder if it is a page too."""
    root = urlparse(root_url)
    folder = root.path.rsplit("/", 1)[0] + "/"
    depth = len([s for s in folder.split("/") if s])
    kept = [u for u in dict.fromkeys(urls) if urlparse(u).netloc == root.netloc and urlparse(u).path.startswith(folder)]
    known, out = set(kept), []
    for u in kept:
        segments = [s for s in urlparse(u).path.split("/") if s]
        up = u.rstrip("/").rsplit("/", 1)[0]
        parent = up + "/" if up + "/" in known else up if up in known else None
        out.append(Entry(segments[-1] if segments else u, u, max(0, len(segments) - depth), True, parent))
    return out


def grouped(html: str | None, root_url: str, nav: str, head: str, scope: str) -> list[Entry]:
    """Headings as groups without a URL, and the links of the list after each, inside the scope; URLs end in a slash."""
    box = first(parse(html), nav)
    out: list[Entry] = []
    if box is None:
        return out
    m = re.search(scope, root_url)
    grouped_in, seen = False, set()
    for e in box.walk():
        if e.tag == head:
            out.append(Entry(_title(e), None, 0, False))
            grouped_in = True
        elif e.tag == "a" and e.attrs.get("href"):
            url = urldefrag(urljoin(root_url, e.attrs["href"]))[0]
            url = url if url.endswith("/") else url + "/"
            if url not in seen and (not m or m[1] in url):
                seen.add(url)
                out.append(Entry(_title(e), url, int(grouped_in), True))
    return out


def anchored(html: str | None, root_url: str, selector: str, heads: tuple[str, ...]) -> list[Entry]:
    """Parts of one page, each with an id: an entry for each, scoped to it."""
    base, out = urldefrag(root_url)[0], []
    for e in select(parse(html), selector):
        ident = e.attrs.get("id")
        if ident:
            head = next((h for h in e.walk() if h.tag in heads), None)
            out.append(Entry(_title(head).translate({0x200B: None, 0xFEFF: None}) if head is not None else ident, f"{base}#{ident}", 0, True, None, f"#{ident}"))
    return out


def preorder(rows: list[dict], key: Callable[[dict], tuple]) -> Iterable[tuple[dict, int, dict | None, bool]]:
    """(row, level, parent's row, whether it has children) depth first; siblings by ``key``. Rows (id, parent) without a known parent are roots; cycles are cut."""
    kids: dict = {}
    known = {r["id"] for r in rows}
    for r in rows:
        kids.setdefault(r.get("parent") if r.get("parent") in known else None, []).append(r)
    todo = [(r, 0, None) for r in sorted(kids.get(None, []), key=key, reverse=True)]
    done = set()
    while todo:
        row, level, above = todo.pop()
        if row["id"] not in done:
            done.add(row["id"])
            below = sorted(kids.get(row["id"], []), key=key, reverse=True)
            yield row, level, above, bool(below)
            todo += [(k, level + 1, row) for k in below]


def paged(fetch: Fetch, address: Callable[[int], str], name: str, more: Callable[[dict], object]) -> list[dict] | None:
    """Rows ``name`` of all pages of an API, by number from 0; None if the first page isn't there."""
    out: list[dict] = []
    n = 0
    while isinstance(data := json_text(fetch(address(n))), dict):
        rows = [r for r in data.get(name) or [] if isinstance(r, dict)]
        out += rows
        n += 1
        if not rows or not more(data):
            return out
    return out if n else None


def help_center(fetch: Fetch, root_url: str) -> list[Entry]:
    """Categories, sections in sections, and articles of a help center's API: of one category if the address names it, else of all.

    Only articles have pages. A section's articles come before its sections; articles of a category without a section come last.
    """
    m = re.search(r"(?i)^(https?://[^/]+)/hc/([a-z]{2}(?:-[a-z]{2,4})?)(?:/|$)", root_url)
    if not m:
        return []
    api, one = f"{m[1]}/api/v2/help_center/{m[2]}", re.search(r"/categories/(\d+)", root_url)
    get = lambda path, name: paged(fetch, lambda n: f"{api}/{path}.json?per_page=100&page={n + 1}", name, lambda d: d.get("next_page")) or []
    categories = [{"id": int(one[1])}] if one else [c for c in get("categories", "categories") if c.get("id") is not None]
    rows = []
    for c in categories:
        top = ("category", c["id"])
        if not one:
            rows.append({"id": top, "rank": 0, "title": c.get("name"), **_place(c)})
        for s in get(f"categories/{c['id']}/sections", "sections"):
            up = s.get("parent_section_id")
            rows.append({"id": ("section", s.get("id")), "parent": top if up is None else ("section", up), "rank": 1, "title": s.get("name"), **_place(s)})
        for a in get(f"categories/{c['id']}/articles", "articles"):
            if a.get("html_url") and a.get("id") is not None:
                loose = a.get("section_id") is None
                rows.append({"id": ("article", a["id"]), "parent": top if loose else ("section", a["section_id"]), "rank": 2 if loose else 0, "title": a.get("title") or a["html_url"], "url": a["html_url"], "body": f"{api}/articles/{a['id']}.json", **_place(a)})
    order = lambda r: (r["rank"], r["position"], (r["title"] or ""))
    return [Entry((r["title"] or "").strip(), r.get("url"), level, "url" in r, None, None, r.get("body")) for r, level, _, _ in preorder(rows, order)]


def _place(row: dict) -> dict:
    return {"position": row["position"] if isinstance(row.get("position"), int) else 0}


def wiki_space(fetch: Fetch, root_url: str) -> list[Entry]:
    """All pages of a wiki's space from its API, under their nearest ancestor; without the API the page links of the captured overview, flat, an entry a page."""
    base, space = re.match(r"(https?://[^/]+(?:/[^?#]*?)?/wiki)", root_url), re.search(r"/spaces/([^/?#]+)", root_url)
    found = None
    if base and space:
        address = lambda n: f"{base[1]}/rest/api/content?spaceKey={space[1]}&type=page&expand=ancestors,extensions.position&limit=100&start={100 * n}"
        found = paged(fetch, address, "results", lambda d: (d.get("_links") or {}).get("next"))
    rows = []
    for p in found or []:
        link, title = (p.get("_links") or {}).get("webui") or "", (p.get("title") or "").strip()
        if p.get("id") is not None and link and title:
            above = p.get("ancestors") or [{}]
            rows.append({"id": str(p["id"]), "parent": str(above[-1].get("id")), "title": title, "url": base[1] + link if link.startswith("/") else link, **_place(p.get("extensions") or {})})
    if rows:
        return [Entry(r["title"], r["url"], level, True, above["url"] if above else None) for r, level, above, _ in preorder(rows, lambda r: (r["position"], r["title"]))]
    flat: dict[str, Entry] = {}
    for e in select(parse(fetch(root_url)), "a"):
        url, title = urldefrag(urljoin(root_url, e.attrs.get("href", "")))[0].split("?", 1)[0], _title(e)
        page = re.search(r"/wiki/spaces/.*/pages/(\d+)", url)
        if page and title:
            known = flat.setdefault(page[1], Entry(title, url, 0, True))
            if len(url) > len(known.url):
                known.title, known.url = title, url
    return list(flat.values())


def api_tree(rows: list[dict], root_url: str, order: tuple[str, ...] = ("position", "title")) -> list[Entry]:
    """Flat rows (id, parent, title, url) of an API: depth first, siblings by position (missing: 0) and title."""
    out: list[Entry] = []
    address = lambda r: urljoin(root_url, r["url"]) if r and r.get("url") else None
    for r, level, above, below in preorder(rows, lambda r: (r.get(order[0]) or 0, r.get(order[1]) or "")):
        out.append(Entry(r.get("title") or "", address(r), level, bool(address(r)) and not below, address(above)))
    return out


def crawl_tree(seeds: list[tuple[str, str]], children: Callable[[str], list[tuple[str, str]]], most: int | None) -> list[Entry]:
    """Breadth first from (title, url) seeds to find each page's children, then depth first in order; each URL once, cycles cut. At most ``most`` pages are expanded (None: all)."""
    kids: dict[str, list[tuple[str, str]]] = {}
    queue, known = [u for _, u in seeds], {u for _, u in seeds}
    while queue and (most is None or len(kids) < most):
        url = queue.pop(0)
        kids[url] = children(url)
        new = [u for _, u in kids[url] if u not in known]
        known.update(new)
        queue += new
    out: list[Entry] = []
    done: set[str] = set()
    stack = [(t, u, 0, None) for t, u in seeds[::-1]]
    while stack:
        title, url, level, up = stack.pop()
        if url not in done:
            done.add(url)
            below = [c for c in kids.get(url, []) if c[1] not in done]
            out.append(Entry(title, url, level, not below, up))
            stack += [(t, u, level + 1, url) for t, u in below[::-1]]
    return out
