"""A small HTML tree with the selectors that content scoping uses, and conversion to Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("article aside blockquote dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style head title noscript template".split())
_ENDS_P = BLOCK - frozenset("li dd dt td th tr tbody thead tfoot".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """All elements inside, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def text(self, between: str = "") -> str:
        parts, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                parts.append(c)
            else:
                stack += reversed(c.children)
        return between.join(parts)

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def html(self) -> str:
        return "".join(escape(c, quote=False) if isinstance(c, str) else c.outer() for c in self.children)

    def outer(self) -> str:
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{self.html()}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def _leave(self, tags: tuple, stop: tuple) -> None:
        e = self.at
        while e.parent and e.tag not in stop:
            if e.tag in tags:
                self.at = e.parent
                return
            e = e.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._leave(("p",), ("table", "td", "th"))
        if tag in _SIBLINGS:
            self._leave(_SIBLINGS[tag], ("ul", "ol", "dl", "table", "select") + (("tr",) if tag in ("td", "th") else ()))
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent:
            if e.tag == tag:
                self.at = e.parent
                return
            e = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:.-]+)(?:(?P<op>[*^$~]?=)\s*[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]")


def _fits(e: Element, compound: str) -> bool:
    at = 0
    for m in _SIMPLE.finditer(compound):
        if m.start() != at:
            raise ValueError(f"selector: {compound}")
        at = m.end()
        if m["tag"]:
            ok = m["tag"] == "*" or e.tag == m["tag"].lower()
        elif m["id"]:
            ok = e.attrs.get("id") == m["id"]
        elif m["cls"]:
            ok = m["cls"] in e.classes
        else:
            have = e.attrs.get(m["attr"])
            val = m["val"]
            ok = have is not None and (val is None or {"=": have == val, "*=": val in have, "^=": have.startswith(val), "$=": have.endswith(val), "~=": val in have.split()}[m["op"]])
        if not ok:
            return False
    return at == len(compound)


def _steps(selector: str) -> list[tuple[str, str]]:
    """[(combinator, compound)] from the last to the first."""
    parts = re.findall(r"(\s*>\s*|\s+)?((?:\[[^\]]*\]|[^\s>\[])+)", selector.strip())
    return [(c.strip() or " ", s) for c, s in parts][::-1]


def _matches(e: Element | None, steps: list[tuple[str, str]]) -> bool:
    if not _fits(e, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    up = e.parent
    while up is not None and up.tag:
        if _matches(up, steps[1:]):
            return True
        if steps[0][0] == ">":
            return False
        up = up.parent
    return False


def select(root: Element, selector: str) -> list[Element]:
    alternatives = [_steps(s) for s in selector.split(",") if s.strip()]
    return [e for e in root.walk() if any(_matches(e, s) for s in alternatives)]


def first(root: Element, selector: str) -> Element | None:
    return next(iter(select(root, selector)), None)


def strip_selectors(html: str | None, selectors: list[str] | None) -> str | None:
    if not html or not selectors:
        return html
    root = parse(html)
    for s in selectors:
        for e in select(root, s):
            e.remove()
    return root.html()


def scope_content(html: str | None, url: str, include: list[str], exclude: list[str] | None = None) -> str | None:
    """The outermost elements that the include selectors match, in selector order, less what the exclude selectors match; image URLs absolute."""
    root = parse(html)
    found: list[Element] = []
    for s in include:
        found += [e for e in select(root, s) if not any(e is f for f in found)]
    own = {id(e) for e in found}

    def inner(e: Element) -> bool:
        up = e.parent
        while up:
            if id(up) in own:
                return True
            up = up.parent
        return False

    outer = [e for e in found if not inner(e)]
    if not outer:
        return None
    box = Element("", {}, None)
    for e in outer:
        e.remove()
        e.parent = box
        box.children.append(e)
    for s in exclude or []:
        for e in select(box, s):
            e.remove()
    for e in box.walk():
        if e.tag == "img" and e.attrs.get("src"):
            e.attrs["src"] = urljoin(url, e.attrs["src"])
    return box.html().strip() or None


def _inline(e: Element) -> str:
    out = []
    for c in e.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
        elif c.tag in SILENT:
            continue
        else:
            body = _inline(c)
            core = body.strip()
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}.get(c.tag)
            if c.tag == "a" and core and c.attrs.get("href"):
                body = body.replace(core, f"[{core}]({c.attrs['href']})", 1)
            elif mark and core:
                body = body.replace(core, f"{mark}{core}{mark}", 1)
            out.append(body)
    return "".join(out)


def _table(e: Element) -> list[str]:
    rows = [r for r in e.walk() if r.tag == "tr"]
    cells = [[_inline(c).strip().replace("\n", " ").replace("|", "\\|") for c in r.elements() if c.tag in ("td", "th")] for r in rows]
    cells = [r for r in cells if r]
    if not cells:
        return []
    width = max(map(len, cells))
    head = any(c.tag == "th" for c in rows[0].elements()) or any(x.tag == "thead" for x in e.walk())
    if not head:
        cells.insert(0, [""] * width)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
    lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return lines


def _blocks(e: Element, depth: int = 0) -> list[str]:
    out: list[str] = []
    run = Element("", {}, None)

    def flush() -> None:
        text = _inline(run).strip()
        if text:
            out.append(text)
        run.children = []

    for c in e.children:
        if isinstance(c, str) or c.tag not in BLOCK and not any(x.tag in BLOCK for x in c.walk()):
            run.children.append(c)
            continue
        flush()
        if c.tag in SILENT:
            continue
        if re.fullmatch("h[1-6]", c.tag):
            text = _inline(c).strip()
            out += [f"{'#' * int(c.tag[1])} {text}"] if text else []
        elif c.tag == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.tag == "hr":
            out.append("---")
        elif c.tag == "blockquote":
            out.append("\n".join(f"> {s}".rstrip() for s in "\n\n".join(_blocks(c)).split("\n")))
        elif c.tag in ("ul", "ol"):
            lines = []
            for n, item in enumerate(x for x in c.elements() if x.tag == "li"):
                mark = f"{n + 1}. " if c.tag == "ol" else "* "
                body = _blocks(item, depth + 1)
                tight = "\n".join(body)
                lines.append(mark + tight.replace("\n", "\n" + " " * len(mark)))
            out.append("\n".join(lines))
        elif c.tag == "table":
            caption = next((x for x in c.elements() if x.tag == "caption"), None)
            if caption is not None:
                text = " ".join(caption.text(" ").split())
                caption.remove()
                out += [f"**{text}**"] if text else []
            out += ["\n".join(_table(c))] if _table(c) else []
        else:
            out += _blocks(c, depth)
    flush()
    return out


def html_to_markdown(html: str | None) -> str:
    """A caption becomes a bold paragraph; a table without a header row gets an empty one, so that it stays a table."""
    return "\n\n".join(b for b in _blocks(parse(html)) if b).strip()
