"""Main text of web pages by consensus of each host's container paths.

First pass: every page is parsed, its containers are scored by the text of their blocks and by link density, and the page votes for the
path of its best one (tags and classes from the root, numbers made alike). Votes are summed by host and path in Spark, and each host's
path with the most votes wins. Second pass: the page's containers on its host's winning path give the text; a page without one, or whose article element has far more, uses its own best.
Paths of equal votes: the least path.

Text leaves out menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments by readers and hidden parts: by tag and role, and
containers (never headings or paragraphs) whose class or id is, as a whole, a name of such a part. Inside an article, its own header, headings, paragraphs and tables of any name
stay. A form goes unless it holds half of the page's text, as the frame that some servers put around a page does. Character references are decoded, white space in a block becomes one space, blocks are joined by a blank line. Null html is empty and
gives an empty text; a null or odd url belongs to the host ''. Pages are read whole; repeated rows give a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.scratch import table
from vellumark.llm.tokens import texts

#: Bytes of the table of winning paths up to which it is broadcast; hosts and paths counted in a task before they are handed on.
BROADCAST, HELD = 16 << 20, 20_000
#: Elements nested deeper than this have no node of their own: their text belongs to the one above, and they are kept on a plain stack.
DEEPEST = 512

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_CONTAINER = frozenset("article body center div form main section table tbody td tr".split())
#: Part of a page's text that makes a form the page's frame, as some servers write it; part of a page's own article that the host's path has to hold to be taken.
FRAME, FAIR = 0.5, 0.3
_OUT = frozenset("script style noscript template iframe object embed svg canvas head title nav footer aside button select option textarea input label noembed noframes menu dialog audio video map".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words that class and id names of parts that aren't the article consist of, those that mean it inside an article too, and words that say nothing beside them.
_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist respond disqus reply replies cookie cookies consent gdpr notice notices alert foot footer header masthead topbar menu menus nav navbar navigation sidebar rail share sharing social related recommended recommendations promo promos promotion sponsor sponsored subscribe subscription newsletter signup popup modal overlay widget widgets pagination pager toolbar search login skip".split()
)
_OUT_INSIDE = frozenset("ad ads adv advert adverts advertisement advertisements advertising adbox adsense breadcrumb breadcrumbs comment comments commentlist respond disqus replies cookie cookies consent gdpr foot footer login menu menus nav navbar navigation notice notices sidebar share sharing signup social promo promos promotion promotions recommended recommendations related sponsored subscribe subscription newsletter popup pagination pager widget widgets".split())
_EMPTY_NAMES = frozenset("site global slot box wrap wrapper container holder block area section bar top bottom left right side primary secondary inner outer list links items group panel unit buttons form thread body main page".split())
#: Tags that a class or an id can put outside the article.
_NAMED = frozenset("article center dd details div dl dt figure li ol section span table tbody td tr ul".split()) - {"span", "li", "dt", "dd"}
_GOOD_NAMES = frozenset("article content entry post body main story text page".split())
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: What an end tag or an implied end doesn't reach beyond.
_SCOPE = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"])}
_NAME = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "up", "path", "out", "good", "inside", "links", "chars", "score", "depth", "form")

    def __init__(self, tag: str, up: Node | None, attributes: str) -> None:
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        self.out = (up.out if up else False) or tag in _OUT
        #: The outermost form around it, itself included.
        self.form = (up.form if up else None) or (self if tag == "form" else None)
        #: Whether it is an article, or a part of one.
        self.inside = bool(up and up.inside) or tag in ("article", "main")
        self.good, self.chars, self.links, self.score = tag in ("article", "main"), 0, 0, 0.0
        step = tag
        if attributes and not attributes.isspace() and tag != "a":
            at = {}
            for m in _ATTRIBUTE.finditer(attributes):
                at.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            classes = at.get("class", "").split()
            named = [_NAME.findall(_CAMEL.sub(" ", c).lower()) for c in [*classes, at.get("id", "")]]
            words = {w for n in named for w in n}
            role = at.get("role", "").lower()
            if role == "form" and not self.form:
                self.form = self
            if tag not in ("body", "html"):
                inside = bool(up and up.inside)
                bad = _OUT_INSIDE if inside else _OUT_NAMES
                style = at.get("style", "").replace(" ", "").lower()
                self.out = self.out or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
                self.out = self.out or (role in _OUT_ROLES and not (inside and role in ("alert", "complementary", "search", "banner")))
                # A table inside an article is the article's own, whatever its name.
                if tag in _NAMED and words & bad and not (inside and tag == "table"):
                    self.out = self.out or any(n and all(w in bad or w in _EMPTY_NAMES or w.isdigit() for w in n) and not bad.isdisjoint(n) for n in named)
            self.inside = self.inside or role in ("main", "article") or at.get("itemprop", "").lower() == "articlebody"
            self.good = self.good or bool(words & _GOOD_NAMES) or at.get("role", "").lower() in ("main", "article") or at.get("itemprop", "").lower() == "articlebody"
            if classes:
                step += "." + ".".join(sorted(re.sub(r"\d+", "#", c.lower()) for c in classes))
        if tag == "header" and not (up and up.inside):
            self.out = True
        above = up.path if up else ""
        if len(above) > 1000:
            above = f"~{zlib.crc32(above.encode()):x}"
        self.path = f"{above}>{step}" if above else step


class Page:
    """Blocks of text, each with the node it stands in."""

    def __init__(self, source: str) -> None:
        self.root = Node("", None, "")
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node, str]] = []
        self._links_of: list[int] = []
        self._node, self._run, self._linked = self.root, [], 0
        #: Open elements below the deepest node: tag, and whether it is what puts its text outside the article.
        self._deep: list[tuple[str, bool]] = []
        self._deep_out = 0
        self._parse(source)

    def _text(self, raw: str) -> None:
        if raw:
            node = self._node
            if not node.out and not self._deep_out:
                text = entities.unescape(raw)
                self._run.append(text)
                while node:
                    if node.tag == "a":
                        self._linked += len(text.strip())
                        break
                    node = node.up if node.tag not in _BLOCK else None

    def _end_block(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                node = self._node
                while node.tag not in _BLOCK and node.up:
                    node = node.up
                self.blocks.append((node, text))
                self._links_of.append(min(self._linked, len(text)))
                self._count(node, len(text), self._links_of[-1])
            self._run = []
        self._linked = 0

    def _count(self, node: Node | None, size: int, links: int) -> None:
        while node:
            node.chars += size
            node.links += links
            node = node.up

    def _drop_forms(self) -> None:
        """Forms go, but for one that holds most of the text: it is the page's frame, and its controls have gone already."""
        total = sum(len(t) for _, t in self.blocks)
        bad = [n.form is not None and n.form.chars < FRAME * total for n, _ in self.blocks]
        if any(bad):
            for (node, text), links, out in zip(self.blocks, self._links_of, bad, strict=True):
                if out:
                    self._count(node, -len(text), -links)
            self.blocks = [b for b, out in zip(self.blocks, bad, strict=True) if not out]

    def _close(self, to: Node) -> None:
        """Leave ``to`` and all inside it."""
        node = self._node
        while node is not to:
            if node.tag in _BLOCK:
                self._end_block()
                break
            node = node.up
        else:
            if to.tag in _BLOCK:
                self._end_block()
        self._node = to.up or self.root

    def _leave_deep(self, count: int) -> None:
        for _, out in self._deep[len(self._deep) - count :]:
            self._deep_out -= out
        del self._deep[len(self._deep) - count :]

    def _up(self, tags: frozenset, stop: frozenset) -> Node | None:
        node = self._node
        while node.up:
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
            node = node.up
        return None

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        lower = None
        for m in iter(lambda: _TOKEN.search(source, at), None):
            self._text(source[at : m.start()])
            at = m.end()
            end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if end and self._deep:
                at_deep = next((k for k, (t, _) in enumerate(reversed(self._deep), 1) if t == tag), 0)
                if at_deep:
                    if tag in _BLOCK:
                        self._end_block()
                    self._leave_deep(at_deep)
                    continue
            if end:
                found = self._up(frozenset([tag]), _SCOPE.get(tag, frozenset()) - {tag})
                if found:
                    self._close(found)
                    self._leave_deep(len(self._deep))
                elif tag in _BLOCK:
                    self._end_block()
                continue
            if tag in _BLOCK:
                self._end_block()
                p = None if self._deep else self._up(frozenset(["p"]), frozenset(["table", "td", "th", "button", "object"]))
                if p:
                    self._node = p.up or self.root
            if self._deep:
                while self._deep and self._deep[-1][0] in _CLOSES.get(tag, ()):
                    self._leave_deep(1)
            elif tag in _CLOSES:
                old = self._up(_CLOSES[tag], _SCOPE[tag] if tag in _SCOPE else frozenset())
                while old:
                    self._close(old)
                    old = self._up(_CLOSES[tag], _SCOPE[tag] if tag in _SCOPE else frozenset())
            if tag in ("td", "th", "br"):
                self._text(" ")
            if tag in _VOID:
                continue
            node = Node(tag, self._node, attributes)
            if tag in _RAW:
                lower = lower or source.lower()
                close = lower.find(f"</{tag}", at)
                at = n if close < 0 else close
                if close >= 0:
                    gt = source.find(">", close)
                    at = n if gt < 0 else gt + 1
                continue
            if attributes.endswith("/") and tag not in _BLOCK and tag != "a":
                continue
            if node.depth > DEEPEST:
                self._deep.append((tag, (node.out or tag == "form") and not self._node.out))
                self._deep_out += self._deep[-1][1]
                continue
            self._node = node
            if tag in _CONTAINER:
                self.nodes.append(node)
        self._text(source[at:])
        self._end_block()
        self._drop_forms()

    def best(self) -> Node | None:
        """An article or main element with half the text, or else the container whose own blocks and, for part, inner containers' blocks hold most unlinked text."""
        told = max((n for n in self.nodes if n.tag in ("article", "main") and not n.out), key=lambda n: n.chars, default=None)
        if told and told.chars and 2 * told.chars >= sum(len(t) for _, t in self.blocks):
            return told
        for node in self.nodes:
            node.score = 0.0
        for block, text in self.blocks:
            worth, node = len(text) + 25.0, block
            while node and worth > 1:
                if node.tag in _CONTAINER:
                    node.score += worth
                    worth *= 0.6
                node = node.up
        top, best = None, 0.0
        for node in self.nodes:
            if node.chars:
                score = node.score * (1 - node.links / node.chars) * (1.8 if node.good else 1.0) * (0.4 if node.tag == "body" else 1.0)
                if score > best:
                    top, best = node, score
        return top

    def extract(self, path: str | None) -> str:
        """The text on ``path``; of the page's best container if there is none, or if that is an article element of which the path holds no fair part (a teaser)."""
        wanted = {id(n) for n in self.nodes if n.path == path and not n.out} if path else set()
        text, top = self._within(wanted), self.best()
        own = self._within({id(top)}) if top else "\n\n".join(t for _, t in self.blocks)
        teaser = top is not None and top.tag in ("article", "main") and len(text) < FAIR * len(own)
        return own if teaser or not text else text

    def _within(self, wanted: set[int]) -> str:
        if not wanted:
            return ""
        kept = []
        for node, text in self.blocks:
            while node and id(node) not in wanted:
                node = node.up
            if node:
                kept.append(text)
        return "\n\n".join(kept)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, str], int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        cols = [[h for h, _ in seen], [p for _, p in seen], list(seen.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "path", "votes"])

    for batch in batches:
        hosts = batch.column(0).to_pylist()
        for k, some in texts(batch, 1, 200):
            for j, source in enumerate(some):
                top = Page(source or "").best()
                if top:
                    seen[hosts[k + j], top.path] += 1
        if len(seen) >= HELD:
            yield out()
            seen.clear()
    yield out()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(3).to_pylist()
        for k, some in texts(batch, 2, 500):
            found = [Page(s or "").extract(p) for s, p in zip(some, paths[k : k + 500], strict=True)]
            part = batch.slice(k, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path string, votes long")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = table(summed.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("w")).select("host", F.col("w.path").alias("path")), "paths")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    # A larger table is joined by host, where adaptive execution splits a host with very many pages.
    side = F.broadcast(winners) if size <= BROADCAST else winners
    joined = rows.join(side, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
