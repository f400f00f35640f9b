"""Converted PDF documents: headings, segments, images in Markdown, and quality flags of segments."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass

_ATX = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_DATA_IMAGE = re.compile(r"!\[([^\]]*)\]\(data:image/([a-zA-Z0-9.+-]+);base64,([^)]*)\)")
_FILE_IMAGE = re.compile(r"!\[([^\]]*)\]\((?!data:|https?:)([^)\s]+)\)")
#: Below this share of the page's raw text (if that is longer than SPARSE_FROM) a segment is sparse.
SPARSE, SPARSE_FROM = 0.5, 200


@dataclass
class Segment:
    title: str
    level: int
    path: list[str]
    body: str
    start_page: int | None = None
    end_page: int | None = None


def data_images(md: str) -> tuple[str, dict[str, bytes]]:
    """Inline images as files named by their hash; equal ones once."""
    files: dict[str, bytes] = {}

    def put(m: re.Match) -> str:
        try:
            data = base64.b64decode(m[3], validate=False)
        except ValueError:
            return m[0]
        name = hashlib.sha256(data).hexdigest()[:16] + ".png"
        files.setdefault(name, data)
        return f"![{m[1]}]({name})"

    return _DATA_IMAGE.sub(put, md), files


def file_images(md: str, load) -> tuple[str, dict[str, bytes]]:
    """The same for files that ``load(path)`` finds; others stay."""
    files: dict[str, bytes] = {}

    def put(m: re.Match) -> str:
        data = load(m[2])
        if data is None:
            return m[0]
        name = hashlib.sha256(data).hexdigest()[:16] + ".png"
        files.setdefault(name, data)
        return f"![{m[1]}]({name})"

    return _FILE_IMAGE.sub(put, md), files


def headings(converted: str | None) -> list[tuple[str, int | None]]:
    """(text, page from 0) of a converter's section headers and titles."""
    data = json.loads(converted or "{}")
    return [(t.get("text") or "", t["prov"][0]["page_no"] - 1 if t.get("prov") else None) for t in data.get("texts", []) if t.get("label") in ("section_header", "title")]


def table_pages(converted: str | None) -> set[int]:
    data = json.loads(converted or "{}")
    return {p["page_no"] - 1 for t in data.get("tables", []) for p in t.get("prov", [])}


def _flat(s: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", s.lower()).split())


def split(md: str, outline: list[tuple[int, str, int | None]] | None = None, titles: list[tuple[str, int | None]] | None = None) -> list[Segment]:
    """Cut at the outline's (level, title, page) entries as they match headings going forward; else at the converter's headings; else at
    every heading; else not at all. Text before the first cut is dropped, and entries without a match are skipped."""
    lines = md.split("\n")
    at = [(k, m[2]) for k, s in enumerate(lines) if (m := _ATX.match(s))]
    wanted = outline or [(1, t, p) for t, p in titles or []]
    cuts: list[tuple[int, int, str, int | None]] = []
    n = 0
    for level, title, page in wanted:
        want = _flat(title)
        hit = next((k for k in range(n, len(at)) if want and (_flat(at[k][1]) == want or want in _flat(at[k][1]) or (_flat(at[k][1]) and _flat(at[k][1]) in want))), None)
        if hit is not None:
            cuts.append((at[hit][0], level, title, page))
            n = hit + 1
    if not cuts:
        cuts = [(k, 1, t, None) for k, t in at]
    if not cuts:
        return [Segment("Document", 1, ["Document"], md.strip())]
    out: list[Segment] = []
    stack: list[str] = []
    for k, (start, level, title, page) in enumerate(cuts):
        end = cuts[k + 1][0] if k + 1 < len(cuts) else len(lines)
        stack = [*stack[: level - 1], title]
        following = cuts[k + 1][3] if k + 1 < len(cuts) else None
        last = max(page, following - 1) if page is not None and following is not None else None
        out.append(Segment(title, level, list(stack), "\n".join(lines[start:end]).strip(), page, last))
    return out


def ragged_table(md: str) -> bool:
    """Some table's rows don't all have as many cells as its header."""
    width = None
    for line in md.split("\n"):
        if line.lstrip().startswith("|"):
            cells = len(re.split(r"(?<!\\)\|", line.strip().strip("|")))
            if width is not None and cells != width:
                return True
            width = cells if width is None else width
        else:
            width = None
    return False


def segment_flags(md: str, has_table: bool, raw: str) -> list[str]:
    flags = ["ragged_table"] if ragged_table(md) else []
    if has_table and "|" not in md:
        flags.append("missing_table")
    if len(raw) > SPARSE_FROM and len(md) < SPARSE * len(raw):
        flags.append("sparse_text")
    return flags
