"""Positioned text items of a page to lines in reading order, and lines to paragraphs."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import numpy as np

from .clean import _INVISIBLE

# fixed values
SAME_BASELINE, PARAGRAPH_GAP, SHORT_LINE, INDENT, TIGHT, OVERLAP = 0.5, 1.2, 0.12, 6, 0.3, 1
GUTTER, CLEAR_SHARE, COLUMN_LINES, COLUMN_CHARS, MARGIN_SHARE = 18, 0.8, 3, 20, 0.12
SENTENCE_END = r"[.!?…][)\]\"'’”]?\Z"
RUNNING_SHARE, RUNNING_PAGES = 0.6, 4
COUNTER = r"\bpage\s+[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?|\b[0-9]+\s*(?:of|/)\s*[0-9]+\b"
COUNTER_ALONE = r"[\[(]?[-–—]?\s*[0-9]+\s*[-–—]?[)\]]?"
# end of fixed values


@dataclass(frozen=True)
class Item:
    text: str
    x: float
    y: float
    width: float
    height: float

    @property
    def right(self) -> float:
        return self.x + self.width


@dataclass(frozen=True)
class Line:
    y: float
    left: float
    right: float
    text: str


def upper_median(values) -> float:
    ordered = sorted(values)
    return ordered[len(ordered) // 2] if ordered else 0


def rows_of(items: list[Item], tolerance: float) -> list[list[Item]]:
    """Items on one baseline, from the top; each row is measured from its first item."""
    rows: list[list[Item]] = []
    for item in sorted(items, key=lambda i: (-i.y, i.x)):
        if rows and abs(rows[-1][0].y - item.y) <= tolerance:
            rows[-1].append(item)
        else:
            rows.append([item])
    return rows


def _line(row: list[Item], origin: float, char: float) -> Line:
    """A row on a grid of characters."""
    out, edge = "", None
    for item in sorted(row, key=lambda i: i.x):
        column = max(0, math.floor((item.x - origin) / char + 0.5))
        if column > len(out) or not out:
            out = out.ljust(column)
        elif edge is not None and not -char * OVERLAP <= item.x - edge <= char * TIGHT:
            out += " "
        out += item.text
        edge = item.right
    return Line(row[0].y, min(i.x for i in row), max(i.right for i in row), out.rstrip())


def _gutter(rows: list[list[Item]]) -> tuple[float, float] | None:
    """The one band between two columns of running text, if there is just one.

    The edges of all items cut the page into bands. A table of rows and wide bands tells which rows cross a band, and how
    many characters each row has on either side of it.
    """
    if len(rows) < COLUMN_LINES:
        return None
    items = [(n, i) for n, row in enumerate(rows) for i in row]
    edges = np.unique([e for _, i in items for e in (i.x, i.right)])
    wide = np.flatnonzero(np.diff(edges) >= GUTTER)
    start, end = edges[wide], edges[wide + 1]
    crossed, left, right = (np.zeros((len(rows), len(wide)), np.int64) for _ in range(3))
    for n, i in items:
        before, after = i.right <= start, i.x >= end
        crossed[n] |= ~before & ~after & (i.x < end) & (i.right > start)
        left[n] += before * len(i.text)
        right[n] += after * len(i.text)
    open_ = crossed.sum(0) <= math.floor(len(rows) * (1 - CLEAR_SHARE))

    def column(chars: np.ndarray) -> bool:
        there = chars[chars > 0].tolist()
        return len(there) >= COLUMN_LINES and upper_median(there) >= COLUMN_CHARS

    found = [k for k in np.flatnonzero(open_) if column(left[:, k]) and column(right[:, k])]
    return (float(start[found[0]]), float(end[found[0]])) if len(found) == 1 else None


def lay_out(items: list[Item], height: float) -> list[Line]:
    items = [Item(_INVISIBLE.sub("", unicodedata.normalize("NFKC", i.text)), i.x, i.y, i.width, i.height) for i in items]
    items = [i for i in items if i.text.strip()]
    if not items:
        return []
    char = upper_median(i.width / len(i.text) for i in items if i.width > 0) or 1
    rows = rows_of(items, (upper_median(i.height for i in items if i.height > 0) or 1) * SAME_BASELINE)
    margin = height * MARGIN_SHARE
    head, body, foot = [], [], []
    for row in rows:
        (head if row[0].y >= height - margin else foot if row[0].y <= margin else body).append(row)
    band = _gutter(body)
    groups = [rows]
    if band:
        left = [[i for i in r if i.x < band[1]] for r in body]
        right = [[i for i in r if i.x >= band[1]] for r in body]
        groups = [head, [r for r in left if r], [r for r in right if r], foot]
    out = []
    for group in filter(None, groups):
        origin = min(i.x for row in group for i in row)
        out += [_line(row, origin, char) for row in group]
    return out


def paragraphs(lines: list[Line]) -> str:
    """Lines with an empty one where a paragraph ends.

    Lines of a paragraph follow each other downwards, no wider apart than usual; and a full last line, or a next one that
    isn't indented, doesn't end it either.
    """
    steps = [a.y - b.y for a, b in zip(lines, lines[1:])]
    usual = upper_median(s for s in steps if s > 0)
    widest = usual * PARAGRAPH_GAP if usual > 0 else math.inf
    margin = upper_median(x.right for x in lines)
    width = margin - upper_median(x.left for x in lines)
    full = margin - width * SHORT_LINE if width > 0 else -math.inf
    out = [x.text for x in lines[:1]]
    for step, above, line in zip(steps, lines, lines[1:]):
        ended = above.right < full and re.search(SENTENCE_END, above.text.rstrip())
        if not 0 <= step <= widest or ended and line.left - above.left > INDENT:
            out.append("")
        out.append(line.text)
    return "\n".join(out)


def running_key(y: float, text: str) -> str:
    """What a header or footer has in common from page to page: about the same height, the same words but for counters."""
    text = re.sub(r"\s+", " ", text).strip()
    words = "#" if re.fullmatch(COUNTER_ALONE, text) else re.sub(COUNTER, "#", text, flags=re.I)
    return f"{math.floor(y / 3 + 0.5)}|{words}"


def suppress_running(pages: list[tuple[float, list[Line]]]) -> tuple[list[list[Line]], int]:
    """The lines of (height, lines) pages without headers and footers seen before, and how many went."""
    def edge(height: float, line: Line) -> bool:
        return line.y <= height * MARGIN_SHARE or line.y >= height * (1 - MARGIN_SHARE)

    on: dict[str, set[int]] = {}
    for n, (height, lines) in enumerate(pages):
        for x in lines:
            if edge(height, x):
                on.setdefault(running_key(x.y, x.text), set()).add(n)
    running = {k: min(seen) for k, seen in on.items() if len(pages) >= RUNNING_PAGES and len(seen) >= RUNNING_SHARE * len(pages)}
    out = [[x for x in lines if not edge(height, x) or running.get(running_key(x.y, x.text), n) == n] for n, (height, lines) in enumerate(pages)]
    return out, sum(len(lines) for _, lines in pages) - sum(map(len, out))
