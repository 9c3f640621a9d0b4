"""Laid-out lines of a page: what lines up in columns is fenced, indents that come from coordinates go."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

from . import markdown as md
from .pages import upper_median

# fixed values
GRID_ROWS, FIELDS, DRIFT, ALIGNED_SHARE, WIDE_GAP = 3, 2, 2, 0.7, 4
NESTED_LEVELS, INDENT_UNIT = 2, 2
HYPHENATED = r"([A-Za-z]{2,})-\n([a-z]+)"
LIST_MARKER = r"(?i)(?:[-*+•‣◦·]|[0-9]+[.)]|[a-z][.)])[ \t]"
# end of fixed values


def dehyphenate(text: str) -> str:
    return re.sub(HYPHENATED, r"\1\2", text)


def _fields(line: str) -> int:
    return len(re.split(r"\s{2,}", line.strip())) if line.strip() else 0


def is_grid(rows: list[str]) -> bool:
    """Rows of about as many fields each, or with wide gaps, with a column that most of them share."""
    if len(rows) < GRID_ROWS:
        return False
    need = len(rows) * ALIGNED_SHARE
    gaps = [len(g) for r in rows for g in re.findall(" {2,}", r.strip())]
    if max(Counter(map(_fields, rows)).values()) < need and not (gaps and upper_median(gaps) >= WIDE_GAP):
        return False
    starts = [[m.end() for m in re.finditer(r"\S {2,}(?=\S)", r)] for r in rows]
    near = Counter(at for row in starts for at in {s + d for s in row for d in range(-DRIFT, DRIFT + 1)})
    return any(near[s] >= need for row in starts for s in row)


def fence_grids(text: str) -> tuple[str, int]:
    """The text with its grids in fences, and how many there are."""
    out: list[str] = []
    count = 0
    for several, lines in itertools.groupby(text.split("\n"), lambda x: _fields(x) >= FIELDS):
        rows = list(lines)
        if several and is_grid(rows):
            count += 1
            rows = ([""] if out and out[-1] else []) + [md.fenced("\n".join(rows)), ""]
        out += rows
    return "\n".join(out), count


def _nests(block: list[str]) -> bool:
    depths = {len(x) - len(x.lstrip(" ")) for x in block} - {0}
    return len(depths) >= NESTED_LEVELS and math.gcd(*depths) >= INDENT_UNIT


def flatten_indents(text: str) -> str:
    """Indents stay in fences, on list items and in blocks whose depths are multiples of one unit."""
    out: list[str] = []
    fence = ""
    block: list[str] = []
    for line in [*text.split("\n"), ""]:
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if not fence and not mark and line.strip():
            block.append(line)
            continue
        out += block if _nests(block) else [x if re.match(LIST_MARKER, x.lstrip()) else x.lstrip() for x in block]
        block = []
        out.append(line)
        if fence:
            fence = "" if mark and mark[1].startswith(fence) and line.strip() == mark[1] else fence
        elif mark:
            fence = mark[1]
    return "\n".join(out[:-1])
