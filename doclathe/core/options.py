"""Options of cleaning and their presets."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from . import fixed


@dataclass(frozen=True)
class Clean:
    normalize_unicode: bool = True
    strip_invisible: bool = True
    ascii_punctuation: bool = True
    strip_emoji: bool = False
    tabs_to_spaces: bool = True
    collapse_spaces: bool = True
    trim_lines: bool = True
    max_blank_lines: float = 1
    unwrap: bool = True
    preserve_code: bool = True
    strip_markdown: bool = False
    compact_tables: bool = True
    unescape_markdown: bool = True
    strip_media: bool = True
    transcript: bool = False

    @property
    def blanks(self) -> int:
        n = self.max_blank_lines
        return max(0, math.floor(n)) if math.isfinite(n) else 1


def preset(name: str = "balanced", **explicit) -> Clean:
    """A preset with explicit choices on top; None chooses nothing."""
    at = ("safe", "balanced", "aggressive").index(name)
    chosen = {f.name: fixed.PRESETS[f.name][at] for f in fields(Clean)}
    return Clean(**chosen | {k: v for k, v in explicit.items() if v is not None})


@dataclass(frozen=True)
class Extract:
    """How documents are read: by default what can be seen, once, in careful order."""

    pages: tuple[tuple[int, int], ...] = ()
    section_headings: bool = False
    drop_running_headers: bool = True
    dehyphenate: bool = False
    preserve_tables: bool = True
    chart_data: bool = False
    diagram_text: bool = True
    hidden_content: bool = False
    most_bytes: int = fixed.MOST_INPUT_BYTES
    most_pages: int = fixed.MOST_PAGES

    def select(self, total: int) -> tuple[list[int], int]:
        """The numbers of the pages or slides to read, and how many the limit leaves out."""
        chosen = [n for n in range(1, total + 1) if not self.pages or any(a <= n <= b for a, b in self.pages)]
        return chosen[: self.most_pages], max(0, len(chosen) - self.most_pages)


def parse_ranges(spec: str) -> list[tuple[int, int]]:
    """'3-7,12' as spans; ValueError for anything that isn't a page or an ascending span from 1."""
    out = []
    for part in spec.split(","):
        a, dash, b = (x.strip() for x in part.strip().partition("-"))
        b = b if dash else a
        if not (a.isascii() and a.isdigit() and b.isascii() and b.isdigit() and 1 <= int(a) <= int(b)):
            raise ValueError(f"{part.strip()!r} is not a page or page range like 3 or 3-7")
        out.append((int(a), int(b)))
    return out
