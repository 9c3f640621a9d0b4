"""Word packages to text, by way of HTML: headings, lists, tables, links, notes."""

from __future__ import annotations

import html
import itertools
import re

from .html_text import html_to_text
from .office import Package, Tag, Unreadable

# fixed values
MAIN, WIDEST = "word/document.xml", 64
PASSED_THROUGH = ("w:sdt", "w:sdtContent", "w:ins", "w:smartTag", "w:fldSimple", "w:customXml", "w:moveTo")
# end of fixed values


def docx(content: bytes) -> tuple[str, list[str]]:
    package = Package(content)
    tree = package.xml(MAIN)
    body = tree.first("w:body") if tree else None
    if body is None:
        raise Unreadable(f"{MAIN} is missing")
    text, captions, merged, images = Writer(package).text(body)
    told = [(images, f"{images} images dropped, {captions} of them captioned"), (merged, f"{merged} merged cells flattened")]
    return text, [x for n, x in told if n]


def _value(tag: Tag | None, *path: str) -> str | None:
    found = tag.first(*path) if tag else None
    return found.attrs.get("w:val", "") if found else None


def _on(props: Tag | None, name: str) -> bool:
    value = _value(props, name)
    return value is not None and value not in ("0", "false", "none", "off")


class Writer:
    def __init__(self, package: Package):
        self.outside = package.links(MAIN, external=True)
        styles, numbers = package.xml("word/styles.xml"), package.xml("word/numbering.xml")
        self.styles = {s.attrs.get("w:styleId", ""): s for s in styles.each("w:style")} if styles else {}
        kinds = {a.attrs.get("w:abstractNumId"): {x.attrs.get("w:ilvl"): _value(x, "w:numFmt") for x in a.each("w:lvl")} for a in (numbers.each("w:abstractNum") if numbers else ())}
        self.numbers = {n.attrs.get("w:numId"): kinds.get(_value(n, "w:abstractNumId"), {}) for n in (numbers.each("w:num") if numbers else ())}
        self.notes: list[str] = []
        self.images = self.captions = 0
        self.bodies = {}
        for kind in ("footnote", "endnote"):
            notes = package.xml(f"word/{kind}s.xml")
            self.bodies[kind] = {n.attrs.get("w:id"): n for n in notes.each(f"w:{kind}")} if notes else {}

    def text(self, body: Tag) -> tuple[str, int, int, int]:
        source = self.blocks(body)
        if self.notes:
            source += "<ol>" + "".join(f"<li>{n}</li>" for n in self.notes) + "</ol>"
        text, _, merged = html_to_text(source)
        return text, self.captions, merged, self.images

    def blocks(self, parent: Tag) -> str:
        out, lists = [], []  # lists: the open ones, (level, tag)

        def close(to: int) -> None:
            while len(lists) > to:
                out.append(f"</li></{lists.pop()[1]}>")

        for k in self.flat(parent):
            if k.name == "w:tbl":
                close(0)
                out.append(self.table(k))
                continue
            inner = self.inline(k)
            style = self.styles.get(_value(k, "w:pPr", "w:pStyle") or "")
            number = k.first("w:pPr", "w:numPr") or (style.first("w:pPr", "w:numPr") if style else None)
            if not inner.strip():
                continue
            if number is None or _value(number, "w:numId") == "0":
                close(0)
                named = (_value(style, "w:name") if style else None) or _value(k, "w:pPr", "w:pStyle") or ""
                level = re.fullmatch(r"(?i)heading\s*([1-6])", named)
                tag = f"h{level[1]}" if level else "p"
                out.append(f"<{tag}>{inner}</{tag}>")
                continue
            at = _value(number, "w:ilvl") or "0"
            kind = self.numbers.get(_value(number, "w:numId"), {}).get(at)
            tag, depth = "ul" if kind in (None, "bullet", "none") else "ol", int(at) if at.isdecimal() else 0
            while lists and lists[-1][0] > depth:
                close(len(lists) - 1)
            if lists and lists[-1] == (depth, tag):
                out.append("</li><li>")
            else:
                if lists and lists[-1][0] == depth:
                    close(len(lists) - 1)
                lists.append((depth, tag))
                out.append(f"<{tag}><li>")
            out.append(inner)
        close(0)
        return "".join(out)

    def flat(self, parent: Tag):
        """Paragraphs and tables, also those within wrappers."""
        for k in parent.kids:
            if k.name in ("w:p", "w:tbl"):
                yield k
            elif k.name in PASSED_THROUGH:
                yield from self.flat(k)

    def inline(self, paragraph: Tag) -> str:
        """Runs as HTML; neighbours of one kind stand in one tag."""
        out = []
        for (bold, slant, address), parts in itertools.groupby(self.runs(paragraph, None), lambda r: r[:3]):
            inner = "".join(p[3] for p in parts)
            if inner.strip():
                inner = f"<em>{inner}</em>" if slant else inner
                inner = f"<strong>{inner}</strong>" if bold else inner
                inner = f'<a href="{html.escape(address)}">{inner}</a>' if address else inner
            out.append(inner)
        return "".join(out)

    def runs(self, parent: Tag, address: str | None):
        for k in parent.kids:
            if k.name == "w:r":
                props = k.first("w:rPr")
                if not _on(props, "w:vanish"):
                    yield _on(props, "w:b"), _on(props, "w:i"), address, "".join(map(self.piece, k.kids))
            elif k.name == "w:hyperlink":
                yield from self.runs(k, self.outside.get(k.attrs.get("r:id", ""), ("", ""))[1] or address)
            elif k.name in PASSED_THROUGH:
                yield from self.runs(k, address)

    def piece(self, k: Tag) -> str:
        if k.name == "w:t":
            return html.escape(k.text, quote=False)
        if k.name in ("w:br", "w:cr"):
            return "<br>"
        if k.name == "w:tab":
            return "\t"
        if k.name == "w:noBreakHyphen":
            return "‑"
        if k.name in ("w:drawing", "w:pict"):
            about = next(k.all("docPr"), None)
            alt = (about.attrs.get("descr") or about.attrs.get("title") or "") if about else ""
            self.images += 1
            shown = html_to_text(f'<img alt="{html.escape(alt)}">')[0]
            self.captions += bool(shown)
            inside = "".join(self.blocks(t) for t in k.all("w:txbxContent"))
            return f'<img alt="{html.escape(alt)}">{inside}'
        if k.name in ("w:footnoteReference", "w:endnoteReference"):
            note = self.bodies[k.name[2:].removesuffix("Reference")].pop(k.attrs.get("w:id"), None)  # each once, so none within itself
            if note is None:
                return ""
            at = len(self.notes)
            self.notes.append("")
            self.notes[at] = " ".join(self.inline(p).strip() for p in self.flat(note)) + " ↑"
            return f"[{at + 1}]"
        return ""

    def table(self, table: Tag) -> str:
        """Cells that go on below are one, with a span."""
        grid: dict[int, list] = {}  # column -> the cell that may go on there: [span, rows, html]
        rows = []
        for tr in table.each("w:tr"):
            column, row = 0, []
            for tc in tr.each("w:tc"):
                span = _value(tc, "w:tcPr", "w:gridSpan") or "1"
                span = max(1, min(WIDEST, int(span))) if span.isdecimal() else 1
                goes_on = _value(tc, "w:tcPr", "w:vMerge")
                if goes_on is not None and goes_on != "restart" and column in grid:
                    grid[column][1] += 1
                else:
                    cell = [span, 1, self.blocks(tc)]
                    row.append(cell)
                    grid.pop(column, None)
                    if goes_on is not None:
                        grid[column] = cell
                column += span
            rows.append(row)
        span = lambda name, n: f' {name}="{n}"' if n > 1 else ""
        return "<table>" + "".join("<tr>" + "".join(f"<td{span('colspan', c[0])}{span('rowspan', c[1])}>{c[2]}</td>" for c in row) + "</tr>" for row in rows) + "</table>"
