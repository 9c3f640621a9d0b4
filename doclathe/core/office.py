"""Office packages: bounded zip, namespace-aware XML; PowerPoint decks to text."""

from __future__ import annotations

import functools
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections import Counter
from dataclasses import dataclass, field
from xml.parsers import expat

from . import graphics
from . import markdown as md
from .html_text import meaningful_alt
from .options import Extract

# fixed values
MOST_INFLATED, MOST_ENTRY, SLIDE = 200_000_000, 50_000_000, (9_144_000, 6_858_000)
SPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w", "http://purl.oclc.org/ooxml/wordprocessingml/main": "w",
    "http://schemas.openxmlformats.org/presentationml/2006/main": "p", "http://purl.oclc.org/ooxml/presentationml/main": "p",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a", "http://purl.oclc.org/ooxml/drawingml/main": "a",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r", "http://purl.oclc.org/ooxml/officeDocument/relationships": "r",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel",
    "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "http://schemas.openxmlformats.org/drawingml/2006/chart": "c", "http://purl.oclc.org/ooxml/drawingml/chart": "c",
    "http://schemas.openxmlformats.org/drawingml/2006/diagram": "dgm", "http://purl.oclc.org/ooxml/drawingml/diagram": "dgm",
}
BODY_HOLDERS = ("body", "subTitle", "obj", "tbl", "chart", "clipArt", "dgm", "media", "pic")
REPEATED_SLIDES, REPEATED_SHARE = 4, 0.6
HEAD, HEAD_PACKED, PIECE = 4096, 4096, 4096
CHROME_FIELD, DEEPEST_LEVEL = r"(?i)slidenum|datetime[0-9]*|ftr|hdr", 8
# end of fixed values


class Unreadable(ValueError):
    pass


class Package:
    """Parts of a zip by name, each inflated when it is first read, within the budgets."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
            raise Unreadable(f"not a readable zip: {e}") from None
        self.content, self.left = content, MOST_INFLATED
        self.parts = {i.filename: i for i in self.zip.infolist()}  # of equal names the last

    def read(self, name: str) -> bytes | None:
        info = self.parts.get(name)
        if info is None:
            return None
        most = min(MOST_ENTRY, self.left)
        try:
            with self.zip.open(info) as f:
                data = f.read(most + 1)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError) as e:
            raise Unreadable(f"{name}: {e}") from None
        if len(data) > most:
            raise Unreadable(f"oversized: {name} inflates past the limit")
        self.left -= len(data)
        return data

    def head(self, name: str, n: int) -> bytes:
        """The first n bytes of a part, as far as its first packed ones hold them; nothing where these can't be read."""
        info = self.parts.get(name)
        if info is None or info.flag_bits & 1:
            return b""
        try:
            names, extra = struct.unpack_from("<HH", self.content, info.header_offset + 26)
            begin = info.header_offset + 30 + names + extra
            packed = self.content[begin : begin + min(info.compress_size, HEAD_PACKED)]
            if info.compress_type == zipfile.ZIP_STORED:
                return packed[:n]
            return zlib.decompressobj(-15).decompress(packed, n) if info.compress_type == zipfile.ZIP_DEFLATED else b""
        except (struct.error, zlib.error):
            return b""

    def root_attributes(self, name: str) -> dict[str, str] | None:
        """The attributes of a part's outermost tag, from the head of the part where that holds the whole tag."""
        if name not in self.parts:
            return None
        found = root_attributes(self.head(name, HEAD), whole=False)
        return found if found is not None else root_attributes(self.read(name))

    def xml(self, name: str) -> Tag | None:
        data = self.read(name)
        return None if data is None else parse_xml(data)

    def links(self, part: str, external: bool = False) -> dict[str, tuple[str, str]]:
        """Relationship id -> type and part name; or the addresses outside."""
        folder, base = posixpath.split(part)
        tree = self.xml(posixpath.join(folder, "_rels", base + ".rels"))
        out = {}
        for t in tree.kids if tree else ():
            if t.name == "rel:Relationship" and (t.attrs.get("TargetMode") == "External") == external:
                target = t.attrs.get("Target", "")
                if external:
                    out[t.attrs.get("Id", "")] = ("", target)
                    continue
                out[t.attrs.get("Id", "")] = (t.attrs.get("Type", "").rpartition("/")[2], posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target)))
        return out


class Tag:
    __slots__ = ("name", "attrs", "kids", "text")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids, self.text = name, attrs, [], ""

    def each(self, *names: str):
        return [k for k in self.kids if k.name in names]

    def first(self, *path: str):
        at = self
        for name in path:
            at = next((k for k in at.kids if k.name == name), None) if at else None
        return at

    def all(self, name: str):
        todo = [self]
        while todo:
            t = todo.pop()
            if t.name == name:
                yield t
            todo.extend(reversed(t.kids))


def _short(name: str) -> str:
    space, _, local = name.rpartition(" ")
    return f"{SPACES[space]}:{local}" if space in SPACES else local


def parse_xml(data: bytes) -> Tag:
    parser = expat.ParserCreate(namespace_separator=" ")
    top = Tag("", {})
    stack = [top]

    def start(name, attrs):
        tag = Tag(_short(name), {_short(k): v for k, v in attrs.items()})
        stack[-1].kids.append(tag)
        stack.append(tag)

    def end(_):
        tag = stack.pop()
        if tag.name == "mc:AlternateContent":  # stands for the content of its choice, or else of its fallback
            chosen = tag.first("mc:Choice") or tag.first("mc:Fallback")
            stack[-1].kids.pop()
            stack[-1].kids.extend(chosen.kids if chosen else ())

    def text(data):
        stack[-1].text += data

    def refuse(*_):
        raise Unreadable("a document type declaration isn't read")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, text, refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise Unreadable(f"malformed XML: {e}") from None
    return top.kids[0]


def root_attributes(data: bytes, whole: bool = True) -> dict[str, str] | None:
    """The attributes of the outermost tag, from as many pieces of the data as it takes to see that tag; None if it isn't in what is the head only."""
    parser, seen = expat.ParserCreate(namespace_separator=" "), []

    def start(_, attrs):
        if not seen:
            seen.append({_short(k): v for k, v in attrs.items()})

    def refuse(*_):
        raise Unreadable("a document type declaration isn't read")

    parser.StartElementHandler, parser.StartDoctypeDeclHandler = start, refuse
    try:
        for at in range(0, len(data), PIECE):
            parser.Parse(data[at : at + PIECE], False)
            if seen:
                return seen[0]
        if whole:  # the parser may have waited for more of a long tag
            parser.Parse(b"", True)
    except expat.ExpatError as e:
        if not seen:
            raise Unreadable(f"malformed XML: {e}") from None
    return seen[0] if seen else None


# PowerPoint


def pptx_slides(content: bytes, options: Extract | None = None) -> tuple[list[tuple[int, str | None, str]], list[str]]:
    """(number, title, text) of each slide in show order, and warnings."""
    options = options or Extract()
    package = Package(content)
    deck = package.xml("ppt/presentation.xml")
    if deck is None:
        raise Unreadable("ppt/presentation.xml is missing")
    links = package.links("ppt/presentation.xml")
    size = deck.first("p:sldSz")
    canvas = (int(size.attrs.get("cx", SLIDE[0])), int(size.attrs.get("cy", SLIDE[1]))) if size else SLIDE
    listed = deck.first("p:sldIdLst")
    refs = listed.kids if listed else []
    chosen, left_out = options.select(len(refs))
    notes = Notes()
    styles: dict[str, Inherited] = {}
    out, skipped = [], 0
    for number in chosen:
        part = links.get(refs[number - 1].attrs.get("r:id", ""), ("", ""))[1]
        shown = package.root_attributes(part)
        if shown is None:
            continue
        if shown.get("show") in ("0", "false") and not options.hidden_content:
            skipped += 1
            continue
        slide = package.xml(part)
        tree = slide.first("p:cSld", "p:spTree")
        reading = Reading(package, package.links(part), _inherited(package, part, styles), canvas, options, notes)
        title, text = reading.slide(tree) if tree else (None, "")
        out.append((number, title, text))
    repeated = 0
    if options.drop_running_headers:
        out, repeated = _once(out)
    told = [
        (repeated, f"{repeated} blocks repeated on most slides dropped"), (notes.images, f"{notes.images} images dropped, {notes.captions} of them captioned"), (notes.merged, f"{notes.merged} merged cells flattened"), *((1, x) for x in notes.charts),
        (skipped, f"{skipped} hidden slides skipped"), (left_out, f"{left_out} slides past the limit not read"), (out and not any(text.strip() for _, _, text in out), f"{len(out)} slides read, but no text found"),
    ]
    return out, [text for n, text in told if n]


def _once(slides: list[tuple[int, str | None, str]]) -> tuple[list[tuple[int, str | None, str]], int]:
    """Of a block that most slides have only its first copy stays; and how many went."""
    blocks = [(slide, place, block, block.strip()) for slide, (_, _, text) in enumerate(slides) for place, block in enumerate(text.split("\n\n"))]
    first, slides_of = {}, Counter({(slide, key) for slide, _, _, key in blocks if key})
    on = Counter(key for _, key in slides_of)
    for slide, place, _, key in blocks:
        first.setdefault(key, (slide, place))
    enough = max(REPEATED_SHARE * len(slides), 1) if len(slides) >= REPEATED_SLIDES else float("inf")
    stay = [(slide, block) for slide, place, block, key in blocks if on[key] < enough or first[key] == (slide, place)]
    texts = ["\n\n".join(block for at, block in stay if at == slide) for slide in range(len(slides))] if len(stay) < len(blocks) else [text for _, _, text in slides]
    return [(number, title, text) for (number, title, _), text in zip(slides, texts)], len(blocks) - len(stay)


@dataclass
class Notes:
    images: int = 0
    captions: int = 0
    merged: int = 0
    charts: dict[str, None] = field(default_factory=dict)


@dataclass
class Inherited:
    """What placeholders take from their layout, and the master's list styles by kind."""

    types: dict[str, str] = field(default_factory=dict)
    by_index: dict[str, Tag] = field(default_factory=dict)
    by_type: dict[str, Tag] = field(default_factory=dict)
    master: dict[str, Tag] = field(default_factory=dict)


def _holder(shape: Tag) -> Tag | None:
    return next((ph for kind in ("p:nvSpPr", "p:nvPicPr", "p:nvGraphicFramePr") if (ph := shape.first(kind, "p:nvPr", "p:ph"))), None)


def _inherited(package: Package, slide_part: str, known: dict[str, Inherited]) -> Inherited:
    part = next((p for kind, p in package.links(slide_part).values() if kind == "slideLayout"), "")
    if part not in known:
        found = known[part] = Inherited()
        layout = package.xml(part) if part else None
        tree = layout.first("p:cSld", "p:spTree") if layout else None
        for shape in tree.each("p:sp") if tree else ():
            if (ph := _holder(shape)) is None:
                continue
            index, kind, style = ph.attrs.get("idx"), ph.attrs.get("type"), shape.first("p:txBody", "a:lstStyle")
            if index is not None and kind is not None:
                found.types[index] = kind
            if style and index is not None:
                found.by_index[index] = style
            if style and kind is not None:
                found.by_type[kind] = style
        above = next((p for kind, p in package.links(part).values() if kind == "slideMaster"), "") if part else ""
        master = package.xml(above) if above else None
        for kind in ("title", "body", "other"):
            if style := master.first("p:txStyles", f"p:{kind}Style") if master else None:
                found.master[kind] = style
    return known[part]


def _is_item(own: Tag | None, styles: list[Tag | None], level: int) -> bool:
    """Whether a paragraph has a bullet: what is nearest to it and says something decides."""
    for says in [own, *(s.first(f"a:lvl{level + 1}pPr") for s in styles if s)]:
        if says and says.first("a:buNone"):
            return False
        if says and (says.first("a:buChar") or says.first("a:buAutoNum")):
            return True
    return False


@dataclass
class Reading:
    """One slide being read."""

    package: Package
    links: dict[str, tuple[str, str]]
    inherited: Inherited
    canvas: tuple[int, int]
    options: Extract
    notes: Notes

    def slide(self, tree: Tag) -> tuple[str | None, str]:
        found: list[tuple] = []
        self.collect(tree, (1.0, 1.0, 0.0, 0.0), found)
        # title, then subtitle and body; then from top to bottom and left to right; paint order for what has no place
        found.sort(key=functools.cmp_to_key(_before))
        title = next((re.sub(r"\s+", " ", text) for rank, _, _, text in found if rank == 0 and text), None)
        return title, "\n\n".join(f"# {text}" if rank == 0 else text for rank, _, _, text in found if text)

    def kind(self, ph: Tag | None) -> str:
        if ph is None:
            return ""
        return ph.attrs.get("type") or self.inherited.types.get(ph.attrs.get("idx", ""), "body")

    def collect(self, tree: Tag, scale: tuple, found: list) -> None:
        sx, sy, dx, dy = scale
        for k in tree.kids:
            box = k.first("p:spPr", "a:xfrm") or k.first("p:xfrm") or k.first("p:grpSpPr", "a:xfrm")
            off, ext = (box.first("a:off"), box.first("a:ext")) if box else (None, None)
            place = (_int(off, "y") * sy + dy, _int(off, "x") * sx + dx) if off else None
            if place and ext and not self.options.hidden_content:
                w, h = _int(ext, "cx") * sx, _int(ext, "cy") * sy
                if place[1] + w < 0 or place[0] + h < 0 or place[1] > self.canvas[0] or place[0] > self.canvas[1]:
                    continue
            kind = self.kind(_holder(k))
            rank = 0 if kind in ("title", "ctrTitle") else 1 if kind in ("subTitle", "body") else 2
            if k.name == "p:grpSp":
                inner = scale
                co, ce = (box.first("a:chOff"), box.first("a:chExt")) if box else (None, None)
                if off and ext and co and ce and _int(ce, "cx") and _int(ce, "cy"):
                    gx, gy = _int(ext, "cx") / _int(ce, "cx") * sx, _int(ext, "cy") / _int(ce, "cy") * sy
                    inner = (gx, gy, place[1] - _int(co, "x") * gx, place[0] - _int(co, "y") * gy)
                self.collect(k, inner, found)
            elif k.name == "p:sp" and kind not in ("dt", "ftr", "sldNum", "hdr"):
                body = k.first("p:txBody")
                found.append((rank, place, len(found), _slide_text(body, self.styles(k, kind)) if body else ""))
            elif k.name == "p:pic":
                self.notes.images += 1
                about = next(k.all("p:cNvPr"), None)
                caption = meaningful_alt(about.attrs.get("descr") or about.attrs.get("title")) if about else None
                self.notes.captions += bool(caption)
                found.append((rank, place, len(found), f"[image: {caption}]" if caption else ""))
            elif k.name == "p:graphicFrame":
                found.append((rank, place, len(found), self.frame(k)))

    def styles(self, shape: Tag, kind: str) -> list[Tag | None]:
        own, ph, by = shape.first("p:txBody", "a:lstStyle"), _holder(shape), self.inherited
        if ph is None:
            return [own, by.master.get("other")]
        role = "title" if kind in ("title", "ctrTitle") else "body" if kind in BODY_HOLDERS else "other"
        return [own, by.by_index.get(ph.attrs.get("idx", "")) or by.by_type.get(kind), by.master.get(role)]

    def part(self, tag: Tag | None, attribute: str) -> Tag | None:
        name = self.links.get(tag.attrs.get(attribute, ""), ("", ""))[1] if tag else ""
        return self.package.xml(name) if name else None

    def frame(self, frame: Tag) -> str:
        """A table, or else a chart, or else a diagram; the last two are parts of their own."""
        if table := next(frame.all("a:tbl"), None):
            return self.table(table)
        if chart := self.part(next(frame.all("c:chart"), None), "r:id"):
            text, told = graphics.chart_text(chart, self.options.chart_data)
            self.notes.charts |= dict.fromkeys(told)
            return text
        diagram = self.part(next(frame.all("dgm:relIds"), None), "r:dm") if self.options.diagram_text else None
        return graphics.diagram_text(diagram) if diagram else ""

    def table(self, table: Tag) -> str:
        rows = []
        for tr in table.each("a:tr"):
            row: list[str] = []
            for n, tc in enumerate(tr.each("a:tc")):
                self.notes.merged += max(_int(tc, "gridSpan"), _int(tc, "rowSpan")) > 1
                text = re.sub(r"\s+", " ", _slide_text(tc.first("a:txBody"), [])) if tc.first("a:txBody") else ""
                left, above = tc.attrs.get("hMerge") in ("1", "true"), tc.attrs.get("vMerge") in ("1", "true")
                row.append(row[-1] if left and row else rows[-1][n] if above and rows and n < len(rows[-1]) else text)
            rows.append(row)
        return md.render_table(rows) or "\n".join(" ".join(r) for r in rows)


def _int(tag: Tag, name: str) -> int:
    try:
        return int(tag.attrs.get(name, 0))
    except ValueError:
        return 0


def _before(a: tuple, b: tuple) -> int:
    if a[0] != b[0] or a[1] is None or b[1] is None:
        return a[0] - b[0] or a[2] - b[2]
    return -1 if (a[1], a[2]) < (b[1], b[2]) else 1


def _slide_text(body: Tag, styles: list[Tag | None]) -> str:
    lines = []
    for p in body.each("a:p"):
        runs = [r for r in p.each("a:r", "a:fld", "a:br") if r.name != "a:fld" or not re.fullmatch(CHROME_FIELD, r.attrs.get("type", ""))]
        text = "".join("\n" if r.name == "a:br" else (r.first("a:t").text if r.first("a:t") else "") for r in runs)
        if not text.strip():
            continue
        own = p.first("a:pPr")
        level = max(0, min(DEEPEST_LEVEL, _int(own, "lvl"))) if own else 0
        lines.append("  " * level + ("- " if _is_item(own, styles, level) else "") + text.strip())
    return "\n".join(lines)
