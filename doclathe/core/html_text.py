"""HTML to compact Markdown-like text, by a walk over the tree."""

from __future__ import annotations

import html.entities
import re

from . import markdown as md
from .dom import Node, parse

# fixed values
SKIPPED = frozenset("script style head noscript template svg picture canvas video audio map object".split())
BREAKING = frozenset("p div section article blockquote table tbody thead tfoot dl dt dd form header footer main nav aside figure figcaption address fieldset hr".split())
ENTITY_NAMES = """amp lt gt quot apos nbsp copy reg trade hellip mdash ndash lsquo rsquo ldquo rdquo sbquo bdquo laquo raquo bull middot
lsaquo rsaquo sdot asymp deg plusmn times divide frac12 frac14 frac34 sup2 sup3 micro para sect dagger Dagger permil prime Prime euro
pound yen cent larr rarr harr darr uarr ne le ge minus shy ensp emsp thinsp zwnj zwj iexcl iquest eacute egrave agrave ccedil uuml ouml
auml szlig ntilde check star""".split()
CODE_HOSTS = ("gist.github.com", "codepen.io", "jsfiddle.net", "codesandbox.io", "stackblitz.com", "replit.com")
CODE_CLASS = r"(?:^|[-_ ])(?:code|highlight|snippet|sourcecode|codeblock)(?:[-_ ]|$)"
TRIVIAL_ALT = r"image\s*\d*|images|avatar|photo|picture|logo|icon|emoji|graphic|spacer|banner|cid:.*"
IMAGE_FILE = r"[\w %.-]+\.(?:png|jpe?g|gif|webp|svg|bmp|tiff?|ico)"
DISCLAIMER = r"[\s,.;:—-]*AI[- ]generated content may be incorrect[.\s]*$"
MOST_SPAN = 64
LANGUAGE_CLASS = r"""(?i)(?:^|[\s"'=])(?:language|lang|highlight)-([a-z0-9+#]{1,15})\b"""
LANGUAGE_DATA = r"""(?i)\bdata-lang(?:uage)?\s*=\s*["']?([a-z0-9+#]{1,15})"""
LEAST_ALT = 3
# end of fixed values

_ENTITIES = {n: html.entities.html5[n + ";"] for n in ENTITY_NAMES}
_ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([a-zA-Z][a-zA-Z0-9]{1,31}));")
BREAK, OPEN, CLOSE, STEP = "\x01", "\x02", "\x03", "\x04"


def decode(text: str) -> str:
    """Numeric references and the names above; others stay as they are."""
    def one(m) -> str:
        if m[3]:
            return _ENTITIES.get(m[3], m[0])
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def attribute(node: Node, name: str) -> str | None:
    m = re.search(rf"""\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", node.attrs, re.I)
    return decode(next(x for x in m.groups()[1:] if x is not None)) if m else None


_MACHINE_ALT = re.compile(f"(?:{TRIVIAL_ALT}|{IMAGE_FILE}|data:.*)", re.I | re.S)


def meaningful_alt(alt: str | None) -> str | None:
    """A description that a person wrote, without the note that a machine did; None for names of files and the like."""
    said = re.sub(DISCLAIMER, "", " ".join((alt or "").split()), flags=re.I).strip()
    return said if len(said) >= LEAST_ALT and not _MACHINE_ALT.fullmatch(said) else None


def words(node: Node, gap: str = "") -> str:
    """Text of a subtree without markup, as it stands in the source."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            if gap and x is not node:
                out.append(gap)
            todo.extend(reversed(x.kids))
    return "".join(out)


def language(*chunks: str) -> str:
    """The language that the first of some attribute strings names, by class before data attribute."""
    named = (m[1].lower() for chunk in chunks for pattern in (LANGUAGE_CLASS, LANGUAGE_DATA) if (m := re.search(pattern, chunk)))
    return next(named, "")


class _Walk:
    def __init__(self):
        self.parked: list[str] = []
        self.flat: dict[int, str] = {}  # parked tables as plain words
        self.images = self.merged = 0

    def park(self, text: str) -> str:
        self.parked.append(text)
        return f"{OPEN}{len(self.parked) - 1}{CLOSE}"

    def block(self, text: str) -> str:
        return BREAK * 2 + self.park(text) + BREAK * 2

    def back(self, text: str, flat: bool = False) -> str:
        def one(m) -> str:
            n = int(m[1])
            return self.back(self.flat[n] if flat and n in self.flat else self.parked[n], flat)

        return re.sub(f"{OPEN}([0-9]+){CLOSE}", one, text)

    def code(self, node: Node, raw_lang: str = "") -> str:
        body = re.sub(r"\A\r?\n", "", decode(words(node))).rstrip()
        return md.fenced(body, raw_lang)

    def kids(self, node: Node, lists: tuple) -> str:
        return "".join([k if isinstance(k, str) else self.node(k, lists) for k in node.kids])

    def node(self, node: Node, lists: tuple) -> str:
        tag = node.tag
        if tag == "iframe":
            src = attribute(node, "src") or ""
            known = any(src.startswith((f"https://{h}", f"http://{h}")) for h in CODE_HOSTS)
            return f"{BREAK * 2}[embedded: {src}]{BREAK * 2}" if known else ""
        if tag in SKIPPED:
            return ""
        if tag == "pre":
            inner = next((k for k in node.kids if isinstance(k, Node) and k.tag == "code"), None)
            return self.block(self.code(node, language(node.attrs, inner.attrs if inner else "")))
        if tag in ("div", "section", "figure") and re.search(CODE_CLASS, attribute(node, "class") or "", re.I) and not any(isinstance(k, Node) and k.tag in (tag, "pre") for k in node.kids) and words(node).strip():
            return self.block(self.code(node, language(node.attrs, attribute(node, "class") or "")))
        if tag == "code":
            body = words(node)
            if "\n" in body.strip():
                return self.park(self.code(node, language(node.attrs)))
            line = re.sub(r"\s+", " ", decode(body)).strip()
            return self.park(f"`{line}`") if line and "`" not in line else self.kids(node, lists)
        if tag == "table":
            return self.table(node)
        if tag in ("img", "image", "source"):
            self.images += 1
            alt = meaningful_alt(attribute(node, "alt") or attribute(node, "title"))
            return f"[image: {alt}]" if alt else ""
        if tag in ("ul", "ol"):
            counted = [0] if tag == "ol" else None
            edge = "" if lists else BREAK * 2
            return edge + self.kids(node, (*lists, counted)) + edge
        if tag == "li":
            mark = "- "
            if lists and lists[-1] is not None:
                lists[-1][0] += 1
                mark = f"{lists[-1][0]}. "
            return BREAK + STEP * max(0, len(lists) - 1) + mark + self.kids(node, lists)
        if tag in ("br", "tr"):
            return BREAK + self.kids(node, lists)
        inner = self.kids(node, lists)
        if tag in ("b", "strong", "em", "i"):
            mark = "**" if tag in ("b", "strong") else "*"
            core = inner.strip()
            return inner.replace(core, f"{mark}{core}{mark}", 1) if core.strip(BREAK + " ") else inner
        if tag == "a":
            return self.link(node, inner)
        if re.fullmatch("h[1-6]", tag):
            return f"{BREAK * 2}{'#' * int(tag[1])} {inner}{BREAK * 2}"
        return f"{BREAK * 2}{inner}{BREAK * 2}" if tag in BREAKING else inner

    def link(self, node: Node, inner: str) -> str:
        raw = re.sub(r"\s+", " ", inner.replace(BREAK, " ")).strip()
        href, text = attribute(node, "href"), decode(raw)
        if not href or not re.match("https?://", href, re.I) or text and text in (href, href.rstrip("/")):
            return raw
        return self.park(f"[{text}]({href})" if text else href)

    def table(self, node: Node) -> str:
        rows: list[list[str]] = []
        carried: dict[int, list] = {}  # column -> [text, rows left]
        for tr in _rows(node):
            cells = [k for k in tr.kids if isinstance(k, Node) and k.tag in ("td", "th")]
            if not cells:
                continue
            row: list[str] = []
            while cells or len(row) in carried:
                if len(row) in carried:
                    kept = carried[len(row)]
                    kept[1] -= 1
                    if kept[1] <= 0:
                        del carried[len(row)]
                    row.append(kept[0])
                    continue
                cell = cells.pop(0)
                text = self.cell(cell)
                wide, high = (min(MOST_SPAN, int(m[1]) or 1) if (m := re.search(rf"""\b{n}\s*=\s*["']?([0-9]{{1,3}})""", cell.attrs, re.I)) else 1 for n in ("colspan", "rowspan"))
                self.merged += wide > 1 or high > 1
                for _ in range(wide):
                    if high > 1:
                        carried[len(row)] = [text, high - 1]
                    row.append(text)
            rows.append(row)
        grid = md.render_table([[self.expand(c, True) for c in r] for r in rows])
        if grid is None:
            grid = "\n".join(" ".join(self.expand(c, False) for c in r) for r in rows)
        out = self.block(grid)
        self.flat[len(self.parked) - 1] = " ".join(" ".join(r) for r in rows).strip()
        return out

    def cell(self, cell: Node) -> str:
        """A cell's words; what can't be words in a row (code, inner tables) is parked."""
        out = []
        for k in cell.kids:
            if isinstance(k, str):
                out.append(k)
            elif k.tag in ("table", "pre", "code"):
                out.append(self.node(k, ()))
            elif k.tag not in SKIPPED and k.tag != "iframe":
                out.append(" " + self.cell(k) + " ")
        return decode("".join(out))

    def expand(self, text: str, flat: bool) -> str:
        return self.back(text, flat).replace(BREAK, "\n").strip()


def _rows(table: Node):
    for k in table.kids:
        if isinstance(k, Node):
            if k.tag == "tr":
                yield k
            elif k.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(k)


def html_to_text(source: str) -> tuple[str, int, int]:
    """Text, images dropped and cells merged."""
    walk = _Walk()
    text = walk.kids(parse(re.sub("[\x01-\x04]", "", source)), ())
    text = decode(re.sub(r"[ \t\r\n\f\v]+", " ", text))
    text = re.sub("[​‌‍﻿]", "", text)
    text = re.sub(r"data:[a-zA-Z0-9.+/-]*;?[a-zA-Z0-9=;,._+/%-]*", "", text)
    lines = []
    for line in re.split(f" *{BREAK} *", text):
        line = re.sub(r"\A(#{1,6} |- )?[ \t]+", r"\1", line.rstrip()).replace(STEP, "  ")
        lines.append("" if re.fullmatch(r"(?:- ?|#{1,6} ?)?[ \t]*", line) else line)
    return walk.back(re.sub(r"\n{3,}", "\n\n", "\n".join(lines))).strip(), walk.images, walk.merged
