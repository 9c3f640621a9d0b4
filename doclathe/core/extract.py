"""Bytes to a document: format, text, warnings, error. Nothing is raised: what can't be read has an error."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import clean as cleaning
from . import html_text, rtf
from .options import Extract

# fixed values
EXTENSIONS = {"docx": "docx", "pptx": "pptx", "ppsx": "pptx", "potx": "pptx", "pdf": "pdf", "rtf": "rtf", "html": "html", "htm": "html", "xhtml": "html", "md": "markdown", "markdown": "markdown", "mdown": "markdown", "mkd": "markdown"}
NOUNS = {"pdf": "Page", "pptx": "Slide"}
OLE2 = bytes.fromhex("d0cf11e0a1b11ae1")
OLE2_STREAMS = {"PowerPoint Document": "ppt", "Workbook": "xls", "WordDocument": "doc"}
ZIP_MARKERS = {b"xl/workbook.xml": "xlsx", b"Index/Document.iwa": "key", b"opendocument.presentation": "odp", b"opendocument.text": "odt"}
# end of fixed values

_TAGS = re.compile(r"</(?:p|div|h[1-6]|ul|ol|table|section|article)\s*>|<br\s*/?>", re.I)


@dataclass
class Document:
    format: str
    text: str | None = None
    warnings: list[str] = field(default_factory=list)
    error: str | None = None
    sections: list[tuple[int, str | None, str]] = field(default_factory=list)


def looks_like_html(sample: str) -> bool:
    return bool(re.match(r"\s*<(?:!doctype\s+html|html|head|body)\b", sample, re.I)) or len(_TAGS.findall(sample)) >= 2


def detect(content: bytes, name: str = "") -> str:
    kind = EXTENSIONS.get(name.rpartition(".")[2].lower(), "") if "." in name else ""
    zipped = content.startswith(b"PK\x03\x04")
    if zipped and b"word/document.xml" in content:
        return "docx"
    if zipped and b"ppt/presentation.xml" in content:
        return "pptx"
    if b"%PDF" in content[:1024]:
        return "pdf"
    if kind in ("docx", "pptx") and zipped:
        return kind
    if content.startswith(b"{\\rtf"):
        return "rtf"
    if kind in ("rtf", "html", "markdown"):
        return kind
    return "html" if looks_like_html(content[:4096].decode("utf-8", "replace")) else "text"


def decode(content: bytes) -> str:
    """UTF-8, or UTF-16 by its mark; ValueError for anything else."""
    for mark, code in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            body = content[2:]
            return body[: len(body) // 2 * 2].decode(code, "replace").replace("﻿", "")
    text = content.decode("utf-8")
    if "\0" in text:
        raise ValueError("binary content")
    return text.removeprefix("﻿")


def binary_kind(content: bytes) -> str | None:
    """The name of a binary format that has to be converted first."""
    if content.startswith(OLE2):
        return next((k for name, k in OLE2_STREAMS.items() if name.encode("utf-16-le") in content), "ole2")
    if content.startswith(b"PK\x03\x04"):
        return next((k for marker, k in ZIP_MARKERS.items() if marker in content), "zip")
    return None


def extract(content: bytes | None, name: str = "", options: Extract | None = None) -> Document:
    options = options or Extract()
    if content is None:
        return Document("text", error="no content")
    kind = detect(content, name)
    if len(content) > options.most_bytes:
        return Document(kind, error=f"oversized: {len(content)} bytes, the limit is {options.most_bytes}")
    if kind in ("docx", "pptx", "pdf"):
        from . import office, pdf, word

        try:
            if kind == "docx":
                return Document(kind, *word.docx(content))
            sections, warnings = pdf.document(content, options) if kind == "pdf" else office.pptx_slides(content, options)
        except (office.Unreadable, pdf.Unreadable) as e:
            return Document(kind, error=f"pdf: {e}" if kind == "pdf" else str(e))
        except (ArithmeticError, AttributeError, LookupError, RecursionError, TypeError, ValueError) as e:  # a part of another shape than the format's
            return Document(kind, error=f"{kind}: broken structure: {type(e).__name__}: {e}")
        return Document(kind, "\n\n".join(text for _, _, text in sections if text), warnings, None, sections)
    other = binary_kind(content)
    if other:
        return Document(kind, error=f"{other}: convert it first")
    try:
        text = decode(content)
    except ValueError:
        return Document(kind, error="not text in UTF-8 or UTF-16")
    if kind == "html":
        text, _, merged = html_text.html_to_text(text)
        return Document(kind, text, [f"{merged} merged cells flattened"] if merged else [])
    if kind == "rtf":
        text, pictures = rtf.rtf_to_text(text)
        return Document(kind, text, [f"{pictures} pictures dropped"] if pictures else [])
    return Document(kind, re.sub("\r\n?", "\n", text) if kind == "text" else text)


def clean_sections(sections: list[tuple[int, str | None, str]], options=None, noun: str = "Section", headings: bool = False) -> tuple[str, list[dict]]:
    """Sections cleaned one by one and joined; empty ones go. With each, its share of the characters."""
    parts, stats = [], []
    for number, label, body in sections:
        head = f"## {noun} {number}" + (f" — {label}" if label is not None else "")
        text = cleaning.clean(f"{head}\n\n{body}" if headings else body, options)
        if text:
            stats.append({"index": number, "label": label, "chars": len(text) + sum(c > "￿" for c in text) + bool(parts)})
            parts.append(text)
    return "\n".join(parts), stats


def clean_document(document: Document, options=None, headings: bool = False) -> tuple[str, list[dict]]:
    """A document's text cleaned, by its sections where it has some, and their shares."""
    if document.sections:
        return clean_sections(document.sections, options, NOUNS.get(document.format, "Section"), headings)
    return cleaning.clean(document.text or "", options), []
