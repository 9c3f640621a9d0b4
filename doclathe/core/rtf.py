"""RTF to text: a token scan over a stack of groups."""

from __future__ import annotations

import re

from . import markdown as md

# fixed values
HIDDEN_GROUPS = frozenset("""fonttbl colortbl stylesheet listtable listoverridetable info pict object objdata themedata colorschememapping datastore
latentstyles rsidtbl generator xmlnstbl filetbl revtbl upr mmathPr wgrffmtfilter nonesttables header footer headerl headerr headerf footerl
footerr footerf ftnsep ftnsepc aftnsep aftnsepc bkmkstart bkmkend shppict nonshppict fldinst panose falt""".split())
WORDS = {
    "par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "softline": "\n", "tab": "\t", "emdash": "—", "endash": "–",
    "emspace": " ", "enspace": " ", "qmspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”",
    "ltrmark": "", "rtlmark": "", "zwbo": "", "zwj": "", "zwnj": "",
}
# end of fixed values

ROW, CELL = "\x1e", "\x1f"
_TOKEN = re.compile(r"\\(?:'(?P<hex>.{0,2})|(?P<word>[a-zA-Z]+)(?P<num>-?[0-9]*) ?|(?P<sign>.))|(?P<group>[{}])|(?P<text>[^\\{}\r\n])|[\r\n]", re.S)
_ENDS = {"row": ROW, "nestrow": ROW, "cell": CELL, "nestcell": CELL}


def byte(value: int) -> str:
    """Windows-1252; its unassigned bytes are the control characters of that number."""
    try:
        return bytes([value]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(value)


def rtf_to_text(source: str) -> tuple[str, int]:
    """Text and the number of pictures dropped."""
    out: list[str] = []
    hidden, uc, stack = False, 1, []
    starred = in_row = False
    skip = pictures = 0

    def say(text: str) -> None:
        if not hidden:
            out.append(text)

    for m in _TOKEN.finditer(source):
        word, sign = m["word"], m["sign"]
        content = m["text"] if m["text"] is not None else sign if sign and sign in "\\{}" else None
        if m["hex"] is not None and re.fullmatch("[0-9a-fA-F]{2}", m["hex"]):
            content = byte(int(m["hex"], 16))
        if content is not None:
            if skip:
                skip -= 1
            elif content not in (ROW, CELL):
                say(content)
        elif m["group"] == "{":
            stack.append((hidden, uc))
            starred = False
        elif m["group"] == "}":
            hidden, uc = stack.pop() if stack else (False, 1)
            starred, skip = False, 0
        elif sign == "*":
            starred = True
        elif sign:
            say({"~": " ", "_": "-", "\n": "\n", "\r": "\n"}.get(sign, ""))
        elif not word:
            continue
        elif starred or word in HIDDEN_GROUPS:
            pictures += word == "pict"
            hidden, starred = True, False
        elif word == "uc":
            uc = max(0, int(m["num"] or 0)) if m["num"] not in ("", "-") else 0
        elif word == "u" and m["num"] not in ("", "-"):
            point = int(m["num"]) % 65536
            if chr(point) not in (ROW, CELL):
                say(chr(point))
            skip = uc
        elif word in ("trowd", "intbl", "nesttableprops"):
            in_row = True
            if word == "trowd":
                say(ROW)
        elif word in _ENDS:
            in_row, skip = _ENDS[word] == CELL, 0
            say(_ENDS[word])
        elif word in WORDS:
            skip = 0
            ends_paragraph = word in ("par", "sect", "page") and not in_row
            say(WORDS[word][:-1] + ROW if ends_paragraph else WORDS[word])
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    text = _tables(text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip(), pictures


def _tables(text: str) -> str:
    """Runs of rows become pipe tables (plain lines under two columns), with a blank line around them."""
    parts: list[tuple[str, bool]] = []
    run: list[list[str]] = []

    def flush() -> None:
        if run:
            table = md.render_table(run)
            parts.append((table, True) if table else ("\n".join(" ".join(re.sub(r"\s+", " ", c).strip() for c in r) for r in run), False))
            run.clear()

    for piece in text.split(ROW):
        if CELL in piece:
            cells = piece.split(CELL)
            run.append(cells[:-1] if not cells[-1].strip() else cells)
        elif piece.strip():
            flush()
            parts.append((piece, False))
        elif not run:
            parts.append(("", False))
    flush()
    out = parts[0][0] if parts else ""
    for (_, before), (body, table) in zip(parts, parts[1:]):
        out += ("\n\n" if table or before else "\n") + body
    return out
