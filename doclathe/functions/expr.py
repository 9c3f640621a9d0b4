"""Cleaning and measuring as Catalyst expressions: no Python in the data path.

Every function takes and returns a Column (or a name). Patterns use only what Java's engine and RE2 share
unless the comment says otherwise, so that the same step can be said in SQL elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import fixed

TOKEN_PATTERN = "|".join([
    rf"[{fixed.LETTER}]+(?:['\x{{2019}}][{fixed.LETTER}]+)*",
    r"[0-9]+",
    rf"[{fixed.CJK}]",
    rf"[{fixed.SPACE}]+",
    rf"[{fixed.ASTRAL}]",
    rf"[^{fixed.LETTER}0-9{fixed.CJK}{fixed.SPACE}{fixed.ASTRAL}]+",
])
#: Pieces that cost a token each: up to five characters of a word (apostrophes between letters included), three of a number,
#: four of other marks, one of CJK. Of a run, only the last piece may be shorter.
#: White space before a piece is passed over with it, and words without an apostrophe take the first, short way.
_MARK = r"['\x{2019}]"
PIECE_PATTERN = rf"[{fixed.SPACE}]*+(?:" + "|".join([
    rf"[{fixed.LETTER}]{{1,{fixed.LETTERS_PER_TOKEN}}}+(?!{_MARK})",
    rf"(?:[{fixed.LETTER}]|{_MARK}(?<=[{fixed.LETTER}]{_MARK})(?=[{fixed.LETTER}]))(?:[{fixed.LETTER}]|{_MARK}(?=[{fixed.LETTER}])){{0,{fixed.LETTERS_PER_TOKEN - 1}}}",
    rf"[0-9]{{1,{fixed.DIGITS_PER_TOKEN}}}",
    rf"[{fixed.CJK}]",
    rf"[^{fixed.LETTER}0-9{fixed.CJK}{fixed.SPACE}{fixed.ASTRAL}]{{1,{fixed.MARKS_PER_TOKEN}}}",
]) + ")"
#: The same of white space, where a single space costs nothing; and of indents behind a line break.
SPACE_PATTERN = rf"[{fixed.SPACE}]{{2,{fixed.LONG_SPACE}}}|[\x09-\x0D]|(?<=[{fixed.SPACE}]) "
INDENT_PATTERN = rf"[\n\r][ \t\x0B\x0C]++(?![{fixed.SPACE}])"
#: INVISIBLE_PATTERN and LINE_BREAK_PATTERN, said so that Java tells by one comparison that a character is none of the rarer ones.
_INVISIBLE_FAST = rf"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\xAD]|[^\x00-\xFF](?<=[{fixed.char_class(p for p in fixed.INVISIBLE if p > 255)}])"
_LINE_BREAK_FAST = r"\r\n?|[\x0B\x0C]|[\x{2028}-\x{2029}]"
INVISIBLE_PATTERN = rf"[{fixed.char_class(fixed.INVISIBLE)}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]"
LINE_BREAK_PATTERN = r"\r\n|[\r\x0B\x0C\x{2028}\x{2029}]"
BULLET_PATTERN = rf"(^|\n)([ \t]*)[{fixed.char_class(fixed.BULLETS)}][ \t]*"
ESCAPE_PATTERN = r"\\([!-/:-@\[-`{-~])"
TAG_PATTERN = r"(?i)</(?:p|div|h[1-6]|ul|ol|table|section|article)\s*>|<br\s*/?>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sub(c, pattern: str, by: str) -> Column:
    return F.regexp_replace(_col(c), F.lit(pattern), F.lit(by))


def strip_sentinels(c) -> Column:
    return _sub(c, r"[\x{E000}-\x{E002}]", "")


def line_breaks(c) -> Column:
    return _sub(c, _LINE_BREAK_FAST, "\n")


def strip_invisible(c) -> Column:
    return _sub(c, _INVISIBLE_FAST, "")


def fold_bullets(c) -> Column:
    return _sub(c, BULLET_PATTERN, "$1$2- ")


def single_folds() -> tuple[str, str]:
    """The one-to-one part of the punctuation table, as the two arguments of translate()."""
    pairs = [(chr(p), to) for to, points in fixed.FOLDS.items() if len(to) == 1 for p in points]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def long_folds() -> list[tuple[str, str]]:
    return [(chr(p), to) for to, points in fixed.FOLDS.items() if len(to) > 1 for p in points]


def fold_punctuation(c) -> Column:
    out = F.translate(fold_bullets(c), *single_folds())
    for one, to in long_folds():
        out = F.replace(out, F.lit(one), F.lit(to))
    return out


def tabs_to_spaces(c) -> Column:
    return F.replace(_col(c), F.lit("\t"), F.lit(" "))


def let(c, f) -> Column:
    """f(c) with c evaluated once, however often f uses it (a column used n times is otherwise computed n times)."""
    return F.get(F.transform(F.array(_col(c)), f), F.lit(0))


def _each_line(c, f) -> Column:
    return F.array_join(F.transform(F.split(_col(c), "\n", -1), f), "\n")


def collapse_spaces(c, even_indent: bool = False) -> Column:
    """Runs of spaces behind the indent become one; with even_indent the indent loses its odd space."""
    def line(x):
        indent = F.regexp_extract(x, r"^[ \t]*", 0)
        lead = F.repeat(F.lit(" "), (F.floor(F.length(indent) / 2) * 2).cast("int")) if even_indent else indent
        return F.concat(lead, _sub(F.substr(x, F.length(indent) + 1), " {2,}", " "))

    return let(c, lambda t: F.when(F.contains(t, F.lit("  ")) | F.lit(even_indent), _each_line(t, line)).otherwise(t))


def trim_lines(c) -> Column:
    return _sub(c, r"[ \t]+(\n|\z)", "$1")


def limit_blank_lines(c, most: int = 1) -> Column:
    """At most ``most`` empty lines in a row, for trimmed text without tables (a table's edge keeps a blank line)."""
    inner = _sub(c, r"\n{%d,}" % (most + 2), "\n" * (most + 1))
    return _sub(_sub(inner, r"\A\n{%d,}" % (most + 1), "\n" * most), r"\n{%d,}\z" % (most + 1), "\n" * most)


def finalise(c) -> Column:
    body = _sub(_sub(c, r"\A(?:[ \t]*\n)+", ""), r"\n(?:[ \t]*\n)*[ \t]*\z", "")
    return _sub(F.concat(body, F.lit("\n")), r"\A\n\z", "")


def unescape_markdown(c) -> Column:
    """Backslash escapes of ASCII punctuation, outside table rows."""
    return _sub(c, ESCAPE_PATTERN, "$1")


def drop_media_lines(c) -> Column:
    keep = lambda x: ~(F.rlike(x, F.lit(fixed.BASE64_LINE)) | F.rlike(x, F.lit(fixed.IMAGE_REF_LINE)))
    return F.array_join(F.filter(F.split(_col(c), "\n", -1), keep), "\n")


def dehyphenate(c) -> Column:
    return _sub(c, r"([A-Za-z]{2,})-\n([a-z]+)", "$1$2")


def is_heading(line) -> Column:
    return F.rlike(_col(line), F.lit(fixed.HEADING_LINE))


def is_block_start(line) -> Column:
    return F.rlike(_col(line), F.lit(fixed.BLOCK_START))


def is_table_row(line) -> Column:
    def row(t):
        pipes = F.regexp_count(_sub(t, r"\\.", ""), F.lit(r"\|"))
        return (F.length(t) >= 2) & F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|")) & (pipes >= 2)

    return let(F.trim(_col(line)), row)


def clean_fast(c, most: int = 1) -> Column:
    """The balanced pipeline where nothing needs per-document state: no code, tables, media, wrapped lines or compatibility characters."""
    out = strip_invisible(line_breaks(strip_sentinels(c)))
    out = unescape_markdown(tabs_to_spaces(fold_punctuation(out)))
    out = _sub(out, r"([^ \n]) {2,}", "$1 ")  # collapse_spaces where there are no tabs
    return finalise(limit_blank_lines(trim_lines(out), most))


def needs_state(c) -> Column:
    """Whether a text holds what only the fused path (code, tables, media, compatibility characters, paragraphs) can clean."""
    return F.rlike(_col(c), F.lit(r"[`|<~]|!\[|data:|\n[ \t]*\n|\n(?: {4}|\t)|\A(?: {4}|\t)|[a-z0-9,;:-][ \t]*\n[ \t]*[a-z]|[^\x00-\x7F]"))


# measures


def estimate_tokens(c) -> Column:
    """The token estimate as counts of matches: no token is ever made."""
    count = lambda pattern: F.regexp_count(_col(c), F.lit(pattern)).cast("long")
    return count(PIECE_PATTERN) + count(SPACE_PATTERN) + count(INDENT_PATTERN) + 2 * count(f"[{fixed.ASTRAL}]")


def count_lines(c) -> Column:
    breaks = F.regexp_count(_col(c), F.lit("\n")).cast("long")
    return F.when(F.length(_col(c)) == 0, F.lit(0).cast("long")).otherwise(breaks + F.when(F.endswith(_col(c), F.lit("\n")), 0).otherwise(1))


def utf16_length(c) -> Column:
    return (F.length(_col(c)) + F.regexp_count(_col(c), F.lit(f"[{fixed.ASTRAL}]"))).cast("long")


def stats(c) -> Column:
    """struct<chars, bytes, lines, tokens>"""
    return F.struct(utf16_length(c).alias("chars"), F.octet_length(_col(c)).cast("long").alias("bytes"), count_lines(c).alias("lines"), estimate_tokens(c).alias("tokens"))


def saved_pct(before, after) -> Column:
    """Percent saved, 0 to 100, halves up at one decimal."""
    share = (_col(before) - _col(after)) * 100.0 / _col(before)
    return F.when(_col(before) <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.floor(share * 10 + 0.5) / 10)))


def format_bytes(c) -> Column:
    n = _col(c).cast("double")
    unit = lambda k, name: F.concat(F.format_string("%.1f", F.floor(n / k * 10 + 0.5) / 10), F.lit(name))
    return F.when(n < 1000, F.concat(_col(c).cast("string"), F.lit(" B"))).when(n < 1e6, unit(1e3, " kB")).when(n < 1e9, unit(1e6, " MB")).otherwise(unit(1e9, " GB"))


def clock(seconds) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = _col(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


# formats


def looks_like_html(c) -> Column:
    head = F.substr(_col(c), F.lit(1), F.lit(4096))
    return F.rlike(head, F.lit(r"(?i)\A\s*<(?:!doctype\s+html|html|head|body)\b")) | (F.regexp_count(head, F.lit(TAG_PATTERN)) >= 2)


def detect_format(content, name) -> Column:
    """Format of binary content: magic bytes first, then the extension, then the looks of the text."""
    b, low = _col(content), F.lower(F.coalesce(_col(name), F.lit("")))
    lossy = F.decode(F.substring(b, 1, 4096), "ISO-8859-1")
    every = F.decode(b, "ISO-8859-1")
    zipped = F.startswith(lossy, F.lit("PK\x03\x04"))
    ends = lambda *e: F.rlike(low, F.lit(r"\.(?:" + "|".join(e) + r")\z"))
    return (
        F.when(zipped & F.contains(every, F.lit("word/document.xml")), "docx")
        .when(zipped & F.contains(every, F.lit("ppt/presentation.xml")), "pptx")
        .when(F.contains(F.substr(lossy, F.lit(1), F.lit(1024)), F.lit("%PDF")), "pdf")
        .when(zipped & ends("docx"), "docx").when(zipped & ends("pptx", "ppsx", "potx"), "pptx")
        .when(F.startswith(lossy, F.lit("{\\rtf")) | ends("rtf"), "rtf")
        .when(ends("html", "htm", "xhtml"), "html").when(ends("md", "markdown", "mdown", "mkd"), "markdown")
        .when(looks_like_html(lossy), "html").otherwise("text")
    )


# geometry of positioned text


def quarter_turn(a, b) -> Column:
    """0, 90, 180 or 270 for a text matrix that turns by quarters (within 5 %), else null."""
    a, b = _col(a), _col(b)
    scale = F.sqrt(a * a + b * b)
    return F.when(scale == 0, F.lit(None)).when(F.abs(b) <= scale * 0.05, F.when(a > 0, 0).otherwise(180)).when(F.abs(a) <= scale * 0.05, F.when(b > 0, 90).otherwise(270)).cast("int")


def upright(x, y, width, turn, page_width, page_height) -> Column:
    """struct<x, y> of an item on a page that is turned back."""
    x, y, width, turn, pw, ph = map(_col, (x, y, width, turn, page_width, page_height))
    nx = F.when(turn == 90, y).when(turn == 180, pw - x - width).when(turn == 270, ph - y).otherwise(x)
    ny = F.when(turn == 90, pw - x).when(turn == 180, ph - y).when(turn == 270, x).otherwise(y)
    return F.struct(nx.alias("x"), ny.alias("y"))
