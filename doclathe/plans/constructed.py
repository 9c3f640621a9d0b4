"""Queries over inputs that are built from the tables, so that the right answer can be said in SQL without the library's patterns."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..core.options import preset
from ..functions import expr, udfs
from ..operators import pages

QUERIES: dict = {}
ORACLES: dict = {}

#: Conversations as words of visible ASCII.
_WORDS = "(SELECT conv_id, turn, trim(regexp_replace(text, '[^!-~]+', ' ', 'g')) AS t FROM conversations)"


def _add(name, run, sql):
    QUERIES[name], ORACLES[name] = run, sql


def _turns(spark, sf_dir):
    words = F.trim(F.regexp_replace("text", "[^!-~]+", " "))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", words.alias("t")).where("t != ''")


def _joined(rows, piece, between: str = ""):
    """One text per conversation: a piece of each turn in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("s")))), lambda x: x["s"])
    return rows.groupBy("conv_id").agg(F.array_join(parts, between).alias("s"))


def _markup(c):
    """Text as XML and HTML have it."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _per_conversation(separator: str, piece: str = "t") -> str:
    return f"SELECT conv_id, string_agg({piece}, {separator} ORDER BY turn) AS text FROM {_WORDS} WHERE t <> '' GROUP BY 1"


_add("html_paragraphs", lambda spark, d: _joined(_turns(spark, d), F.concat(F.lit("<p>"), _markup(F.col("t")), F.lit("</p>"))).select("conv_id", udfs.html_to_text("s").alias("text")), _per_conversation("chr(10) || chr(10)"))
_add(
    "html_lists",
    lambda spark, d: _joined(_turns(spark, d), F.concat(F.lit("<li>"), _markup(F.col("t")), F.lit("<ul><li>turn <b>"), F.col("turn").cast("string"), F.lit("</b></ul></li>"))).select("conv_id", udfs.html_to_text(F.concat(F.lit("<script>var a;</script><ol>"), F.col("s"), F.lit("</ol>"))).alias("text")),
    "SELECT conv_id, string_agg(n || '. ' || t || chr(10) || '  - turn **' || turn || '**', chr(10) ORDER BY turn) AS text "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {_WORDS} WHERE t <> '') GROUP BY 1",
)
_add(
    "html_tables",
    lambda spark, d: _joined(_turns(spark, d), F.concat(F.lit("<tr><td>"), F.col("turn").cast("string"), F.lit("<td>"), _markup(F.col("t")))).select("conv_id", udfs.html_to_text(F.concat(F.lit("<table><tr><th>turn<th>words"), F.col("s"), F.lit("</table>"))).alias("text")),
    "SELECT conv_id, '| turn | words |' || chr(10) || '| --- | --- |' || chr(10) || text AS text FROM (" + _per_conversation("chr(10)", "'| ' || turn || ' | ' || replace(t, '|', chr(92) || '|') || ' |'") + ")",
)
_add(
    "rtf_paragraphs",
    lambda spark, d: _joined(_turns(spark, d), F.regexp_replace("t", r"([\\{}])", r"\\$1"), "\\par ").select("conv_id", udfs.rtf_to_text(F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl f}{\\*\\generator g}"), F.col("s"), F.lit("}"))).alias("text")),
    _per_conversation("chr(10)"),
)


def _package(build):
    """A column of zipped packages, whose parts ``build`` makes of a list of texts."""
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(texts) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in build(list(texts)).items():
                    z.writestr(name, body)
            return out.getvalue()

        return rows.map(one)

    return run


def _docx(texts: list[str]) -> dict[str, str]:
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return {"word/document.xml": f"<w:document {space}><w:body>{''.join(f'<w:p><w:r><w:t>{t}</w:t></w:r></w:p>' for t in texts)}</w:body></w:document>"}


def _pptx(texts: list[str]) -> dict[str, str]:
    """A slide for each text, listed from the last to the first; above the text, but behind it in the file, its number; a hidden slide."""
    spaces = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda text, y: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/><a:ext cx="9" cy="9"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slides = [*texts, "never seen"]
    numbers = range(len(slides), 0, -1)
    parts = {f"ppt/slides/s{n}.xml": f"<p:sld {spaces} {'show=%s0%s' % (chr(34), chr(34)) if t is slides[-1] else ''}><p:cSld><p:spTree>{shape(t, 900)}{shape(f'number {n}', 20)}</p:spTree></p:cSld></p:sld>" for n, t in enumerate(slides, 1)}
    listed = "".join(f'<p:sldId r:id="r{n}"/>' for n in numbers)
    links = "".join(f'<Relationship Id="r{n}" Type="x/slide" Target="slides/s{n}.xml"/>' for n in numbers)
    return parts | {"ppt/presentation.xml": f"<p:presentation {spaces}><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'}


def _read_packages(build, name: str):
    def run(spark, d):
        rows = _turns(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", _markup(F.col("t")).alias("s")))), lambda x: x["s"]).alias("texts"))
        read = rows.select("conv_id", udfs.extract(_package(build)("texts"), F.lit(name)).alias("d"))
        return read.select("conv_id", "d.format", "d.text")

    return run


_add("docx_text", _read_packages(_docx, "a.docx"), f"SELECT conv_id, 'docx' AS format, text FROM ({_per_conversation('chr(10) || chr(10)')})")
_add(
    "pptx_text", _read_packages(_pptx, "a.pptx"),
    "SELECT conv_id, 'pptx' AS format, string_agg('number ' || n || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY n DESC) AS text "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {_WORDS} WHERE t <> '') GROUP BY 1",
)


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _paragraph(text: str, props: str = "") -> str:
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def _docx_parts(texts: list[str]) -> dict[str, str]:
    """A heading for each text, by its style, and the text as an item of a numbered list."""
    body = "".join(_paragraph(f"Part {n}", '<w:pStyle w:val="H"/>') + _paragraph(t, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>') for n, t in enumerate(texts, 1))
    return {
        "word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {_W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {_W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    }


def _docx_table(texts: list[str]) -> dict[str, str]:
    rows = [("place", "words"), *((str(n), t) for n, t in enumerate(texts, 1))]
    cells = "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    return {"word/document.xml": f"<w:document {_W}><w:body><w:tbl>{cells}</w:tbl></w:body></w:document>"}


def _one_slide(shapes: str, links: str = "", **parts: str) -> dict[str, str]:
    """A deck of one slide."""
    spaces = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
    related = lambda inner: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
    return {
        "ppt/presentation.xml": f'<p:presentation {spaces}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": related('<Relationship Id="r1" Type="x/slide" Target="slides/s1.xml"/>'),
        "ppt/slides/s1.xml": f"<p:sld {spaces}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/s1.xml.rels": related(links),
    } | {f"ppt/charts/{name}.xml": f"<c:chartSpace {spaces}>{body}</c:chartSpace>" for name, body in parts.items()}


def _pptx_table(texts: list[str]) -> dict[str, str]:
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    rows = "".join(f"<a:tr>{cell(n)}{cell(t)}</a:tr>" for n, t in [("place", "words"), *enumerate(texts, 1)])
    return _one_slide(f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>")


def _pptx_list(texts: list[str]) -> dict[str, str]:
    """Bullets by turns on the first and second level; a slide number, which goes."""
    items = "".join(f'<a:p><a:pPr lvl="{n % 2}"><a:buChar char="x"/></a:pPr><a:r><a:t>{t}</a:t></a:r></a:p>' for n, t in enumerate(texts))
    number = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="sldNum"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>7</a:t></a:r></a:p></p:txBody></p:sp>'
    return _one_slide(f"{number}<p:sp><p:txBody>{items}</p:txBody></p:sp>")


def _pptx_chart(texts: list[str]) -> dict[str, str]:
    points = "".join(f'<c:pt idx="{n}"><c:v>{t}</c:v></c:pt>' for n, t in enumerate(texts))
    series = f"<c:ser><c:tx><c:v>Said</c:v></c:tx><c:cat><c:strRef><c:strCache>{points}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache><c:pt idx=\"0\"><c:v>1</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser>"
    chart = f"<c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>Turns</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart>{series}</c:barChart></c:plotArea></c:chart>"
    frame = '<p:graphicFrame><a:graphic><a:graphicData><c:chart r:id="c1"/></a:graphicData></a:graphic></p:graphicFrame>'
    return _one_slide(frame, '<Relationship Id="c1" Type="x/chart" Target="../charts/one.xml"/>', one=chart)


_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {_WORDS} WHERE t <> '')"


def _in_order(format_: str, piece: str, between: str, head: str = "''") -> str:
    return f"SELECT conv_id, '{format_}' AS format, {head} || string_agg({piece}, {between} ORDER BY n) AS text FROM {_NUMBERED} GROUP BY 1"


_GRID = "'| place | words |' || chr(10) || '| --- | --- |' || chr(10)"
_GRID_ROW = "'| ' || n || ' | ' || replace(t, '|', chr(92) || '|') || ' |'"
_add("docx_headings_lists", _read_packages(_docx_parts, "a.docx"), _in_order("docx", "'## Part ' || n || chr(10) || chr(10) || '1. ' || t", "chr(10) || chr(10)"))
_add("docx_tables", _read_packages(_docx_table, "a.docx"), _in_order("docx", _GRID_ROW, "chr(10)", _GRID))
_add("pptx_tables", _read_packages(_pptx_table, "a.pptx"), _in_order("pptx", _GRID_ROW, "chr(10)", _GRID))
_add("pptx_lists", _read_packages(_pptx_list, "a.pptx"), _in_order("pptx", "CASE WHEN n % 2 = 0 THEN '  ' ELSE '' END || '- ' || t", "chr(10)"))
_add("pptx_charts", _read_packages(_pptx_chart, "a.pptx"), f"SELECT conv_id, 'pptx' AS format, 'Turns' || chr(10) || chr(10) || '- Category: ' || string_agg(t, ', ' ORDER BY n) || chr(10) || '- Series: Said' AS text FROM {_NUMBERED} WHERE n <= 60 GROUP BY 1")
_add(
    "rtf_tables",
    lambda spark, d: _joined(_turns(spark, d), F.concat(F.lit("\\trowd "), F.col("turn").cast("string"), F.lit("\\cell "), F.regexp_replace("t", r"([\\{}])", r"\\$1"), F.lit("\\cell\\row "))).select("conv_id", udfs.rtf_to_text(F.concat(F.lit("{\\rtf1\\ansi\\trowd place\\cell words\\cell\\row "), F.col("s"), F.lit("}"))).alias("text")),
    f"SELECT conv_id, {_GRID} || text AS text FROM (" + _per_conversation("chr(10)", "'| ' || turn || ' | ' || replace(t, '|', chr(92) || '|') || ' |'") + ")",
)


# a page of two columns for each document: ten lines of each, which share their heights
def _columns(spark, d):
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    items = lines.select("doc_id", "k", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.lit(72.0).alias("x")), F.struct(F.lit("right").alias("side"), F.lit(330.0).alias("x")))).alias("p"))
    text = F.concat("p.side", F.lit(" words of line "), "k", F.lit(" of document "), "doc_id")
    items = items.select("doc_id", F.lit(1).alias("page"), text.alias("text"), "p.x", (600.0 - 12.0 * F.col("k")).alias("y"))
    items = items.select("*", (F.length("text") * 5.0).alias("width"), F.lit(10.0).alias("height"), F.lit(792.0).alias("page_height"))
    return pages.page_texts(pages.page_lines(items))


_COLUMN = "array_to_string(list_transform(range(0, 10), lambda k: '{side} words of line ' || k || ' of document ' || doc_id), chr(10))"
_add("page_columns", _columns, f"SELECT doc_id, 1 AS page, {_COLUMN.format(side='left')} || chr(10) || chr(10) || {_COLUMN.format(side='right')} AS text FROM documents")


# meetings of two people who take turns
def _meeting(spark, d):
    spoken = F.when(F.col("turn") % 2 == 0, "Ann Lee").otherwise("Ray, Bob")
    line = F.concat(expr.clock(F.col("turn") * 61 + 5), F.lit(" "), spoken, F.lit(": words "), F.col("t"), F.lit("\nAnn Lee left the meeting\n"))
    return _joined(_turns(spark, d), line)


_CLOCK = "((turn * 61 + 5) // 60) || ':' || lpad(((turn * 61 + 5) % 60)::VARCHAR, 2, '0')"
_SAID = f"(SELECT *, CASE WHEN turn % 2 = 0 THEN 'Ann' ELSE 'Bob' END AS who, 'words ' || t AS said FROM {_WORDS} WHERE t <> '')"
_SINGLE = "(SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) = count(DISTINCT turn))"
_ALTERNATE = f"(SELECT *, lag(who) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM who AS new FROM {_SAID})"
_add(
    "transcript_turns", lambda spark, d: _meeting(spark, d).select("conv_id", udfs.tidy_transcript("s").alias("text")),
    "SELECT conv_id, string_agg(head || CASE WHEN length(body) > 200 THEN chr(10) ELSE ' ' END || body, chr(10) || chr(10) ORDER BY g) AS text FROM ("
    f"SELECT conv_id, g, first(who || ' [' || {_CLOCK} || ']:' ORDER BY turn) AS head, string_agg(said, ' ' ORDER BY turn) AS body FROM ("
    f"SELECT *, sum(new::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM {_ALTERNATE}) GROUP BY 1, 2) GROUP BY 1",
)
_add(
    "transcript_utterances", lambda spark, d: udfs.utterances(_meeting(spark, d), "conv_id", "s").select("conv_id", F.col("seq").cast("long").alias("seq"), "speaker", "time", "text"),
    f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CASE WHEN who = 'Ann' THEN 'Ann Lee' ELSE 'Ray, Bob' END AS speaker, {_CLOCK} AS time, said AS text FROM {_SAID}",
)


# cleaning that needs more than a line, on pieces of Markdown around each document's number and source
def _cleaned(pieces: list, name: str = "balanced"):
    def run(spark, d):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        text = F.concat(*[F.col(p[1:]).cast("string") if p.startswith("=") else F.lit(p) for p in pieces])
        return docs.select("doc_id", udfs.clean(text, preset(name)).alias("text"))

    return run


def _said(*pieces: str) -> str:
    """SQL for pieces put together: names with = are columns."""
    quoted = [f"{p[1:]}" if p.startswith("=") else "'" + p.replace("'", "''") + "'" for p in pieces]
    return f"SELECT doc_id, {' || '.join(quoted)} AS text FROM documents"


_add("unwrap", _cleaned(["The text of\n", "=source", " goes on\nhere.\n\nNext ", "=doc_id", ",\nthe end.\n- item\n- other\nwraps\n"]), _said("The text of ", "=source", " goes on here.\n\nNext ", "=doc_id", ", the end.\n- item\n- other wraps\n"))
_add("compact_tables", _cleaned(["| a |   ", "=source", "    |\n|:--|-----:|\n|x  |  ", "=doc_id", "|\n| b\\|c |  |\n"]), _said("| a | ", "=source", " |\n| :--- | ---: |\n| x | ", "=doc_id", " |\n| b\\|c | |\n"))
_add("strip_media", _cleaned(["![A fine ", "=source", "](x.png)\n\n![](y.png)\n\nText <img src=a alt='logo'> end ", "=doc_id", "\n\n<figure><img src=b><figcaption>Seen <b>", "=lang", "</b></figcaption></figure>\n[r]: photo.jpg\n[shown](data:abc) data:image/png;base64,QUJD\n"]), _said("[image: A fine ", "=source", "]\n\nText end ", "=doc_id", "\n\nSeen ", "=lang", " shown\n"))
_add("keep_code", _cleaned(["```py\nlet  a = ", "=doc_id", ";   \n\n\n\n“x”\n```\nand `b  ", "=source", "`  c…\n\n    deep  code\n"]), _said("```py\nlet  a = ", "=doc_id", ";   \n\n\n\n“x”\n```\nand `b  ", "=source", "` c...\n\n    deep  code\n"))
_add("strip_markdown", _cleaned(["# Head ", "=doc_id", " #\n\n> Some **bold ", "=source", "** and _it_ ~~no~~ [link](http://x) <https://y.z>\n***\n1. one\n\nTitle\n=====\nlast <!-- no -->\n"], "aggressive"), _said("Head ", "=doc_id", "\nSome bold ", "=source", " and it no link https://y.z\n1. one\nTitle\nlast \n"))
_add("strip_emoji", _cleaned(["Good \U0001f600 day ", "=source", "\n\n\U0001f44d\U0001f3fd\nnot ☃️ cold ", "=doc_id", "\n"], "aggressive"), _said("Good day ", "=source", "\nnot cold ", "=doc_id", "\n"))
_add("fold_compatibility", _cleaned(["ﬁne ＡＢ ① x² ", "=source", "  end\n"]), _said("fine AB 1 x2 ", "=source", " end\n"))
_add("keep_safe", _cleaned(["“Kept”  ", "=source", "\tﬁ **b**​ \nwrapped\nline\n\n\n\n\nend …\n"], "safe"), _said("“Kept” ", "=source", " ﬁ **b**\nwrapped\nline\n\n\nend …\n"))
