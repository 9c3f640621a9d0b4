"""The core on single texts: cleaning, HTML, RTF, transcripts, packages, formats."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doclathe.core import clean as C
from doclathe.core import extract as X
from doclathe.core import html_text, markdown, office, options, rtf, transcript

MESSY = "“Hello”  world…\n\n\n\n• one\n```js\nlet  a = 1;  \n```\n| a |   b |\n|----|:---|\ntext with `x  y` code\nwrapped line\ncontinues here.\n![](a.png)\nEnd ![A nice cat](x.png).\n"
PIECES = ["word", "Two words", "\n", "\n\n", "  ", "\t", "`code`", "| a | b |", "- item", "# Head", "’", "​", "×", "> q", "---", "![x](y.png)", "\\*", "<b>", "**bold**", "1. x", "    deep"]


@pytest.mark.parametrize("name", ["safe", "balanced", "aggressive"])
@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.sampled_from(PIECES), max_size=14))
def test_cleaning_ends_in_one_line_break_and_keeps_words(name, parts):
    text = " ".join(parts)
    out = C.clean(text, options.preset(name))
    assert out == "" or out.endswith("\n") and not out.endswith("\n\n")
    assert out.count("word") == text.count("word")


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.sampled_from(["word", "Two words.", "\n\n", "- item", "`a  b`", "| a | b |", "—"]), max_size=12))
def test_balanced_cleaning_is_stable(parts):
    once = C.clean("\n".join(parts))
    assert C.clean(once) == once


def test_messy():
    out = C.clean(MESSY)
    assert out == '"Hello" world...\n\n- one\n```js\nlet  a = 1;  \n```\n| a | b |\n| --- | :--- |\ntext with `x  y` code wrapped line continues here. End [image: A nice cat].\n'


def test_aggressive():
    assert C.clean("# Title\n\nSome **bold** and _it_ [l](http://x)\n> q\n---\nx \U0001f600 y\n", options.preset("aggressive")) == "Title\nSome bold and it l\nq\nx y\n"


def test_tables_and_fences():
    assert markdown.render_table([["a|b", "c"], ["1"]]) == "| a\\|b | c |\n| --- | --- |\n| 1 |  |"
    assert markdown.render_table([["one"]]) is None
    assert markdown.fenced("x ``` y\n\n").splitlines()[0] == "````"


def test_html():
    text, images, merged = html_text.html_to_text('<head><title>no</title></head><h1>T &amp; x</h1><p>a <b>b</b><br>c <a href="https://e.org">l</a> <a href="/r">r</a></p><ul><li>1<ol><li>2</ol></ul><img alt="logo"><table><tr><td rowspan=2>a<td>b<tr><td>c</table><pre>x  y</pre>')
    assert text == "# T & x\n\na **b**\nc [l](https://e.org) r\n\n- 1\n  1. 2\n\n| a | b |\n| --- | --- |\n| a | c |\n\n```\nx  y\n```" and (images, merged) == (1, 1)


def test_rtf():
    dash = "\\" + "u8212 ?"
    source = r"{\rtf1{\fonttbl x}Caf\'e9 " + dash + r" {\*\gen y}a\par b\trowd c\cell d\cell\row}"
    assert rtf.rtf_to_text(source)[0] == "Café — a\nb\n\n| c | d |\n| --- | --- |"


def test_transcript():
    text = "\n".join(["Ann Lee 0:05: hello there", "Ann Lee 0:09: hello there everyone", "Bob Ray 1:02:03: hi", "Bob Ray joined the meeting", "Ann Lee: bye now"])
    assert transcript.tidy(text) == "Ann [0:05]: hello there everyone\n\nBob [1:02:03]: hi\n\nAnn: bye now"
    assert transcript.looks_like_transcript("WEBVTT\n") and not transcript.looks_like_transcript("just text")
    assert "\n" in transcript.tidy("Ann Lee: " + "w " * 120) and transcript.clock(0, 75, 3) == "1:15:03"


def test_heads_of_parts():
    long = "<a " + "".join(f' x{n}="{n * n}"' for n in range(3000)) + ">"
    p = office.Package(package({"s.xml": '<p show="0"><q/></p><broken', "long.xml": long + "</a>", "none.xml": "", "bad.xml": "<<"}))
    assert p.head("s.xml", 5) == b"<p sh" and p.head("missing", 5) == b"" and len(p.head("long.xml", 9000)) == 9000
    assert p.root_attributes("s.xml") == {"show": "0"} and p.root_attributes("missing") is None
    assert p.root_attributes("long.xml")["x2999"] == str(2999 * 2999)
    for bad in ("none.xml", "bad.xml"):
        with pytest.raises(office.Unreadable):
            p.root_attributes(bad)


def test_ranges():
    assert options.parse_ranges("3-7, 12") == [(3, 7), (12, 12)]
    for bad in ("0", "7-3", "a", "", "1-"):
        with pytest.raises(ValueError):
            options.parse_ranges(bad)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_docx():
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    body = p("Head", '<w:pStyle w:val="Heading2"/>') + p("one", "<w:numPr/>") + p("two", "<w:numPr/>") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    doc = X.extract(package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}))
    assert (doc.format, doc.text, doc.error) == ("docx", "## Head\n\n- one\n- two\n\n| a | b |\n| --- | --- |", None)
    assert X.extract(package({"word/document.xml": "<w"})).error.startswith("malformed")
    assert X.extract(package({"word/document.xml": "<!DOCTYPE x><x/>"})).error


def test_pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda text, y, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/><a:ext cx="9" cy="9"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda shapes, more="": f"<p:sld {ns} {more}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    rel = lambda i: f'<Relationship Id="r{i}" Type="x/slide" Target="slides/s{i}.xml"/>'
    deck = package({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel(1)}{rel(2)}{rel(3)}</Relationships>',
        "ppt/slides/s1.xml": slide(shape("low", 500) + shape("high", 20) + shape("off", 99_000_000)),
        "ppt/slides/s2.xml": slide(shape("late", 1) + shape("Title", 900, '<p:ph type="title"/>')),
        "ppt/slides/s3.xml": slide(shape("hidden", 1), 'show="0"'),
    })
    slides, warnings = office.pptx_slides(deck)
    assert slides == [(1, "Title", "# Title\n\nlate"), (2, None, "high\n\nlow")] and warnings == ["1 hidden slides skipped"]
    assert X.extract(deck).format == "pptx"


def test_formats_and_refusals():
    assert X.detect(b"%PDF-1.7") == "pdf" and X.detect(b"{\\rtf1") == "rtf" and X.detect(b"<p>a</p><div>b</div>") == "html" and X.detect(b"x", "a.MD") == "markdown" and X.detect(b"x,y") == "text"
    assert X.extract(bytes.fromhex("d0cf11e0a1b11ae1")).error.startswith("ole2") and X.extract(b"\xff\x00").error and X.extract(None).error and X.extract(b"abc", options=options.Extract(most_bytes=2)).error.startswith("oversized")
    assert X.decode("é".encode("utf-16")) == "é" and X.extract(b"a\r\nb").text == "a\nb"


def test_sections():
    text, stats = X.clean_sections([(1, "A", "one"), (2, None, " "), (3, None, "three")])
    assert text == "one\n\nthree\n" and [(s["index"], s["chars"]) for s in stats] == [(1, 4), (3, 7)]


NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:dgm="http://schemas.openxmlformats.org/drawingml/2006/diagram"'


def one_slide(shapes, parts=(), links=()):
    rels = lambda *rows: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="x/{kind}" Target="{to}"/>' for i, kind, to in rows) + "</Relationships>"
    return package({
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/s1.xml")),
        "ppt/slides/s1.xml": f"<p:sld {NS}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/s1.xml.rels": rels(*links),
        "ppt/layouts/_rels/l1.xml.rels": rels(("m", "slideMaster", "../masters/m1.xml")),
        **dict(parts),
    })


def slide_text(*args, **chosen):
    slides, warnings = office.pptx_slides(one_slide(*args), options.Extract(**chosen))
    return slides[0][2], warnings


def test_inherited_bullets():
    shape = lambda ph, *rows: f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{"".join(rows)}</p:txBody></p:sp>'
    row = lambda text, props="": f"<a:p><a:pPr {props}</a:pPr><a:r><a:t>{text}</a:t></a:r></a:p>"
    layout = f'<p:sldLayout {NS}><p:cSld><p:spTree>{shape("<p:ph type=&quot;body&quot; idx=&quot;1&quot;/>".replace("&quot;", chr(34)))}</p:spTree></p:cSld></p:sldLayout>'
    master = f'<p:sldMaster {NS}><p:txStyles><p:bodyStyle><a:lvl1pPr><a:buChar char="x"/></a:lvl1pPr><a:lvl2pPr><a:buNone/></a:lvl2pPr></p:bodyStyle></p:txStyles></p:sldMaster>'
    shapes = shape('<p:ph idx="1"/>', row("item", ">"), row("off", "><a:buNone/>"), row("deeper", 'lvl="1">')) + shape("", row("plain", ">"), row("own", "><a:buAutoNum/>"))
    text, _ = slide_text(shapes, {"ppt/layouts/l1.xml": layout, "ppt/masters/m1.xml": master}, [("l", "slideLayout", "../layouts/l1.xml")])
    assert text == "- item\noff\n  deeper\n\nplain\n- own"
    assert slide_text(shapes)[0] == "item\noff\n  deeper\n\nplain\n- own"


def test_charts_and_diagrams():
    points = lambda *v: "".join(f'<c:pt idx="{i}"><c:v>{x}</c:v></c:pt>' for i, x in v)
    series = f'<c:ser><c:tx><c:v>Sales</c:v></c:tx><c:cat>{points((0, "Q1"), (1, "Q2"))}</c:cat><c:val>{points((0, 5), (2, 7), (99, 1), (-1, 1))}</c:val></c:ser>'
    title = lambda t: f"<c:title><a:p><a:r><a:t>{t}</a:t></a:r></a:p></c:title>"
    chart = f"<c:chartSpace {NS}><c:chart>{title('Year')}{series}<c:ser><c:xVal/></c:ser><c:valAx>{title('Units')}</c:valAx></c:chart></c:chartSpace>"
    pts = "".join(f'<dgm:pt modelId="{i}" {kind}><dgm:t><a:p><a:r><a:t>{t}</a:t></a:r></a:p></dgm:t></dgm:pt>' for i, t, kind in [(0, "", 'type="doc"'), (1, "top", ""), (2, "second", ""), (3, "first", ""), (4, "loop", ""), (5, "loop too", "")])
    edges = "".join(f'<dgm:cxn srcId="{a}" destId="{b}" srcOrd="{o}"/>' for a, b, o in [(0, 1, 0), (1, 2, 1), (1, 3, 0), (4, 5, 0), (5, 4, 0)])
    diagram = f"<dgm:dataModel {NS}><dgm:ptLst>{pts}</dgm:ptLst><dgm:cxnLst>{edges}</dgm:cxnLst></dgm:dataModel>"
    shapes = '<p:graphicFrame><c:chart r:id="c"/></p:graphicFrame><p:graphicFrame><dgm:relIds r:dm="d"/></p:graphicFrame><p:pic><p:nvPicPr><p:cNvPr descr="A harbour at dusk"/></p:nvPicPr></p:pic>'
    parts, links = {"ppt/charts/c.xml": chart, "ppt/diagrams/d.xml": diagram}, [("c", "chart", "../charts/c.xml"), ("d", "diagramData", "../diagrams/d.xml")]
    text, warnings = slide_text(shapes, parts, links)
    assert text == "Year\nUnits\n\n- Category: Q1, Q2\n- Series: Sales\n\n- top\n  - first\n  - second\n- loop\n- loop too\n\n[image: A harbour at dusk]"
    assert any("mixed chart" in w for w in warnings) and any("without a position" in w for w in warnings) and any("1 images" in w for w in warnings)
    text, _ = slide_text(shapes, parts, links, chart_data=True, diagram_text=False)
    assert "| Category | Sales |\n| --- | --- |\n| Q1 | 5 |\n| Q2 |  |\n|  | 7 |" in text and "- top" not in text


def test_docx_in_full():
    run = lambda text, props="": f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'
    para = lambda *runs, props="": f"<w:p><w:pPr>{props}</w:pPr>{''.join(runs)}</w:p>"
    item = lambda text, level, number: para(run(text), props=f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{para(run(text))}</w:tc>"
    body = (
        para(run("Start"), props='<w:pStyle w:val="Kop1"/>')
        + para(run("some "), run("bo", "<w:b/>"), run("ld", "<w:b/>"), run(" a &amp; b &lt;i&gt; "), '<w:hyperlink r:id="h1">' + run("site") + "</w:hyperlink>", '<w:r><w:footnoteReference w:id="2"/></w:r>', run("gone", "<w:vanish/>"), "<w:del>" + run("cut") + "</w:del>")
        + item("one", 0, 1) + item("deeper", 1, 1) + item("two", 0, 1) + item("first", 0, 2) + item("second", 0, 2)
        + f"<w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('tall', '<w:vMerge w:val=&quot;restart&quot;/>'.replace('&quot;', chr(34)))}{cell('x')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('y')}</w:tr></w:tbl>"
        + '<w:p><w:r><w:drawing><docPr descr="A harbour at dusk"/></w:drawing></w:r></w:p>'
    )
    ns = f'{W} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    level = lambda kind: f'<w:lvl w:ilvl="0"><w:numFmt w:val="{kind}"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl>'
    doc = X.extract(package({
        "word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="h1" Type="x/hyperlink" Target="https://a.example/b" TargetMode="External"/></Relationships>',
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Kop1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7">{level("bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="8">{level("decimal")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="2">{para(run("the note"))}</w:footnote></w:footnotes>',
    }))
    assert doc.error is None and doc.warnings == ["1 images dropped, 1 of them captioned", "1 merged cells flattened"]
    assert doc.text == (
        "# Start\n\nsome **bold** a & b <i> [site](https://a.example/b)[1]\n\n- one\n  - deeper\n- two\n\n1. first\n2. second\n\n"
        "| h1 | h2 |\n| --- | --- |\n| tall | x |\n| tall | y |\n\n[image: A harbour at dusk]\n\n1. the note ↑"
    )


def test_blocks_on_most_slides():
    slides = [(n, None, f"own {n}\n\nfooter") for n in range(1, 6)]
    assert office._once(slides) == ([(1, None, "own 1\n\nfooter"), *[(n, None, f"own {n}") for n in range(2, 6)]], 4)
    assert office._once(slides[:3]) == (slides[:3], 0)
