"""PDF bytes to text: files are written here, whole, packed and damaged."""

import random
import zlib

import pytest

from doclathe.core import extract as X
from doclathe.core import pdf, preformat
from doclathe.core.options import Extract


def write(pages, font="<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>", packed=False, extra=(), trailer=""):
    """A file with a content stream for each page. Objects: 1 catalogue, 2 page tree, 3 font, then ``extra``, then pages."""
    kids = [4 + len(extra) + 2 * n for n in range(len(pages))]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>".encode(), 3: font.encode()}
    objects |= {4 + n: x for n, x in enumerate(extra)}
    for k, content in zip(kids, pages):
        body = zlib.compress(content.encode("latin-1"))
        objects[k] = f"<< /Type /Page /Parent 2 0 R /Contents {k + 1} 0 R >>".encode()
        objects[k + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body)
    out, at, inside = bytearray(b"%PDF-1.7\n"), {}, []
    if packed:
        inside = [n for n, x in objects.items() if b"stream" not in x]
        texts = [objects.pop(n) for n in inside]
        head, body = b"", b""
        for n, x in zip(inside, texts):
            head += b"%d %d " % (n, len(body))
            body += x + b" "
        data = zlib.compress(head + body)
        holder = max([*objects, *inside]) + 1
        objects[holder] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(inside), len(head), len(data), data)
    for n, x in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    start, size = len(out), max([*objects, *inside]) + 2
    if packed:
        rows = [bytes([1]) + at[n].to_bytes(3, "big") + b"\0" if n in at else bytes([2]) + holder.to_bytes(3, "big") + bytes([inside.index(n)]) if n in inside else bytes(5) for n in range(size)]
        up = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(r, above)) for r, above in zip(rows, [bytes(5), *rows]))
        data = zlib.compress(up)
        out += b"%d 0 obj\n<< /Type /XRef /W [1 3 1] /Size %d /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (size - 1, size, len(data), data)
    else:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, a) for n, a in at.items())
        out += b"trailer\n<< /Size %d /Root 1 0 R %s >>\n" % (size, trailer.encode())
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


def lines(*rows, x=72, y=700, step=14):
    return f"BT /F1 10 Tf {x} {y} Td " + " ".join(f"({r}) Tj 0 -{step} Td" for r in rows) + " ET"


@pytest.mark.parametrize("packed", [False, True])
def test_whole_and_packed(packed):
    got = X.extract(write([lines("First line of text", "second \\(line\\) \\101"), lines("Next page")], packed=packed))
    assert (got.error, got.format, got.text) == (None, "pdf", "First line of text\nsecond (line) A\n\nNext page")
    assert [s[0] for s in got.sections] == [1, 2]
    assert X.extract(write([lines("a b"), lines("c d")], packed=packed), options=Extract(pages=((2, 2),))).text == "c d"


def test_damaged():
    good = write([lines("Still here")])
    assert X.extract(good.replace(b"startxref\n", b"startxref\n9")).text == "Still here"
    assert X.extract(good[: good.index(b"xref\n0")]).text == "Still here"
    assert X.extract(write([lines("Still here")], packed=True).replace(b"/XRef", b"/Xref").replace(b"startxref", b"startnone")).text == "Still here"
    assert "encrypted" in X.extract(write([lines("x")], trailer="/Encrypt << /V 1 >>")).error
    assert "no catalogue" in X.extract(b"%PDF-1.4 nothing").error and "scan" in X.extract(write([""])).error
    rng = random.Random(5)
    for base in (good, write([lines("Still here")], packed=True)):
        for _ in range(150):  # whatever is broken, there is a document with text or an error
            broken = bytearray(base)
            for _ in range(rng.randint(1, 12)):
                broken[rng.randrange(9, len(broken))] = rng.randrange(256)
            got = X.extract(bytes(broken))
            assert (got.text is None) != (got.error is None)


def test_fonts():
    page = "BT /F1 10 Tf 72 700 Td <00010002> Tj <0003> Tj ET"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0002> <0041> endbfrange 1 beginbfchar <0003> <00660069> endbfchar"
    extra = [b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap), b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /W [1 [500 700]] >>"]
    font = "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R /DescendantFonts [5 0 R] >>"
    assert X.extract(write([page], font, extra=extra)).text == "ABfi"
    font = "<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /uni4E2D /Scaron /a.alt] >> /FirstChar 1 /Widths [600 600 600 600] >>"
    assert X.extract(write(["BT /F1 10 Tf 72 700 Td <01020304> Tj (\\351) Tj ET"], font)).text == "é中Ša" + "é"


def test_spacing():
    page = "BT /F1 10 Tf 72 700 Td [(Wo) -20 (rd) -300 (next)] TJ ET q 1 0 0 1 300 0 cm BT /F1 10 Tf 1 0 0 1 72 700 Tm (far) Tj ET Q"
    (number, width, height, runs, cut), = pdf.read_pages(write([page]))
    assert [(r.text, round(r.x), r.y, r.height, r.turn) for r in runs] == [("Word next", 72, 700, 10, 0), ("far", 372, 700, 10, 0)] and (number, width, height, cut) == (1, 612, 792, False)


def test_forms_and_pictures_within():
    form = b"BT /F1 10 Tf 0 0 Td (in a form) Tj ET /Me Do"
    extra = [b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 72 600] /Resources << /Font << /F1 3 0 R >> /XObject << /Me 4 0 R >> >> /Length %d >>\nstream\n%s\nendstream" % (len(form), form)]
    data = write(["BI /W 1 /H 1 ID (Tj EI q Q /Fm Do " + lines("outside")], extra=extra).replace(b"/Font << /F1 3 0 R >> >> >>\nendobj\n3", b"/Font << /F1 3 0 R >> /XObject << /Fm 4 0 R >> >> >>\nendobj\n3")
    assert X.extract(data).text == "outside\nin a form"  # once: a form within itself isn't followed


def test_turned():
    page = "BT /F1 10 Tf 0 1 -1 0 100 50 Tm (sideways one) Tj 0 -14 Td (sideways two) Tj ET"
    got = X.extract(write([page]))
    assert got.text == "sideways one\nsideways two" and "1 pages laid out a quarter or half turn" in got.warnings


def test_running_text():
    pages = [lines("Annual report", y=770) + " " + lines(f"body {n} words", y=400) + " " + lines(f"Page {n} of 5", y=20) for n in range(1, 6)]
    got = X.extract(write(pages))
    assert got.text.count("Annual report") == 1 and got.text.count("of 5") == 1 and "8 running headers and footers dropped" in got.warnings
    assert X.extract(write(pages), options=Extract(drop_running_headers=False)).text.count("Annual report") == 5


def test_grids_and_indents():
    grid = "name    size    age\nab      12      3\ncde     4       55"
    assert preformat.fence_grids(f"prose\n{grid}\nmore") == (f"prose\n\n```\n{grid}\n```\n\nmore", 1)
    assert preformat.fence_grids("a  b\nc  d") == ("a  b\nc  d", 0)
    assert preformat.flatten_indents("   one\n     two\n    three") == "one\ntwo\nthree"
    assert preformat.flatten_indents("def f:\n    if x:\n        y") == "def f:\n    if x:\n        y"
    assert preformat.flatten_indents("   - item\n   text\n```\n   kept\n```") == "   - item\ntext\n```\n   kept\n```"
    assert preformat.dehyphenate("inter-\nnational A-\nB") == "international A-\nB"
