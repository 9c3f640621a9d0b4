"""The command line: arguments, names, delivery and exit codes."""

import io
import json

import pytest

from doclathe import cli


class In(io.StringIO):
    def __init__(self, data: bytes):
        super().__init__()
        self.raw = data

    @property
    def buffer(self):
        return io.BytesIO(self.raw)


def call(spark, *argv, given=b""):
    out, err = io.StringIO(), io.StringIO()
    return cli.run([str(x) for x in argv], spark, In(given), out, err), out.getvalue(), err.getvalue()


def test_arguments():
    _, reading, cleaning = cli.parse(["--unwrap", "--aggressive", "--no-unwrap", "--keep-tabs", "--pages", "2-3,9", "--chart-data"])
    assert not cleaning.unwrap and cleaning.strip_markdown and not cleaning.tabs_to_spaces and reading.pages == ((2, 3), (9, 9)) and reading.chart_data
    for bad in ("-o x a b", "-o x -D y a", "-w", "-w -o x a", "-c a", "-j -w a", "-o x.docx a", "--pages 0 a", "--max-pages 0 a", "--max-blank-lines x a", "--nothing"):
        with pytest.raises(cli.Usage):
            cli.parse(bad.split())


def test_names():
    assert cli.output_names([("q1/a.pdf", "pdf"), ("q2/A.pdf", "pdf"), ("q2/a.pdf", "pdf"), ("a.csv", "text"), ("a-2.md", "markdown"), ("<stdin>", "text")]) == ["a.md", "q2-A.md", "a-2.md", "a.csv", "a-2-2.md", "stdin.md"]


def test_delivery(spark, tmp_path):
    one, two, odd = tmp_path / "one.html", tmp_path / "two [x] %41.txt", tmp_path / "bad.txt"
    one.write_text("<h1>Hi</h1><p>there")
    two.write_text("a   b")
    odd.write_bytes(b"\xff\x00\xfe")
    code, out, err = call(spark, one, two, "--stats")
    assert (code, out) == (0, "# Hi\n\nthere\n\n--- two [x] %41.txt ---\n\na b\n") and "total:" in err
    code, out, err = call(spark, odd, two, tmp_path / "none.txt", "-j")
    assert code == 1 and json.loads(out)["stats"]["chars"] == {"before": 5, "after": 4} and "none.txt: no such file" in err and "bad.txt: not text" in err
    assert call(spark, one, two, "-D", tmp_path / "out")[:2] == (0, "") and (tmp_path / "out" / "one.md").read_text() == "# Hi\n\nthere\n" and (tmp_path / "out" / two.name).read_text() == "a b\n"
    assert call(spark, one, two, "-w")[0] == 1 and two.read_text() == "a b\n" and one.read_text().startswith("<h1>")
    assert call(spark, "-o", tmp_path / "o.md", given=b"x  y")[:2] == (0, "") and (tmp_path / "o.md").read_text() == "x y\n"
    assert call(spark, "-j", "-w", one)[0] == 2
