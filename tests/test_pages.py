"""Layout of positioned items, and running text across pages."""

from doclathe.core.pages import Item, Line, lay_out, paragraphs, running_key
from doclathe.operators import pages


def row(y, *words, step=60):
    return [Item(w, 50 + step * n, y, len(w) * 5.0, 10) for n, w in enumerate(words)]


def test_rows_and_gaps():
    lines = lay_out(row(500, "alpha", "beta") + [Item("x", 220, 503, 5, 10)] + row(480, "next"), 792)
    assert [x.text.split() for x in lines] == [["alpha", "beta", "x"], ["next"]]
    assert lay_out([Item(" ", 0, 0, 1, 1)], 100) == []


def test_two_columns():
    items = [Item("HEAD", 50, 780, 20, 10), Item("foot", 50, 20, 20, 10)]
    for n in range(6):
        items += [Item(f"left column text line {n}", 50, 600 - 12 * n, 110, 10), Item(f"right column text line {n}", 300, 600 - 12 * n, 115, 10)]
    got = [x.text for x in lay_out(items, 792)]
    assert got == ["HEAD", *[f"left column text line {n}" for n in range(6)], *[f"right column text line {n}" for n in range(6)], "foot"]


def test_paragraphs():
    lines = [Line(100, 0, 100, "one"), Line(88, 0, 100, "two"), Line(60, 0, 100, "three"), Line(48, 0, 60, "end."), Line(36, 10, 100, "indented")]
    assert paragraphs(lines) == "one\ntwo\n\nthree\nend.\n\nindented" and paragraphs([]) == ""


def test_running_text(spark):
    rows = [(1, p, n, y, 0.0, 9.0, 792.0, t) for p in range(1, 6) for n, (y, t) in enumerate([(780.0, "Report"), (400.0, f"body {p}"), (400.0, "Report"), (20.0, f"Page {p} of 5")])]
    got = pages.suppress_running_text(spark.createDataFrame(rows, pages.LINES)).collect()
    assert sorted(r.page for r in got if r.text == "Report" and r.y > 700) == [1] and sum(r.y < 50 for r in got) == 1 and sum(r.y == 400 for r in got) == 10
    keys = spark.createDataFrame(rows, pages.LINES).select("y", "text", pages.running_key("y", "text").alias("k")).collect()
    assert all(r.k == running_key(r.y, r.text) for r in keys)


def test_running_text_of_repeating_sentences(spark, tmp_path):
    import duckdb

    from doclathe.plans import catalogue

    rows = [(1, "Same. " * 170 + "end"), (2, "Same. " * 100), (3, " ".join(f"Line {i}." for i in range(200))), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(catalogue.ORACLES["running_text"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["running_text"](spark, str(tmp_path)).collect())) == sorted(want)


def test_files_to_text(spark, tmp_path):
    from doclathe.sources import files
    from test_pdf import lines, write

    (tmp_path / "a.pdf").write_bytes(write([lines("Title", "of a page"), lines("Another")]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    items = files.read_pdf_items(spark, str(tmp_path))
    got = pages.page_texts(pages.page_lines(items)).orderBy("page").collect()
    assert [(r.page, r.text) for r in got] == [(1, "Title\nof a page"), (2, "Another")]
    read = {r.source.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert [s.text for s in read["a.pdf"].sections] == ["Title\nof a page", "Another"] and "no catalogue" in read["b.pdf"].error
