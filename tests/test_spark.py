"""Expressions, relational operators, files, streams and the driver's entry points."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from doclathe.core import clean as C
from doclathe.functions import expr, udfs
from doclathe.operators import relational
from doclathe.plans import catalogue
from doclathe.sources import files
from doclathe.streaming.clean import clean_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


TOKENS = {"": 0, "The quick brown fox jumps over the lazy dog.": 10, "a b": 2, "a      b": 3, "\n    x": 3, "don't": 1, "漢字": 2, "\U0001f600": 2, "12345": 2, "-----": 2, "a" + " " * 256 + "b": 5}


def test_token_estimates(spark):
    rows = spark.createDataFrame(list(TOKENS.items()), "t string, n int").select("t", "n", expr.estimate_tokens("t").alias("m")).collect()
    assert [(r.t, r.m) for r in rows] == [(r.t, r.n) for r in rows]


def test_fast_and_fused_paths_agree(spark):
    texts = ["plain text here", "a  b — c".replace("—", "-"), "one\n\n\n\ntwo", "  lead \t x", "x\\*y", "Bell\u0007 end  ", "`code  x`", "| a |  b |\n| - | - |", "wrapped\nline", "", "\n \n"]
    got = {r.t: r.cleaned for r in udfs.clean_routed(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == {t: C.clean(t) for t in texts}


def test_nulls_stay(spark):
    row = spark.createDataFrame([(None,)], "t string").select(expr.clean_fast("t").alias("a"), udfs.clean(F.col("t")).alias("b"), udfs.html_to_text("t").alias("c")).first()
    assert tuple(row) == (None, None, None)


def test_repeats_keep_the_first(spark):
    rows = [("d", s, 0, "foot") for s in range(5)] + [("d", s, 1, f"own {s}") for s in range(5)] + [("e", s, 0, "foot") for s in range(3)]
    got = relational.suppress_repeats(spark.createDataFrame(rows, "d string, s int, i int, t string"), "d", "s", "i", "t")
    assert sum(r.t == "foot" and r.d == "d" for r in got.collect()) == 1 and got.where("d = 'e'").count() == 3


def test_files_and_limits(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>Hi</h1><p>x</p>")
    (tmp_path / "b.txt").write_bytes(b"\xff\x00\xfe")
    (tmp_path / "c.md").write_text("long " * 100)
    got = {r.source.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path), 300).collect()}
    assert got["a.html"].text == "# Hi\n\nx" and got["b.txt"].error and got["c.md"].error.startswith("oversized")
    plan = spark.read.format("binaryFile").load(str(tmp_path)).where("length <= 300")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a  b"), (2, "`x  y`")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    query = clean_stream(spark, f"{tmp_path}/in", "doc_id long, text string").select("doc_id", "cleaned").writeStream.format("memory").queryName("cleaned_stream").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("cleaned_stream").collect()} == {(1, "a b\n"), (2, "`x  y`\n")}


def test_sql_functions(spark):
    udfs.register(spark)
    assert spark.sql("SELECT doc_clean('a  b') AS a, doc_html_to_text('<p>x') AS b, doc_is_transcript('WEBVTT') AS c").first() == ("a b\n", "x", True)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
