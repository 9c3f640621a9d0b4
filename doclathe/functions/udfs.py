"""The fused Arrow path: one Python crossing a batch, for what expressions can't say; and the functions by SQL name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.options import Clean, Extract, preset
from . import expr

EXTRACTED = "format string, text string, warnings array<string>, error string, sections array<struct<index:int,label:string,text:string>>"
PROCESSED = "format string, text string, cleaned string, warnings array<string>, error string, sections array<struct<index:int,label:string,chars:bigint>>"
ITEMS = "doc_id {key}, page int, item int, text string, x double, y double, width double, height double, page_height double"


def clean(c, options: Clean | None = None) -> Column:
    """Any text through the whole pipeline. Null stays null."""
    o = options or preset()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from ..core.clean import clean as one

        for s in batches:
            yield s.map(lambda t: one(t, o), na_action="ignore")

    return run(c)


def clean_routed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``cleaned`` (balanced): expressions for plain texts, the fused UDF for the others, in two branches of one union."""
    state = F.coalesce(expr.needs_state(text), F.lit(False))
    fast = docs.where(~state).withColumn("cleaned", expr.clean_fast(text))
    full = docs.where(state).withColumn("cleaned", clean(F.col(text)))
    return fast.unionByName(full)


def _mapped(kind: T.DataType, load) -> object:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = load()
        for s in batches:
            yield s.map(one, na_action="ignore")

    return run


def _html():
    from ..core.html_text import html_to_text

    return lambda t: html_to_text(t)[0]


def _rtf():
    from ..core.rtf import rtf_to_text

    return lambda t: rtf_to_text(t)[0]


def _tidy():
    from ..core.transcript import tidy

    return tidy


def _looks():
    from ..core.transcript import looks_like_transcript

    return looks_like_transcript


def _nfkc():
    import unicodedata

    return lambda t: unicodedata.normalize("NFKC", t)


html_to_text = _mapped(T.StringType(), _html)
rtf_to_text = _mapped(T.StringType(), _rtf)
tidy_transcript = _mapped(T.StringType(), _tidy)
looks_like_transcript = _mapped(T.BooleanType(), _looks)
nfkc = _mapped(T.StringType(), _nfkc)


def extract(content, name, options: Extract | None = None) -> Column:
    """struct of EXTRACTED from binary content and a file name; a document that can't be read has an error, the job goes on."""
    @F.pandas_udf(EXTRACTED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from ..core.extract import extract as one

        for bodies, names in batches:
            found = [one(b, n or "", options) for b, n in zip(bodies, names)]
            sections = [[{"index": i, "label": title, "text": t} for i, title, t in d.sections] for d in found]
            yield pd.DataFrame({"format": [d.format for d in found], "text": [d.text for d in found], "warnings": [d.warnings for d in found], "error": [d.error for d in found], "sections": sections})

    return run(content, name)


def process(content, name, reading: Extract | None = None, cleaning: Clean | None = None) -> Column:
    """struct of PROCESSED: extracted and cleaned in one crossing, section by section where there are some."""
    @F.pandas_udf(PROCESSED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from ..core import extract as core

        for bodies, names in batches:
            found = [core.extract(b, n or "", reading) for b, n in zip(bodies, names)]
            done = [core.clean_document(d, cleaning, bool(reading and reading.section_headings)) if d.text is not None else (None, []) for d in found]
            yield pd.DataFrame({
                "format": [d.format for d in found], "text": [d.text for d in found], "cleaned": [t for t, _ in done],
                "warnings": [d.warnings for d in found], "error": [d.error for d in found], "sections": [stats for _, stats in done],
            })

    return run(content, name)


def pdf_items(files: DataFrame, key: str, content: str) -> DataFrame:
    """doc_id, page and the positioned items of PDF files, a row for each, upright, for ``operators.pages``.

    A file is read page by page; its layout can then be spread by page. Files that can't be read give no rows here;
    ``extract`` tells why.
    """
    schema = ITEMS.format(key=files.schema[key].dataType.simpleString())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..core import pdf

        for frame in batches:
            for doc, body in zip(frame[key], frame[content]):
                try:
                    for page, width, height, runs, _ in pdf.read_pages(bytes(body)) if body is not None else ():
                        placed, tall, _, _ = pdf.put_upright(runs, width, height)
                        yield pd.DataFrame([(doc, page, n, r.text, r.x, r.y, r.width, r.height, tall) for n, r in enumerate(placed)], columns=names)
                except (pdf.Unreadable, ArithmeticError, AttributeError, LookupError, RecursionError, TypeError, ValueError):
                    continue

    return files.select(key, content).mapInPandas(run, schema)


def register(spark: SparkSession) -> None:
    """doc_clean, doc_html_to_text, doc_rtf_to_text, doc_tidy_transcript, doc_is_transcript, doc_nfkc for SQL."""
    @F.pandas_udf("string")
    def doc_clean(s: pd.Series) -> pd.Series:
        from ..core.clean import clean as one

        return s.map(one, na_action="ignore")

    for name, f in (("doc_clean", doc_clean), ("doc_html_to_text", html_to_text), ("doc_rtf_to_text", rtf_to_text), ("doc_tidy_transcript", tidy_transcript), ("doc_is_transcript", looks_like_transcript), ("doc_nfkc", nfkc)):
        spark.udf.register(name, f)


def utterances(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, speaker, time, text: one row per utterance."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("seq", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("speaker", "time", "text")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..core.transcript import utterances as said

        for frame in batches:
            rows = [(k, i, u.speaker, u.time, u.text) for k, t in zip(frame[key], frame[text]) if t for i, u in enumerate(said(t))]
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select(key, text).mapInPandas(run, schema)
