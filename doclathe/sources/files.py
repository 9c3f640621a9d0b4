"""Files as rows, and rows as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.fixed import MOST_INPUT_BYTES
from ..core.options import Clean, Extract
from ..functions import expr, udfs


def read_documents(spark: SparkSession, path: str, most_bytes: int = MOST_INPUT_BYTES, pattern: str = "*") -> DataFrame:
    """source, format, text, warnings, error, sections. The size limit is a pushed filter: larger files are listed, not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    good = files.where(F.col("length") <= most_bytes).select(F.col("path").alias("source"), udfs.extract("content", "path").alias("d")).select("source", "d.*")
    large = files.where(F.col("length") > most_bytes).select(F.col("path").alias("source"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("warnings"), F.format_string("oversized: %d bytes, the limit is %d", F.col("length"), F.lit(most_bytes)).alias("error"), F.array().cast("array<struct<index:int,label:string,text:string>>").alias("sections"))
    return good.unionByName(large)


def read_pdf_items(spark: SparkSession, path: str, most_bytes: int = MOST_INPUT_BYTES) -> DataFrame:
    """Positioned items of the PDF files of a folder; doc_id is the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return udfs.pdf_items(files.where(F.col("length") <= most_bytes), "path", "content")


def process(named: DataFrame, reading: Extract | None = None, cleaning: Clean | None = None) -> DataFrame:
    """From (source, content): source, format, text, stats {chars, bytes, lines, tokens: {before, after}, saved_pct}, warnings, error, sections."""
    done = named.select("source", udfs.process("content", "source", reading, cleaning).alias("d")).select("source", "d.*")
    both = done.withColumn("_b", expr.stats("text")).withColumn("_a", expr.stats("cleaned"))
    pairs = [F.struct(F.col(f"_b.{m}").alias("before"), F.col(f"_a.{m}").alias("after")).alias(m) for m in ("chars", "bytes", "lines", "tokens")]
    stats = F.struct(*pairs, expr.saved_pct("_b.chars", "_a.chars").alias("saved_pct"))
    return both.select("source", "format", F.col("cleaned").alias("text"), stats.alias("stats"), "warnings", "error", "sections")


def joined_output(docs: DataFrame, order: str, name: str, text: str) -> DataFrame:
    """One text column row per document, headed by its name where there are several (for the ``text`` writer)."""
    return docs.orderBy(order).select(F.concat(F.lit("--- "), F.col(name), F.lit(" ---\n\n"), F.col(text)).alias("value"))


def json_output(docs: DataFrame) -> DataFrame:
    """One JSON document per row: source, format, text, stats, warnings as they are there."""
    return docs.select(F.to_json(F.struct(*[c for c in ("source", "format", "text", "stats", "warnings") if c in docs.columns])).alias("value"))
