"""A training corpus from raw documents: quality rules, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclathe.llm import bpe, mixing, ngram_join, quality, secrets
from doclathe.llm.common import discard, free_names, written
from doclathe.llm.queries import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A verdict depends on text and host alone, so that it finds its rows by (id, text, source), of
    which each may be null; a null text is rejected, rows that repeat are judged alike, other columns may have any name."""
    of, text, host = free_names(docs, "kept_id", "kept_text", "kept_source")
    verdicts = quality.quality_rules(docs).where("kept").select(F.col("doc_id").alias(of), F.col("text_hash").alias(text), F.col("source").alias(host)).distinct()
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(verdicts[of]) & (F.xxhash64(docs["text"]) == verdicts[text]) & docs["source"].eqNullSafe(verdicts[host]), "left_semi")


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id; rows without words or id stay."""
    return ngram_join.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; its secrets are cut out of its text, and n_chars follows. A null text stays null."""
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (up to three times, or not at all); texts without words are never taken."""
    return mixing.mix_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: doc_id, lang, source, n_tokens, the two digests and the ids; none for a null or empty text."""
    return bpe.tokenize(docs, vocabulary_path(), keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: Mixing draws by Spark's hash, and tokens are beyond SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{number}")
            if number:
                discard(before)
    return docs
