"""Cleaning of a stream: every step is a function of one document, so it is a stateless map under readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import expr, udfs


def clean_stream(spark: SparkSession, path: str, schema, text: str = "text") -> DataFrame:
    docs = spark.readStream.schema(schema).parquet(path)
    return udfs.clean_routed(docs, text).withColumn("stats", expr.stats("cleaned"))
