"""The pipeline stage by stage, each on the whole of its predecessor's rows."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_operators import CORPUS, DOCS, WORD, brute_components, brute_quality

from doclathe.llm import secrets

SYMBOLS = lambda text: len(re.findall("[#*$%&|<>]", text))


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(CORPUS + [(200, "password=abcdefghijklmnop " + " ".join(f"u{i}" for i in range(80)), "en", "a", 0)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{number}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{number}.parquet")
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([r.asDict() for r in docs.collect()])
        if number == 0:
            assert sorted(map(repr, (tuple(r.values()) for r in kept[0]))) == sorted(repr(r) for r in before if not brute_quality(r[1])[-1] and not (SYMBOLS(r[1]) * 10 > len(WORD.findall(r[1]))))
        if number == 1:
            comp = {d: c for d, _, c in brute_components(before) if d is not None}
            assert sorted(r["doc_id"] for r in kept[1] if r["doc_id"] is not None) == sorted(set(comp.values()))
        if number == 2:
            assert not any(secrets.base_spans(r["text"]) for r in kept[2]) and len(kept[2]) == len(before)
        if number == 3:
            assert set(Counter(r["doc_id"] for r in kept[3]).values()) <= {1, 2, 3} and {r["text"] for r in kept[3]} <= {r[1] for r in before}
    assert all(r["n_tokens"] == len(r["ids"]) >= len(WORD.findall("x")) for r in kept[4])
    assert pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def test_stages_keep_clashing_columns(spark, tmp_path):
    names = ["_h", "_d", "_t", "found", "_gone", "_mix_hash", "kept_id", "mix_id", "secret_spans", "jaccard_gone", "size", "text_hash"]
    docs = plain = spark.createDataFrame(CORPUS + [(200, "password=abcdefghijklmnop " + " ".join(f"u{i}" for i in range(80)), "en", "a", 0)], DOCS)
    for name in names:
        docs = docs.withColumn(name, F.lit("clash"))
    for number, (_, stage) in enumerate(pipeline.STAGES):
        for part in ("docs", "plain"):
            stage(spark, docs if part == "docs" else plain, "").write.parquet(f"{tmp_path}/{part}{number}.parquet")
        before = docs.columns
        docs, plain = (spark.read.parquet(f"{tmp_path}/{part}{number}.parquet") for part in ("docs", "plain"))
        if number < 4:
            assert docs.columns == before and docs.where(" OR ".join(f"{n} != 'clash'" for n in names)).count() == 0
        assert sorted(map(repr, docs.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
        empty = stage(spark, docs.limit(0), "") if number < 4 else docs.limit(0)
        assert empty.count() == 0
