"""Secret scans with corpus-wide ownership.

Three base kinds are found by pattern in each text. Further candidates are long mixed tokens of high entropy
outside the base spans. All candidates, base ones by their value, are judged by the corpus: the hash of each is
counted by distinct owners (``source``) and distinct repositories (``source`` and ``lang``). What more than
``MOST_OWNERS`` owners or ``MOST_REPOSITORIES`` repositories have is a widely copied example; what fewer have looks like
somebody's live credential. Base spans stay in any case, further candidates are reported (as kind ``owned``) only if
they aren't copied, and each document has the number of its distinct values of either sort (n_owned, n_copied).

Defined results: null text is empty and has no spans; a null source is an owner of its own, and so is a null language
a repository; no rows give no rows; rows that repeat get the same spans each; extra columns are ignored, or kept under
whatever name by ``redact_documents``. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_names, own_columns, trimmed, written

KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("passw", "secret", "token", "api")
#: Access keys, hex runs and further candidates all lie in such runs, so the text is searched once.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A candidate with more owners, or in more repositories, is a widely copied example.
MOST_OWNERS = 2
MOST_REPOSITORIES = 4
LEAST_ENTROPY = 3.5


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def looks_random(token: str) -> bool:
    """Digits, and letters of both cases or many changes between digits and letters; bits a character."""
    digits = sum(c.isdigit() for c in token)
    if digits < 2 or not any(c.isalpha() for c in token):
        return False
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    both = token.lower() != token and token.upper() != token
    return (both or turns >= 5) and entropy(token) >= LEAST_ENTROPY


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[str]]:
    """(start, kind, end) of the base kinds in order; of further candidates; and the values of both, in this order."""
    found: list[tuple[int, int, int, str]] = []
    more: list[tuple[int, int]] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for run in _RUN.finditer(text):
        word, at = run[0], run.start()
        found += [(at + m.start(), 1, at + m.end(), m[0]) for m in _ACCESS.finditer(word)]
        found += [(at + m.start(), 2, at + m.end(), m[0]) for m in _HEX.finditer(word)]
        if len(word) >= 20:
            more += [(at + m.start(), at + m.end()) for m in _TOKEN.finditer(word) if looks_random(m[0])]
    found.sort()
    others = [(s, 3, e) for s, e in more if not any(a < e and s < b for a, _, b, _ in found)]
    return [x[:3] for x in found], others, [x[3] for x in found] + [text[s:e] for s, _, e in others]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return candidates(text)[0]


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_CAND = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())])
_SCANNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("owner", pa.string()), ("lang", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(_SPAN)), ("candidates", pa.list_(_CAND))])
_SCANNED_DDL = "doc_id long, text_hash long, owner string, lang string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,kind:int,end:int,hash:string>>"


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches):
    for part in chunks(batches, "text"):
        rows = []
        for doc, text, source, lang, text_hash in zip(*(part.column(n).to_pylist() for n in ("doc_id", "text", "source", "lang", "text_hash")), strict=True):
            spans, others, values = candidates(text or "")
            kinds = [k for _, k, _ in spans]
            digest = hashlib.sha256(joined(spans).encode()).hexdigest()
            cand = [{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for (s, k, e), v in zip([*spans, *others], values)]
            rows.append((doc, text_hash, source, lang, kinds.count(0), kinds.count(1), kinds.count(2), digest, [dict(zip(("start", "kind", "end"), x)) for x in spans], cand))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCANNED)] if rows else [pa.array([], f.type) for f in _SCANNED], schema=_SCANNED)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_assign, n_access, n_hex, base_sha256, spans (text), found (the same as an array), n_owned, n_copied."""
    rows = own_columns(docs, "doc_id", "text", "source", "lang").withColumn("text_hash", F.xxhash64("text"))
    scanned = written(rows.mapInArrow(trimmed(_scan), _SCANNED_DDL), "secrets")
    each = scanned.where(F.size("candidates") > 0).select("doc_id", "text_hash", F.struct("owner").alias("owner"), F.struct("owner", "lang").alias("repo"), F.explode("candidates").alias("c")).select("doc_id", "text_hash", "owner", "repo", "c.*")
    # distinct first, so that a secret which is everywhere is a row for each repository, not for each copy
    owners = each.select("hash", "owner", "repo").distinct().groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count(F.lit(1)).alias("n_repos"))
    owners = owners.select("hash", ((F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repos") <= MOST_REPOSITORIES)).alias("live"))
    judged = each.join(owners, "hash").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(F.col("live") & (F.col("kind") == 3), F.struct("start", "kind", "end"))).alias("more"),
        F.size(F.collect_set(F.when(F.col("live"), F.col("hash")))).cast("long").alias("n_owned"),
        F.size(F.collect_set(F.when(~F.col("live"), F.col("hash")))).cast("long").alias("n_copied"),
    )
    judged = judged.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "more", "n_owned", "n_copied")
    both = scanned.join(judged, scanned["doc_id"].eqNullSafe(judged["_d"]) & (scanned["text_hash"] == judged["_t"]), "left")
    both = both.withColumn("found", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    zero = F.lit(0).cast("long")
    return both.select("doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), "found", F.coalesce("n_owned", zero).alias("n_owned"), F.coalesce("n_copied", zero).alias("n_copied"))


def _redacting(held: str):
    def run(batches):
        for part in chunks(batches, "text"):
            out = []
            for text, found in zip(part.column("text").to_pylist(), part.column(held).to_pylist(), strict=True):
                if found:
                    kept, at = [], 0
                    for x in found:
                        if x["end"] > at:
                            if x["start"] >= at:
                                kept += [text[at : x["start"]], "[secret]"]
                            at = x["end"]
                    text = "".join(kept) + text[at:]
                out.append(text)
            names = [n for n in part.schema.names if n != held]
            arrays = [pa.array(out, pa.string()) if n == "text" else part.column(n) for n in names]
            if "n_chars" in names:
                arrays[names.index("n_chars")] = pc.utf8_length(arrays[names.index("text")]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with every reported span replaced by ``[secret]``; all other columns as they came (n_chars follows the text)."""
    of, text, held = free_names(docs, "secret_id", "secret_text", "secret_spans")
    spans = secret_spans(docs).where(F.size("found") > 0).select(F.col("doc_id").alias(of), F.col("text_hash").alias(text), F.col("found").alias(held)).dropDuplicates([of, text])
    same = docs["doc_id"].eqNullSafe(spans[of]) & (F.xxhash64(docs["text"]) == spans[text])
    return docs.join(spans, same, "left").drop(of, text).mapInArrow(trimmed(_redacting(held)), docs.schema)
