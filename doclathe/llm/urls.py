"""URL filter: rules by host and path, and for the rest a ratio of two character language models.

The models are interpolated (Witten-Bell) Markov models of characters, of order 0 to ``ORDER``: one of
accepted and one of rejected URLs. They read host and path; in training alone the rules' own hosts are cut off
the host's end, so that the rules aren't learnt. The score of a URL is the difference of the two log-likelihoods
by character. Its threshold is calibrated on held-out URLs, read whole: the lowest that rejects at most
``FALSE_BLOCKS`` of the accepted ones.

They are fitted to all distinct labelled URLs but a third by hash, which is held out: counts of characters after each
context are summed by Spark in ``CELLS`` cells for each model, by a hash of the context, so that a model's size is
bounded at any number of URLs; the threshold is the exact quantile of all held-out accepted ones. Rejected are those that a rule blocks or whose host has one of ``WORDS``; all others count as
accepted, so that a host of which some paths are blocked isn't learnt as bad by itself. Every URL is judged.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
scored as an empty string; without labelled URLs of both kinds nothing is blocked but by rule; no rows give no rows;
rows that repeat are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, own_columns, written

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words of trades whose hosts are commonly blocked: gambling, drugs by mail, adult, adverts and tracking, piracy, loans
#: and fakes. A host that has one is a rejected example (a label, not a rule). Words under six letters must be a whole part
#: of a label, but for digits at its end; longer ones may be anywhere in it.
WORDS = tuple(
    "casino poker roulette jackpot betting bet bets slots lottery bingo gambling "
    "viagra cialis pill pills steroids xanax tramadol "
    "porn xxx escort escorts hentai camgirls "
    "ad ads adserver adservice adtrack adclick popads doubleclick tracker clickbait "
    "warez torrent torrents keygen cracked "
    "payday forex replica replicas".split()
)
#: Counters of a model. Contexts may share one by chance, the more the fuller it is; every URL counts.
CELLS = 1 << 20
ORDER = 5
FALSE_BLOCKS = 0.01


def parts(urls: DataFrame) -> DataFrame:
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("_rest", rest).withColumn("host", host).withColumn("path", path).withColumn("host", lower).drop("_rest")


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and by_rule: the longest rule (host and path together) that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("by_rule", verdict)


def bad_word() -> str:
    """A regular expression: a host with one of WORDS."""
    short, long = ("|".join(w for w in WORDS if (len(w) < 6) == few) for few in (True, False))
    return rf"(?:^|[._-])(?:{short})[0-9]*(?:[._-]|$)|{long}"


def masked(host: str, rules) -> str:
    """For training: the host without the longest rule host at its end."""
    for ends in sorted((r[0] for r in rules), key=len, reverse=True):
        if host == ends or host.endswith("." + ends):
            return host[: -len(ends)].rstrip(".")
    return host


def contexts(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character of the texts and the end of each: hashes of the contexts of 0 to ``order`` characters before it
    (a row for each), of these with the character, and the text's number."""
    starts, ends = "\x02" * order, "\x03"
    chars = np.frombuffer("".join(starts + t + ends for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) + order + 1 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    at = np.flatnonzero(np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size) >= order)
    before, after = np.empty((2, order + 1, len(at)), np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(order + 1):
        if k:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + chars[at - k] + np.uint64(1))
        before[k] = mix(h + np.uint64(k + 1))
        after[k] = mix(before[k] ^ (chars[at] + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    return before, after, text[at]


class Markov:
    """Character counts after each context of up to ``order`` characters, smoothed by Witten-Bell; counts of a context and
    of a context with a character, and the kinds of characters after a context, are found by hash."""

    def __init__(self, pairs: np.ndarray, totals: np.ndarray, kinds: np.ndarray):
        self.pairs, self.totals, self.kinds = pairs, totals, kinds

    def __getstate__(self):
        """Packed, as most counters are zero or small."""
        return [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in (self.pairs, self.totals, self.kinds)]

    def __setstate__(self, state):
        self.pairs, self.totals, self.kinds = (np.frombuffer(zlib.decompress(x), np.int64) for x in state)

    def scores(self, before: np.ndarray, after: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        cells = np.uint64(len(self.pairs))
        p = np.full(before.shape[1], 1 / 256)
        for k in range(len(before)):
            context = before[k] % cells
            total, kinds = self.totals[context], self.kinds[context]
            p = np.where(total > 0, (np.minimum(self.pairs[after[k] % cells], total) + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.bincount(text, np.log(p), n) / np.bincount(text, minlength=n)


class Filter:
    """The two models and the threshold; None where one side has no labelled URL. Of lists of (host, path), or as fitted."""

    def __init__(self, good: list[tuple[str, str]], bad: list[tuple[str, str]], rules=RULES, false_blocks: float = FALSE_BLOCKS, cells: int = CELLS):
        self.ready = bool(good and bad)
        if not self.ready:
            return
        fit = lambda x: [masked(h, rules) + p for i, (h, p) in enumerate(x) if i % 3 or len(x) < 3]
        self.good, self.bad = (Markov(*tabled(contexts(fit(x)), cells)) for x in (good, bad))
        held = np.sort(self.ratios([h + p for h, p in (good[::3] or good)]))
        self.threshold = max(float(held[max(0, math.ceil(len(held) * (1 - false_blocks)) - 1)]) + 1e-12, 0.0)

    def ratios(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        seen = contexts(texts)
        return self.bad.scores(*seen, len(texts)) - self.good.scores(*seen, len(texts))

    def blocked(self, texts: list[str]) -> np.ndarray:
        return self.ratios(texts) > self.threshold if self.ready else np.zeros(len(texts), bool)

    def blocks(self, text: str) -> bool:
        return bool(self.blocked([text])[0])


def cells_of(seen, cells: int) -> tuple:
    """Cells of contexts with their character, of contexts, and the distinct pairs of both, with their counts."""
    context, both = ((x.ravel() % np.uint64(cells)).astype(np.int64) for x in seen[:2])
    return np.unique(both, return_counts=True), np.unique(context, return_counts=True), (np.unique(context * cells + both), None)


def tabled(seen, cells: int) -> list[np.ndarray]:
    (both, n), (context, m), (kinds, _) = cells_of(seen, cells)
    return [np.bincount(both, n, cells).astype(np.int64), np.bincount(context, m, cells).astype(np.int64), np.bincount(kinds // cells, minlength=cells)]


def _counted(rules, cells: int):
    """Counts of a batch of URLs by label and kind: cells of contexts with their character (0), of contexts (1), pairs of both (2)."""
    def run(batches):
        for batch in batches:
            for label in (0, 1):
                k = batch.filter(pc.equal(batch.column("bad"), label))
                if not k.num_rows:
                    continue
                texts = [masked(h, rules) + p for h, p in zip(k.column("host").to_pylist(), k.column("path").to_pylist())]
                for kind, (cell, n) in enumerate(cells_of(contexts(texts), cells)):
                    n = np.ones(len(cell), np.int64) if n is None else n
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), label, np.int32)), pa.array(np.full(len(cell), kind, np.int32)), pa.array(cell), pa.array(n)], names=["bad", "kind", "cell", "n"])
    return run


def _quantile(scores: DataFrame, share: float) -> float:
    """The smallest score with at least a share of all at or below it, exactly, by ever finer histograms."""
    n = scores.count()
    place, low, wide = max(1, math.ceil(n * share)), -64.0, 128.0
    while True:
        inside = scores.where((F.col("score") >= low) & (F.col("score") < low + wide))
        kinds = inside.select("score").distinct().limit(10_001).count()
        if kinds <= 10_000:
            rows = sorted((r.score, r["count"]) for r in inside.groupBy("score").count().collect())
            return next(s for (s, _), upto in zip(rows, itertools.accumulate(c for _, c in rows)) if upto >= place)
        bins = sorted((r.b, r["count"]) for r in inside.groupBy(F.floor((F.col("score") - low) / (wide / 1024)).alias("b")).count().collect())
        for b, c in bins:
            if place <= c:
                low, wide = low + b * (wide / 1024), wide / 1024
                break
            place -= c


def fit_filter(urls: DataFrame, rules=RULES, false_blocks: float = FALSE_BLOCKS, cells: int = CELLS) -> Filter:
    """Models and threshold from all distinct labelled URLs."""
    bad = F.rlike("host", F.lit(bad_word())) | (F.coalesce("by_rule", F.lit("")) == "block")
    rows = written(urls.select("host", "path", bad.cast("int").alias("bad")).distinct(), "url-labels")
    try:
        held = F.pmod(F.xxhash64("host", "path"), F.lit(3)) == 0
        sides = {r.bad: r for r in rows.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("held")).collect()}
        if len(sides) < 2:
            return Filter([], [])
        # a side that is held out as a whole is fitted as a whole
        fitted = F.lit(False)
        for label, r in sides.items():
            fitted = fitted | ((F.col("bad") == label) & (F.lit(r.held == r.n) | ~held))
        seen = rows.where(fitted).mapInArrow(_counted(rules, cells), "bad int, kind int, cell long, n long").groupBy("bad", "kind", "cell").agg(F.sum("n").alias("n"))
        place = F.when(F.col("kind") == 2, F.floor(F.col("cell") / cells)).otherwise(F.col("cell"))
        counts = seen.groupBy("bad", "kind", place.cast("int").alias("cell")).agg(F.sum(F.when(F.col("kind") == 2, 1).otherwise(F.col("n"))).alias("n")).toArrow()
        label, kind, cell, n = (np.asarray(counts.column(c).combine_chunks()) for c in ("bad", "kind", "cell", "n"))
        models = []
        for side in (0, 1):
            tables = []
            for what in (0, 1, 2):
                k = (label == side) & (kind == what)
                tables.append(np.bincount(cell[k], n[k], cells).astype(np.int64))
            models.append(Markov(*tables))
        model = Filter([], [])
        model.ready, model.good, model.bad, model.threshold = True, *models, 0.0
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def score(batches):
            for batch in batches:
                texts = [h + p for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.ratios(texts))], names=["score"])

        good = rows.where((F.col("bad") == 0) & (held | F.lit(sides[0].held == 0)))
        scores = written(good.select("host", "path").mapInArrow(score, "score double"), "url-scores")
        model.threshold = max(_quantile(scores, 1 - false_blocks) + 1e-12, 0.0)
        discard(scores)
        return model
    finally:
        discard(rows)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rows = ruled(parts(own_columns(pages, "page_id", "url")), rules)
    model = rows.sparkSession.sparkContext.broadcast(fit_filter(rows, rules))

    def decide(batches):
        for frame in batches:
            says = frame["by_rule"].map(lambda x: x if isinstance(x, str) else None).to_numpy(object)
            left = np.flatnonzero([x is None for x in says])
            blocked = model.value.blocked([h + p for h, p in zip(frame["host"].iloc[left], frame["path"].iloc[left])])
            says[left] = np.where(blocked, "block", "allow")
            verdict = list(says)
            yield pd.DataFrame({"page_id": frame["page_id"], "host": frame["host"], "path": frame["path"], "rule": frame["rule"], "verdict": verdict})

    return rows.select("page_id", "host", "path", "rule", "by_rule").mapInPandas(decide, "page_id long, host string, path string, rule string, verdict string")
