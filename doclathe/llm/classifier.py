"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of
vote patterns (3 to the number of labellers at most, whatever the corpus) estimates each labeller's accuracy
and the posterior of each pattern. A linear scorer on hashed words and word shapes is trained to the
posteriors of at most ``SAMPLE`` distinct texts (the smallest hashes), then scores every document.

Defined results: null and empty texts are judged by their length alone, like any text of no words; no rows
give no rows; without two kinds of posterior in the sample the score is the posterior itself; rows that repeat
get the same score, whatever their ids (which may be null), and are one text of the sample; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, lowered, mix, own_columns, prefix_hash, span_hash, trimmed, word_spans

LABELLERS = ("length", "word_length", "symbols", "variety", "repeats", "digits", "letters", "top_word")
BUCKETS = 1 << 16
#: Documents that the scorer is trained on, at most.
SAMPLE = 6_000
#: Documents of a lower score go.
LEAST_SCORE = 0.4

_KIND = np.zeros((4, 256), bool)  # symbol, digit, upper case, letter or beyond ASCII
_KIND[0][[ord(c) for c in "#*$%&|<>"]] = True
_KIND[1][48:58] = True
_KIND[2][65:91] = True
_KIND[3][65:91] = _KIND[3][97:123] = _KIND[3][128:] = True


class Words:
    """What the labellers and the scorer see of a batch of texts."""

    def __init__(self, texts):
        data, offsets = bytes_of(texts)
        self.n = len(offsets) - 1
        start, end, self.doc = word_spans(data, offsets)
        self.hash = span_hash(prefix_hash(lowered(data)), start, end)
        sums = [np.concatenate(([0], np.cumsum(k[data], dtype=np.int32))) for k in _KIND]
        self.has = [s[end] - s[start] for s in sums]
        lead = data & 0xC0 != 0x80
        points = np.concatenate(([0], np.cumsum(lead, dtype=np.int32)))
        self.length = points[end] - points[start]
        self.count = np.bincount(self.doc, minlength=self.n)

    def per_doc(self, values) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.n)

    def votes(self) -> np.ndarray:
        """A row per text, a column per labeller: 2 good, 1 bad, 0 nothing."""
        n = np.maximum(self.count, 1)
        chars = np.maximum(self.per_doc(self.length), 1)
        same = np.zeros(len(self.doc), bool)
        if len(same) > 1:
            same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        pair = np.lexsort((self.hash, self.doc))
        new = np.ones(len(pair), bool)
        new[1:] = (self.hash[pair][1:] != self.hash[pair][:-1]) | (self.doc[pair][1:] != self.doc[pair][:-1])
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(pair)))
        top = np.zeros(self.n, np.int64)
        np.maximum.at(top, self.doc[pair][at], run)
        distinct = np.bincount(self.doc[pair][at], minlength=self.n) / n
        mean, symbols = self.per_doc(self.length) / n, self.per_doc(self.has[0]) / n
        repeats, digits, letters = self.per_doc(same) / n, self.per_doc(self.has[1]) / chars, self.per_doc(self.has[3]) / chars
        some = self.count > 0
        vote = lambda good, bad: np.where(bad, 1, np.where(good, 2, 0)) * some
        return np.stack([
            np.where(self.count < 5, 1, np.where(self.count >= 40, 2, 0)),
            vote((mean >= 3) & (mean <= 9), (mean < 2.2) | (mean > 14)),
            vote(symbols < 0.05, symbols > 0.3),
            vote(distinct > np.minimum(0.35, 8 / np.sqrt(n)), distinct < np.minimum(0.15, 3 / np.sqrt(n))),
            vote(repeats < 0.05, repeats > 0.2),
            vote(digits < 0.1, digits > 0.3),
            vote(letters > 0.8, letters < 0.68),
            vote((top / n < 0.2) | (n < 20), (top / n > 0.4) & (n >= 10)),
        ], axis=1).astype(np.uint8)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, bucket and value of every non-zero feature: shares of words and of word shapes."""
        shape = np.minimum(self.length, 15).astype(np.uint64) | ((self.has[0] > 0).astype(np.uint64) << np.uint64(4)) | ((self.has[1] > 0).astype(np.uint64) << np.uint64(5)) | ((self.has[2] > 0).astype(np.uint64) << np.uint64(6))
        same = np.zeros(len(self.doc), np.uint64)
        if len(same) > 1:
            same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        shapes = mix(shape | (same << np.uint64(7)) | np.uint64(1 << 20))
        size = mix(np.minimum(np.log2(self.count + 1.0), 20).astype(np.uint64) | np.uint64(1 << 21))
        code = np.concatenate([self.hash, shapes, size]) & np.uint64(BUCKETS - 1)
        doc = np.concatenate([self.doc, self.doc, np.arange(self.n)])
        weight = np.concatenate([1 / self.count[self.doc], 4 / self.count[self.doc], np.ones(self.n)])
        keys, back = np.unique(doc.astype(np.int64) * BUCKETS + code.astype(np.int64), return_inverse=True)
        return keys // BUCKETS, keys % BUCKETS, np.bincount(back, weights=weight)


def _vote_text(votes: np.ndarray) -> list[str]:
    return ["".join(map(str, v)) for v in votes.tolist()]


def posteriors(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """P(good) of each vote pattern, and each labeller's accuracy where it votes."""
    if not counts:
        return {}, np.zeros(0)
    names = sorted(counts)
    votes = np.array([[int(c) for c in n] for n in names])
    weight = np.array([counts[n] for n in names], float)
    good, bad = (votes == 2).sum(1), (votes == 1).sum(1)
    p = (good + 1.0) / (good + bad + 2.0)  # majority to begin with
    p = np.where(bad >= 2, np.minimum(p, 0.3), p)
    for _ in range(rounds):
        tables = []
        for q in (p, 1 - p):
            w = weight * q
            tables.append(np.stack([[(w @ (votes[:, j] == v)) + 0.5 for v in range(3)] for j in range(votes.shape[1])]))
        share = np.array([(weight @ p) + 1, (weight @ (1 - p)) + 1])
        log = [np.log(share[k]) + sum(np.log(t[j, votes[:, j]] / t[j].sum()) for j in range(votes.shape[1])) for k, t in enumerate(tables)]
        p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    right = np.array([((weight * p) @ (votes[:, j] == 2) + (weight * (1 - p)) @ (votes[:, j] == 1)) / max(1e-9, weight @ (votes[:, j] > 0)) for j in range(votes.shape[1])])
    return dict(zip(names, p.tolist())), right


def train(rows: list[tuple[float, np.ndarray, np.ndarray]], rounds: int = 12) -> tuple[np.ndarray, float] | None:
    """Logistic regression on (posterior, buckets, values) rows by Adagrad, the classes weighted alike."""
    total = np.array([r[0] for r in rows])
    if not len(rows) or total.max(initial=0) < 0.5 or total.min(initial=1) >= 0.5:
        return None
    share = float((total >= 0.5).mean())
    w, b, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-2), 1e-2
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            y, k, x = rows[i]
            g = (1 / (1 + np.exp(-np.clip(w[k] @ x + b, -30, 30))) - y) * (0.5 / share if y >= 0.5 else 0.5 / (1 - share))
            step = g * x + 1e-6 * w[k]
            seen[k] += step * step
            w[k] -= 0.3 * step / np.sqrt(seen[k])
            seen_b += g * g
            b -= 0.3 * g / np.sqrt(seen_b)
    return w, b


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score, kept."""
    rows = own_columns(docs, "doc_id", "text")

    def vote(batches):
        for part in chunks(batches, "text", 4 << 20):
            names, counts = np.unique(_vote_text(Words(part.column("text")).votes()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(counts, pa.int64())], names=["votes", "n"])

    counts = {r.votes: r.n for r in rows.mapInArrow(trimmed(vote), "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    known, _ = posteriors(counts)
    total = sum(counts.values())
    # about twice SAMPLE rows by hash, copies being one, of which SAMPLE are taken: never more, whatever the ids and texts
    cut = min(1.0, 2 * SAMPLE / max(1, total))
    code = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    sample = rows.select(F.coalesce("text", F.lit("")).alias("text"), code.alias("code")).where(F.col("code") < int(cut * (1 << 40))).groupBy("code").agg(F.min("text").alias("text"))

    def featured(batches):
        for part in chunks(batches, "text", 4 << 20):
            words = Words(part.column("text"))
            doc, bucket, value = words.features()
            at = np.searchsorted(doc, np.arange(words.n + 1))
            yield pa.RecordBatch.from_arrays([part.column("code"), pa.array(_vote_text(words.votes()), pa.string()), *(pa.array([a[at[i] : at[i + 1]].astype(t).tobytes() for i in range(words.n)], pa.binary()) for a, t in ((bucket, np.uint16), (value, np.float32)))], names=["code", "votes", "k", "x"])

    got = sample.mapInArrow(trimmed(featured), "code long, votes string, k binary, x binary").orderBy("code").limit(SAMPLE).collect()
    model = train(sorted(((known[r.votes], np.frombuffer(r.k, np.uint16).astype(np.int64), np.frombuffer(r.x, np.float32).astype(float)) for r in got), key=lambda r: (r[0], r[1].tobytes())))
    fixed = None if model is None else (model[0].astype(np.float32), model[1])

    def score(batches):
        for part in chunks(batches, "text", 4 << 20):
            words = Words(part.column("text"))
            votes = _vote_text(words.votes())
            chance = np.array([known.get(v, 0.5) for v in votes])
            if fixed is None:
                points = chance
            else:
                doc, bucket, value = words.features()
                points = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=fixed[0][bucket] * value, minlength=words.n) + fixed[1], -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(votes, pa.string()), pa.array(chance, pa.float64()), pa.array(points, pa.float64()), pa.array(points >= LEAST_SCORE, pa.bool_())], names=["doc_id", "votes", "posterior", "score", "kept"])

    return rows.mapInArrow(trimmed(score), "doc_id long, votes string, posterior double, score double, kept boolean")
