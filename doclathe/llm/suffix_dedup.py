"""Removal of repeated passages by suffix order, built column by column.

A byte goes when it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

1. Texts are packed into batches of a few MB (compressed, written once to the shared folder).
2. Every window of LENGTH bytes selects one k-mer of itself, by its content alone (mod-minimisers: about
   one k-mer in 19 positions). Consecutive windows that select the same k-mer are one segment (LENGTH + 18 bytes
   at most). Equal windows lie in segments of equal k-mer.
3. The distinct k-mer hashes of all batches meet by hash range; each batch gets back which of its hashes other batches
   have too. Only the segments of those go on, equal ones of a batch as one, with their smallest id.
4. Hashes of segments meet by k-mer. Where all segments of a k-mer are equal, their smallest id is the answer;
   only the others, the neighbourhoods of where texts part, are sent as bytes.
5. For each k-mer that has different segments, the collection's
   Burrows-Wheeler transform and suffix order are built column-wise: one symbol of every segment a round, from
   the last to the first, the order of the longer suffixes being the stable order of the shorter ones by
   their next symbol. In the end, neighbours with a common prefix of LENGTH are one group, with its smallest id.
6. Each batch gets back, for its segments, the smallest id of each window, and removes what is covered.

The collection is cut by k-mer so that the rounds number LENGTH + 18 and not the longest text's length; each
task builds its own transform, in sequential passes over arrays. k-mers that ``HOT`` or more batches
share are dealt by window instead of by segment, so that no key gathers a passage's many neighbourhoods.

Defined results: null text is empty; nothing is removed from texts under LENGTH bytes; of rows with the same id none
has the smaller one, so they don't remove each other; rows with a null id are neither removed from nor count
for others; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, from_planes, mix, own_columns, partitions, planes, prefix_hash, small_hash, span_hash, trim_memory, trimmed, written

LENGTH = 50
KMER = 32
SMALL = 13
STEP = LENGTH - KMER + 1
MOST = LENGTH + STEP - 1
#: k-mers that so many batches share are dealt by window.
HOT = 256
BATCH_BYTES = 3 << 20
#: Windows handled at once within a batch: the arrays of a piece fit a core's cache, whatever a text's length.
PIECE = 1 << 16
_NO_ID = -(1 << 63)


_LOW = np.uint64((1 << 20) - 1)
_HIGH = ~np.uint64(255)
_AT = np.arange(PIECE + LENGTH, dtype=np.uint64)


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, number of windows, k-mer hash (56 bits) and own hash of each segment; ends[i]: where the text of byte i ends."""
    out = []
    for a in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        part = data[a : a + PIECE + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0:
            continue
        valid = ends[a : a + n] - np.arange(a, a + n) >= LENGTH
        prefix = prefix_hash(part)
        at = _AT[: len(part) - SMALL + 1]
        least = (small_hash(prefix, SMALL) & ~_LOW) | at
        width = LENGTH - SMALL + 1
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[width - span : width - span + n])
        least &= _LOW
        first = at[:n]
        chosen = (first + (least - first) % np.uint64(STEP)).astype(np.int64)
        new = np.ones(n, bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1]) | (ends[a + 1 : a + n] != ends[a : a + n - 1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        start, count = start[valid[start]], count[valid[start]]
        k = chosen[start]
        out.append((start + a, count, span_hash(prefix, k, k + KMER) & _HIGH, span_hash(prefix, start, start + count + LENGTH - 1)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Batch:
    """A packed batch and its segments."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        total = int(self.sizes.sum())
        self.data = np.frombuffer(pa.decompress(row["text"], total, codec="zstd", asbytes=True), np.uint8) if total else np.zeros(0, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        ends = np.repeat(self.offsets[1:], self.sizes)
        self.start, self.count, self.kmer, self.own = _runs(self.data, ends)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        if (self.ids == _NO_ID).any():
            ok = self.ids[self.doc] != _NO_ID
            self.start, self.count, self.kmer, self.own, self.doc = self.start[ok], self.count[ok], self.kmer[ok], self.own[ok], self.doc[ok]

    def shared(self, hashes: np.ndarray, hot: np.ndarray) -> Segments:
        """Segments whose k-mer other batches have, or that this batch has more than once."""
        order = np.argsort(self.kmer, kind="stable")
        k = self.kmer[order]
        twice = np.zeros(len(k), bool)
        if len(k) > 1:
            twice[1:] = k[1:] == k[:-1]
            twice[:-1] |= twice[1:]
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, k), len(hashes) - 1)
            outside = hashes[at] == k
            is_hot = outside & hot[at]
        else:
            outside = is_hot = np.zeros(len(k), bool)
        pick = np.zeros(len(k), np.int8)
        pick[order] = np.where(is_hot, 2, np.where(outside | twice, 1, 0))
        warm, hots = np.flatnonzero(pick == 1), np.flatnonzero(pick == 2)
        start, count, kmer, own, doc = self.start[warm], self.count[warm], self.kmer[warm], self.own[warm], self.doc[warm]
        if len(hots):  # each window on its own, under its own hash
            n = self.count[hots]
            s = np.repeat(self.start[hots], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, count, doc = np.concatenate([start, s]), np.concatenate([count, np.ones(len(s), np.int64)]), np.concatenate([doc, np.repeat(self.doc[hots], n)])
            h = _row_hash(_matrix(self.data, s, np.full(len(s), LENGTH))[:, MOST - LENGTH :])
            kmer, own = np.concatenate([kmer, h & _HIGH]), np.concatenate([own, h])
        return Segments(self, start, count, kmer, own, doc)


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Segments as rows, the last byte in the last column, zeros before the first."""
    padded = np.concatenate([np.zeros(MOST, np.uint8), data])
    out = np.lib.stride_tricks.sliding_window_view(padded, MOST)[start + size]
    for lead in range(MOST - int(size.min(initial=MOST)), 0, -1):
        out[size <= MOST - lead, lead - 1] = 0
    return out


def _distinct(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each distinct row (with its size), and which of these each row is. Hashes find them, bytes decide."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, which = np.unique(_row_hash(rows) + size.astype(np.uint64), return_index=True, return_inverse=True)
    for a in range(0, len(rows), 100_000):
        one = first[which[a : a + 100_000]]
        if (rows[a : a + 100_000] != rows[one]).any() or (size[a : a + 100_000] != size[one]).any():
            full = np.ascontiguousarray(np.hstack([size[:, None].astype(np.uint8), rows])).view(f"V{MOST + 1}").ravel()
            _, first, which = np.unique(full, return_index=True, return_inverse=True)
            break
    return first, which


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(0, rows.shape[1], 8):
        word = np.zeros((len(rows), 8), np.uint8)
        word[:, : min(8, rows.shape[1] - j)] = rows[:, j : j + 8]
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)[:, 0] + np.uint64(j + 1))
    return h


class Segments:
    """A batch's segments: each occurrence, and the distinct ones, by k-mer, with their smallest ids."""

    def __init__(self, batch: Batch, start, count, kmer, own, doc):
        self.start, self.count, self.doc = start, count, doc
        order = np.lexsort((own, kmer))
        new = np.ones(len(order), bool)
        new[1:] = (kmer[order][1:] != kmer[order][:-1]) | (own[order][1:] != own[order][:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.kmer, self.own, self.size = kmer[self.first], own[self.first], count[self.first] + LENGTH - 1
        at = np.flatnonzero(new)
        self.least = np.minimum.reduceat(batch.ids[doc[order]], at) if len(at) else np.zeros(0, np.int64)


def suffix_groups(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise suffix order of the rows (right-aligned). Returns, for suffixes of LENGTH bytes or more in order,
    the row, the suffix's length, and whether it begins another group than the one before (common prefix under LENGTH)."""
    m = len(rows)
    who = np.arange(m, dtype=np.int32)  # in suffix order; in round 0 all suffixes are empty
    length = np.zeros(m, np.int16)
    for j in range(1, int(size.max(initial=0)) + 1):
        more = length < size[who]
        parent, long = who[more], length[more] + np.int16(1)
        # the transform's column: the symbol before each suffix so far
        symbol = rows[parent, MOST - long]
        order = np.argsort(symbol, kind="stable")
        ended = np.arange(m, dtype=np.int32)  # empty suffixes come first
        who = np.concatenate([ended, parent[order]])
        length = np.concatenate([np.zeros(m, np.int16), long[order]])
    keep = length >= LENGTH
    who, length = who[keep], length[keep]
    new = np.ones(len(who), bool)
    for a in range(1, len(who), 200_000):
        b = min(len(who), a + 200_000)
        w = np.arange(a - 1, b)
        prefix = rows[who[w][:, None], (MOST - length[w].astype(np.int64))[:, None] + np.arange(LENGTH)]
        new[a:b] = (prefix[1:] != prefix[:-1]).any(1)
    return who, length, new


def window_minima(rows: np.ndarray, size: np.ndarray, kmer: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For distinct segments: the smallest id of each window (column i: the window that starts at byte i)."""
    out = np.repeat(least[:, None], STEP, axis=1)
    order = np.argsort(kmer, kind="stable")
    k = kmer[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    run = np.diff(np.append(np.flatnonzero(new), len(k)))
    mixed = order[np.repeat(run > 1, run)]  # a k-mer with one segment has nothing to compare
    for a in _cuts(kmer[mixed], 3_000):
        some = mixed[a]
        who, length, new = suffix_groups(rows[some], size[some])
        at = np.flatnonzero(new)
        smallest = np.minimum.reduceat(least[some][who], at) if len(at) else np.zeros(0, np.int64)
        group = np.cumsum(new) - 1
        out[some[who], size[some][who] - length] = smallest[group]
    return out


def _cuts(kmer: np.ndarray, most: int):
    """Slices of sorted k-mers, about ``most`` segments each, that don't part a k-mer."""
    a = 0
    while a < len(kmer):
        b = min(len(kmer), a + most)
        if b < len(kmer):
            b = max(a, int(np.searchsorted(kmer, kmer[b], side="left"))) or b
            if b <= a:
                b = int(np.searchsorted(kmer, kmer[a], side="right"))
        yield slice(a, b)
        a = b


_PACK = "batch string, ids binary, sizes binary, text binary"
_HASHES = "bucket int, batch string, h binary"
_ASKED = "bucket int, batch string, kmer binary, own binary, least binary, number binary"
_SEGS = "bucket int, batch string, size binary, rows binary, kmer binary, least binary, number binary"
_TOLD = "batch string, kind string, a binary, b binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _names(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    cols = list(zip(*rows)) or [[]] * len(_names(ddl))
    return pa.Table.from_arrays([pa.array(c, kinds[d.split(" ")[1]]) for c, d in zip(cols, ddl.split(", "))], names=_names(ddl))


def _pack(batches):
    for part in chunks(batches, "text", BATCH_BYTES, 1 << 30):
        data, offsets = bytes_of(part.column("text"))
        ids = np.asarray(part.column("doc_id").fill_null(_NO_ID), np.int64)
        sizes = np.diff(offsets)
        text = pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(data) else b""
        name = hashlib.sha256(ids.tobytes() + sizes.tobytes() + text).hexdigest()[:32]
        yield _table(_PACK, [(name, ids.tobytes(), sizes.tobytes(), text)]).to_batches()[0]


def _packed_rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def deduplicated(docs: DataFrame, hot: int = HOT, finish=None, ddl: str = _OUT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. With finish(ids, kept texts, removed, spans) -> rows of ddl, those."""
    spark = docs.sparkSession
    n = 2 * partitions(spark)
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = written(own.mapInArrow(trimmed(_pack), _PACK), "suffix-texts")
    bounds = np.array([i * (1 << 64) // n for i in range(n)], np.uint64)

    def sample(batches):
        for row in _packed_rows(batches):
            h = np.unique(Batch(row).kmer)
            edge = np.searchsorted(h, bounds)
            edge = [*edge.tolist(), len(h)]
            yield from _table(_HASHES, [(b, row["batch"], planes(h[edge[b] : edge[b + 1]])) for b in range(n) if edge[b + 1] > edge[b]]).to_batches()

    def meet(table: pa.Table) -> pa.Table:
        names = table.column("batch").to_pylist()
        lists = [from_planes(x, np.uint64) for x in table.column("h").to_pylist()]
        who = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        h = np.concatenate(lists)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        run = np.diff(np.append(np.flatnonzero(new), len(h)))
        many = np.repeat(run, run)
        keep = many > 1
        h, who, many = h[keep], who[keep], many[keep]
        back = np.argsort(who, kind="stable")
        h, who, many = h[back], who[back], many[back]
        at = np.searchsorted(who, np.arange(len(names) + 1))
        return _table(_TOLD, [(names[i], "shared", planes(h[at[i] : at[i + 1]]), (many[at[i] : at[i + 1]] >= hot).astype(np.uint8).tobytes()) for i in range(len(names)) if at[i + 1] > at[i]])

    def known(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        rows = [r for r in rows if r["kind"] == "shared"]
        h = np.concatenate([from_planes(r["a"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
        is_hot = np.concatenate([np.frombuffer(r["b"], np.uint8) for r in rows] or [np.zeros(0, np.uint8)]) > 0
        order = np.argsort(h)
        return h[order], is_hot[order]

    def dealt(kmer: np.ndarray):
        """The numbers of each bucket's segments; k-mers ascend."""
        at = [*np.searchsorted(kmer, bounds).tolist(), len(kmer)]
        return [(b, slice(at[b], at[b + 1])) for b in range(n) if at[b + 1] > at[b]]

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist()[:1]:  # a name stands for the content: equal batches are one
            seg = Batch(row).shared(*known(right.to_pylist()))
            rows += [(b, row["batch"], planes(seg.kmer[k]), seg.own[k].tobytes(), planes(seg.least[k]), np.int32(k.start).tobytes()) for b, k in dealt(seg.kmer)]
        trim_memory()
        return _table(_ASKED, rows)

    def answer(table: pa.Table) -> pa.Table:
        """Where a k-mer's segments are all equal, their smallest id (if it isn't the asking batch's own); else, that they differ."""
        parts = table.to_pylist()
        kmer, least = (np.concatenate([from_planes(p[c], t) for p in parts]) for c, t in (("kmer", np.uint64), ("least", np.int64)))
        own = np.concatenate([np.frombuffer(p["own"], np.uint64) for p in parts])
        size = [len(p["own"]) // 8 for p in parts]
        order = np.argsort(kmer, kind="stable")
        k, o = kmer[order], own[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        differ = np.zeros(len(k), bool)
        differ[1:] = (o[1:] != o[:-1]) & ~new[1:]
        mixed_group = np.add.reduceat(differ, at) > 0
        mixed, lowest = np.empty(len(k), bool), np.empty(len(k), np.int64)
        mixed[order], lowest[order] = mixed_group[group], np.minimum.reduceat(least[order], at)[group]
        rows, a = [], 0
        for p, m in zip(parts, size):
            number = np.arange(m, dtype=np.int32) + np.frombuffer(p["number"], np.int32)[0]
            told = ~mixed[a : a + m] & (lowest[a : a + m] < least[a : a + m])
            if told.any():
                rows.append((p["batch"], "all", planes(number[told]), planes(lowest[a : a + m][told])))
            if mixed[a : a + m].any():
                rows.append((p["batch"], "differ", planes(number[mixed[a : a + m]]), None))
            a += m
        trim_memory()
        return _table(_TOLD, rows)

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, told = [], right.to_pylist()
        number = np.sort(np.concatenate([from_planes(r["a"], np.int32) for r in told if r["kind"] == "differ"] or [np.zeros(0, np.int32)]))
        for row in left.to_pylist()[:1] if len(number) else []:
            batch = Batch(row)
            seg = batch.shared(*known(told))
            size, kmer, least = seg.size[number], seg.kmer[number], seg.least[number]
            text = _matrix(batch.data, seg.start[seg.first[number]], size)
            for b, k in dealt(kmer):
                used = np.arange(MOST) >= MOST - size[k][:, None]
                rows.append((b, row["batch"], size[k].astype(np.uint8).tobytes(), text[k][used].tobytes(), planes(kmer[k]), planes(least[k]), planes(number[k])))
        trim_memory()
        return _table(_SEGS, rows)

    def compare(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        join = lambda c, t: np.concatenate([np.frombuffer(p[c], t) for p in parts])
        size, flat = join("size", np.uint8).astype(np.int64), join("rows", np.uint8)
        kmer, least, number = (np.concatenate([from_planes(p[c], t) for p in parts]) for c, t in (("kmer", np.uint64), ("least", np.int64), ("number", np.int32)))
        rows = np.zeros((len(size), MOST), np.uint8)
        rows[np.arange(MOST) >= MOST - size[:, None]] = flat
        who = np.repeat(np.arange(len(parts)), [len(p["size"]) for p in parts])
        first, which = _distinct(rows, size)
        lowest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(lowest, which, least)
        minima = window_minima(rows[first], size[first], kmer[first], lowest)[which]
        tell = (minima < least[:, None]).any(1)
        out = []
        for i, p in enumerate(parts):
            a, b = np.searchsorted(who, [i, i + 1])
            k = a + np.flatnonzero(tell[a:b])
            if len(k):
                out.append((p["batch"], "each", number[k].tobytes(), minima[k].tobytes()))
        trim_memory()
        return _table(_TOLD, out)

    def beside(batch_rows):
        return packed.groupBy("batch").cogroup(batch_rows.groupBy("batch"))

    shared = written(packed.mapInArrow(trimmed(sample), _HASHES).groupBy("bucket").applyInArrow(meet, _TOLD), "suffix-shared")
    asked = beside(shared).applyInArrow(ask, _ASKED)
    answers = written(asked.groupBy("bucket").applyInArrow(answer, _TOLD), "suffix-answers")
    parted = beside(shared.unionByName(answers.where("kind = 'differ'"))).applyInArrow(segments, _SEGS)
    found = parted.groupBy("bucket").applyInArrow(compare, _TOLD)
    every = shared.unionByName(answers.where("kind = 'all'")).unionByName(found)
    out_rows = finish or _digests

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        told = right.to_pylist()
        for row in left.to_pylist():
            batch = Batch(row)
            seg = batch.shared(*known(told))
            minima = np.repeat(seg.least[:, None], STEP, axis=1)
            for r in told:
                if r["kind"] == "all":
                    number = from_planes(r["a"], np.int32)
                    minima[number] = np.minimum(minima[number], from_planes(r["b"], np.int64)[:, None])
                elif r["kind"] == "each":
                    number = np.frombuffer(r["a"], np.int32)
                    minima[number] = np.minimum(minima[number], np.frombuffer(r["b"], np.int64).reshape(-1, STEP))
            delta = np.zeros(len(batch.data) + 1, np.int32)
            ids = batch.ids[seg.doc]
            for i in range(STEP):
                s = seg.start[(seg.count > i) & (minima[seg.which, i] < ids)] + i
                np.add.at(delta, s, 1)
                np.add.at(delta, s + LENGTH, -1)
            rows += out_rows(batch, np.cumsum(delta[:-1]) > 0)
        trim_memory()
        return _table(ddl, rows)

    return beside(every).applyInArrow(remove, ddl)


def _digests(batch: Batch, gone: np.ndarray) -> list[tuple]:
    rows = []
    for i, doc in enumerate(batch.ids.tolist()):
        a, b = batch.offsets[i], batch.offsets[i + 1]
        cut = gone[a:b]
        removed = int(cut.sum())
        spans = int((cut[1:] & ~cut[:-1]).sum() + cut[0]) if removed else 0
        kept = batch.data[a:b][~cut] if removed else batch.data[a:b]
        rows.append((None if doc == _NO_ID else doc, int(b - a), removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
    return rows
