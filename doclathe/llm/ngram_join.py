"""N-gram Jaccard join, and its near-duplicate classes.

1. Each document becomes its set of hashed n-grams. All sets meet by hash range, in packed arrays; each document gets
   back those of its n-grams that other documents have too, with the number of documents. An n-gram of one
   document can't be in any intersection, so a document of which less than the threshold is shared has no
   links, and most end here.
2. Documents of equal sets are one class, represented by the smallest id.
3. N-grams are ordered over the corpus by document count, rarest first. Linked sets share one of the first
   size - ceil(threshold * size) + 1 in this order: representatives that share one of those are candidates, and
   the components of candidates are cut into groups of bounded size.
4. In each group, the sets in one order (the group's rarest n-grams first) are stored in a prefix tree, whose paths share
   the overlap with a query. Subtrees are pruned by the overlap that their remaining lengths allow, and where no set
   is left that shares a first n-gram and isn't linked already. The tree is arrays, passed through level by level.
5. A candidate component over ``MOST`` sets or ``MOST_BYTES`` is cut into blocks, each joined within itself, then with the
   first block, which links most of what is one. Where sets are left that aren't linked, each block meets each other one
   if there are up to ``PAIRED``. Beyond that only grams of the prefixes matter whose sets aren't linked yet: the sets
   of each such gram are a group (equal groups are one), groups over ``MOST`` are parted by size, as linked sets
   have sizes within the threshold of each other, and cut into blocks. No link is lost, no pairs are listed.

Defined results: null and empty texts, and texts of white space, have no n-grams and no links; fewer than n words are
one n-gram; rows that repeat an id are one document (linked to itself) if their sets are equal, else each
set links the id; rows with a null id have their size and no component; no rows give no rows; extra columns
are ignored. N-grams are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, chunks, discard, free_names, from_planes, lowered, mix, own_columns, partitions, planes, prefix_hash, span_hash, trim_memory, trimmed, word_spans, written
from .components import connected_components

NGRAM = 5
PERCENT = 80
#: Sets in a block and bytes of their n-grams, at most (a group is one block or two).
MOST = 4000
MOST_BYTES = 24 << 20
#: Components of candidates of at most so many blocks compare each block with each other one.
PAIRED = 64
BATCH_BYTES = 4 << 20
#: Bytes of texts that are hashed at once.
CACHED_BYTES = 1 << 19
#: Counts of documents beyond this are as one in the order of n-grams.
MOST_COUNTED = (1 << 24) - 1
_NO_ID = -(1 << 63)


def ngram_hashes(texts, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram occurrence (the whole sequence where there are fewer words)."""
    data, offsets = bytes_of(texts)
    hashes, docs, at, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, len(offsets) - 1
    while at < last:  # so many texts at once that arrays stay in the processor's cache, one at least
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + CACHED_BYTES, side="right")) - 1), last)
        h, doc = _hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], n)
        hashes.append(h)
        docs.append(doc + at)
        at = to
    return np.concatenate(hashes), np.concatenate(docs)


def _hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = span_hash(prefix_hash(lowered(data)), start, end)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[doc]
    head = np.flatnonzero(place <= np.maximum(count[doc] - n, 0))
    have = np.minimum(count[doc[head]], n)
    odds = [np.uint64((0x9FB21C651E98DF25 * (2 * j + 3)) & ((1 << 64) - 1) | 1) for j in range(n)]
    padded = np.concatenate([word, np.zeros(n, np.uint64)])
    every = np.zeros(len(word), np.uint64)
    for j, odd in enumerate(odds):
        every += padded[j : j + len(word)] * odd
    h = every[head]
    few = np.flatnonzero(have < n)
    h[few] = 0
    for j, odd in enumerate(odds[:-1]):
        h[few] += np.where(j < have[few], padded[head[few] + j] * odd, np.uint64(0))
    return mix(h + have.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), doc[head]


_ROWS = "key int, batch string, kind string, a binary, b binary, c binary, d binary"
_SETS = "doc_id long, n long, s1 long, s2 long, grams binary"


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [c.split(" ") for c in ddl.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[f for f, _ in fields])


def _group_sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    at = np.searchsorted(doc, np.arange(n))
    some = np.flatnonzero(np.append(at[1:], len(doc)) > at)
    if len(some):
        out[some] = np.add.reduceat(values, at[some])
    return out


def sets_of(texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts in order of hash, the text number of each; size and signature of each text's set."""
    h, doc = ngram_hashes(texts, n)
    order = np.argsort(h)
    h, doc = h[order], doc[order].astype(np.uint16)
    same = h[1:] == h[:-1]
    run = np.zeros(len(h), bool)
    run[1:] = same
    run[:-1] |= same
    at = np.flatnonzero(run)
    if len(at):  # texts ascend within equal hashes
        first = np.ones(len(at), bool)
        first[1:] = h[at[1:]] != h[at[:-1]]
        doc[at] = np.sort(np.cumsum(first) << 16 | doc[at]) & 0xFFFF
    new = np.ones(len(h), bool)
    new[1:] = ~same | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    by = np.argsort(doc, kind="stable")
    d = doc[by]
    size = np.bincount(d, minlength=len(texts))
    by_text = h[by]
    s1, s2 = (_group_sums(mix(by_text ^ np.uint64(x)), d, len(texts)) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))
    return h, doc, size.astype(np.int64), s1, s2


def _rarest_first(h: np.ndarray, many: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by text, count (up to MOST_COUNTED) and hash of n-grams that come in order of hash."""
    if len(h) > 1 << 24:
        return np.lexsort((h, many, doc))
    # text, count and place in one number
    return (np.sort(doc.astype(np.uint64) << np.uint64(48) | many.astype(np.uint64) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)) & np.uint64((1 << 24) - 1)).astype(np.int64)


def shared_sets(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (the set's signature), grams (what is shared, rarest first; null where too little)."""
    parts = max(16, 2 * partitions(docs.sparkSession))
    bounds = np.array([i * (1 << 64) // parts for i in range(parts)], np.uint64)

    def scatter(batches):
        for number, part in enumerate(chunks(batches, "text", BATCH_BYTES, 60_000)):
            h, doc, size, s1, s2 = sets_of(part.column("text"), n)
            ids = np.asarray(part.column("doc_id").fill_null(_NO_ID), np.int64)
            # batches of equal rows must not share a name
            place = np.array([TaskContext.get().partitionId(), number])
            name = hashlib.sha256(b"".join(x.tobytes() for x in (place, ids, size, s1, s2))).hexdigest()[:32]
            at = [*np.searchsorted(h, bounds).tolist(), len(h)]
            rows = [(int(name[:6], 16) % parts, name, "docs", ids.tobytes(), size.tobytes(), s1.tobytes(), s2.tobytes())]
            rows += [(b, name, "grams", planes(h[at[b] : at[b + 1]]), doc[at[b] : at[b + 1]].tobytes(), None, None) for b in range(parts) if at[b + 1] > at[b]]
            yield from _table(_ROWS, rows).to_batches()

    def count(table: pa.Table) -> pa.Table:
        """Within a hash range: what two documents or more have, back to the batches."""
        rows = table.to_pylist()
        out = [(r["key"], r["batch"], "docs", r["a"], r["b"], r["c"], r["d"]) for r in rows if r["kind"] == "docs"]
        rows = [r for r in rows if r["kind"] == "grams"]
        if rows:
            lists = [from_planes(r["a"], np.uint64) for r in rows]
            who = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in lists])
            h, doc = np.concatenate(lists), np.concatenate([np.frombuffer(r["b"], np.uint16) for r in rows])
            order = np.argsort(h)
            sorted_h = h[order]
            new = np.ones(len(h), bool)
            new[1:] = sorted_h[1:] != sorted_h[:-1]
            run = np.diff(np.append(np.flatnonzero(new), len(h)))
            many = np.empty(len(h), np.int64)
            many[order] = np.repeat(run, run)
            keep = many > 1
            h, doc, who, many = h[keep], doc[keep], who[keep], np.minimum(many[keep], MOST_COUNTED).astype(np.uint32)
            at = np.searchsorted(who, np.arange(len(rows) + 1))
            out += [(r["key"], r["batch"], "grams", planes(h[a:b]), doc[a:b].tobytes(), many[a:b].tobytes(), None) for r, a, b in zip(rows, at, at[1:]) if b > a]
        trim_memory()
        return _table(_ROWS, out)

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        grams = sorted((r for r in rows if r["kind"] == "grams"), key=lambda r: r["key"])
        none = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
        h, doc, many = (np.concatenate([*x, *y]) for x, y in zip(none, ([from_planes(r["a"], np.uint64) for r in grams], [np.frombuffer(r["b"], np.uint16) for r in grams], [np.frombuffer(r["c"], np.uint32) for r in grams])))
        order = _rarest_first(h, many, doc)
        h, doc = h[order], doc[order]
        for r in rows:
            if r["kind"] != "docs":
                continue
            ids, size, s1, s2 = (np.frombuffer(r[c], np.int64) for c in "abcd")
            at = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i in range(len(ids)):
                k = slice(at[i], at[i + 1])
                enough = size[i] > 0 and 100 * (at[i + 1] - at[i]) >= percent * size[i] and ids[i] != _NO_ID
                out.append((None if ids[i] == _NO_ID else int(ids[i]), int(size[i]), int(s1[i]), int(s2[i]), h[k].tobytes() if enough else None))
        trim_memory()
        return _table(_SETS, out)

    rows = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = rows.mapInArrow(trimmed(scatter), _ROWS).groupBy("key").applyInArrow(count, _ROWS)
    return met.groupBy("batch").applyInArrow(gather, _SETS)


def needed(nx: int, ny: int, percent: int) -> int:
    """The least intersection of sets of these sizes that links them: 100 i >= percent (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


class Union:
    """Components as a label of each member: the smallest member of its component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        return int(self.root[x])

    def join(self, x: int, y: int) -> None:
        x, y = self.root[x], self.root[y]
        if x != y:
            self.root[self.root == max(x, y)] = min(x, y)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class PrefixTree:
    """Sets in global order as a radix tree over their sorted sequence, in arrays; a node's children follow one another."""

    def __init__(self, sets: list, sizes: list[int]):
        self.sets, self.sizes = [np.asarray(s, np.int64) for s in sets], np.asarray(sizes, np.int64)
        keys = [s.astype(">u4").tobytes() for s in self.sets]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        ordered = [self.sets[i] for i in self.order]
        self.mark = np.zeros(max((int(s[-1]) + 1 for s in ordered if len(s)), default=1), bool)
        length = np.array([len(s) for s in ordered], np.int64)
        shared = np.zeros(len(ordered), np.int64)  # with the set before
        for i in range(1, len(ordered)):
            a, b = ordered[i - 1], ordered[i]
            m = min(len(a), len(b))
            other = a[:m] != b[:m]
            k = int(other.argmax()) if m else 0
            shared[i] = k if m and other[k] else m
        size = self.sizes[self.order]
        # node: lo, hi (in the order), depth at its start and end, its children; most remaining length below, least set size, last of its path
        nodes, rest, low, last, paths = [[0, len(ordered), 0, 0, 0, 0]] if ordered else [], [], [], [], []
        for node in nodes:
            lo, hi, depth = node[:3]
            end = int(shared[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
            path = ordered[lo]
            node[3] = end
            rest.append(int(length[lo:hi].max()) - end)
            low.append(int(size[lo:hi].min()))
            last.append(int(path[end - 1]) if end else -1)
            paths.append(path[depth:end])
            node[4] = node[5] = len(nodes)
            if hi - lo > 1:
                cut = [lo, *(np.flatnonzero(shared[lo + 1 : hi] == end) + lo + 1).tolist(), hi]
                nodes.extend([x, y, end, 0, 0, 0] for x, y in zip(cut, cut[1:]))
                node[5] = len(nodes)
        self.lo, self.hi, _, _, self.first, self.past = np.array(nodes, np.int64).reshape(-1, 6).T
        self.rest, self.low, self.last = (np.array(x, np.int64) for x in (rest, low, last))
        self.path = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        self.at = np.cumsum([0, *map(len, paths)])
        self.index: dict = {}

    def sharing(self, x: int, percent: int) -> np.ndarray:
        """Which sets have one of x's first grams among their own first ones; linked sets do."""
        if percent not in self.index:
            n = self.sizes
            have = np.array([len(s) for s in self.sets], np.int64)
            take = np.clip(have - -(-percent * n // 100) + 1, 0, have)  # grams that no set shares come first and aren't here
            grams = np.concatenate([s[:k] for s, k in zip(self.sets, take)])
            order = np.argsort(grams, kind="stable")
            self.index[percent] = take, grams[order], np.repeat(np.arange(len(n)), take)[order]
        take, grams, who = self.index[percent]
        mine = self.sets[x][: take[x]]
        start, end = np.searchsorted(grams, mine), np.searchsorted(grams, mine, side="right")
        out = np.zeros(len(self.sets), bool)
        out[who[_ranges(start, end - start)]] = True
        return out

    def link(self, x: int, union: Union, percent: int, allowed) -> None:
        """Join x with the sets that it is linked to and not yet joined with; pairs (x, y) with allowed(x, y), of which y is an array."""
        mine, nx = self.sets[x], int(self.sizes[x])
        least_y, most_y = -(-percent * nx // 100), 100 * nx // percent
        asked = (union.root != union.root[x]) & (self.sizes >= least_y) & (self.sizes <= most_y) & allowed(x, np.arange(len(self.sets)))
        if not asked.any():
            return
        asked &= self.sharing(x, percent)
        before = np.concatenate([[0], np.cumsum(asked[self.order])])
        self.mark[mine] = True
        node, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            some = before[self.hi[node]] > before[self.lo[node]]  # below is one that is asked
            node, overlap = node[some], overlap[some]
            size = self.at[node + 1] - self.at[node]
            hits = np.concatenate([[0], np.cumsum(self.mark[self.path[_ranges(self.at[node], size)]])])
            to = np.cumsum(size)
            overlap = overlap + hits[to] - hits[to - size]
            left = len(mine) - np.searchsorted(mine, self.last[node], side="right")
            enough = overlap + np.minimum(left, self.rest[node]) >= needed(nx, np.maximum(self.low[node], least_y), percent)
            node, overlap = node[enough], overlap[enough]
            children = self.past[node] - self.first[node]
            y = self.order[self.lo[node[children == 0]]]
            found.append(y[asked[y] & (overlap[children == 0] >= needed(nx, self.sizes[y], percent))])
            node, overlap = _ranges(self.first[node], children), np.repeat(overlap, children)
        self.mark[mine] = False
        for y in np.concatenate(found):
            union.join(x, y)


def linked(sets: list[tuple[int, np.ndarray, int, int]], percent: int) -> list[tuple[int, int]]:
    """Links that join (size, grams, label, side) sets: sets of one label are joined already; of sides 0 and 1
    pairs across are compared, of side 2 all pairs. The rarest grams of these sets come first."""
    if len(sets) == 2:  # most groups; one comparison, no tree
        (nx, x, of_x, side_x), (ny, y, of_y, side_y) = sets
        asked = of_x != of_y and (side_x == 2 or side_x != side_y)
        return [(0, 0), (1, int(of_x != of_y and not (asked and len(x) + len(y) - len(np.union1d(x, y)) >= needed(nx, ny, percent))))]
    _, where, counts = np.unique(np.concatenate([s[1] for s in sets]), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks, ordered, a = rank[where], [], 0
    for s in sets:
        ordered.append(np.sort(ranks[a : a + len(s[1])]))
        a += len(s[1])
    union, first = Union(len(sets)), {}
    for i, s in enumerate(sets):
        union.join(first.setdefault(s[2], i), i)
    tree = PrefixTree(ordered, [s[0] for s in sets])
    side = np.array([s[3] for s in sets])
    allowed = lambda x, y: y > x if side[x] == 2 else side[y] != side[x]
    for x in np.flatnonzero(side != 0):
        tree.link(int(x), union, percent, allowed)
    return [(i, union.find(i)) for i in range(len(sets))]


def _join_groups(percent: int):
    """For each candidate component of a group: (doc, root) links. Sets of one component share their group's trees only."""
    def run(table: pa.Table) -> pa.Table:
        comps: dict = {}
        for r in table.to_pylist():
            comps.setdefault(r["comp"], []).append(r)
        out = []
        for rows in comps.values():
            rows.sort(key=lambda r: (r["doc_id"], r["side"]))
            sets = [(r["n"], np.frombuffer(r["grams"], np.uint64), r["label"], r["side"]) for r in rows]
            out += [(rows[i]["doc_id"], rows[j]["doc_id"]) for i, j in linked(sets, percent) if rows[i]["doc_id"] != rows[j]["doc_id"]]
        trim_memory()
        return _table("a long, b long", out)
    return run


def _prefixes(percent: int):
    def run(batches):
        for batch in batches:
            grams, ids = [], []
            for doc, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "grams")), strict=True):
                g = np.frombuffer(blob, np.uint64)
                take = n - -(-percent * n // 100) + 1 - (n - len(g))  # the rarest, those of one document, come first
                if take > 0:
                    grams.append(g[:take].view(np.int64))
                    ids.append(np.full(min(take, len(g)), doc))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(ids))], names=["gram", "doc_id"])
    return run


def near_duplicates(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    sets = written(shared_sets(docs, n, percent), "jaccard-sets")
    comp = linked_sets(sets, percent, most)
    out = sets.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(comp, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def linked_sets(sets: DataFrame, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """node, root: for every linked doc_id of shared_sets the smallest one of its component."""
    spark = sets.sparkSession
    some = sets.where("grams is not null")
    classes = some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = some.select("doc_id", "n", "s1", "s2").distinct().join(classes, ["n", "s1", "s2"]).select("doc_id", "rep")
    # one row per set: the representative's
    reps = some.join(classes.withColumnRenamed("rep", "doc_id"), ["n", "s1", "s2", "doc_id"], "left_semi")
    reps = written(reps.groupBy("doc_id", "n", "s1", "s2").agg(F.first("grams").alias("grams")), "jaccard-reps")
    tokens = reps.mapInArrow(_prefixes(percent), "gram long, doc_id long")
    roots = tokens.groupBy("gram").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").select("gram", "b")
    near = tokens.join(roots, "gram").where("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct()
    comps = written(connected_components(near), "jaccard-candidates")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") * 8 / MOST_BYTES))
    sizes = written(reps.select("doc_id", "n").join(comps, F.col("doc_id") == F.col("node")).groupBy("root").agg(blocks.alias("blocks")), "jaccard-sizes")
    placed = reps.join(comps.join(sizes, "root"), F.col("doc_id") == F.col("node")).select("doc_id", "n", "grams", F.col("root").alias("comp"), "blocks")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    groups = max(partitions(spark), 1) * 4
    small = F.col("blocks") == 1
    inner = placed.withColumn("g", F.when(small, F.pmod(F.xxhash64("comp"), F.lit(groups))).otherwise(F.xxhash64("comp", "block")))
    inner = inner.select(F.col("g"), "doc_id", "n", "grams", "comp", F.col("doc_id").alias("label"), F.lit(2).alias("side"))
    links = written(_joined(inner, percent), "jaccard-links")
    largest = sizes.agg(F.max("blocks")).collect()[0][0] or 0
    if largest > 1:
        links = _large(placed.where(~small), tokens, links, percent, most, largest)
    out = connected_components(links.unionByName(members.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    for done in (links, sizes, comps, reps):
        discard(done)
    return out


def _joined(groups: DataFrame, percent: int) -> DataFrame:
    return groups.groupBy("g").applyInArrow(lambda t: _join_groups(percent)(t), "a long, b long")


def _large(placed: DataFrame, tokens: DataFrame, links: DataFrame, percent: int, most: int, largest: int) -> DataFrame:
    """Links beyond the blocks of candidate components that are too large for one group."""
    def labelled(found: DataFrame) -> DataFrame:
        comp = connected_components(found)
        return written(placed.join(comp, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "doc_id")).drop("node", "root"), "jaccard-labels")

    own = ["doc_id", "n", "grams", "comp", "label"]
    rows = labelled(links)
    # the first block with each other one
    last = (F.col("blocks") - 1).cast("long")
    hub = rows.where("block = 0").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), last))).select(F.xxhash64("comp", "j").alias("g"), *own, F.lit(0).alias("side"))
    rest = rows.where("block > 0").select(F.xxhash64("comp", F.col("block").cast("long")).alias("g"), *own, F.lit(1).alias("side"))
    links = links.unionByName(_joined(hub.unionByName(rest), percent))
    links = written(links, "jaccard-links")
    if largest == 2:
        return links
    rows = labelled(links)
    # of a few blocks each with each other one, where several labels are left
    left = rows.groupBy("comp").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("comp")
    pairs = rows.where((F.col("blocks") <= PAIRED) & (F.col("block") > 0)).join(left, "comp", "left_semi").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), last))).where("j != block")
    pairs = pairs.select(F.xxhash64("comp", F.least(F.col("block").cast("long"), "j"), F.greatest(F.col("block").cast("long"), "j")).alias("g"), *own, (F.col("block") > F.col("j")).cast("int").alias("side"))
    links = written(links.unionByName(_joined(pairs, percent)), "jaccard-links")
    if largest <= PAIRED:
        return links
    rows = rows.where(F.col("blocks") > PAIRED)
    # grams of prefixes whose sets have several labels; of grams with the same sets one
    marked = tokens.join(rows.select("doc_id", "label"), "doc_id")
    who = F.xxhash64("doc_id")
    mixed = marked.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(who).alias("x"), F.sum(who.cast("decimal(38,0)")).alias("s"))
    mixed = mixed.where("low != high").groupBy("k", "x", "s").agg(F.min("gram").alias("gram")).select("gram", "k")
    # sets whose sizes are a step of the threshold apart or more, in either of two neighbouring bands, aren't linked
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("long")
    asked = written(marked.join(mixed, "gram").join(rows.select(*own[:1], "n"), "doc_id").select("gram", "k", "doc_id", F.when(F.col("k") > most, band).otherwise(0).alias("band")), "jaccard-mixed")
    if not asked.limit(1).count():
        return links
    few, many = asked.where(F.col("k") <= most).select(F.xxhash64("gram").alias("g"), "doc_id", F.lit(2).alias("side")), asked.where(F.col("k") > most)
    sizes = many.groupBy("gram", "band").agg(F.count(F.lit(1)).alias("m")).select("gram", "band", F.ceil(F.col("m") / most).alias("blocks"))
    # a group is some sets of a band with some of the same or the next lower band
    cut = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks"))
    cuts = many.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, ["gram", "band"]).select("gram", "band", "doc_id", "blocks", cut.alias("cut"))
    each = lambda to: F.explode(F.sequence(F.lit(0).cast("long"), (to - 1).cast("long")))
    below = F.explode(F.array("band", F.col("band") - 1))
    others = sizes.select("gram", F.col("band").alias("lower"), F.col("blocks").alias("opposite"))
    asks = cuts.withColumn("lower", below).join(others, ["gram", "lower"]).withColumn("j", each(F.col("opposite")))
    asks = asks.select(F.xxhash64("gram", "band", "cut", "lower", "j").alias("g"), "doc_id", F.lit(1).alias("side"))
    above = F.explode(F.array("band", F.col("band") + 1))
    askers = sizes.select("gram", F.col("band").alias("upper"), F.col("blocks").alias("opposite"))
    told = cuts.withColumn("upper", above).join(askers, ["gram", "upper"]).withColumn("i", each(F.col("opposite")))
    told = told.select(F.xxhash64("gram", "upper", "i", "band", "cut").alias("g"), "doc_id", F.lit(0).alias("side"))
    groups = few.unionByName(asks).unionByName(told).join(rows, "doc_id").select("g", *own, "side")
    return written(links.unionByName(_joined(groups, percent)), "jaccard-links")


def one_of_each(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates: of each group of linked rows the row with the smallest id stays.

    Here a document is an id and a set: of rows that share an id, those of equal sets are one, those of other sets are
    linked by their own n-grams only. Rows without n-grams or without id have no links and stay. The columns are
    those of docs, which may have any names; no rows give no rows.
    """
    lost, twice, mine, count, first, second = free_names(docs, "jaccard_gone", "jaccard_again", "jaccard_node", "jaccard_n", "jaccard_s1", "jaccard_s2")
    sets = written(shared_sets(docs, n, percent), "jaccard-sets")
    again = written(sets.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("doc_id").alias(twice)), "jaccard-repeats")
    if not again.limit(1).count():
        gone = linked_sets(sets, percent).where("node != root").select(F.col("node").alias(lost))
        return docs.join(gone, docs["doc_id"] == gone[lost], "left_anti")
    # a node for each set of an id that repeats
    node = F.xxhash64("doc_id", "n", "s1", "s2")
    nodes = sets.join(again, F.col("doc_id") == F.col(twice), "left").withColumn("node", F.when(F.col(twice).isNotNull(), node).otherwise(F.col("doc_id")))
    nodes = written(nodes.withColumnRenamed("doc_id", "id").withColumnRenamed("node", "doc_id").drop(twice), "jaccard-nodes")
    ids = nodes.where("id != doc_id").select(F.col("doc_id").alias("_node"), "id").distinct()
    comp = linked_sets(nodes.drop("id"), percent).join(ids, F.col("node") == F.col("_node"), "left").select("node", "root", F.coalesce("id", "node").alias("id"))
    stays = comp.groupBy("root").agg(F.min(F.struct("id", "node")).alias("m")).select("root", F.col("m.node").alias("stays"))
    gone = written(comp.join(stays, "root").where("node != stays").select(F.col("node").alias(lost)), "jaccard-gone")
    one = docs.join(again, docs["doc_id"] == again[twice], "left_anti").join(gone, docs["doc_id"] == gone[lost], "left_anti")

    def sign(batches):
        for part in chunks(batches, "text", BATCH_BYTES, 60_000):
            _, _, size, s1, s2 = sets_of(part.column("text"), n)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], names=[*part.schema.names, count, first, second])

    kind = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in (count, first, second))])
    odd = docs.join(again, docs["doc_id"] == again[twice], "left_semi").mapInArrow(trimmed(sign), kind)
    odd = odd.withColumn(mine, F.xxhash64(F.col("doc_id").cast("long"), count, first, second))
    odd = odd.join(gone, odd[mine] == gone[lost], "left_anti")
    return one.unionByName(odd.where(F.col(count) > 0).dropDuplicates([mine]).unionByName(odd.where(F.col(count) == 0)).select(*[F.col(f"`{c}`") for c in docs.columns]))
