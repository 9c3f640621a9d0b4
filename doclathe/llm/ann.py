"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more coordinate, so that all have the same length and the largest inner product is the
smallest angle. Trees split a bounded sample (``SAMPLE`` distinct vectors, the smallest hashes) at the
perpendicular bisectors of random pairs; every distinct vector is then filed in one leaf of each
tree. A query visits leaves of all trees through one priority queue, ordered by the smallest margin
on the way there, and its candidates are reranked by the exact inner product in double precision, summed in
the order of the components.

How many leaves a query visits is measured, not set: the true neighbours of ``MEASURED`` queries (the smallest hashes) are
found by brute force against all rows, and visits are as many as reach ``RECALL`` of these, all leaves if need be. So
recall holds at every size, and what it costs depends on the data. ``recall=1`` visits every leaf, which is exact.

Equal vectors are one entry with their ``TOP + 1`` smallest ids: more of them can't be among the nearest
``TOP`` of any query. Equal query vectors are searched once.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those
of another length than the commonest (of two, the larger); null ids take no part; no rows give no rows; a vector
that is alone has no neighbours; rows that repeat an id with the same vector count once; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, own_columns, partitions, written

TOP = 20
TREES = 12
SAMPLE = 20_000
#: Vectors in a leaf, about, as long as the sample allows.
LEAF = 100
#: Queries whose true neighbours are found, and the share of these that visits must reach; above the 0.9 that is
#: promised, as so many queries tell recall to about 0.01.
MEASURED = 100
RECALL = 0.94
EVERY = 20
#: Queries whose margins to all planes are held at once.
VISITORS = 256


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors, and which rows of the column these are."""
    flat = column.flatten()
    size = np.asarray(column.value_lengths().fill_null(-1))
    ok = size == dim
    begin = np.cumsum(np.where(size > 0, size, 0)) - np.where(size > 0, size, 0)
    values = np.asarray(flat.fill_null(float("nan")), np.float64)
    at = np.flatnonzero(ok)
    rows = values[begin[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))
    good = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return rows[good], at[good]


def vector_hash(rows: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(rows + 0.0).view(np.uint64).reshape(rows.shape)
    out = np.full(len(rows), 0x243F6A8885A308D3, np.uint64)
    for j in range(rows.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, j])
    return out.view(np.int64)


class Forest:
    def __init__(self, sample: np.ndarray, leaf: int, trees: int, longest: float, seed: int = 11):
        self.longest = longest
        points = self.lift(sample)
        rng = np.random.default_rng(seed)
        normal, offset, child = [], [], []
        self.roots, self.leaves = [], 0

        def grow(rows: np.ndarray) -> int:
            """A node's number; leaves are ~number."""
            for _ in range(4 if len(rows) > leaf else 0):
                a, b = points[rng.choice(rows, 2, replace=False)]
                n = a - b
                size = np.linalg.norm(n)
                if size == 0:
                    continue
                n = n / size
                c = -float(n @ (a + b)) / 2
                side = points[rows] @ n + c > 0
                if 0.05 < side.mean() < 0.95:
                    me = len(normal)
                    normal.append(n)
                    offset.append(c)
                    child.append([0, 0])
                    child[me] = [grow(rows[~side]), grow(rows[side])]
                    return me
            self.leaves += 1
            return ~(self.leaves - 1)

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(points))))
        self.normal = np.array(normal).reshape(len(normal), points.shape[1])
        self.offset, self.child = np.array(offset), np.array(child, np.int64).reshape(-1, 2)

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.longest**2 - (rows * rows).sum(1))
        return np.hstack([rows, np.sqrt(rest)[:, None]]) / self.longest

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        points, out = self.lift(rows), np.empty((len(rows), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(rows), root, np.int64)
            while len(at := np.flatnonzero(node >= 0)):
                now = node[at]
                side = np.einsum("ij,ij->i", points[at], self.normal[now]) + self.offset[now] > 0
                node[at] = self.child[now, side.astype(np.int64)]
            out[:, t] = ~node
        return out

    def visit(self, rows: np.ndarray, most: int) -> list[list[int]]:
        """For each query the leaves that it visits, from all trees, the smallest margins first."""
        scale = np.linalg.norm(rows, axis=1, keepdims=True)
        points = np.hstack([rows / scale, np.zeros((len(rows), 1))])
        out = []
        for margin in (points @ self.normal.T + self.offset if len(self.normal) else np.zeros((len(rows), 0))):
            margin = margin.tolist()
            queue, found = [(-1e30, root) for root in self.roots], []
            heapq.heapify(queue)
            while queue and len(found) < most:
                worst, node = heapq.heappop(queue)
                while node >= 0:
                    m = margin[node]
                    near, far = self.child_list[node][m > 0], self.child_list[node][m <= 0]
                    heapq.heappush(queue, (max(worst, abs(m)), far))
                    node = near
                found.append(~node)
            out.append(found)
        return out

    @property
    def child_list(self):
        got = self.__dict__.get("_children")
        if got is None:
            got = self.__dict__["_children"] = self.child.tolist()
        return got


def exact_pairs(rows: np.ndarray, i: np.ndarray, queries: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i with queries j, summed component by component, so that equal vectors have equal scores."""
    out = np.zeros(len(i))
    for c in range(rows.shape[1]):
        out += rows[i, c] * queries[j, c]
    return out


def _firsts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place of each distinct pair of small numbers."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_index=True)[1]


_PACK = "bucket int, side int, leaf binary, who binary, hash binary, vec binary, ids binary, n_ids binary"
_PACK_NAMES = [c.split(" ")[0] for c in _PACK.split(", ")]


def _packed(bucket: int, side: int, leaf, who, hashes, vec, ids, n_ids) -> pa.RecordBatch:
    raw = [np.ascontiguousarray(a).tobytes() for a in (leaf, who, hashes, vec, ids, n_ids)]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([side], pa.int32()), *(pa.array([r], pa.binary()) for r in raw)], names=_PACK_NAMES)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the nearest rows of ``vectors`` but itself; at least a
    share of ``recall`` of the true ones, as measured."""
    spark = vectors.sparkSession
    both = [own_columns(d, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding")).where("vec_id is not null") for d in (vectors, queries)]
    lengths = both[0].where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = lengths[0].d if lengths else 1
    buckets = 4 * partitions(spark)

    def collapse(side: int):
        def run(batches):
            for batch in batches:
                rows, at = matrix(batch.column("embedding"), dim)
                ids = np.asarray(batch.column("vec_id"), np.int64)[at]
                order = np.lexsort((ids, h := vector_hash(rows)))
                rows, ids, h = rows[order], ids[order], h[order]
                place = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(place):
                    k = place == b
                    yield _packed(int(b), side, np.zeros(0), np.zeros(0), h[k], rows[k], ids[k], np.zeros(0))
        return run

    def merge(most: int | None):
        """Entries of equal hash and vector become one, with their smallest ids."""
        def run(table: pa.Table) -> pa.Table:
            parts = table.to_pylist()
            h = np.concatenate([np.frombuffer(p["hash"], np.int64) for p in parts])
            rows = np.concatenate([np.frombuffer(p["vec"], np.float64) for p in parts]).reshape(-1, dim)
            ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
            order = np.lexsort((ids, h))
            h, rows, ids = h[order], rows[order], ids[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(1)
            at = np.append(np.flatnonzero(new), len(h))
            kept = [np.unique(ids[a:b])[:most] for a, b in zip(at, at[1:])]
            return pa.Table.from_arrays([pa.array(h[at[:-1]], pa.int64()), pa.array([r.tobytes() for r in rows[at[:-1]]], pa.binary()), pa.array([k.tolist() for k in kept], pa.list_(pa.int64()))], names=["hash", "vec", "ids"])
        return run

    entry = "hash long, vec binary, ids array<long>"
    items = written(both[0].mapInArrow(collapse(0), _PACK).groupBy("bucket").applyInArrow(merge(top + 1), entry), "ann-items")
    # a query needs its id, so all are kept, but equal ones in lists of bounded length
    asked = written(both[1].mapInArrow(collapse(1), _PACK).select("hash", "vec", "ids").mapInArrow(_query_lists(dim), entry), "ann-queries")
    total = items.count()
    some = items.orderBy("hash").limit(SAMPLE).select("vec").collect()
    sample = np.array([np.frombuffer(r.vec, np.float64) for r in some]).reshape(-1, dim)
    most = items.mapInArrow(_longest(dim), "m double").agg(F.max("m")).collect()[0][0] or 1.0
    longest = most
    grown = Forest(sample, max(2, round(LEAF * len(sample) / max(1, total))), trees, most)
    visits = _visits(items, asked, grown, dim, top, recall)
    forest = spark.sparkContext.broadcast(grown)

    def file_items(batches):
        for batch in batches:
            rows = _rows(batch.column("vec"), dim)
            h = np.asarray(batch.column("hash"), np.int64)
            lists = batch.column("ids")
            ids, n = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths(), np.int64)
            first = np.cumsum(n) - n
            leaf = forest.value.file(rows)
            yield from _dealt(0, leaf.ravel(), np.repeat(np.arange(len(rows)), leaf.shape[1]), h, rows, ids, n, first, buckets)

    def file_queries(batches):
        for batch in batches:
            rows = _rows(batch.column("vec"), dim)
            h = np.asarray(batch.column("hash"), np.int64)
            h, first = np.unique(h, return_index=True)
            rows = rows[first]
            for some, leaf, who, a in _visited(forest.value, rows, visits):
                none = np.zeros(len(some), np.int64)
                yield from _dealt(1, leaf, who, h[a : a + len(some)], some, np.zeros(0, np.int64), none, none, buckets)

    def rerank(table: pa.Table) -> pa.Table:
        """Exact scores within the leaves of a bucket, and the best of each query, ties of the last one included."""
        sides = []
        for side in (0, 1):
            parts = [p for p in table.to_pylist() if p["side"] == side]
            leaf, who, hashes, vec, ids, n_ids = ([np.frombuffer(p[c], t) for p in parts] for c, t in (("leaf", np.int64), ("who", np.int32), ("hash", np.int64), ("vec", np.float64), ("ids", np.int64), ("n_ids", np.int64)))
            base = np.cumsum([0, *map(len, hashes)])
            who = [w + b for w, b in zip(who, base)]
            sides.append([np.concatenate(x) if x else np.zeros(0, t) for x, t in ((leaf, np.int64), (who, np.int64), (hashes, np.int64), (vec, np.float64), (ids, np.int64), (n_ids, np.int64))])
        (leaf, item, ih, vec, ids, n_ids), (qleaf, ask, qh, qvec, _, _) = sides
        vec, qvec, first = vec.reshape(-1, dim), qvec.reshape(-1, dim), np.cumsum(n_ids) - n_ids
        order, qorder = np.argsort(leaf, kind="stable"), np.argsort(qleaf, kind="stable")
        leaf, item, qleaf, ask = leaf[order], item[order], qleaf[qorder], ask[qorder]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        slack = 8 * dim * np.finfo(float).eps * longest * np.linalg.norm(qvec, axis=1)
        for x in np.unique(qleaf):
            mine = item[slice(*np.searchsorted(leaf, [x, x + 1]))]
            asks = ask[slice(*np.searchsorted(qleaf, [x, x + 1]))]
            for a in range(0, len(asks) if len(mine) else 0, 256):
                some = asks[a : a + 256]
                # a matrix product finds what may be among the best, allowing for its rounding; sums in order decide
                scores = vec[mine] @ qvec[some].T
                if len(mine) > top + 1:
                    edge = np.partition(scores, len(mine) - top - 1, axis=0)[len(mine) - top - 1]
                    i, j = np.nonzero(scores >= edge - slack[some])
                else:
                    i, j = (g.ravel() for g in np.indices(scores.shape))
                found.append((some[j], mine[i]))
        q, i = (np.concatenate(x) for x in zip(*found))
        # an entry has leaves in several trees, and may have come in several packs, as a query may: hashes name them
        (_, ask_of), (_, item_of) = (np.unique(x, return_inverse=True) for x in (qh, ih))
        one = _firsts(ask_of[q], item_of[i])
        q, i = q[one], i[one]
        score = exact_pairs(vec, i, qvec, q)
        q = qh[q]
        n = n_ids[i]
        listed = ids[np.repeat(first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return _ranked(np.repeat(q, n), listed, np.repeat(score, n), top + 1, ["hash", "ids", "scores"])

    dealt = items.mapInArrow(file_items, _PACK).unionByName(asked.mapInArrow(file_queries, _PACK))
    part = dealt.groupBy("bucket").applyInArrow(rerank, "hash long, ids array<long>, scores array<double>")
    pairs = part.select(F.col("hash").alias("q"), F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket"), "ids", "scores")

    def combine(table: pa.Table) -> pa.Table:
        lists = table.column("ids").combine_chunks()
        q = np.repeat(np.asarray(table.column("q"), np.int64), np.asarray(lists.value_lengths(), np.int64))
        ids, scores = np.asarray(lists.flatten(), np.int64), np.asarray(table.column("scores").combine_chunks().flatten(), np.float64)
        one = _firsts(np.unique(q, return_inverse=True)[1], np.unique(ids, return_inverse=True)[1])
        return _ranked(q[one], ids[one], scores[one], top + 1, ["q", "found", "scores"])

    best = pairs.groupBy("bucket").applyInArrow(combine, "q long, found array<long>, scores array<double>")
    each = asked.select(F.col("hash").alias("h"), F.explode("ids").alias("query_id")).distinct().join(best, F.col("h") == F.col("q"))
    rows = each.select("query_id", F.filter(F.arrays_zip("found", "scores"), lambda x: x["found"] != F.col("query_id")).alias("hits"))
    rows = rows.select("query_id", F.posexplode(F.slice("hits", 1, top)).alias("i", "x"))
    return rows.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.found").alias("vec_id"), F.col("x.scores").alias("score"))


def _visited(forest: Forest, rows: np.ndarray, visits: int):
    """Some queries at a time: their rows, the leaves that they visit, the place of each leaf's query, the first one's place."""
    for a in range(0, len(rows), VISITORS):
        some = rows[a : a + VISITORS]
        seen = forest.visit(some, visits)
        yield some, np.array([x for v in seen for x in v], np.int64), np.repeat(np.arange(len(some)), [len(v) for v in seen]), a


def _visits(items: DataFrame, asked: DataFrame, forest: Forest, dim: int, top: int, recall: float) -> int:
    """The leaves that queries must visit to reach a share of ``recall`` of the true neighbours of some of them."""
    if recall >= 1:
        return forest.leaves
    some = {r.hash: r.vec for r in asked.orderBy("hash").limit(MEASURED).select("hash", "vec").collect()}
    if not some:
        return 1
    hashes = np.array(sorted(some), np.int64)
    queries = np.array([np.frombuffer(some[h], np.float64) for h in hashes]).reshape(-1, dim)

    def near(batches):
        for batch in batches:
            h, vec = np.asarray(batch.column("hash"), np.int64), batch.column("vec")
            scores = _rows(vec, dim) @ queries.T
            scores[h[:, None] == hashes] = -np.inf
            k = min(top, len(h))
            best = np.argpartition(-scores, k - 1, axis=0)[:k] if k else np.zeros((0, len(hashes)), np.int64)
            for q in range(len(hashes)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, q, np.int32)), pa.array(scores[best[:, q], q]), vec.take(pa.array(best[:, q]))], names=["q", "score", "vec"])

    def nearest_of(table: pa.Table) -> pa.Table:
        score = np.asarray(table.column("score"))
        best = np.argsort(-score, kind="stable")[:top]
        return table.take(pa.array(best[np.isfinite(score[best])]))

    kind = "q int, score double, vec binary"
    found = items.select("hash", "vec").mapInArrow(near, kind).groupBy("q").applyInArrow(nearest_of, kind).collect()
    if not found:
        return 1
    leaf = forest.file(np.array([np.frombuffer(r.vec, np.float64) for r in found]).reshape(-1, dim))
    place = []
    for order in forest.visit(queries, forest.leaves):
        at = np.full(forest.leaves, forest.leaves)
        at[order] = np.arange(1, len(order) + 1)
        place.append(at)
    first = np.sort([int(place[r.q][leaf[i]].min()) for i, r in enumerate(found)])
    return int(first[int(np.ceil(recall * len(first))) - 1])


def _ranked(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int, names: list[str]) -> pa.Table:
    """A row per query with its best ids and scores: larger scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    start = np.flatnonzero(new)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = place < most
    sizes = np.bincount(np.cumsum(new)[keep] - 1, minlength=len(start)) if len(q) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[keep])) for x in (ids.astype(np.int64), scores.astype(np.float64))]
    return pa.Table.from_arrays([pa.array(q[start], pa.int64()), *lists], names=names)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float64) for v in column.to_pylist()]).reshape(-1, dim)


def _longest(dim: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((_rows(batch.column("vec"), dim) ** 2).sum(1)).max())])], names=["m"])
    return run


def _query_lists(dim: int):
    """Per task and vector one list of query ids (of at most 1,000)."""
    def run(batches):
        for batch in batches:
            for p in batch.to_pylist():
                h, ids = np.frombuffer(p["hash"], np.int64), np.frombuffer(p["ids"], np.int64)
                rows = np.frombuffer(p["vec"], np.float64).reshape(-1, dim)
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                at = [*np.flatnonzero(new), len(h)]
                cut = sorted({x for a, b in zip(at, at[1:]) for x in range(a, b, 1000)} | {len(h)})
                yield pa.RecordBatch.from_arrays([pa.array(h[cut[:-1]], pa.int64()), pa.array([rows[a].tobytes() for a in cut[:-1]], pa.binary()), pa.array([ids[a:b].tolist() for a, b in zip(cut, cut[1:])], pa.list_(pa.int64()))], names=["hash", "vec", "ids"])
    return run


def _dealt(side, leaf, who, h, rows, ids, n, first, buckets):
    """One packed row for each bucket of leaves; a vector that has several leaves there is sent once."""
    place = leaf % buckets
    order = np.argsort(place, kind="stable")
    at = np.searchsorted(place[order], np.arange(buckets + 1))
    for b in range(buckets):
        k = order[at[b] : at[b + 1]]
        if len(k):
            used, which = np.unique(who[k], return_inverse=True)
            listed = np.concatenate([ids[first[i] : first[i] + n[i]] for i in used]) if len(ids) else np.zeros(0, np.int64)
            yield _packed(int(b), side, leaf[k], which.astype(np.int32), h[used], rows[used], listed, n[used])
