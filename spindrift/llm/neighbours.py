"""Approximate nearest neighbours by a forest of random-projection trees.

Fit: `TREES` trees over a bounded sample of at most about `SAMPLE` different vectors. A node splits its
sample at the median of the projection on the difference of two random members, down to
`LEAF` sample rows. The forest is bounded by the sample and goes to the executors.

Index: every different vector is routed to its leaf in every tree. Equal vectors are one entry that keeps
its smallest ids, which is all that a list of the nearest can show. Leaves in a row of one tree form a
block, and a block's entries are dealt by hash over as many cells as keep a cell at about `CELL_ROWS` entries, so that a task
holds the entries of a cell whatever their number; each entry is stored once to a tree.

Search: a query descends all trees through one shared priority queue. A node's priority
is the sum of squared distances to the planes crossed on the way to it, so the leaf that is
nearest next, of whatever tree, is opened next, until the leaves opened hold the search budget:
a share of all entries, found on the sample as the least that gives `AIM` recall against
brute force there. That share, over all trees, is the number of distances a query costs, divided by the number of entries.

Rerank: a query goes once to each cell of a block in which it opened leaves, with their list. The queries of a cell, however
many, stream past its entries in batches of `BATCH`, and each is compared with the entries of its leaves only; what may
be among the nearest is ranked by the exact distance in double precision, ties to smaller ids.

Measure: Euclidean distance. Vectors that are null, zero, of another dimension than
most, or hold null or non-finite components take no part, nor do rows without an id; repeated rows
count once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

TREES = 16
SAMPLE = 16_384
LEAF = 8
AIM = 0.93
TRIALS = 128
ROWS = 4096  # entries routed at a time
BLOCK_LEAVES = 256
CELL_ROWS = 50_000
BATCH = 256  # queries compared with a cell at a time
SEED = 5


@dataclass
class Trees:
    """All nodes of all trees. leaf[node] is -1 inside, else the leaf's number over all trees."""

    roots: np.ndarray
    normal: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    held: np.ndarray  # sample rows by leaf
    share: float  # search budget: entries looked at, repeats of several trees included, over all entries

    def blocks(self) -> np.ndarray:
        """The block of each leaf: up to BLOCK_LEAVES in a row, and none of two trees."""
        nodes = np.flatnonzero(self.leaf >= 0)
        tree = np.empty(len(self.held), np.int64)
        tree[self.leaf[nodes]] = np.searchsorted(self.roots, nodes, "right") - 1
        within = np.arange(len(tree)) - np.searchsorted(tree, tree)
        return np.unique(np.stack([tree, within // BLOCK_LEAVES], 1), axis=0, return_inverse=True)[1].reshape(-1).astype(np.int32)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers, a column to each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.leaf[node] < 0)
                if not len(inner):
                    break
                at = node[inner]
                side = np.einsum("ij,ij->i", x[inner], self.normal[at]) >= self.offset[at]
                node[inner] = np.where(side, self.right[at], self.left[at])
            out[:, t] = self.leaf[node]
        return out

    def opened(self, margins: np.ndarray) -> Iterator[int]:
        """All leaves in the order in which one query opens them; margins: its signed distance to every node's plane."""
        queue = [(0.0, int(r)) for r in self.roots]
        while queue:
            p, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                m = margins[node]
                near, far = (self.right[node], self.left[node]) if m >= 0 else (self.left[node], self.right[node])
                heapq.heappush(queue, (p + m * m, int(far)))
                node = near
            yield int(self.leaf[node])

    def open_leaves(self, margins: np.ndarray, share: float | None = None) -> list[int]:
        """The leaves that a query opens within the budget."""
        budget = (self.share if share is None else share) * self.held.sum() / len(self.roots)  # held: once to a tree
        found, had = [], 0
        for leaf in self.opened(margins):
            if had >= budget:
                break
            found.append(leaf)
            had += int(self.held[leaf])
        return found


def grow(x: np.ndarray, trees: int, leaf: int, seed: int) -> Trees:
    r = np.random.default_rng(seed)
    normal, offset, left, right, number, held, roots = [], [], [], [], [], [], []
    zero = np.zeros(x.shape[1])
    for _ in range(trees):
        roots.append(len(normal))
        todo = [(np.arange(len(x)), None, None)]
        while todo:
            rows, parent, side = todo.pop()
            k = len(normal)
            if parent is not None:
                (left if side == 0 else right)[parent] = k
            normal.append(zero), offset.append(0.0), left.append(k), right.append(k), number.append(-1)
            halves = None
            if len(rows) > leaf:
                a, b = x[r.choice(rows, 2, replace=False)]
                w = a - b
                w /= max(np.sqrt(w @ w), 1e-300)
                p = x[rows] @ w
                cut = float(np.median(p))
                high = p >= cut
                if high.any() and not high.all():
                    normal[k], offset[k], halves = w, cut, (rows[~high], rows[high])
            if halves is None:
                number[k] = len(held)
                held.append(len(rows))
            else:
                todo += [(halves[0], k, 0), (halves[1], k, 1)]
    arrays = [np.asarray(a) for a in (roots, normal, offset, left, right, number, held)]
    arrays[1] = arrays[1].astype(np.float32)  # half the broadcast; entries and queries go by the same planes
    return Trees(*arrays, share=float(trees))


def fit(x: np.ndarray, k: int, trees: int = TREES, leaf: int = LEAF, aim: float = AIM, seed: int = SEED) -> Trees:
    """Grow the trees, then find the least budget with recall `aim` for sample queries against brute force."""
    forest = grow(x, trees, leaf, seed)
    if len(x) <= k + 1:
        forest.share = float(trees)
        return forest
    trial = np.random.default_rng(seed + 1).choice(len(x), min(TRIALS, len(x)), replace=False)
    placed = forest.route(x)
    margins = x[trial] @ forest.normal.T - forest.offset
    squares = np.einsum("ij,ij->i", x, x)
    near = []
    for q in trial:
        d = squares - 2 * (x @ x[q])
        d[q] = np.inf
        near.append(np.argpartition(d, k)[:k])
    # the budget at which each true neighbour's first leaf is opened; the one that `aim` of them need is it
    needed = []
    for m, truth in zip(margins, near):
        left = {int(leaf): k for k, t in enumerate(truth) for leaf in placed[t]}
        reached: dict[int, int] = {}
        had = 0
        for leaf in forest.opened(m):
            if (k := left.get(leaf)) is not None:
                reached.setdefault(k, had)
                if len(reached) == len(truth):
                    break
            had += int(forest.held[leaf])
        needed += reached.values()
    forest.share = (sorted(needed)[int(np.ceil(aim * len(needed))) - 1] + 1) * trees / forest.held.sum()
    return forest


def _vectors(batch_column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the vectors of a list column that take part."""
    lists = batch_column
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    bad = np.asarray(flat.is_null())
    values = np.asarray(flat.cast(pa.float64()).fill_null(0.0)) + 0.0
    bad |= ~np.isfinite(values)
    ends = np.cumsum(sizes)
    start = ends - sizes
    good = sizes > 0 if dim is None else sizes == dim
    any_of = lambda mask: np.r_[0, np.cumsum(mask)][ends] - np.r_[0, np.cumsum(mask)][start] > 0
    good &= ~any_of(bad) & any_of(values != 0)
    at = np.flatnonzero(good)
    if dim is None or not len(at):
        return at, np.zeros((0, dim or 0))
    return at, values[start[at][:, None] + np.arange(dim)]


def _packed(x: np.ndarray) -> pa.Array:
    raw, step = np.ascontiguousarray(x, "<f8").tobytes(), 8 * x.shape[1]
    return pa.array([raw[k : k + step] for k in range(0, len(raw), step)], pa.binary())


def _unpacked(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f8").reshape(-1, dim)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, aim: float = AIM) -> DataFrame:
    """From vec_id and embedding: query_id, rank, vec_id and score of the k nearest found for each query row."""
    keep = k + 1  # a query may be among its own nearest
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id is not null and embedding is not null")
    dims = given.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    spark = rows.sparkSession
    if dims is None or not dims["d"]:
        return spark.createDataFrame([], out_schema)
    dim = dims["d"]

    def valid(batches):
        for batch in batches:
            at, x = _vectors(batch.column(1), dim)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), _packed(x), batch.column(2).take(at)], names=["vec_id", "vec", "is_query"])

    def combined(batches):
        for batch in valid(batches):
            groups: dict[bytes, list] = {}
            for i, v, q in zip(*(c.to_pylist() for c in batch.columns)):
                g = groups.setdefault(v, [[], False])
                g[0].append(i)
                g[1] |= q
            ids = [sorted(set(g[0]))[:keep] for g in groups.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([g[1] for g in groups.values()], pa.bool_())], names=["vec", "ids", "is_query"])

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    entries = given.mapInArrow(combined, "vec binary, ids array<long>, is_query boolean").groupBy("vec").agg(smallest.alias("ids"), F.max("is_query").alias("is_query"))
    entries = materialize(entries.withColumn("name", F.unhex(F.md5("vec"))), "vectors")
    total = entries.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    if not total["q"]:
        return spark.createDataFrame([], out_schema)
    part = min(1.0, sample / total["n"])
    drawn = entries.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(part * (1 << 30))).select("vec").toArrow()
    forest = fit(_unpacked(sorted(drawn.column(0).to_pylist()), dim), k, trees, leaf, aim)
    block_of = forest.blocks()
    deal = max(1, -(-total["n"] * trees // ((int(block_of.max()) + 1) * CELL_ROWS)))

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                leaves = forest.route(_unpacked(b.column(0).to_pylist(), dim)).ravel()
                cell = np.asarray([int.from_bytes(n[:4], "big") % deal for n in b.column(2).to_pylist()], np.int32)
                pick = np.repeat(np.arange(b.num_rows), trees)
                yield _side(block_of[leaves], cell[pick], 0, leaves, [None] * len(pick), b, pick)

    def ask(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                margins = _unpacked(b.column(0).to_pylist(), dim) @ forest.normal.T - forest.offset
                block, opened, pick = [], [], []
                for q, m in enumerate(margins):
                    leaves = np.sort(np.asarray(forest.open_leaves(m), np.int32))
                    for part in np.split(leaves, np.flatnonzero(np.diff(block_of[leaves])) + 1):
                        block.append(block_of[part[0]]), opened.append(part), pick.append(q)
                n = len(block)
                for c in range(deal):
                    yield _side(block, np.full(n, c, np.int32), 1, np.full(n, -1, np.int32), opened, b, np.asarray(pick))

    side = "block int, cell int, kind int, leaf int, opened array<int>, vec binary, ids array<long>, name binary"
    listed = entries.select("vec", "ids", "name")
    both = listed.mapInArrow(index, side).unionByName(entries.where("is_query").select("vec", "ids", "name").mapInArrow(ask, side))

    def rank(batches):
        where, held, cell = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)) for c in range(3)], 1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for s, e in zip(cuts, np.r_[cuts[1:], len(key)]):
                b = batch.slice(int(s), int(e - s))
                if where != (here := tuple(key[s][:2])):
                    where, held, cell = here, [], None
                if key[s][2] == 0:
                    held.append(b)
                elif held:
                    cell = cell or Cell(held, dim)
                    for at in range(0, b.num_rows, BATCH):
                        yield cell.nearest(b.slice(at, BATCH), keep)

    ranked = both.repartition("block", "cell").sortWithinPartitions("block", "cell", "kind", "leaf").mapInArrow(rank, "q binary, v binary, score double, ids array<long>")
    once = ranked.groupBy("q", "v").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("q").orderBy("score", F.element_at("ids", 1))
    listed = once.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= keep).select(F.col("q").alias("name"), "score", F.explode("ids").alias("vec_id"))
    asked = given.where("is_query").mapInArrow(valid, "vec_id long, vec binary, is_query boolean").select(F.col("vec_id").alias("query_id"), F.unhex(F.md5("vec")).alias("name")).distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    own = asked.join(listed, "name").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _side(block, cell, kind: int, leaf, opened: list, b: pa.RecordBatch, pick: np.ndarray) -> pa.RecordBatch:
    ints = lambda v: pa.array(np.asarray(v, np.int32))
    columns = [ints(block), ints(cell), ints(np.full(len(pick), kind)), ints(leaf), pa.array(opened, pa.list_(pa.int32())), *(b.column(c).take(pa.array(pick)) for c in range(3))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "cell", "kind", "leaf", "opened", "vec", "ids", "name"])


class Cell:
    """The entries of a cell, sorted by leaf."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        leaf = table.column(3).to_numpy()
        self.dim = dim
        self.x = _unpacked(table.column(5).to_pylist(), dim)
        self.squares = np.einsum("ij,ij->i", self.x, self.x)
        self.ids, self.names = table.column(6), table.column(7)
        first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        self.span = dict(zip(leaf[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(leaf)])))

    def nearest(self, queries: pa.RecordBatch, keep: int) -> pa.RecordBatch:
        """Of the entries in the leaves each query opened here, those that may be among its `keep` nearest, with exact distances."""
        q = _unpacked(queries.column(5).to_pylist(), self.dim)
        by_leaf: dict[int, list[int]] = {}
        for k, leaves in enumerate(queries.column(4).to_pylist()):
            for leaf in leaves:
                if leaf in self.span:
                    by_leaf.setdefault(leaf, []).append(k)
        rough: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        rows: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        for leaf, who in by_leaf.items():
            s, e = self.span[leaf]
            d = self.squares[s:e] - 2 * (q[who] @ self.x[s:e].T)
            at = np.arange(s, e)
            for k, row in zip(who, d):
                rough[k].append(row)
                rows[k].append(at)
        qs, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(q)):
            if rough[k]:
                d, at = np.concatenate(rough[k]), np.concatenate(rows[k])
                most = np.partition(d, min(keep, len(d)) - 1)[min(keep, len(d)) - 1]
                near = at[d <= most + 1e-9 * (1 + abs(most) + q[k] @ q[k])]
                qs.append(np.full(len(near), k)), vs.append(near)
        qs, vs = np.concatenate(qs), np.concatenate(vs)
        score = np.sqrt(((q[qs] - self.x[vs]) ** 2).sum(axis=1))
        pick = pa.array(vs)
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return pa.RecordBatch.from_arrays([queries.column(7).take(pa.array(qs)), one(self.names.take(pick)), pa.array(score), one(self.ids.take(pick))], names=["q", "v", "score", "ids"])
