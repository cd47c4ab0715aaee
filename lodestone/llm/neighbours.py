"""Approximate nearest neighbours with learned partitions.

1. A bounded sample (SAMPLE different vectors, the first by a hash of vec_id; fewer if
   SAMPLE_BYTES are reached) gives a graph of nearest neighbours, computed in tasks.
2. The graph is cut into equal parts by repeated bisection: a smooth vector over the
   graph is split at its median, then pairs of nodes change sides while that cuts fewer
   edges, so each half keeps its size.
3. A small network (one hidden layer, softmax over the parts) learns for each vector in
   which parts it and its neighbours are. Every row of the table is put into its most
   probable part.
4. A query is routed to its most probable parts. How many is measured on sample rows
   that the network did not learn from: the fewest by which their neighbours are found
   with TARGET recall. A query whose parts hold too few rows is routed to further ones.
5. Rows and queries of a part meet in blocks of bounded size; each block keeps exact
   distances of its nearest, and the nearest of all blocks are the answer.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and those with a length other than the most common one (ties: the longer), take no
part, nor do rows with null vec_id; rows that repeat a vec_id are candidates each, but
never for that id, and as a query the id has the least of its vectors; ties go to the
smaller vec_id; a table with fewer candidates than k gives all of them; an empty one
none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, runs, small, spread, written

#: The sample that the graph and the network are made from: rows at most, and bytes of them as doubles.
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
#: Sample rows for each part, and parts at most.
PART_ROWS, PARTS = 128, 32
#: Neighbours in the graph; held-out recall that sets the number of parts for a query.
GRAPH, TARGET = 10, 0.96
#: Rows and queries of one block.
ROW_BLOCK, QUERY_BLOCK = 16_384, 4096


def matrix(col: pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, ids: np.ndarray | None = None, own: np.ndarray | None = None, chunk: int = 256):
    """For each query the places and exact distances of its k nearest rows, by distance and then ``ids``; rows whose id is ``own`` are left out. Yields (query, places, distances)."""
    ids = np.arange(len(rows)) if ids is None else ids
    squares = (rows * rows).sum(1)
    for s in range(0, len(queries), chunk):
        q = queries[s : s + chunk]
        near = squares[None, :] - 2 * (q @ rows.T)
        if own is not None:
            near[own[s : s + chunk, None] == ids[None, :]] = np.inf
        most = min(k, len(rows))
        edge = np.partition(near, most - 1, axis=1)[:, most - 1]
        slack = 1e-9 * (1 + np.abs(squares).max() + (q * q).sum(1))  # over what rounding can change
        for i in range(len(q)):
            at = np.flatnonzero((near[i] <= edge[i] + slack[i]) & np.isfinite(near[i]))
            d = np.sqrt(((rows[at] - q[i]) ** 2).sum(1))
            best = np.lexsort((ids[at], d))[:k]
            yield s + i, at[best], d[best]


def sample_graph(vectors: np.ndarray, k: int):
    """Tasks that find the k nearest sample rows of sample rows (by place)."""

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            for i, places, _ in nearest(vectors[at], vectors, k, own=at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), at[i])), pa.array(places)], names=["a", "b"])

    return run


def _smooth(a: np.ndarray, b: np.ndarray, n: int, rng, steps: int = 60) -> np.ndarray:
    """A vector over the nodes that differs little along edges, by repeated averaging without its constant part."""
    degree = np.bincount(a, minlength=n) + 1.0
    x = rng.standard_normal(n)
    for _ in range(steps):
        x = (x + np.bincount(a, x[b], n)) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.sqrt((x * x).sum()) + 1e-300
    return x


def _swap(side: np.ndarray, a: np.ndarray, b: np.ndarray, passes: int = 12) -> np.ndarray:
    """side (booleans) with pairs of nodes exchanged that cut fewer edges; the sides keep their sizes."""
    n = len(side)

    def cut(s):
        return int((s[a] != s[b]).sum())

    best = cut(side)
    for _ in range(passes):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        ones, zeros = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (side, ~side))
        m = min(len(ones), len(zeros))
        m = int((gain[ones[:m]] + gain[zeros[:m]] > 0).sum())
        while m:  # many at once may spoil each other's gain: then fewer
            new = side.copy()
            new[ones[:m]], new[zeros[:m]] = False, True
            if cut(new) < best:
                side, best = new, cut(new)
                break
            m //= 2
        if not m:
            break
    return side


def balanced_parts(a: np.ndarray, b: np.ndarray, n: int, parts: int, seed: int = 3) -> np.ndarray:
    """A part for each of n nodes; sizes differ by one for each level of bisection at most. Edges count in both directions."""
    rng = np.random.default_rng(seed)
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    part, todo, made = np.zeros(n, np.int64), [(np.arange(n), parts)], 0
    while todo:
        nodes, k = todo.pop()
        if k <= 1 or len(nodes) < 2:
            part[nodes] = made
            made += 1
            continue
        local = np.full(n, -1)
        local[nodes] = np.arange(len(nodes))
        inside = (local[a] >= 0) & (local[b] >= 0)
        x, y = local[a[inside]], local[b[inside]]
        order = np.argsort(_smooth(x, y, len(nodes), rng), kind="stable")
        side = np.zeros(len(nodes), bool)
        side[order[: len(nodes) * (k // 2) // k]] = True
        side = _swap(side, x, y)
        todo += [(nodes[side], k // 2), (nodes[~side], k - k // 2)]
    return part


class Router:
    """Softmax over the parts behind one hidden layer, on vectors scaled by their sample."""

    def __init__(self, vectors: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, batch: int = 256, rate: float = 2e-3, decay: float = 1e-4, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = vectors.mean(0), vectors.std() + 1e-12
        x, y = self._scaled(vectors), target.astype(np.float32)
        sizes = [(x.shape[1], hidden), (hidden, y.shape[1])]
        self.weights = [(rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32) for s in sizes] + [np.zeros(s[1], np.float32) for s in sizes]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                rows = order[s : s + batch]
                step += 1
                h = np.maximum(x[rows] @ self.weights[0] + self.weights[2], 0)
                g = (self._softmax(h @ self.weights[1] + self.weights[3]) - y[rows]) / len(rows)
                back = (g @ self.weights[1].T) * (h > 0)
                grads = (x[rows].T @ back + decay * self.weights[0], h.T @ g + decay * self.weights[1], back.sum(0), g.sum(0))
                for k, d in enumerate(grads):
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.001 * (d * d - second[k])
                    self.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _scaled(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.mean) / self.scale).astype(np.float32)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """The parts of each vector, most probable first."""
        h = np.maximum(self._scaled(vectors) @ self.weights[0] + self.weights[2], 0)
        return np.argsort(-(h @ self.weights[1] + self.weights[3]), axis=1, kind="stable")


class Index:
    """The router, the number of its parts, and how many parts a query is routed to."""

    def __init__(self, vectors: np.ndarray, a: np.ndarray, b: np.ndarray, target: float = TARGET, seed: int = 11):
        n = len(vectors)
        self.parts = max(1, min(PARTS, n // PART_ROWS))
        self.router, self.probes, self.recall = None, 1, 1.0
        if self.parts == 1:
            return
        part = balanced_parts(a, b, n, self.parts)
        near = np.zeros((n, self.parts))
        np.add.at(near, (a, part[b]), 1.0)
        near[np.arange(n), part] += 1.0
        near /= near.sum(1, keepdims=True)
        held = np.random.default_rng(seed).random(n) < 0.2
        self.router = Router(vectors[~held], near[~held])
        order = self.router.order(vectors)
        place = np.argsort(order, axis=1)  # at which probe a part comes
        asked = held[a]
        probe = place[a[asked], order[b[asked], 0]]
        found = np.cumsum(np.bincount(probe, minlength=self.parts)) / max(1, len(probe))
        self.probes = int(np.searchsorted(found, target)) + 1
        self.recall = float(found[min(self.probes, self.parts) - 1])

    def order(self, vectors: np.ndarray) -> np.ndarray:
        return self.router.order(vectors) if self.router is not None else np.zeros((len(vectors), 1), np.int64)


def assigned(index: Index):
    """Rows (vec_id, vec) with their part."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                cut = batch.slice(s, 4096)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(index.order(matrix(cut.column(1)))[:, 0].astype(np.int32))], names=["vec_id", "vec", "part"])

    return run


def routed(index: Index, sizes: np.ndarray, k: int):
    """Queries (vec_id, vec), once for each part they are routed to: the index's number of parts, and more until they hold k rows besides the query."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                cut = batch.slice(s, 4096)
                order = index.order(matrix(cut.column(1)))
                held = np.cumsum(sizes[order], axis=1)
                want = np.maximum(index.probes, (held < k + 1).sum(1) + 1)
                take = np.arange(order.shape[1])[None, :] < want[:, None]
                row = np.nonzero(take)[0]
                yield pa.RecordBatch.from_arrays([cut.column(0).take(pa.array(row)), cut.column(1).take(pa.array(row)), pa.array(order[take].astype(np.int32))], names=["vec_id", "vec", "part"])

    return run


def block_nearest(k: int):
    """Runs of one (part, row block, query block): the k nearest rows of the block for each of its queries."""

    def run(batches):
        for t in runs(batches, 3):
            side, ids, vectors = t["side"].to_numpy(), t["vec_id"].to_numpy(), matrix(t["vec"])
            ask, have = side == 0, side == 1
            if not ask.any() or not have.any():
                continue
            own, rows = ids[ask], ids[have]
            out = [(np.full(len(at), own[q]), rows[at], d) for q, at, d in nearest(vectors[ask], vectors[have], k, ids=rows, own=own)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    v = F.col("vec")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).where(F.col("vec_id").isNotNull() & sound)
    lengths = rows.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return rows.where(F.size("vec") == F.lit(most.length if most else 0))


def fit(rows: DataFrame) -> Index:
    """The index of written rows (vec_id, vec), from a bounded sample of them."""
    spark = rows.sparkSession
    n = rows.count()
    first = rows.select("vec").first()
    dim = len(first.vec) if first else 1
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    u = F.xxhash64(F.lit(7), "vec_id")
    share = (most + 8 * most**0.5 + 64) / max(1, n)
    near = rows.where(F.shiftrightunsigned(u, 11) / F.lit(float(2**53)) <= F.lit(share))
    sample = near.orderBy(F.shiftrightunsigned(u, 11), "vec_id").limit(most).select("vec").collect()  # bound: SAMPLE rows of SAMPLE_BYTES
    vectors = np.unique(np.array([r.vec for r in sample], np.float64).reshape(len(sample), dim), axis=0)
    if len(vectors) < 2 * PART_ROWS:
        return Index(vectors, np.zeros(0, np.int64), np.zeros(0, np.int64))
    places = spark.range(len(vectors)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    edges = places.mapInArrow(sample_graph(vectors, GRAPH), "a long, b long").toPandas()  # bound: GRAPH edges for each sample row
    edges = edges.sort_values(["a", "b"])
    return Index(vectors, edges["a"].to_numpy(), edges["b"].to_numpy())


def search(table: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest rows found for each row of the table that ``queries`` (of vec_id) picks."""
    rows = written(usable(table), "vectors")
    index = fit(rows)
    held = written(rows.mapInArrow(assigned(index), rows.withColumn("part", F.lit(0)).schema), "parts")
    forget(rows)
    sizes = np.zeros(index.parts, np.int64)
    for r in held.groupBy("part").agg(F.count("*").alias("n")).collect():  # bound: PARTS rows
        sizes[r.part] = r.n
    asked = held.where(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = written(asked.mapInArrow(routed(index, sizes, k), held.schema), "routed")
    blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq"))
    blocks = written(blocks.join(held.groupBy("part").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("nr")), "part"), "part-blocks")
    blocks = small(blocks, index.parts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.col(n)).cast("int")
    left = asked.join(blocks, "part").select("part", every("nr").alias("rb"), deal("nq").alias("qb"), F.lit(0).alias("side"), "vec_id", "vec")
    right = held.join(blocks, "part").select("part", deal("nr").alias("rb"), every("nq").alias("qb"), F.lit(1).alias("side"), "vec_id", "vec")
    found = spread(left.unionByName(right), "part", "rb", "qb").mapInArrow(block_nearest(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
