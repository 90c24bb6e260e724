"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is learnt from a bounded sample; every vector is then put into a leaf, and the leaves are stored in blocks of bounded
size, so that a leaf that holds a third of all vectors is many blocks. A query takes the leaves off a priority queue, the
most promising first, and visits as many as calibration asks for: for a sample of the queries, the true neighbours are
found among all vectors, and the visits are widened until the wanted share of them lies in visited leaves. Each visited block gives
its best candidates with exact inner products, merged by query.

Defined cases: vectors that are NULL, zero, hold NULL or non-finite components or have another number of components than most take no part; with
fewer candidates than wanted, all are given; ties go to the smaller id, NULL ids last; rows with equal ids are rows of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import columns_of, staged

#: Vectors that the tree is learnt from, and queries that the number of visits is calibrated with; the driver holds these.
FIT_ROWS, CALIBRATION_QUERIES = 20_000, 200
BRANCHES, LEAF_ROWS = 16, 64
RECALL, NEAREST = 0.97, 20
BLOCK_ROWS, CHUNK_QUERIES = 1024, 512
LAST = 2**63 - 1


@dataclass
class Tree:
    """Nodes by number, the root first: centroids, children (none for a leaf), and a leaf's number."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest centroid on every level."""
        at = np.zeros(len(x), np.int64)
        open_nodes = [0] if self.children[0] else []
        while open_nodes:
            following = []
            for node in open_nodes:
                rows = np.flatnonzero(at == node)
                if len(rows):
                    kids = np.array(self.children[node])
                    c = self.centroids[kids]
                    at[rows] = kids[np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)]
                following += [k for k in self.children[node] if self.children[k]]
            open_nodes = following
        return np.array(self.leaf)[at]

    def visits(self, q: np.ndarray, n: int, rows: list[int] | None = None, least: int = 0) -> list[int]:
        """The first `n` leaves in best-bin-first order for inner products with `q`, and more until they have `least` of the `rows` in each leaf."""
        worth = self.centroids @ q
        queue, found, held = [(-worth[0], 0)], [], 0
        while queue and (len(found) < n or held < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-worth[kid], kid))
            else:
                found.append(self.leaf[node])
                held += rows[self.leaf[node]] if rows else 0
        return found


def grow(x: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Tree:
    """A tree over a sample: nodes are parted by k-means until few rows or equal rows are left."""
    rng = np.random.default_rng(seed)
    tree = Tree(x.mean(0, keepdims=True), [[]], [-1])
    work, leaves = [(0, np.arange(len(x)))], 0
    while work:
        node, rows = work.pop()
        parts = _parted(x[rows], min(branches, -(-len(rows) // leaf_rows)), rng) if len(rows) > leaf_rows else []
        if len(parts) < 2:
            tree.leaf[node], leaves = leaves, leaves + 1
            continue
        for part in parts:
            tree.children[node].append(len(tree.leaf))
            work.append((len(tree.leaf), rows[part]))
            tree.centroids = np.vstack([tree.centroids, x[rows[part]].mean(0)])
            tree.children.append([])
            tree.leaf.append(-1)
    return tree


def _parted(x: np.ndarray, k: int, rng) -> list[np.ndarray]:
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        nearest = np.argmin((centroids * centroids).sum(1) - 2 * x @ centroids.T, axis=1)
        centroids = np.array([x[nearest == i].mean(0) if (nearest == i).any() else centroids[i] for i in range(k)])
    return [np.flatnonzero(nearest == i) for i in range(k) if (nearest == i).any()]


def usable(table: DataFrame, name: str, vector: str) -> DataFrame:
    """`uid`, `id`, `v` of the vectors that take part, written once."""
    slim = columns_of(table, name, vector).select(F.col(name).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    infinite = float("inf")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (c == infinite) | (c == -infinite))
    fine = slim.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda c: c != 0))
    kept = staged(fine.withColumn("uid", F.monotonically_increasing_id()))
    sizes = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _row(key: tuple, arrays: dict[str, np.ndarray]) -> pa.Table:
    """Arrays of a leaf's block as binary values in one row."""
    named = {"leaf": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32())}
    return pa.table(named | {name: pa.array([value.tobytes()], pa.binary()) for name, value in arrays.items()})


def _blocks(index: DataFrame) -> DataFrame:
    """A block of a leaf as one row: `leaf`, `block`, `uids`, `ids` and `vectors` as binary values."""

    def gather(key, table):
        ids = table.column("id").fill_null(LAST).to_numpy()
        columns = [table.column("uid").to_numpy(), ids, _matrix(table.column("v").combine_chunks())]
        return _row(key, dict(zip(("uids", "ids", "vectors"), columns)))

    return index.groupBy("leaf", "block").applyInArrow(gather, "leaf int, block int, uids binary, ids binary, vectors binary")


def _best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, uids: np.ndarray, ids: np.ndarray, own: int, nearest: int):
    """The nearest of a block by exact score and id. Rounding in `scores` cannot shut out any that belongs."""
    scores = np.where(uids == own, -np.inf, scores)
    if len(scores) > nearest:
        slack = 1e-9 * (1 + np.abs(q).sum() * np.abs(x).max())
        at = np.flatnonzero(scores >= np.partition(scores, -nearest)[-nearest] - slack)
    else:
        at = np.arange(len(scores))
    at = at[uids[at] != own]
    exact = (x[at] * q).sum(axis=1)
    order = np.lexsort((uids[at], ids[at], -exact))[:nearest]
    return uids[at[order]], ids[at[order]], exact[order]


def _merged(parts: list[tuple], nearest: int) -> tuple:
    """The nearest of several (uids, ids, scores)."""
    both = [np.concatenate(columns) for columns in zip(*parts)]
    order = np.lexsort((both[0], both[1], -both[2]))[:nearest]
    return tuple(c[order] for c in both)


def _search(blocks: DataFrame, asked: DataFrame, nearest: int) -> DataFrame:
    """`quid`, `rank`, `uid`, `id`, `score`: the nearest for each query in the blocks it asks (`quid`, `q`, `leaf`, `block`).

    A task sends on one row for each query, with the best of all its blocks.
    """

    def gather(key, table):
        quids, q = table.column("quid").to_numpy(), _matrix(table.column("q").combine_chunks())
        return _row(key, {"quids": quids, "queries": q})

    chunks = asked.withColumn("chunk", F.pmod(F.xxhash64("quid"), F.col("chunks")).cast("int"))
    gathered = chunks.groupBy("leaf", "block", "chunk").applyInArrow(gather, "leaf int, block int, quids binary, queries binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}

        def sent():
            payload = [b"".join(c.tobytes() for c in found) for found in best.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(payload, pa.binary())], ["quid", "found"])

        for batch in batches:
            for row in batch.to_pylist():
                uids, ids = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["vectors"]).reshape(len(uids), -1)
                quids = np.frombuffer(row["quids"], np.int64)
                q = np.frombuffer(row["queries"]).reshape(len(quids), -1)
                scores = q @ x.T
                for i, quid in enumerate(quids.tolist()):
                    found = _best(scores[i], q[i], x, uids, ids, quid, nearest)
                    best[quid] = _merged([best[quid], found], nearest) if quid in best else found
                if len(best) > 20_000:
                    yield sent()
                    best.clear()
        yield sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(quid, parts):
            found = _merged(parts, nearest)
            n = len(found[0])
            columns = [np.full(n, quid), np.arange(1, n + 1, dtype=np.int32), *found]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["quid", "rank", "uid", "id", "score"])

        now, parts = None, []
        for batch in batches:
            for quid, found in zip(batch.column("quid").to_pylist(), batch.column("found").to_pylist()):
                if quid != now and parts:
                    yield ranked(now, parts)
                    parts = []
                now, n = quid, len(found) // 24
                parts.append((*np.frombuffer(found, np.int64, 2 * n).reshape(2, n), np.frombuffer(found, np.float64, n, 16 * n)))
        if parts:
            yield ranked(now, parts)

    asking = blocks.join(gathered, ["leaf", "block"]).select("uids", "ids", "vectors", "quids", "queries")
    found = asking.mapInArrow(scan, "quid long, found binary").repartition("quid").sortWithinPartitions("quid")
    return found.mapInArrow(merge, "quid long, rank int, uid long, id long, score double")


def nearest_neighbours(
    table: DataFrame, name: str = "vec_id", vector: str = "embedding", is_query=lambda i: i % 20 == 0, nearest: int = NEAREST,
    recall: float = RECALL, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """`query_id`, `rank`, `id`, `score`: for each query row the rows with the largest inner products that were found."""
    vectors = usable(table, name, vector)
    sample = vectors.orderBy(F.xxhash64("uid"), "uid").limit(fit_rows).toPandas()
    if not len(sample):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    tree = grow(np.stack(sample["v"].to_numpy()))
    del sample

    def into_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(tree.assign(_matrix(batch.column("v"))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], [*batch.schema.names, "leaf"])

    index = staged(vectors.select("uid", "id", "v").mapInArrow(into_leaves, "uid long, id long, v array<double>, leaf int"))
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row for each leaf of the tree
    leaf_rows = [counts.get(leaf, 0) for leaf in range(tree.leaves)]
    block_counts = [-(-n // BLOCK_ROWS) for n in leaf_rows]
    in_leaf = F.get(F.array(*[F.lit(n) for n in block_counts]), F.col("leaf"))
    blocks = staged(_blocks(index.withColumn("block", F.pmod(F.xxhash64("uid"), in_leaf).cast("int"))))
    queries = vectors.where(F.coalesce(is_query(F.col("id")), F.lit(False)))
    n_queries = queries.count()

    def asking(rows: DataFrame, visits: int, total: int) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column("v"))
                orders = [tree.visits(row, visits, leaf_rows, nearest + 1) for row in q]  # its own row may be one of them
                bounds = np.concatenate([[0], np.cumsum([len(o) for o in orders])])
                leaves = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(orders) if orders else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("v"), leaves], ["quid", "q", "leaves"])

        asked = rows.select("uid", "v").mapInArrow(scan, "quid long, q array<double>, leaves array<int>")
        asked = asked.select("quid", "q", F.posexplode("leaves").alias("visit", "leaf")).where(in_leaf > 0)
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), in_leaf - 1)))
        return asked.withColumn("chunks", F.lit(-(-total // CHUNK_QUERIES)))

    few = staged(queries.orderBy(F.xxhash64("uid"), "uid").limit(CALIBRATION_QUERIES))
    truth = _search(blocks, asking(few, tree.leaves, CALIBRATION_QUERIES), nearest)
    places = truth.join(index.select("uid", "leaf"), "uid").join(few.select(F.col("uid").alias("quid"), F.col("v").alias("q")), "quid")
    needed = []
    by_query: dict[int, tuple] = {}
    for row in places.select("quid", "q", "leaf").collect():  # at most CALIBRATION_QUERIES * nearest rows
        if row["quid"] not in by_query:
            by_query[row["quid"]] = {leaf: i + 1 for i, leaf in enumerate(tree.visits(np.array(row["q"]), tree.leaves))}
        needed.append(by_query[row["quid"]][row["leaf"]])
    visits = int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if needed else tree.leaves
    found = _search(blocks, asking(queries, visits, max(n_queries, 1)), nearest)
    named = queries.select(F.col("uid").alias("quid"), F.col("id").alias("query_id"))
    own = F.when(F.col("id") != LAST, F.col("id")).alias("id")
    return found.join(named, "quid").select("query_id", "rank", own, "score")
