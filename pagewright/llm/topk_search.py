"""Exact top-k search by inner product, by the threshold algorithm over sorted lists of each dimension.

A block of candidates has one list per dimension, in order of that component. For a query the lists are read in rounds
from the end that its weight favours. What is met for the first time is scored in full, once; the weighted sum of the
components at the depth reached bounds every score not yet met, and reading stops when the bound is below the k-th result.
The k-th result goes on from block to block, so that later blocks stop earlier, or are not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

QUERY_BLOCK = 8192  # queries that the driver reads and broadcasts at once
CANDIDATE_BLOCK = 8192
FIRST_DEPTH = 256  # the first round reads this part of a list, each further one as much again as all before
SCHEMA = "query_id long, vec_id long, score long"


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


class Lists:
    """The sorted lists of one block of candidates of equal dimension; rows of x are integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], np.asarray(x)[order]
        self.x = self.whole.astype(np.float64)
        self.order = np.ascontiguousarray(np.argsort(self.x, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(self.x.T, self.order, axis=1)
        self.most = float(np.abs(self.x).max(initial=0))

    def bound(self, q: np.ndarray, depth: int) -> np.ndarray:
        """For each query the best score that a row not met at this depth can have."""
        n = len(self.ids)
        if depth >= n:
            return np.full(len(q), -np.inf)
        return np.maximum(q, 0) @ self.sorted[:, n - 1 - depth] + np.minimum(q, 0) @ self.sorted[:, depth]

    def read(self, weights: np.ndarray, low: int, high: int) -> np.ndarray:
        """Rows at depths low to high of all lists that have a weight; of all lists where none has."""
        n = len(self.ids)
        up, down = (weights > 0, weights < 0) if weights.any() else (np.ones(len(weights), bool), np.zeros(len(weights), bool))
        return np.concatenate([self.order[up, n - high : n - low].ravel(), self.order[down, low:high].ravel()])

    def score(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products, exact: doubles hold them where they are small enough, else Python's integers."""
        if self.most * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**53:
            q = q.astype(np.float64)
            return self.x[rows] @ q if 4 * len(rows) < len(self.ids) else (self.x @ q)[rows]
        exact = self.whole[rows].astype(object) @ np.array([int(w) for w in q], object)
        if any(abs(s) >= 2**63 for s in exact):
            raise OverflowError("an inner product does not fit into 64 bits")
        return exact


class Best:
    """The k best (score, id) of every query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), in order
        self.kth = np.full(n, -np.inf)  # not above the k-th score

    def add(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        fine = scores >= self.kth[row]
        ids, scores = ids[fine], scores[fine]
        if len(ids) > self.k:
            least = np.sort(scores)[-self.k]
            sure, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
            at = np.concatenate([sure, ties[np.argsort(ids[ties], kind="stable")[: self.k]]])
            ids, scores = ids[at], scores[at]
        self.found[row] = sorted([*self.found[row], *((-int(s), int(i)) for s, i in zip(scores, ids))])[: self.k]
        if len(self.found[row]) == self.k:
            self.kth[row] = -self.found[row][-1][0]


def threshold_search(lists: Lists, query_ids: np.ndarray, q: np.ndarray, best: Best) -> tuple[int, int]:
    """Brings best up to date with a block; gives the numbers of list entries read and of scores computed."""
    n = len(lists.ids)
    if not n or not len(query_ids):
        return 0, 0
    weights = q.astype(np.float64)
    # a bound is a sum of rounded products: it is raised by more than that can lose
    slack = 1e-9 * lists.most * np.abs(weights).sum(1)
    read = scored = 0
    for r in np.flatnonzero(lists.bound(weights, 0) + slack >= best.kth).tolist():
        met = lists.ids == query_ids[r]  # the query's own rows take no part
        low, high = 0, min(n, max(best.k, n // FIRST_DEPTH))
        while True:
            fresh = np.zeros(n, bool)
            at = lists.read(weights[r], low, high)
            fresh[at] = True
            fresh &= ~met
            met |= fresh
            rows = np.flatnonzero(fresh)
            read, scored = read + len(at), scored + len(rows)
            if len(rows):
                best.add(r, lists.ids[rows], lists.score(rows, q[r]))
            if met.all() or lists.bound(weights[r : r + 1], high)[0] + slack[r] < best.kth[r]:
                break
            low, high = high, min(n, 2 * high)
    return read, scored


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (id, v): floor(scale * component) as integers; vectors that are null or have odd components are left out."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of all other vectors for each id divisible by `every`.

    Scores are inner products of the integer components; ties go to the smaller id, and only vectors of the query's own
    length are compared. Rows with the query's id are its own. A repeated candidate counts as often as it comes; a
    repeated query is asked once. A score beyond 64 bits is an error. No vectors: no rows.

    Queries go out in blocks of about query_block rows, one block after the other: each meets all candidates where they
    lie, what a task sends on is k rows for each query, and its result is written before the next block is read. So
    neither the driver nor an executor holds more than one block of queries.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // query_block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).dropDuplicates(["id"])
        by_size: dict[int, tuple[list, list]] = {}
        for i, v in part.collect():
            ids, vs = by_size.setdefault(len(v), ([], []))
            ids.append(i)
            vs.append(v)
        sent = spark.sparkContext.broadcast({d: (np.array(ids, np.int64), np.array(vs, np.int64)) for d, (ids, vs) in by_size.items()})
        found = rows.mapInArrow(_search(sent, k), SCHEMA).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = ws.table(found.select("query_id", "rank", "vec_id", "score"))
        sent.destroy()
        done = found if done is None else done.unionByName(found)
    return done


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best = {d: Best(len(ids), k) for d, (ids, _) in queries.items()}
        held: dict[int, list[pa.RecordBatch]] = {d: [] for d in queries}

        def searched(d: int) -> None:
            rows = pa.Table.from_batches(held[d]).combine_chunks().to_batches()
            held[d] = []
            for part in rows:
                threshold_search(Lists(part.column(0).to_numpy(), _matrix(part.column(1))), *queries[d], best[d])

        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d in queries.keys() & set(np.unique(sizes).tolist()):
                held[d].append(batch.filter(pa.array(sizes == d)))
                if sum(b.num_rows for b in held[d]) >= CANDIDATE_BLOCK:
                    searched(d)
        for d, b in best.items():
            if held[d]:
                searched(d)
            found = [(int(q), i, -s) for q, rows in zip(queries[d][0], b.found) for s, i in rows]
            yield pa.record_batch([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run
