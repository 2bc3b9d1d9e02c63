"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 5).

Each component of a vector is a term, its integer value the weight of a posting. Queries go out in
blocks of a fixed size; every task turns its candidates into postings (per term, the rows where it
isn't zero and their weights), scatters the non-zero weights of a few queries times the postings into
a dense tile of scores that stays in a core's cache, keeps what reaches each query's k-th score by
partition selection of the tile, and merges it with what it kept before. The last merge is over a few
rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolith.llm.shared import bounded_batches, written

#: Queries of one pass, about. Their block is all that the driver holds and broadcasts at a time.
QUERY_BLOCK = 32_768
#: A tile of scores is of so many queries by so many candidates.
QUERIES, CANDIDATES = 64, 1_024
#: Share of non-zero weights from which zeros are added too, which is faster than to place the others.
DENSE = 0.5


def postings(matrix: np.ndarray) -> list[tuple[slice | np.ndarray, np.ndarray]]:
    """Per term: rows where it isn't zero, and their weights; a slice and all weights if those are most."""
    out = []
    for column in matrix.T:
        rows = np.flatnonzero(column)
        out.append((slice(None), np.ascontiguousarray(column)) if len(rows) > DENSE * len(column) else (rows, column[rows]))
    return out


def accumulate(queries: np.ndarray, lists: list, scores: np.ndarray, room: np.ndarray) -> None:
    """Scores of sparse query rows against the postings, term by term; room is as large as scores."""
    scores[:] = 0
    for term, (rows, weights) in enumerate(lists):
        who = np.flatnonzero(queries[:, term])
        if not len(who) or not len(weights):
            continue
        if len(who) > DENSE * len(queries):
            who = np.arange(len(queries))
        part = np.multiply(queries[who, term][:, None], weights[None, :], out=room[: len(who), : len(weights)])
        if isinstance(rows, slice):
            if len(who) == len(queries):
                scores += part
            else:
                scores[who] += part
        elif len(who) == len(queries):
            scores[:, rows] += part
        else:
            scores[np.ix_(who, rows)] += part


class Best:
    """The k highest scores of each of some queries so far, ties to smaller ids."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k, self.kind = k, kind
        self.lowest = np.array(-np.inf if kind is not np.int64 else np.iinfo(np.int64).min, kind)
        self.ids, self.scores = np.zeros((queries, k), np.int64), np.full((queries, k), self.lowest)
        self.many = np.zeros(queries, np.int64)

    def widen(self, kind: type) -> None:
        """Scores become of another type, which holds those so far."""
        known = np.arange(self.k) < self.many[:, None]
        old = self.scores
        self.kind, self.lowest = kind, np.array(-np.inf if kind is not np.int64 else np.iinfo(np.int64).min, kind)
        self.scores = np.full(old.shape, self.lowest)
        self.scores[known] = old[known]

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> None:
        """A tile of the queries from `at` on; own: its places that are no candidates."""
        scores[own] = self.lowest
        least = np.where(self.many[at : at + len(scores)] == self.k, self.scores[at : at + len(scores), -1], self.lowest)
        hit = scores >= least[:, None]
        hit[own] = False
        times = hit.sum(axis=1)
        crowded = np.flatnonzero(times > self.k)
        if len(crowded):
            floor = np.partition(scores[crowded], scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            hit[crowded] &= scores[crowded] >= floor[:, None]
        row, col = np.nonzero(hit)
        if not len(row):
            return
        some = np.unique(row)
        had, place = np.nonzero(np.arange(self.k) < self.many[at + some, None])
        row = np.concatenate([some[had], row])
        value = np.concatenate([self.scores[at + some[had], place], scores[row[len(had) :], col]])
        name = np.concatenate([self.ids[at + some[had], place], ids[col]])
        order = np.lexsort((name, -value, row))
        row, value, name = row[order], value[order], name[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        row, rank = row[keep], rank[keep]
        self.scores[at + row, rank], self.ids[at + row, rank] = value[keep], name[keep]
        self.many[at + some] = np.bincount(row, minlength=len(scores))[some]


def top_k(df: DataFrame, k: int = 20, modulus: int = 20, scale: float = 64.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score long: the k candidates with the highest
    integer inner product of each query, the rows whose id `modulus` divides.

    Components become floor(scale * x). Rows take no part if their id or vector is null, the vector
    is empty or holds a null or non-finite component, or (as a pair) lengths differ. A query's own
    row, and any other with its id, is no candidate; repeated candidate rows are listed each; of
    repeated query ids the least vector counts. Sums are exact in float32 or float64 while
    they stay below 2**24 or 2**53, which is checked, and else in int64.
    """
    spark = df.sparkSession
    x = F.col(column).cast("array<double>")
    ints = F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("double"))
    fine = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(fine, ints).alias("v")).where("v is not null")
    asked = rows.where(F.col("id") % modulus == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    if blocks > 1:
        asked = written(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    found = None
    for b in range(blocks):
        part = _one_pass(spark, rows, (asked if blocks == 1 else asked.where(F.col("block") == b).drop("block")).collect(), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _one_pass(spark, rows: DataFrame, block: list, k: int) -> DataFrame:
    """The k best of each task's candidates for one block of queries."""
    by_size: dict[int, list] = {}
    for i, v in sorted(map(tuple, block)):
        by_size.setdefault(len(v), []).append((i, v))
    sent = spark.sparkContext.broadcast({n: (np.array([i for i, _ in g], np.int64), np.array([v for _, v in g], np.float64)) for n, g in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Best] = {}
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                if n not in sent.value:
                    continue
                asked, queries = sent.value[n]
                mine = np.flatnonzero(sizes == n)
                matrix = flat[(starts[mine][:, None] + np.arange(n)).ravel()].reshape(-1, n)
                bound = n * np.abs(queries).max(initial=0) * np.abs(matrix).max(initial=0)
                exact = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
                if n not in kept:
                    kept[n] = Best(len(asked), k, exact)
                elif kept[n].kind is not exact:
                    kept[n].widen(np.promote_types(kept[n].kind, exact).type if np.int64 not in (kept[n].kind, exact) else np.int64)
                _tiles(kept[n], asked, queries, ids[mine], matrix)
        for n, best in kept.items():
            who, place = np.nonzero(np.arange(k) < best.many[:, None])
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[n][0][who]), pa.array(best.ids[who, place]), pa.array(best.scores[who, place].astype(np.int64))], ["query_id", "vec_id", "score"])

    bounded_batches(rows)
    found = written(rows.mapInArrow(run, "query_id long, vec_id long, score long"), "best")
    sent.destroy()
    return found


def _tiles(best: Best, asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
    """All queries (asked holds their ids, ascending) against the candidates, tile by tile."""
    q, m = queries.astype(best.kind), matrix.astype(best.kind)
    cache, room = np.zeros((QUERIES, CANDIDATES), best.kind), np.zeros((QUERIES, CANDIDATES), best.kind)
    for a in range(0, len(ids), CANDIDATES):
        part, own = m[a : a + CANDIDATES], ids[a : a + CANDIDATES]
        inverted = postings(part)
        place = np.searchsorted(asked, own)  # the query that each candidate is itself
        same = np.flatnonzero((place < len(asked)) & (asked[np.minimum(place, len(asked) - 1)] == own))
        for b in range(0, len(asked), QUERIES):
            block = q[b : b + QUERIES]
            scores = cache[: len(block), : len(part)]
            accumulate(block, inverted, scores, room)
            its = same[(place[same] >= b) & (place[same] < b + len(block))]
            best.add(b, scores, own, (place[its] - b, its))
