"""Exact top-k search by inner product, with bounds from segment means and deviations, coarse to fine.

For a segment of m components, the inner product of two vectors is at most m (mean a x mean b + deviation a x deviation b).
Summed over segments that bounds the score from above (a lower bound of the distance), and more, shorter segments bound it
closer. A candidate that can't reach a query's k-th best score at a coarse resolution is done; for the others the next one
is taken, and the exact integer score last. Bounds are enlarged by more than their rounding error, so no result is lost.

A query has a score to beat from the first row on: the k-th best among the other queries of its block, and in every slice of
rows the k with the highest bounds are scored first.

Queries of one block are broadcast. More are written to the shared folder, a file a block, and each task holds a range of its rows
while it goes through the blocks: one job of (range, block) cells, which reads the rows once and shuffles none of them.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, ship, table

SCALE = 1024
#: Segments at each resolution.
LEVELS = (1, 8, 32)
#: Queries that are compared at a time: with 64 components 2 MB. Rows that are, and bytes of rows that a task holds while it goes through blocks.
BLOCK, ROWS, RANGE = 4096, 512, 32 << 20
#: Components of that size or more take no part; scores under WHOLE are exact as doubles.
LARGEST, WHOLE = 1e140, 2.0**53


def whole_numbers(batch: pa.RecordBatch, at: int, scale: int = SCALE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: which rows hold one without a null or non-finite part, and floor(scale x component), as doubles."""
    column = batch.column(at)
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    begin, parts = np.cumsum(size) - size, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null part is no number
    out = []
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = parts[begin[rows][:, None] + np.arange(n)]
        good = np.isfinite(x).all(1) & (np.abs(x) < LARGEST).all(1)
        out.append((rows[good], np.floor(scale * x[good])))
    return out


def segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of n segments, each times the root of the segment's length; lengths may differ by one."""
    parts = np.array_split(np.arange(x.shape[1]), min(n, max(1, x.shape[1])))
    means = np.stack([x[:, p].mean(1) * np.sqrt(len(p)) for p in parts], 1)
    return means, np.stack([x[:, p].std(1) * np.sqrt(len(p)) for p in parts], 1)


def resolutions(x: np.ndarray) -> list[np.ndarray]:
    return [np.hstack(segments(x, n)) for n in LEVELS]


def floors(ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the other queries; none if there are fewer."""
    out = np.full(len(ids), -np.inf)
    if len(ids) > k:
        for a in range(0, len(ids), 256):
            part = queries[a : a + 256]
            error = 1e-12 * np.abs(part) @ np.abs(queries.T)
            scores = np.where(ids[a : a + 256, None] == ids, -np.inf, part @ queries.T - error)
            out[a : a + 256] = np.partition(scores, -k, 1)[:, -k]
    return out


class Search:
    """The k best rows seen so far for a block of queries of one length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.floor = ids, queries, k, np.minimum(floor, 2.0**62)
        self.levels = resolutions(queries)
        #: Over the rounding error of any sum of a row's products.
        self.slack = 1e-9 * (1 + np.sqrt((queries**2).sum(1)))
        self.best = np.full((len(ids), k), -np.inf)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.norms = np.sqrt((queries**2).sum(1))
        #: Of queries whose scores may pass WHOLE: the best as Python's integers, ``(-score, id)`` in order.
        self.large: dict[int, list[tuple[int, int]]] = {}
        #: Pairs seen, and those whose exact score was needed.
        self.seen = self.scored = 0

    def _take(self, q: int, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores rows exactly for a query."""
        self.scored += len(ids)
        if q in self.large or self.norms[q] * np.sqrt((rows**2).sum(1).max()) >= WHOLE / 2:
            self._take_large(q, ids, rows)
            return
        scores, found = np.append(self.best[q], rows @ self.queries[q]), np.append(self.best_id[q], ids)
        if len(scores) > 4 * self.k:  # all that may be among the best, ties included
            top = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, found = scores[top], found[top]
        order = np.lexsort((found, -scores))[: self.k]
        self.best[q], self.best_id[q] = scores[order], found[order]
        self.floor[q] = max(self.floor[q], self.best[q, -1])

    def _take_large(self, q: int, ids: np.ndarray, rows: np.ndarray) -> None:
        """The same in whole numbers; one beyond a long's range counts as the nearest long."""
        known = [(-int(s), int(i)) for s, i in zip(self.best[q], self.best_id[q]) if np.isfinite(s)]
        query = [int(x) for x in self.queries[q]]
        told = [(-max(-(1 << 63), min(sum(a * int(b) for a, b in zip(query, row.tolist())), (1 << 63) - 1)), int(i)) for i, row in zip(ids, rows)]
        self.large[q] = best = sorted(self.large.get(q, known) + told)[: self.k]
        if len(best) == self.k:
            self.floor[q] = max(self.floor[q], float(-best[-1][0]) * (1 - np.sign(float(-best[-1][0])) * 1e-15))

    def results(self) -> tuple[list[int], list[int], list[int]]:
        """Query, row and score of all that is among the best."""
        q, r = np.nonzero(np.isfinite(self.best))
        small = ~np.isin(q, list(self.large))
        q, r = q[small], r[small]
        told = [*zip(self.ids[q].tolist(), self.best_id[q, r].tolist(), self.best[q, r].astype(np.int64).tolist())]
        told += [(int(self.ids[k]), i, -s) for k, best in self.large.items() for s, i in best]
        return tuple(zip(*told)) or ((), (), ())

    def add(self, ids: np.ndarray, rows: np.ndarray, told: list[np.ndarray] | None = None) -> None:
        """Takes rows in; told: their segments at each resolution."""
        size = np.sqrt((rows**2).sum(1))
        told = told or resolutions(rows)
        for q in range(len(self.ids)):
            left = np.flatnonzero(ids != self.ids[q])
            self.seen += len(left)
            slack = self.slack[q] * (1 + size)
            for query, rows_at in zip(self.levels, told):
                bounds = rows_at[left] @ query[q] + slack[left]
                near = bounds >= self.floor[q]
                left, bounds = left[near], bounds[near]
            if len(left) > self.k:  # the most promising first; they raise what the others must beat
                first = np.argpartition(-bounds, self.k - 1)[: self.k]
                self._take(q, ids[left[first]], rows[left[first]])
                bounds[first] = -np.inf
                left = left[bounds >= self.floor[q]]
            if len(left):
                self._take(q, ids[left], rows[left])


def _searches(batches: list[pa.RecordBatch], k: int) -> dict[int, Search]:
    """A search for the queries of each length; the batches hold at most BLOCK rows."""
    told: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        for rows, x in whole_numbers(b, 1):
            told.setdefault(x.shape[1], []).append((b.column(0).to_numpy(zero_copy_only=False)[rows], x))
    out = {}
    for size, found in told.items():
        ids, x = (np.concatenate(c) for c in zip(*found))
        out[size] = Search(ids, x, floors(ids, x, k), k)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of rows of one length, at most ROWS at a time."""
    for b in batches:
        for a in range(0, len(b), ROWS):
            part = b.slice(a, ROWS)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield from ((ids[rows], x) for rows, x in whole_numbers(part, 1) if len(rows))


def _found(searches: dict[int, Search]) -> Iterator[pa.RecordBatch]:
    for search in searches.values():
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in search.results()], ["query_id", "vec_id", "score"])


def _one_block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each task's k best rows for queries that are one block."""
    sent = vectors.sparkSession.sparkContext.broadcast(_searches(queries.toArrow().to_batches(), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = copy.deepcopy(sent.value)  # tasks of one worker share what was sent
        for ids, x in _slices(batches):
            if x.shape[1] in searches:
                searches[x.shape[1]].add(ids, x)
        yield from _found(searches)

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def _many_blocks(vectors: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """The k best rows of each range of rows for each query, in one pass."""
    at = fresh_dir(vectors.sparkSession, "queries")
    queries.repartition(blocks).write.option("maxRecordsPerFile", BLOCK).parquet(at)

    def cells(held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(at)
        for file in sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet")):
            searches = _searches(parquet.read_table(file, filesystem=store, partitioning=None).to_batches(), k)
            for ids, x, told in held:
                if x.shape[1] in searches:
                    searches[x.shape[1]].add(ids, x, told)
            yield from _found(searches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, x in _slices(batches):
            held.append((ids, x, resolutions(x)))
            size += x.nbytes
            if size >= RANGE:
                yield from cells(held)
                held, size = [], 0
        if held:
            yield from cells(held)

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: str, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows with the largest inner product for each query, its own id left out.

    Components count as floor(1024 x), and scores are exact; one beyond the range of a long counts as its limit. is_query: a condition on ``vec_id``. Ties go to the smaller id. Rows that are null,
    empty, or hold a null or non-finite component, or one of 1e140 or more, take no part, nor do rows without an id; a repeated id is one query for
    each of its rows, told apart by nothing, so ids should be distinct. Vectors meet those of their own length alone. No
    queries or no candidates: no rows. Other columns are not read. Up to ``BLOCK`` queries are broadcast; more are read by the tasks
    from the shared folder, which must be one that ``pyarrow.fs`` reads.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id is not null and embedding is not null")
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    found = _one_block(rows, queries, k) if blocks == 1 else _many_blocks(rows, queries, blocks, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
