"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments.  A segment's mean and deviation bound
what it can add to an inner product: with n components, means m and deviations s,
``n * (m1*m2 + s1*s2)`` at most, by Cauchy-Schwarz on the centred parts; equally,
they bound the squared distance from below.  A task holds one block of queries and
streams one part of the rows past it.  It keeps every query's best k so far, drops
the pairs whose bound cannot reach the query's k-th score, coarse bounds first, and
computes exact integer products for the survivors only.

Blocks and parts form a grid of tasks.  Queries and rows reach their tasks through
one shuffle, queries first; nothing passes through the driver or a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.shared import lean, materialize

LEVELS = (1, 4, 16)
#: Below this, sums of products are exact in double precision.
_EXACT = 1 << 53
#: Pairs looked at in one step, and the share of survivors up to which they are looked at one by one.
_PAIRS, _SPARSE = 1 << 21, 0.05


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, code``: each component x becomes floor(scale * x); unusable vectors are left out."""
    e = F.col("embedding")
    code = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(e.isNotNull() & finite & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), code.alias("code"))


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of scaled means and deviations whose products are the bound of a level."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    stats = []
    for p in parts:
        root = np.sqrt(p.shape[1])
        stats += [root * p.mean(axis=1), root * p.std(axis=1)]
    return np.stack(stats, axis=1)


class QueryBlock:
    """Queries of one length, their statistics, and the best k rows of each so far."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int) -> None:
        self.ids, self.codes, self.k = ids, codes, k
        self.levels = [segment_statistics(codes.astype(np.float64), s) for s in LEVELS] if codes.shape[1] else []
        self.largest = float(np.abs(codes.astype(np.float64)).max(initial=0))
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # query, score, id
        self.floor = np.full(len(ids), -np.inf)
        self.last = np.full(len(ids), np.iinfo(np.int64).max)  # id at the floor
        self.seen = self.pairs = self.scored = 0

    def update(self, ids: np.ndarray, codes: np.ndarray) -> None:
        """Merge rows into every query's best k, few at first so that bounds soon have a floor to reach."""
        at = 0
        while at < len(ids):
            n = max(1, min(max(64, self.seen), 2048, _PAIRS // len(self.ids)))
            self._merge(ids[at : at + n], codes[at : at + n])
            self.seen += n
            at += n

    def _survivors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and query of the pairs that all bounds let through."""
        rows, queries = None, None
        shape = (len(codes), len(self.ids))
        if self.levels and (self.floor > -np.inf).any():
            wide = codes.astype(np.float64)
            first = segment_statistics(wide, LEVELS[0])
            slack = 1e-6 * (1 + np.abs(first).sum(axis=1))  # rounding of the bounds
            norm = 1 + np.abs(self.levels[0]).sum(axis=1)
            alive = np.ones(shape, bool)
            for level, mine in zip(LEVELS, self.levels, strict=True):
                theirs = first if level == LEVELS[0] else segment_statistics(wide, level)
                if rows is None:
                    alive &= theirs @ mine.T + np.outer(slack, norm) >= self.floor
                    if alive.mean() < _SPARSE:
                        rows, queries = np.nonzero(alive)
                else:
                    bound = np.einsum("ij,ij->i", theirs[rows], mine[queries]) + slack[rows] * norm[queries]
                    ok = bound >= self.floor[queries]
                    rows, queries = rows[ok], queries[ok]
            if rows is None:
                rows, queries = np.nonzero(alive)
            return rows, queries
        return np.divmod(np.arange(shape[0] * shape[1]), shape[1])

    def _products(self, codes: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact products of the pairs; what leaves the range of a long counts as its end."""
        largest = float(np.abs(codes.astype(np.float64)).max(initial=0)) * self.largest * max(1, codes.shape[1])
        if largest < _EXACT:
            if len(rows) > _SPARSE * len(codes) * len(self.ids):
                return (codes.astype(np.float64) @ self.codes.T.astype(np.float64))[rows, queries].astype(np.int64)
            return np.einsum("ij,ij->i", codes[rows], self.codes[queries])
        out = np.empty(len(rows), np.int64)
        whole = np.iinfo(np.int64)
        for i, (r, q) in enumerate(zip(rows.tolist(), queries.tolist(), strict=True)):
            exact = sum(x * y for x, y in zip(codes[r].tolist(), self.codes[q].tolist(), strict=True))
            out[i] = min(max(exact, whole.min), whole.max)
        return out

    def _merge(self, ids: np.ndarray, codes: np.ndarray) -> None:
        rows, queries = self._survivors(codes)
        self.pairs += len(ids) * len(self.ids)
        self.scored += len(rows)
        other = ids[rows] != self.ids[queries]
        rows, queries = rows[other], queries[other]
        scores = self._products(codes, rows, queries)
        known = ids[rows]
        wins = (scores > self.floor[queries]) | ((scores == self.floor[queries]) & (known < self.last[queries]))
        if not wins.any():
            return
        query, score, found = (np.concatenate([a, b]) for a, b in zip(self.best, (queries[wins], scores[wins], known[wins]), strict=True))
        order = np.lexsort((found, ~score, query))
        query, score, found = query[order], score[order], found[order]
        starts = np.searchsorted(query, np.arange(len(self.ids)))
        place = np.arange(len(query)) - starts[query]
        keep = place < self.k
        self.best = (query[keep], score[keep], found[keep])
        full = np.flatnonzero(place == self.k - 1)
        self.floor[query[full]], self.last[query[full]] = score[full], found[full]

    def result(self) -> pa.RecordBatch:
        query, score, found = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[query]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])


_SCHEMA = "query_id long, vec_id long, score long"


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and codes of a batch's rows, one pair for each length of vector."""
    ids, codes = batch.column("vec_id").to_numpy(), batch.column("code")
    lengths = np.diff(codes.offsets.to_numpy())
    flat = codes.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == d)
        yield ids[own], flat[starts[own][:, None] + np.arange(d)]


def _search(k: int):
    """Cells of the grid come one after the other, each with its queries before its rows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, blocks = None, [], {}

        def ready() -> None:
            gathered: dict[int, list] = {}
            for ids, codes in waiting:
                gathered.setdefault(codes.shape[1], []).append((ids, codes))
            waiting.clear()
            for d, parts in gathered.items():
                ids, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
                blocks[d] = QueryBlock(ids, codes, k)

        for batch in batches:
            cells, is_row = batch.column("cell").to_numpy(), batch.column("is_row").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_row) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    yield from (b.result() for b in blocks.values())
                    cell = cells[lo]
                    waiting.clear()
                    blocks.clear()
                part = batch.slice(lo, hi - lo)
                if not is_row[lo]:
                    waiting.extend(_matrices(part))
                    continue
                if waiting:
                    ready()
                for ids, codes in _matrices(part):
                    if codes.shape[1] in blocks:
                        blocks[codes.shape[1]].update(ids, codes)
        yield from (b.result() for b in blocks.values())

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 16_384, part_rows: int = 1 << 22) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product per query.

    Both sides are ``vec_id, code`` as ``quantized`` gives.  Ties go to the smaller
    vec_id; rows with the query's own id are no candidates; a query with fewer than
    k candidates gets them all.  Rows that repeat an id are candidates each, so an
    id may occur twice in a result; queries that repeat an id are answered once.
    Vectors of another length than the query's are no candidates; vectors without
    components have product 0 with each other.  Scores are exact whatever the size
    of the components; a score outside the range of a long counts as its end.  No
    rows or no queries give no rows.

    A task holds ``block`` queries and streams up to about ``part_rows`` rows.  Every
    row is sent once per block of queries, every query once per part of the rows.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors, "codes")
    asked = materialize(queries.groupBy("vec_id").agg(F.min("code").alias("code")), "query-codes")
    blocks = max(1, math.ceil(asked.count() / block))
    parts = max(math.ceil(vectors.count() / part_rows), math.ceil(2 * spark.sparkContext.defaultParallelism / blocks))
    rows = vectors.select("vec_id", "code", F.lit(1).alias("is_row"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
                          F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(parts)).alias("p"))
    lines = asked.select("vec_id", "code", F.lit(0).alias("is_row"), F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int").alias("b"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("p"))
    grid = rows.unionByName(lines).select((F.col("p") * blocks + F.col("b")).alias("cell"), "is_row", "vec_id", "code")
    dealt = grid.repartition(blocks * parts, "cell").sortWithinPartitions("cell", "is_row")
    found = dealt.mapInArrow(lean(_search(k)), _SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
