"""Exact top-k search by integer inner product with MaxScore.

Components are terms, vectors are documents and a vector's components are its postings. In a shard, a term's
postings are counted from their end with the least score, so that all contributions are 0 or more and
have an upper bound: |weight| x (greatest - least component in the shard). Terms in order of bound
are split into essential and non-essential ones: non-essential are those whose bounds together do not
bring a vector to the query's threshold. Essential postings are traversed for all vectors, as one matrix product for a
block of queries; the others are probed only for vectors that still can compete, or by a second product where
most of them can. Shards are searched on their own and merged.

A query's threshold is its k-th score in a bounded sample of the vectors, found in a round before. Each shard is sent
once, to one task, and the queries stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwright.llm.common import materialize

K = 5
#: Components in a shard, and the least number of vectors for which a further shard is made.
SHARD_CELLS, SHARD_ROWS = 1 << 20, 512
#: Vectors of the sample that gives the first thresholds; their components are bounded by SHARD_CELLS too.
SAMPLE_ROWS = 2048
#: Terms probed at a time, and the share of vectors that may compete for probing one by one.
STEP, FEW = 8, 0.05
#: Scores held at a time.
CELLS = 1 << 22
NONE = np.iinfo(np.int64).min


def quantized(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, q, u): q = floor(256 x component), each component as double, for vectors that take part; u tells rows apart."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(ok & F.col("vec_id").isNotNull())
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"), F.monotonically_increasing_id().alias("u"))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of integers; shorter ones are filled with 0."""
    n = lists.value_lengths().to_numpy().astype(np.int64)
    values, width = lists.flatten().to_numpy().astype(np.int64), int(n.max(initial=0))
    if (n == width).all():
        return values.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = values
    return out


class Shard:
    """Vectors of one shard with the range of each term."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.least, self.greatest = x.min(axis=0), x.max(axis=0)
        self.small = int(np.abs(x).max(initial=0))
        self.exact = x.astype(np.float64) if self.small < 2**52 else x

    def product(self, w: np.ndarray) -> np.ndarray:
        """Scores of all vectors for rows of weights, exact."""
        if self.small * int(np.abs(w).max(initial=0)) * max(1, w.shape[1]) < 2**52:
            return (w.astype(np.float64) @ self.exact.T).astype(np.int64)
        return w @ self.x.T

    def search(self, query_ids: np.ndarray, weights: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the k best for each query that reach its floor (NONE: no floor), ties to the smaller vec_id, without rows of the query's own id."""
        width = self.x.shape[1]
        w = np.zeros((len(weights), width), np.int64)
        used = min(width, weights.shape[1])
        w[:, :used] = weights[:, :used]  # a component that no vector of the shard has adds nothing
        step = max(1, CELLS // max(1, len(self.ids)))
        found = [self._block(query_ids[i : i + step], w[i : i + step], floors[i : i + step], k) for i in range(0, len(w), step)]
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def _block(self, query_ids: np.ndarray, w: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = w.shape[1]
        end = np.where(w >= 0, self.least, self.greatest)
        base = (w * end).sum(axis=1)  # every vector's score from the least contributions
        need = np.where(floors == NONE, 0, floors - base)
        bound = np.abs(w) * (self.greatest - self.least)
        order = np.argsort(-bound, axis=1, kind="stable")
        falling = np.take_along_axis(bound, order, axis=1)
        rest = np.zeros((len(w), width + 1), np.int64)  # rest[q, j]: bound of the terms from j on
        rest[:, :width] = np.cumsum(falling[:, ::-1], axis=1)[:, ::-1]
        at = (rest[:, :width] >= need[:, None]).sum(axis=1)  # what follows cannot reach the threshold alone
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(width), order.shape), axis=1)
        essential = np.where(rank < at[:, None], w, 0)
        have = self.product(essential) - (essential * end).sum(axis=1)[:, None]
        alive = (have + np.take_along_axis(rest, at[:, None], axis=1) >= need[:, None]) & (self.ids != query_ids[:, None])
        if alive.mean() > FEW:
            have += self.product(w - essential) - ((w - essential) * end).sum(axis=1)[:, None]
            at = np.full(len(w), width)
            alive &= have >= need[:, None]
        q, v = np.nonzero(alive)
        score = have[q, v]
        while len(q) and (at[q] < width).any():
            place = at[q, None] + np.arange(STEP)
            inside = place < width
            terms = np.take_along_axis(order[q], np.minimum(place, width - 1), axis=1)
            score = score + np.where(inside, (self.x[v[:, None], terms] - end[q[:, None], terms]) * w[q[:, None], terms], 0).sum(axis=1)
            at = np.minimum(at + STEP, width)
            stay = score + rest[q, at[q]] >= need[q]
            q, v, score = q[stay], v[stay], score[stay]
        order = np.lexsort((self.ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        first = np.searchsorted(q, q, side="left")
        best = np.arange(len(q)) - first < k
        return query_ids[q[best]], self.ids[v[best]], score[best] + base[q[best]]


def with_floors(queries: DataFrame, sample: Shard | None, k: int) -> DataFrame:
    """queries: (vec_id, q); with column floor, the k-th score among the sample's vectors of other ids; NONE if it has fewer."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, floors = batch.column(0).to_numpy(), np.full(batch.num_rows, NONE)
            if sample is not None and len(ids):
                q, _, score = sample.search(ids, matrix(batch.column(1)), floors, k)
                full, first, n = np.unique(q, return_index=True, return_counts=True)  # a query's rows follow each other and fall in score
                by = np.argsort(ids)
                place = by[np.searchsorted(ids[by], full)]
                floors[place[n >= k]] = score[(first + k - 1)[n >= k]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors)], ["vec_id", "q", "floor"])

    kind = queries.schema["q"].dataType.simpleString()
    return queries.mapInArrow(of, f"vec_id long, q {kind}, floor long")


def _search(k: int):
    """Rows (query_id, vec_id, score) from rows (shard, kind, id, q, floor), a shard's vectors (kind 0) before its queries (1)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            runs = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])])) if len(number) else []
            for start, stop in zip(runs, [*runs[1:], len(number)]):
                ids, x = batch.column(2).to_numpy()[start:stop], matrix(batch.column(3).slice(start, stop - start))
                if number[start] != now:
                    now, parts, shard = number[start], [], None
                if kind[start] == 0:
                    parts.append((ids, x))
                    continue
                if shard is None and parts:
                    width = max(p.shape[1] for _, p in parts)
                    shard = Shard(np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for _, p in parts]))
                    parts = []
                if shard is not None:
                    out = shard.search(ids, x, batch.column(4).to_numpy()[start:stop], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["query_id", "vec_id", "score"])

    return over


def top_k(vectors: DataFrame, query_condition: str = "vec_id % 50 = 0", k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best other rows, all if fewer.

    Queries are the rows that fulfil the condition; ties go to the smaller vec_id. Vectors that are
    null or hold a null or non-finite component take no part, nor do rows without vec_id. Vectors of
    different lengths: missing components count as 0. Rows of the query's own vec_id are no candidates; other
    repeated vec_ids are candidates each. Of several vectors of a query's id the least, component by component, is
    the query. Empty vectors score 0. Further columns play no part. No rows: no rows. Components so large that a score
    might not fit 64 bits raise ValueError.

    Rows meet shards by a hash of their place, so repeated vec_ids are spread like others.
    """
    rows = materialize(quantized(vectors), "vectors")
    size = F.greatest(F.abs(F.array_max("q").cast("double")), F.abs(F.array_min("q").cast("double")))
    count, width, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(F.max(size), F.lit(0.0))).first()
    if most * most * max(1, width) >= 2.0**62:
        raise ValueError("scores of these vectors may not fit 64 bits")
    kind = "array<int>" if most < 2**31 else "array<bigint>"
    rows = rows.withColumn("q", F.col("q").cast(kind))
    per_shard = max(1, SHARD_CELLS // max(1, width))
    sample = rows.orderBy(F.xxhash64("vec_id", "u"), "u").limit(min(SAMPLE_ROWS, per_shard)).select("vec_id", "q").toArrow()
    first = Shard(sample.column(0).to_numpy(), matrix(sample.column(1).combine_chunks())) if sample.num_rows else None
    queries = rows.where(query_condition).groupBy("vec_id").agg(F.min("q").alias("q"))
    asked = materialize(with_floors(queries, first, k), "queries")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-count // per_shard), min(tasks, -(-count // SHARD_ROWS)), 1)
    own = rows.select(F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "q", F.lit(NONE).alias("floor"))
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "q", "floor")
    streams = own.union(sent).repartition("shard").sortWithinPartitions("shard", "kind")
    found = streams.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
