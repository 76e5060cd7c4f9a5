"""Centroid clustering over a VA-file.

The file has for each vector a few bits a dimension, the cell in which its component lies, and its squared norm; cells
are bounded by quantiles of a bounded sample and by the least and greatest component of all. In each round lookup tables
give, for each dimension, cell and centroid, the least and greatest of c^2 - 2xc over the cell; summed over the dimensions and
added to the norm they are an interval of the distance to each centroid. A vector whose intervals leave one centroid is
assigned by the file alone. Full vectors are fetched where intervals overlap, and where a vector changes its centroid, as the sums of both
change; then distances are computed for the centroids left. All arithmetic is in integers, so results are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.llm.common import by_batch, materialize, released

WIDTH = 64
CENTROIDS, ROUNDS = 40, 5
#: Bits of a cell's number, of which four make three bytes.
BITS = 6
#: Vectors of the sample that bounds the cells; where cells lie has no part in the result.
SAMPLE_ROWS = 4096
#: Components may be so large, so that all distances fit 64 bits.
LARGEST = 1 << 27


def quantized(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (row, vec_id, q) of the vectors that take part: q = floor(256 x component), row a number of its own."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return vectors.where(ok).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def full_vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def packed_rows(rows: DataFrame) -> DataFrame:
    """Rows (row, vec_id, q) with q as little-endian 32-bit numbers."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, n = batch.column(2).flatten().to_numpy().astype("<i4").tobytes(), batch.num_rows
        size = len(flat) // max(n, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[i * size : (i + 1) * size] for i in range(n)], pa.binary())], ["row", "vec_id", "q"])

    return rows.mapInArrow(by_batch(of), "row long, vec_id long, q binary")


def cell_bounds(sample: np.ndarray, least: np.ndarray, greatest: np.ndarray, bits: int) -> np.ndarray:
    """For each dimension 2^bits + 1 bounds; cell i holds the components from bound i to less than bound i + 1."""
    cuts = np.quantile(sample, np.arange(1, 1 << bits) / (1 << bits), axis=0).T.astype(np.int64)
    return np.concatenate([least[:, None], np.clip(cuts, least[:, None], greatest[:, None]), greatest[:, None] + 1], axis=1)


def packed_cells(cells: np.ndarray) -> np.ndarray:
    """Cells of BITS bits, one row of bytes for each row."""
    bits = cells[:, :, None] >> np.arange(BITS) & 1
    return np.packbits(bits.reshape(len(cells), -1).astype(bool), axis=1, bitorder="little")


def unpacked_cells(column: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(column.__len__(), -1)
    bits = np.unpackbits(data, axis=1, count=width * BITS, bitorder="little").reshape(len(data), width, BITS)
    return (bits << np.arange(BITS, dtype=np.uint8)).sum(axis=2, dtype=np.int64)


def va_file(full: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Rows (row, cells, norm, cluster) of the packed vectors; no cluster yet: -1."""
    width = len(bounds)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = full_vectors(batch.column(1), width)
        cells = np.stack([np.searchsorted(b[1:-1], column, side="right") for b, column in zip(bounds, x.T)], axis=1)
        cells = [c.tobytes() for c in packed_cells(cells)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), pa.array((x * x).sum(axis=1)), pa.array(np.full(len(x), -1, np.int32))], ["row", "cells", "norm", "cluster"])

    return full.select("row", "q").mapInArrow(by_batch(of), "row long, cells binary, norm long, cluster int")


def tables(bounds: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables [dimension, cell, centroid]: least and greatest of c^2 - 2xc over the cell."""
    c = centroids.T[:, None, :]
    ends = [c * c - 2 * x[:, :, None] * c for x in (bounds[:, :-1], np.maximum(bounds[:, 1:] - 1, bounds[:, :-1]))]
    return np.minimum(*ends), np.maximum(*ends)


def intervals(cells: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each row to each centroid."""
    least = np.repeat(norms[:, None], low.shape[2], axis=1)
    most = least.copy()
    for d, column in enumerate(cells.T):
        least += low[d][column]
        most += high[d][column]
    return least, most


def marked(va: DataFrame, bounds: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """The rows of the file with ``guess``, the centroid that the intervals leave or -1, and ``left``, one bit for each centroid left."""
    low, high = tables(bounds, centroids)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        least, most = intervals(unpacked_cells(batch.column(1), len(bounds)), batch.column(2).to_numpy(), low, high)
        left = least <= most.min(axis=1, keepdims=True, initial=np.iinfo(np.int64).max)
        guess = np.where(left.sum(axis=1) == 1, left.argmax(axis=1), -1).astype(np.int32)
        bits = [b.tobytes() for b in np.packbits(left, axis=1)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(guess), pa.array(bits, pa.binary())], ["row", "cells", "norm", "cluster", "guess", "left"])

    return va.mapInArrow(by_batch(of), "row long, cells binary, norm long, cluster int, guess int, left binary")


def nearest(x: np.ndarray, norms: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids left, ties to the smaller number, and its squared distance."""
    row, k = np.nonzero(left)
    c = centroids[k]
    apart = norms[row] + (c * (c - 2 * x[row])).sum(axis=1)
    distance = np.full(left.shape, np.iinfo(np.int64).max)
    distance[row, k] = apart
    at = distance.argmin(axis=1)
    return at.astype(np.int32), distance[np.arange(len(x)), at]


def unpacked_left(column: pa.Array, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1, count=count).astype(bool)


def fetched(rows: DataFrame, full: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (row, cells, norm, cluster, change) of marked rows, each with its new cluster.

    One row of each task carries ``change``: by how much its rows change each centroid's count (first) and sums, as
    64-bit numbers; elsewhere it is null.
    """
    count, width = centroids.shape
    names = ["row", "cells", "norm", "cluster", "change"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, held = np.zeros((count, 1 + width), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = full_vectors(batch.column(5), width)
            new, _ = nearest(x, batch.column(2).to_numpy(), unpacked_left(batch.column(4), count), centroids)
            old, ones = batch.column(3).to_numpy(), np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
            moved = new != old
            np.add.at(change, new[moved], ones[moved])
            np.subtract.at(change, old[moved & (old >= 0)], ones[moved & (old >= 0)])
            if held:
                yield pa.RecordBatch.from_arrays([*held, pa.nulls(len(held[0]), pa.binary())], names)
            held = [batch.column(0), batch.column(1), batch.column(2), pa.array(new)]
        if held:
            yield pa.RecordBatch.from_arrays([*held, pa.array([change.astype("<i8").tobytes()] + [None] * (len(held[0]) - 1), pa.binary())], names)

    wanted = rows.select("row", "cells", "norm", "cluster", "left").join(full.select("row", "q"), "row")
    return wanted.select("row", "cells", "norm", "cluster", "left", "q").mapInArrow(of, "row long, cells binary, norm long, cluster int, change binary")


#: Groups in which the tasks' changes are summed before they come to the driver.
SUMS = 64


def changes(rows: DataFrame, count: int, width: int) -> np.ndarray:
    """The changes of all tasks together, [centroid, 1 + dimension]; at most SUMS rows come to the driver."""

    def summed(key: tuple, found: pa.Table) -> pa.Table:
        total = np.zeros(count * (1 + width), np.int64)
        for data in found.column("change").to_pylist():
            total += np.frombuffer(data, "<i8")
        return pa.table({"change": pa.array([total.tobytes()], pa.binary())})

    told = rows.where("change is not null").select("change", F.pmod(F.xxhash64("change"), F.lit(SUMS)).alias("part"))
    parts = told.groupBy("part").applyInArrow(summed, "change binary").collect()
    return sum((np.frombuffer(r.change, "<i8").astype(object) for r in parts), np.zeros(count * (1 + width), object)).reshape(count, 1 + width)


def seed_hash(vec_id: Column, seed: int = 2) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """One row (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that takes part.

    Vectors that are null, have another length than ``width``, or hold a null or non-finite component take no part. The first centroids are the
    vectors with the smallest hash of their vec_id, ties to the least vector; fewer vectors: fewer centroids. Vectors without vec_id
    are assigned like others but are no first centroids; without any vec_id there are no centroids and no rows. Repeated
    rows and vec_ids count each. A centroid without vectors stays as it is. Further columns play no part. No vectors: no rows.
    Components of 2^27 or more in absolute value after scaling raise ValueError, as distances might not fit 64 bits; sums do for up to 2^36 vectors.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, width)
    checked = materialize(rows, "vectors")
    size = F.greatest(F.abs(F.array_max("q").cast("double")), F.abs(F.array_min("q").cast("double")))
    if checked.agg(F.coalesce(F.max(size), F.lit(0.0))).first()[0] >= LARGEST:
        raise ValueError("distances of these vectors may not fit 64 bits")
    first = checked.where("vec_id is not null").orderBy(seed_hash(F.col("vec_id")), "q").limit(centroids).select("q").collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    c = np.array([r.q for r in first], np.int64)
    sample = np.array([r.q for r in checked.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE_ROWS).select("q").collect()], np.int64)
    ends = checked.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("greatest")).orderBy("d").collect()
    bounds = cell_bounds(sample, np.array([r.least for r in ends]), np.array([r.greatest for r in ends]), BITS)
    full = materialize(packed_rows(checked), "full")
    released(checked)
    va = materialize(va_file(full, bounds), "va")
    sums = np.zeros((len(c), 1 + width), object)
    for _ in range(rounds):
        seen = materialize(marked(va, bounds, c), "marked")
        wanted = (F.col("guess") < 0) | (F.col("guess") != F.col("cluster"))
        got = materialize(fetched(seen.where(wanted), full, c), "fetched")
        sums = sums + changes(got, len(c), width)
        c = np.array([[x // n for x in row] if n else old for (n, *row), old in zip(sums.tolist(), c.tolist())], np.int64)
        before, va = va, materialize(seen.where(~wanted).select("row", "cells", "norm", "cluster").unionByName(got.drop("change")), "va")
        released(before, seen, got)

    def last(batch: pa.RecordBatch) -> pa.RecordBatch:
        new, distance = nearest(full_vectors(batch.column(3), width), batch.column(1).to_numpy(), unpacked_left(batch.column(2), len(c)), c)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(new), pa.array(distance)], ["vec_id", "cluster", "distance"])

    pairs = marked(va, bounds, c).select("row", "norm", "left").join(full, "row").select("vec_id", "norm", "left", "q")
    assigned = materialize(pairs.mapInArrow(by_batch(last), "vec_id long, cluster int, distance long"), "assigned")
    released(va, full)
    inertias = {k: int(v) for k, v in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = sum(inertias.values())
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    known = spark.createDataFrame([(k, v, total, digest[k]) for k, v in inertias.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
