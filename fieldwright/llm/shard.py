"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwright.llm.common import free_name, numbered, row_hashes

SHARDS = 8
SEED = 20240611
ROUNDS = 6
#: Odd multipliers of the round function.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def feistel(numbers: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """A permutation of range(count), applied to the given row numbers.

    A balanced Feistel network permutes the least even number of bits that hold count values; a value
    outside the range is sent through again until it falls inside (cycle walking), under four times on average.
    """
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((seed * (r + 1) * MIX[0] + r) & (2**64 - 1)) for r in range(ROUNDS)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            y = (right ^ key) * np.uint64(MIX[0])
            y = (y ^ (y >> np.uint64(29))) * np.uint64(MIX[1])
            left, right = right, left ^ ((y ^ (y >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    x = network(np.asarray(numbers, dtype=np.uint64))
    while (out := x >= np.uint64(count)).any():
        x[out] = network(x[out])
    return x.astype(np.int64)


def place(number: int, count: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row number, without looking at any other row."""
    at = int(feistel(np.array([number]), count, seed)[0])
    return at % shards, at // shards


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with columns shard (int) and slot (long).

    Row number i, in ascending doc_id and then by a hash of the whole row, goes to place p = Feistel(i): shard p
    mod shards, slot p div shards. So row counts differ by one at most, slots run gapless from 0, and reruns agree. Null
    doc_ids come first; null, empty and very long texts are rows like others; repeated rows get a place each, and
    any of them may have either place. Columns shard and slot of the input are replaced; others, of whatever
    name, stay. No documents: no rows.
    """
    rows = docs.drop("shard", "slot")
    number, at = free_name(rows, "number"), free_name(rows, "at")
    rows = numbered(rows, [F.col("doc_id").cast("long").asc_nulls_first(), row_hashes(rows)[0].asc()], number)
    count = rows.count()

    @F.pandas_udf("long")
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(np.int64), count, seed) if len(number) else number.to_numpy(np.int64))

    placed = rows.withColumn(at, permuted(number))
    return placed.withColumn("shard", F.pmod(at, F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"{at} div {shards}")).drop(number, at)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int = 16, rows_per_file: int | None = None, seed: int = SEED) -> None:
    """Writes the sharded documents as Parquet under ``path``/shard=N, rows of a file in slot order.

    Each shard is cut into runs of slots so that no task writes a whole shard. Nulls, repeated rows, long texts and
    clashing names as in ``shard``. No documents: no files but Spark's mark of success.
    """
    placed = shard(docs, shards, seed)
    if rows_per_file is None:
        rows_per_file = max(1, -(-docs.count() // (shards * files_per_shard)))
    run = free_name(placed, "run")
    cut = placed.withColumn(run, F.expr(f"slot div {rows_per_file}")).repartition("shard", run).sortWithinPartitions("shard", "slot")
    cut.drop(run).write.partitionBy("shard").parquet(path)
