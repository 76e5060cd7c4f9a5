"""Tables of files that are changed in place: upserts, deletions in passes, and tables that only grow.

A table is kept in a fixed number of buckets by its key, as folders ``bucket=n``. A change rewrites the buckets that it touches and no others: the
new rows are written beside the table first and then take the buckets' place, so nothing is read from where it is written to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.streaming.common import remove, scratch

BUCKETS = 64


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Writes a table; several rows of one key are several rows."""
    _put(rows.withColumn("bucket", bucket(keys, buckets)), path, "error")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def _put(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def _replace(rows: DataFrame, path: str, touched: list[int]) -> None:
    """Puts ``rows`` in place of the touched buckets; a bucket without rows is emptied."""
    spark = rows.sparkSession
    beside = scratch(spark, "buckets")
    rows.write.parquet(beside)
    new = spark.read.schema(rows.schema).parquet(beside)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    filled = {r.bucket for r in new.select("bucket").distinct().collect()}
    for empty in set(touched) - filled:
        remove(spark, f"{path}/bucket={empty}")
    remove(spark, beside)


def buckets_of(rows: DataFrame) -> list[int]:
    """The buckets that rows are in, at most as many as the table has."""
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


def upsert(incoming: DataFrame, path: str, keys: list[str], arrival: str, buckets: int = BUCKETS) -> None:
    """Stores rows by key, in place of what the table has of it; of several incoming rows of a key the last by ``arrival``, then the greatest, counts."""
    spark = incoming.sparkSession
    last = incoming.groupBy(*keys).agg(F.max(F.struct(arrival, *[c for c in incoming.columns if c not in (*keys, arrival)])).alias("r")).select(*keys, "r.*").select(*incoming.columns)
    new = last.withColumn("bucket", bucket(keys, buckets))
    touched = buckets_of(new)
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    _replace(stored.join(new.select(*keys), keys, "left_anti").unionByName(new), path, touched)


def delete(spark: SparkSession, path: str, gone: Column) -> int:
    """Deletes the rows that fulfil a condition, null is no, and says how many there were; buckets without such rows stay as they are."""
    rows = spark.read.parquet(path)
    hit = F.coalesce(gone, F.lit(False))
    counts = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.count_if(hit).alias("n")).where("n > 0").collect()}
    if counts:
        _replace(rows.where(F.col("bucket").isin(list(counts))).where(~hit), path, list(counts))
    return sum(counts.values())


def cleanup(spark: SparkSession, passes: dict[str, Callable[[], int]]) -> DataFrame:
    """Runs each pass on its own: rows (pass, ok, deleted_rows, error). One that fails does not keep the others from running."""
    out = []
    for name, run in passes.items():
        try:
            out.append((name, True, int(run()), None))
        except Exception as e:  # noqa: BLE001  what goes wrong in a pass is its result
            out.append((name, False, 0, str(e).splitlines()[0] if str(e) else type(e).__name__))
    return spark.createDataFrame(out, "pass string, ok boolean, deleted_rows long, error string")


class AlreadyStored(ValueError):
    """Rows of an append-only table that are to be stored again."""


def append_only(incoming: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Adds rows whose keys are new and says how many; a key that is stored, or comes twice, refuses all of them. Nothing stored is ever rewritten."""
    spark = incoming.sparkSession
    held = f"{scratch(spark, 'incoming')}"
    incoming.withColumn("bucket", bucket(keys, buckets)).write.parquet(held)
    new = spark.read.parquet(held)
    try:
        twice = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        stored = spark.read.parquet(path).where(F.col("bucket").isin(buckets_of(new))).join(new.select(*keys), keys, "left_semi")
        if not twice.isEmpty() or not stored.isEmpty():
            raise AlreadyStored("rows of an append-only table must have new keys")
        _put(new, path, "append")
        return new.count()
    finally:
        remove(spark, held)


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table that lasts as long as the program."""
    return scratch(spark, f"{name}-{uuid.uuid4().hex[:8]}")
