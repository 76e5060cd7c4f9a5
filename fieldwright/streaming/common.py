"""Running a stream over a table's files to its end."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder spark.checkpoint.dir; where that is unset a temporary one, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: streams need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, unless the session has ended."""
    if spark.sparkContext._jsc is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream of its files and of no others."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    if folder:
        return reader.parquet(path)
    above, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(above)


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that the stream puts out until its input is used up, batch by batch as Parquet.

    A batch that is repeated after a failure overwrites its own folder, so rows are there once.
    """
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    remove(spark, f"{out}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)
