"""What several corpus operators share: scratch tables, word splitting, distributed components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than space and \\x09-\\x0D; bytes.split() cuts exactly there.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made once and set, on a local master only: elsewhere executors do
    not share it, so that is an error.
    """
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, unless the session has ended."""
    if spark.sparkContext._jsc is None:
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Scratch tables of this program by the identity of their DataFrame: (DataFrame, path).
_SCRATCH: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts the lineage, survives lost executors and lets several passes share one computation.
    The table goes with ``released``, or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _SCRATCH[id(out)] = (out, path)
    return out


def released(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more; other tables stay."""
    for t in tables:
        _, path = _SCRATCH.pop(id(t), (None, None))
        if path:
            remove(t.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name from ``name`` that the table does not have, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns of a row; nulls count."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in columns]  # xxhash64 passes over nulls
    return F.xxhash64(*columns, *nulls), F.xxhash64(F.lit("second"), *reversed(columns), *nulls)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with column ``name``, the row's number from 0 in the given order; rows that are equal there may have either number.

    Spark's range exchange deals the rows out by samples, with a random number after the order, so that many equal
    rows are spread too; a row's number is its place in its task's part and the counts of the parts before, one
    figure for each part. The parts are written once, so that numbers do not depend on a second sampling.
    """
    local = free_name(df, "local")
    parts = df.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order).withColumn(local, F.monotonically_increasing_id())
    placed = materialize(parts, "numbered")
    part, before = free_name(placed, "part"), free_name(placed, "before")
    counts = placed.groupBy(F.shiftright(F.col(local), 33).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    rows = placed.join(F.broadcast(sums), F.shiftright(placed[local], 33) == sums[part])
    return rows.withColumn(name, F.col(before) + F.col(local).bitwiseAND(F.lit((1 << 33) - 1))).select(*[placed[c] for c in df.columns], name)


#: Rows that a function of a batch sees at a time; what it makes of them is held in a worker's memory.
SLICE_ROWS = 1024


def by_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one Arrow batch as one for ``mapInArrow``, called on slices of the batches."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield function(batch.slice(start, SLICE_ROWS))

    return over


#: Repeats of a row that one task makes at most.
REPEATS = 4096


def repeated(rows: Callable[[DataFrame], DataFrame], plan: DataFrame, times: Column, number: str) -> DataFrame:
    """``rows(plan)`` with each row as often as ``times`` says, numbered from 1.

    plan is a written table with a row for each row of the result before it is repeated; times is made of its columns, all of which rows() keeps.
    What is repeated more than ``REPEATS`` times is cut into ranges of so many, which are dealt out before they are made rows. So a
    group that holds a third of all rows is made by many tasks, and no row ever holds more numbers than there are ranges.
    """
    start, least = F.lit(1).cast("long"), times.cast("long")
    out = rows(plan.where((times > 0) & (times <= REPEATS))).withColumn(number, F.explode(F.sequence(start, least)))
    many = plan.where(times > REPEATS)
    if many.isEmpty():
        return out
    cut = rows(many).withColumn(f"{number}_range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((least - 1) / REPEATS))))
    first = F.col(f"{number}_range") * REPEATS
    dealt = cut.repartition(*plan.columns, f"{number}_range").withColumn(number, F.explode(F.sequence(first + 1, F.least(least, first + REPEATS))))
    return out.unionByName(dealt.drop(f"{number}_range"))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces links a[i]-b[i] by links of each node to the smallest node of its component here."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def connected_components(links: DataFrame) -> DataFrame:
    """Components of the graph with links (a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds; each is a partial minimum per node and an equi-join,
    so a hub's links are spread. Every round is written to the shared folder. Ends when a round
    changes nothing, after about the logarithm of the longest path. Nodes without links, null ends and
    loops give no rows.
    """

    def keep_least(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))

    def fingerprint(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = fingerprint(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = keep_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = keep_least(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialize(small, "links")
        released(before)
        now = fingerprint(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
