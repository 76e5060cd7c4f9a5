"""Exact dedup against a history by minimal perfect hashing.

The history's distinct digests are dealt by their leading bits into buckets of bounded size, and each bucket gets a
minimal perfect hash of its own: levels of bits, in which a digest that is alone at its place sets the bit and the others go on to
the next level; the number of bits set before is the slot. Slots hold the full 32 bytes of the digest, the locator of the row
that won, and how many rows had it. An incoming digest is led to one slot and compared byte by byte: a member repeats
the history and is removed; nonmembers are grouped among themselves.

Rows are counted by digest before they are shuffled, so a text that a third of all rows share is one entry for each task. The
way back to the rows is a join on the digest; digests with over 1/1024 of all rows, of which there are fewer than 1,024, are
broadcast, so what is left of the join has no hot key.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm.common import free_name, materialize, remove, shared_folder

#: Digests in a bucket, on average, of the history and of what is looked up at a time.
BUCKET = 1 << 16
#: Bits of a level for each digest in it.
ROOM = 1.5
#: A digest with more than one in so many rows is hot.
HOT = 1024
#: Odd multipliers that mix a digest's words for each level.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: A row of the index; doc_ids and rows are the locators of the winners.
SLOTS = "bucket long, n long, sizes array<bigint>, bits binary, digests binary, doc_ids array<bigint>, rows array<bigint>, counts array<bigint>"
LONGS = pa.list_(pa.field("element", pa.int64()))


def flat(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, digest): SHA-256 of the normalised text; row is a number of its own for each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(flat(F.col("text")), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """Rows (digest, doc_id, row, n) of distinct digests, with the row of the smallest doc_id, null last."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return rows.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).select("digest", "first.doc_id", "first.row", "n")


def lead(digest: Column) -> Column:
    """The first 32 bits as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def words_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Four 64-bit words of each digest."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the digests fall among ``size`` bits of a level."""
    h = (words[:, (level + 1) % 4] + np.uint64(level)) * MIX[0]
    h = (h ^ (h >> np.uint64(32)) ^ words[:, level % 4]) * MIX[1]
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct digests: levels of bits."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        levels, left = [], words
        while len(left):
            size = max(64, int(len(left) * ROOM))
            at = places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls([len(x) for x in levels], np.concatenate([np.zeros(0, bool), *levels]))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest; of a digest outside some slot or -1."""
        out, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = places(words[left], level, size) + start
            found = self.bits[at]
            out[left[found]] = self.before[at[found]]
            left, start = left[~found], start + size
        return out


@dataclass
class Index:
    """A history's index under ``path``: rows of SLOTS."""

    path: str
    buckets: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SLOTS).parquet(self.path)


def _build(key: tuple, entries: pa.Table) -> pa.Table:
    words = words_of(entries.column("digest"))
    hash_ = PerfectHash.of(words)
    order = np.empty(len(words), np.int64)
    order[hash_.slots(words)] = np.arange(len(words))
    in_slots = entries.take(pa.array(order))
    lists = {name: pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), in_slots.column(of).combine_chunks(), type=LONGS) for name, of in (("doc_ids", "doc_id"), ("rows", "row"), ("counts", "n"))}
    one = {"bucket": pa.array([key[0].as_py()]), "n": pa.array([len(words)]), "sizes": pa.array([hash_.sizes], LONGS), "bits": pa.array([np.packbits(hash_.bits).tobytes()]), "digests": pa.array([words[order].tobytes()]), **lists}
    return pa.table(one)


def build(entries: DataFrame, path: str, most: int | None = None) -> Index:
    """Writes the index of distinct digests, rows (digest, doc_id, row, n), under ``path``. most: how many there may be, or are looked up at a time, counted here if None."""
    spark = entries.sparkSession
    count = entries.count() if most is None else most
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BUCKET))
    dealt = entries.withColumn("bucket", F.shiftright(lead(F.col("digest")) * buckets, 32))
    dealt.groupBy("bucket").applyInArrow(_build, SLOTS).write.parquet(path)
    return Index(path, buckets)


def _found(with_rest: bool):
    """For the digests asked of a bucket: the history's entry where its slot holds the same 32 bytes. with_rest: entries that nobody asked for, too."""

    def of(asked: pa.Table, slots: pa.Table) -> pa.Table:
        words = words_of(asked.column("digest"))
        digests, held = np.zeros((0, 4), np.uint64), {name: pa.nulls(0, pa.int64()) for name in ("doc_ids", "rows", "counts")}
        slot = np.full(len(words), -1, np.int64)
        if slots.num_rows:
            n = slots.column("n")[0].as_py()
            sizes = slots.column("sizes")[0].as_py()
            digests = np.frombuffer(slots.column("digests")[0].as_py(), "<u8").reshape(n, 4)
            held = {name: slots.column(name).combine_chunks().flatten() for name in held}
            slot = PerfectHash(sizes, np.unpackbits(np.frombuffer(slots.column("bits")[0].as_py(), np.uint8), count=sum(sizes)).astype(bool)).slots(words)
        member = slot >= 0
        member[member] = (digests[slot[member]] == words[member]).all(axis=1)
        new, counts = asked.column("n").to_numpy(), held["counts"].to_numpy(zero_copy_only=False)
        old = np.zeros(len(words), np.int64)
        old[member] = counts[slot[member]]
        kept = [pa.concat_arrays([asked.column(name).combine_chunks(), held[f"{name}s"]]) for name in ("doc_id", "row")]
        take = np.where(member, len(words) + slot, np.arange(len(words)))
        out_digests, old_n, new_n = asked.column("digest").to_pylist(), old, new
        if with_rest:
            rest = np.ones(len(digests), bool)
            rest[slot[member]] = False
            rest = np.flatnonzero(rest)
            out_digests += [digests[i].tobytes() for i in rest.tolist()]
            take, member = np.concatenate([take, len(words) + rest]), np.concatenate([member, np.ones(len(rest), bool)])
            old_n, new_n = np.concatenate([old, counts[rest]]), np.concatenate([new, np.zeros(len(rest), np.int64)])
        return pa.table({"digest": pa.array(out_digests, pa.binary()), "doc_id": kept[0].take(pa.array(take)), "row": kept[1].take(pa.array(take)), "member": pa.array(member), "n_history": pa.array(old_n), "n_new": pa.array(new_n)})

    return of


def look_up(index: Index, entries: DataFrame, with_rest: bool = False) -> DataFrame:
    """Rows (digest, doc_id, row, member, n_history, n_new) for distinct digests, rows (digest, doc_id, row, n).

    A member has the locator of the history's row; others keep their own. with_rest: with the history's digests that
    were not asked for. Where far more digests are asked for than the history has, its buckets are sent to several tasks each.
    """
    spark, part = entries.sparkSession, F.lit(0)
    parts = 1
    if not with_rest:
        parts = max(1, -(-entries.count() // (index.buckets * BUCKET)))
        part = F.pmod(lead(F.col("digest")), F.lit(parts))
    asked = entries.withColumns({"bucket": F.shiftright(lead(F.col("digest")) * index.buckets, 32), "part": part.cast("long")})
    slots = index.rows(spark).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    out = "digest binary, doc_id long, row long, member boolean, n_history long, n_new long"
    return asked.groupBy("bucket", "part").cogroup(slots.groupBy("bucket", "part")).applyInArrow(_found(with_rest), out)


def with_labels(rows: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of ``labels``, rows of distinct digests with column ``size``, by the digest; hot digests by a broadcast of fewer than HOT rows."""
    hot = F.broadcast(labels.where(F.col("size") * HOT > total))
    named = [F.col(c).alias(f"hot_{c}") for c in labels.columns]
    both = rows.join(hot.select(*named), F.col("digest") == F.col("hot_digest"), "left")
    columns = [c for c in labels.columns if c != "digest"]
    first = both.where("hot_digest is not null").select(*rows.columns, *[F.col(f"hot_{c}").alias(c) for c in columns])
    rest = both.where("hot_digest is null").select(*rows.columns).join(labels.where(F.col("size") * HOT <= total), "digest").select(*rows.columns, *columns)
    return first.unionByName(rest)


def deduplicate(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, digest) per document, dropped ones too.

    Texts are equal if identical after each run of space and \\x09-\\x0D is replaced by one space; null counts as empty. Of
    equal texts the row with the smallest doc_id is kept, null last; of rows that share it, too, one. The half of
    the rows with the smaller doc_ids is the history, whose index is written to ``path`` (default: the shared folder, until
    the program ends); the others are looked up there. keep_id is null where no row of the group has a doc_id. Empty texts are
    one group; very long ones are taken whole; repeated rows give a row each. Further columns, of whatever name, play no part.
    No documents: no rows.
    """
    spark = docs.sparkSession
    rows = materialize(digests(docs), "digests")
    total, half = rows.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", 0.5)).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(half), F.lit(False))
    if path is None:
        path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
        atexit.register(remove, spark, path)
    index = build(grouped(rows.where(old)), path, total)
    found = look_up(index, grouped(rows.where(~old)), with_rest=True)
    labels = materialize(found.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), (F.col("n_history") + F.col("n_new")).alias("size")), "groups")
    out = with_labels(rows, labels, total)
    return out.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def write_history(docs: DataFrame, path: str) -> Index:
    """Writes the index of all texts of ``docs`` under ``path``, for ``new_documents``."""
    return build(materialize(grouped(digests(docs)), "groups"), path)


def new_documents(docs: DataFrame, index: Index) -> DataFrame:
    """The documents whose text the history has not, one row of each: that of the smallest doc_id, null last.

    What the history has goes, whatever its doc_id. Columns stay as they are.
    """
    row, doc_id = free_name(docs, "row"), F.col("doc_id").cast("long")
    held = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    rows = held.select(doc_id.alias("doc_id"), F.col(row).alias("row"), F.unhex(F.sha2(flat(F.col("text")), 256)).alias("digest"))
    entries = materialize(grouped(rows), "groups")
    winners = look_up(index, entries).where("not member").select(F.col("row").alias(row))
    return held.join(winners, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
