"""Versioned facts: overrides, insert-once, editions, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwright.functions.text import content_hash


def resolved_overrides(overrides: DataFrame) -> DataFrame:
    """(doc, key): the override of the highest version; it takes effect only if confirmed, and hides older ones all the same."""
    last = overrides.groupBy("doc", "key").agg(F.max("version").alias("version"), F.max_by(F.struct("value", "confirmed"), "version").alias("o"), F.count(F.lit(1)).alias("n_versions"))
    state = F.when(~F.col("o.confirmed"), "absent").when(F.col("o.value").isNull(), "rejected").otherwise("released")
    return last.select("doc", "key", "version", "n_versions", F.when(F.col("o.confirmed"), F.col("o.value")).alias("final_value"), state.alias("final_state"))


def insert_once(arrivals: DataFrame, key: str) -> DataFrame:
    """Every arrival with inserted: it is the first of its key; arrivals have numbers of their own. Null is a key too.

    The first ones are counted out by key before anything is shuffled and joined back, so a key with most of the rows is no single task's matter.
    """
    first = arrivals.groupBy(F.col(key).alias("_key")).agg(F.min("arrival").alias("_first"))
    return arrivals.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("inserted", F.col("arrival") == F.col("_first")).drop("_key", "_first")


def next_versions(facts: DataFrame, key: str) -> DataFrame:
    """(key): one more than the highest version."""
    return facts.groupBy(key).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def editions(snapshots: DataFrame) -> DataFrame:
    """Snapshots (source, at, ordinal, hash) that begin an edition, numbered, with its end; the last is current."""
    order = Window.partitionBy("source").orderBy("at", "ordinal")
    changed = snapshots.withColumn("before", F.lag("hash").over(order)).where("before is null or before <> hash")
    return changed.withColumn("edition", F.row_number().over(order).cast("long")).withColumn("valid_until", F.lead("at").over(order)).withColumn("is_current", F.col("valid_until").isNull()).drop("before")


def changes(snapshots: DataFrame, slot: Column) -> DataFrame:
    """Snapshots (source, at, ordinal, hash) whose hash is not that of the one before, with first_seen: there is none before.

    slot is a rising function of ``at``. Rows are ordered within a slot; the last hash of a slot goes to the first row of the next
    that has rows, so one source with most of the snapshots is spread over as many tasks as it has slots.
    """
    rows = snapshots.withColumn("_slot", slot)
    ends = rows.groupBy("source", "_slot").agg(F.max_by("hash", F.struct("at", "ordinal")).alias("last"))
    carried = ends.select(F.col("source").alias("_source"), F.col("_slot").alias("_s"), F.lag("last").over(Window.partitionBy("source").orderBy("_slot")).alias("_carried"))
    before = F.lag("hash").over(Window.partitionBy("source", "_slot").orderBy("at", "ordinal"))
    out = rows.withColumn("_before", before).join(carried, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slot") == F.col("_s")))
    known = F.coalesce("_before", "_carried")
    return out.where(known.isNull() | (known != F.col("hash"))).select(*snapshots.columns, known.isNull().alias("first_seen"))


def content_groups(docs: DataFrame) -> DataFrame:
    """(hash): documents of equal normalized content, the first of them and their number."""
    return docs.groupBy(content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))


def reused_keys(facts: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys of an append-only table that were written with different payloads."""
    return facts.groupBy(key).agg(F.count_distinct(payload).alias("n_payloads")).where("n_payloads > 1")


def without_children(children: DataFrame, parents: DataFrame, key: str, prefix: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Children less those whose parent's name begins with the prefix. A prefix outside the ``allowed`` ones, if such are told, is refused."""
    if allowed is not None and not prefix.startswith(allowed):
        raise ValueError(f"rows under {prefix!r} must not be deleted")
    return children.join(parents.where(F.col("name").startswith(prefix)).select(key), key, "left_anti")
