"""Keyed state over streams with timers: a rate limiter whose idle keys leave the state, and orders that move by checked steps.

State lies in RocksDB. A batch holds at most ``BATCH`` bytes of files, which bounds what a single key can bring at once; in a batch a key's
requests are taken in order of time, and a request that comes in a later batch does not undo what was decided before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldwright.operators.timing import TRANSITIONS
from fieldwright.streaming.common import file_stream, remove, scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH = str(256 << 20)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """A key's rows of a batch in order of time and id, nulls last. Plain lists, as a key's few rows would pay for each step over a frame."""
    rows = [r for f in frames for r in zip(*[[None if v is None or v != v else v for v in f[c].tolist()] for c in columns])]
    keys = [columns.index(c) for c in ("micros", "id")]
    rows.sort(key=lambda r: [(r[k] is None, r[k] or 0) for k in keys])
    return rows


class Limiter(StatefulProcessor):
    """Up to ``most`` requests in a window that the first one opens; the first after its end opens the next."""

    def __init__(self, most: int, seconds: int) -> None:
        self.most, self.length = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, count long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        start, count = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for id_, micros in in_order(rows, ["id", "micros"]):
            if start is None or micros - start > self.length:
                start, count = micros, 0
            count += 1
            out.append((key[0], id_, count, count <= self.most, max(0, self.most - count), start + self.length))
        self.window.update((start, count))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((start + 2 * self.length) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "id", "place", "allowed", "remaining", "reset_micros"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """A key that was idle for a window after its own leaves the state."""
        self.window.clear()
        yield from ()

    def close(self) -> None:
        pass


LIMITED = "key long, id long, place long, allowed boolean, remaining long, reset_micros long"


def limited(requests: DataFrame, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Requests (key, id, at) of a stream with place, allowed, remaining and reset_micros; those ``late`` behind the newest one of the batches before are left out, as their window is gone."""
    timed = requests.withWatermark("at", late).select("key", "id", "at", F.unix_micros("at").alias("micros"))
    return timed.groupBy("key").transformWithStateInPandas(Limiter(most, seconds), LIMITED, "Append", "EventTime")


ALLOWED = set(TRANSITIONS)
#: What each kind of order step needs, in the order in which it is tested.
OUTCOMES = ("actor_required", "exists_already", "not_found", "state_conflict", "version_conflict", "invalid_transition", "applied")


def transition(state: tuple | None, micros: int, actor: str | None, expected_status: str | None, expected_version: int | None, to_status: str) -> tuple[tuple | None, str]:
    """The order's state (status, version, paid, completed) after a step, and its outcome. A refused step leaves the state as it is.

    A step to ``created`` makes the order, queued and of version 1. Others must name the status and the version that the order has, unless they are null.
    """
    if actor is None or not actor.strip():
        return state, "actor_required"
    if to_status == "created":
        return (state, "exists_already") if state else (("queued", 1, None, None), "applied")
    if state is None:
        return state, "not_found"
    status, version, paid, completed = state
    if expected_status is not None and expected_status != status:
        return state, "state_conflict"
    if expected_version is not None and expected_version != version:
        return state, "version_conflict"
    if (status, to_status) not in ALLOWED:
        return state, "invalid_transition"
    paid = micros if to_status == "assigned" and paid is None else paid
    return (to_status, version + 1, paid, micros if to_status == "delivered" else completed), "applied"


class Orders(StatefulProcessor):
    """Steps of orders one after the other; an order keeps its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order = handle.getValueState("order", "status string, version long, paid long, completed long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, out = tuple(self.order.get()) if self.order.exists() else None, []
        for id_, micros, actor, status, version, to in in_order(rows, ["id", "micros", "actor", "expected_status", "expected_version", "to_status"]):
            before = state
            state, outcome = transition(state, micros, actor, status, version, to)
            now = state or (None, None, None, None)
            out.append((key[0], id_, micros, actor, outcome, before[0] if before else None, *now))
        if state is not None:
            self.order.update(state)
        names = ["order_id", "id", "micros", "actor", "outcome", "from_status", "status", "version", "paid", "completed"]
        yield pd.DataFrame({c: pd.array(v, dtype="Int64") if c in ("version", "paid", "completed") else list(v) for c, v in zip(names, zip(*out))})

    def close(self) -> None:
        pass


MOVED = "order_id long, id long, micros long, actor string, outcome string, from_status string, status string, version long, paid long, completed long"


def moved(steps: DataFrame) -> DataFrame:
    """Steps (order_id, id, micros, actor, expected_status, expected_version, to_status) of a stream with outcome and the order's state after it."""
    return steps.groupBy("order_id").transformWithStateInPandas(Orders(), MOVED, "Append", "None")


def run(stream: DataFrame, name: str, outputs: dict[str, Callable[[DataFrame], DataFrame]], path: str | None = None) -> str:
    """Runs a stream until its input is used up; each of ``outputs`` is a table under the folder that is returned.

    Every batch writes a part of its own number in each table, over what was there; so a batch that is repeated after a failure changes nothing. With a
    ``path`` the stream goes on from where it ended there.
    """
    spark = stream.sparkSession
    own = path is None
    path = path or scratch(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        for table, of in outputs.items():
            of(rows).write.mode("overwrite").parquet(f"{path}/{table}/batch={batch}")
        rows.unpersist()

    with rocks(spark):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    if own:
        remove(spark, f"{path}/checkpoint")
    return path


def newest(rows: DataFrame) -> DataFrame:
    """Of a batch's steps the last state of each order that they moved."""
    moved_ = rows.where("outcome = 'applied'")
    return moved_.groupBy("order_id").agg(F.max_by(F.struct("status", "paid", "completed"), "version").alias("s"), F.max("version").alias("version")).select("order_id", "s.status", "version", "s.paid", "s.completed")


def order_tables(steps: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as they are now (order_id, status, version, paid, completed), the log of all steps that moved one (order_id, from_status, status, version, actor, micros, id), and all outcomes (order_id, id, outcome)."""
    spark = steps.sparkSession
    log = lambda rows: rows.where("outcome = 'applied'").select("order_id", "from_status", "status", "version", "actor", "micros", "id")
    path = run(moved(steps), "orders", {"orders": newest, "log": log, "outcomes": lambda rows: rows.select("order_id", "id", "outcome")}, path)
    states = spark.read.parquet(f"{path}/orders").drop("batch")
    now = states.groupBy("order_id").agg(F.max_by(F.struct("status", "paid", "completed"), "version").alias("s"), F.max("version").alias("version")).select("order_id", "s.status", "version", "s.paid", "s.completed")
    return now, spark.read.parquet(f"{path}/log").drop("batch"), spark.read.parquet(f"{path}/outcomes").drop("batch")


def run_limiter(spark: SparkSession, path: str, most: int, seconds: int) -> DataFrame:
    """The events (event_id, user_id, ts) of a table as requests of their users."""
    events = file_stream(spark, path, maxBytesPerTrigger=BATCH)
    requests = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    out = run(limited(requests, most, seconds), "limits", {"rows": lambda rows: rows})
    return spark.read.schema(LIMITED + ", batch int").parquet(f"{out}/rows").drop("batch")
